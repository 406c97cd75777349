"""Readers and adapters: tables by name, the owner filter, and the retrieval shapes that the driver's tables stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def owned(rows: DataFrame, owner: object | None, column: str = "owner_id") -> DataFrame:
    """Rows of one tenant; None reads all tenants and is for maintenance jobs only."""
    return rows if owner is None else rows.filter(F.col(column) == F.lit(owner))


def between(rows: DataFrame, column: str, start: object, end: object) -> DataFrame:
    """Rows in the half-open range [start, end)."""
    return rows.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def doc_pages(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, page_number (from 1), text: a page for each line."""
    docs = read(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("document_id", (F.col("p") + 1).alias("page_number"), "text")


def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, document_id, owner_id, node_id, embedding, text. Vectors are the smaller side and join on the key, no broadcast is forced."""
    vectors = read(spark, folder, "embeddings")
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("owner_id"), "text")
    return vectors.join(docs, F.col("vec_id") == F.col("document_id")).select(F.col("vec_id").alias("chunk_id"), "document_id", "owner_id", F.col("label").alias("node_id"), "embedding", "text")


def tree_nodes(spark: SparkSession, folder: str, orders: bool = False) -> DataFrame:
    """node_id, parent_id, depth, sequence_no, title: region, nation, customer and, on demand, orders."""
    r = read(spark, folder, "region").selectExpr("concat('r', r_regionkey) AS node_id", "CAST(NULL AS STRING) AS parent_id", "0 AS depth", "CAST(r_regionkey AS BIGINT) AS k", "r_name AS title")
    n = read(spark, folder, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "1", "CAST(n_nationkey AS BIGINT)", "n_name")
    c = read(spark, folder, "customer").selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)", "2", "c_custkey", "c_name")
    rows = r.union(n).union(c)
    if orders:
        rows = rows.union(read(spark, folder, "orders").selectExpr("concat('o', o_orderkey)", "concat('c', o_custkey)", "3", "o_orderkey", "o_orderpriority"))
    from pyspark.sql import Window

    return rows.withColumn("sequence_no", F.row_number().over(Window.partitionBy("parent_id").orderBy("k")) - 1).drop("k")


def usage_events(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, activity, cost, ts."""
    return read(spark, folder, "events").select("event_id", "user_id", F.col("event_type").alias("activity"), F.col("value").cast("decimal(20,10)").alias("cost"), F.col("ts").cast("timestamp").alias("ts"))


def periods(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, period_id, period_start, period_end (a calendar month later)."""
    return read(spark, folder, "orders").selectExpr("o_custkey AS user_id", "o_orderkey AS period_id", "CAST(o_orderdate AS TIMESTAMP) AS period_start", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MONTH AS period_end")


def write(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, optionally in folders by columns."""
    (rows.write.mode(mode).partitionBy(*by) if by else rows.write.mode(mode)).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
