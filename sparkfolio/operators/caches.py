"""Caches keyed by content, registration without repeats, batches for providers, and appends guarded by owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inputs of one request to a provider.
BATCH = 100


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def manifest_key(*fields: str) -> Column:
    """A hash of named settings in a fixed order."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def looked_up(rows: DataFrame, cache: DataFrame, model: str, version: int) -> DataFrame:
    """Rows (with text) and hit: whether the cache (model, version, text_hash, vector) holds a vector for the text under this model and version."""
    held = cache.filter((F.col("model") == model) & (F.col("version") == version) & F.col("vector").isNotNull()).groupBy("text_hash").agg(F.first("vector").alias("vector"))
    return rows.withColumn("text_hash", text_key(F.col("text"))).join(held, "text_hash", "left").withColumn("hit", F.col("vector").isNotNull())


def batches(rows: DataFrame, within: str, order: str, size: int = BATCH) -> DataFrame:
    """Rows with batch (from 1) and place (from 0) in it, counted inside ``within``."""
    number = F.row_number().over(Window.partitionBy(within).orderBy(order)) - 1
    return rows.withColumn("number", number).withColumn("batch", F.floor(F.col("number") / size).cast("int") + 1).withColumn("place", F.col("number") % size).drop("number")


def in_order(answers: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Answers (key, place, vector) joined to the rows that asked, by place; answers without a row are dropped, rows without an answer keep null."""
    return rows.join(answers, [*key, "place"], "left")


def unregistered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The first row of each owner and file hash that isn't known."""
    first = rows.groupBy("owner_id", "file_hash").agg(F.min("document_id").alias("document_id"))
    return first.join(known, ["owner_id", "file_hash"], "left_anti")


def owned_append(table: DataFrame, rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Append rows whose parent exists and belongs to the row's owner."""
    return table.unionByName(rows.join(parents.select(key, "owner_id").distinct(), [key, "owner_id"], "left_semi").select(table.columns))


def merged(lists: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each key; each column's value is the first that isn't null in the lists' order."""
    value = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return lists.groupBy(key).agg(*(value(c) for c in columns))
