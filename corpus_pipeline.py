"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Every stage takes the documents that its predecessor kept, as Parquet, and all but the last return the documents that they keep
with all columns of ``documents``. Null texts are empty; rows of null doc_id are kept by stages that work on pairs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import exact, gam, jaccard, packing, tiling
from sparkfolio.llm.common import shared, table
from sparkfolio.llm.queries import vocabulary

#: A list of dropped ids up to this length is broadcast (8 bytes each); a longer one is joined by a shuffle.
MOST_BROADCAST = 1_000_000


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't in ``dropped``."""
    dropped = shared(dropped.distinct())
    small = dropped.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(dropped) if small else dropped, "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are scored like others, rows of null or repeated doc_id each by their text; without labels every score is 0.5 and all stay. Empty table: no rows."""
    return gam.accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty), the row that stays: the longest, then the least doc_id, null last; of rows that repeat doc_id and text, one. Empty table: no rows."""
    rows = shared(exact.exact_duplicates(docs))
    if not rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        return without(docs, rows.filter("NOT kept").select("doc_id"))
    # doc_id doesn't name a row: by doc_id and text, and of rows that repeat both the longest
    sha = fresh(docs, "sha")
    out = docs.withColumn(sha, F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", ""), 256))
    keep = rows.filter("kept").select("doc_id", "text_sha256")
    out = out.join(keep, out["doc_id"].eqNullSafe(keep["doc_id"]) & (out[sha] == keep["text_sha256"]), "left_semi")
    longest = F.max_by(F.struct(*docs.columns), F.struct(F.char_length(F.coalesce("text", F.lit(""))), "text"))
    return out.groupBy(sha, F.col("doc_id")).agg(longest.alias(fresh(docs, "row"))).select(f"{fresh(docs, 'row')}.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of least doc_id; of rows that share it, the one of least text digest. Rows of null doc_id, and null and empty texts, stay. Empty table: no rows."""
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return without(docs, jaccard.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id"))
    # doc_id doesn't name a row: numbers do, and of a group the row of least doc_id, then least text digest, stays
    row = fresh(docs, "row")
    numbered = shared(docs.withColumn(row, F.monotonically_increasing_id()))
    own = numbered.filter("doc_id IS NOT NULL").select(F.col(row).alias("number"), F.col("doc_id"), F.sha2("text", 256).alias("sha"))
    linked = jaccard.near_duplicates(numbered.filter("doc_id IS NOT NULL").select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("number"), "component_id")
    members = shared(linked.join(own, "number"))
    stays = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "sha", "number")).alias("least")).select(F.col("least.number").alias("number"))
    dropped = members.select("number").join(stays, "number", "left_anti")
    return numbered.join(dropped, numbered[row] == dropped["number"], "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; every row is judged by its own text, whatever its doc_id. Null and empty texts stay; without items all stay. Empty table: no rows."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: a row for each piece of a document, with its place. Null and empty texts give the end id alone; each row is packed, repeated or of null doc_id too. Empty table: no rows."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]
#: The classifier, the tokenizer and best-fit packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = spark.sparkContext
    docs = table(spark, sf_dir, "documents")
    shared(spark.range(1))  # makes sure that there is a shared folder
    folder = f"{context.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
