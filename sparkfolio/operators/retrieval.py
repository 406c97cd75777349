"""Hybrid retrieval: exact vector search, routing, fusion and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text

TOP_K, THRESHOLD, RRF = 20, 0.4, 60
# Router weights (name, description, topics), least name match, least score, most documents.
NAME_WEIGHT, DESCRIPTION_WEIGHT, TOPIC_WEIGHT, LEAST_NAME, LEAST_SCORE, MOST_DOCUMENTS = 0.5, 0.35, 0.15, 0.6, 0.4, 3


def similarity(chunks: DataFrame, query: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Chunks with their cosine similarity to a one-row query vector, from the threshold on. The one row is broadcast."""
    one = query.limit(1).select(F.col("embedding").alias("_query"))
    return chunks.join(F.broadcast(one)).withColumn("similarity", F.round(numbers.cosine(F.col("embedding"), F.col("_query")), 6)).drop("_query").filter(F.col("similarity") >= threshold)


def vector_topk(chunks: DataFrame, query: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD, excluded: DataFrame | None = None) -> DataFrame:
    """The k most similar chunks, ties by chunk_id; excluded chunks leave before the limit."""
    if excluded is not None:
        chunks = chunks.join(excluded.select("chunk_id"), "chunk_id", "left_anti")
    return similarity(chunks, query, threshold).orderBy(F.desc("similarity"), "chunk_id").limit(k)


def ranked(rows: DataFrame, by: list, within: list[str], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)))


def topk_within(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most similar rows of each key; Spark limits groups before the shuffle."""
    return ranked(rows, [F.desc("similarity"), "chunk_id"], [key]).filter(F.col("rank") <= k)


def two_stage(chunks: DataFrame, query: DataFrame, nodes: int, k: int, threshold: float) -> DataFrame:
    """Chunks of the best nodes, by their node's best similarity, then their own."""
    near = similarity(chunks, query, threshold)
    best = near.groupBy("node_id").agg(F.max("similarity").alias("node_similarity")).orderBy(F.desc("node_similarity"), "node_id").limit(nodes)
    return near.join(F.broadcast(best), "node_id").orderBy(F.desc("node_similarity"), F.desc("similarity"), "chunk_id").limit(k)


def fuse(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Reciprocal-rank fusion of (path, rank, chunk_id): score, paths, and the order in which equal scores were first seen."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    order = F.create_map(*[F.lit(x) for i, p in enumerate(weights) for x in (p, i)])
    return lists.groupBy("chunk_id").agg(
        F.round(F.sum(F.element_at(weight, F.col("path")) / (RRF + F.col("rank"))), 6).alias("hybrid_score"),
        F.min(F.element_at(order, F.col("path")) * 1_000_000 + F.col("rank")).cast("long").alias("first_seen"),
        F.array_join(F.array_sort(F.collect_set("path")), ",").alias("match_types"),
    )


def round_robin(rows: DataFrame, k: int) -> DataFrame:
    """Rows of (document_id, document_order, rank, chunk_id) in turns over documents; a chunk counts where it comes first."""
    turn = ranked(rows, ["rank", "chunk_id"], ["document_id"], "turn")
    first = turn.groupBy("chunk_id").agg(F.min(F.struct("turn", "document_order", "document_id")).alias("at"))
    return first.select("chunk_id", "at.*").orderBy("turn", "document_order", "chunk_id").limit(k)


def unit_cap(rows: DataFrame, k: int) -> DataFrame:
    """Anchors (is_anchor) all stay; supplements fill what their distinct units leave of k, best first."""
    units = rows.filter("is_anchor").agg(F.countDistinct("retrieval_unit_id").alias("units"))
    extra = rows.filter("NOT is_anchor").orderBy(F.desc("hybrid_score"), "chunk_id").limit(k)  # at most k rows number in one task
    extra = extra.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hybrid_score"), "chunk_id"))).join(F.broadcast(units)).filter(F.col("place") <= F.greatest(F.lit(0), F.lit(k) - F.col("units"))).drop("place", "units")
    return rows.filter("is_anchor").unionByName(extra)


def route(candidates: DataFrame, question: str) -> DataFrame:
    """Scores of (document_id, title, filename, topics, description_similarity) and the selection: named documents, then confident ones, at most three; all if none is."""
    q = F.lit(question)
    name = F.greatest(text.name_match(q, F.col("title")), text.name_match(q, F.col("filename")))
    held = lambda c: (text.normalize_text(F.col(c)) != "") & F.contains(text.normalize_text(q), text.normalize_text(F.col(c)))
    topic = F.coalesce(F.array_max(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: text.overlap(text.meaningful_words(t), text.meaningful_words(q)))), F.lit(0.0))
    rows = candidates.withColumn("name_score", name).withColumn("exact_name", held("title") | held("filename")).withColumn("topic_score", topic).withColumn("description_score", F.greatest(F.lit(0.0), F.coalesce("description_similarity", F.lit(0.0))))
    named = F.when(F.col("exact_name") | (F.col("name_score") >= LEAST_NAME), NAME_WEIGHT).otherwise(0.0)
    score = (named * F.col("name_score") + DESCRIPTION_WEIGHT * F.col("description_score") + TOPIC_WEIGHT * F.col("topic_score")) / (named + DESCRIPTION_WEIGHT + TOPIC_WEIGHT)
    rows = rows.withColumn("combined_score", F.round(score, 6))
    confident = rows.filter(F.col("exact_name") | (F.col("combined_score") >= LEAST_SCORE)).orderBy(F.desc("exact_name"), F.desc("combined_score"), "document_id").limit(MOST_DOCUMENTS)
    chosen = confident.select("document_id", F.lit(True).alias("chosen"))
    any_ = confident.agg((F.count("*") > 0).alias("any"))
    return rows.join(F.broadcast(chosen), "document_id", "left").join(F.broadcast(any_)).select("document_id", F.round("name_score", 6).alias("name_score"), "exact_name", F.round("topic_score", 6).alias("topic_score"), "combined_score", (F.coalesce("chosen", F.lit(False)) | ~F.col("any")).alias("selected"))


def identifier_anchor(nodes: DataFrame, question: str) -> DataFrame:
    """Of nodes (node_type, identifier, node_id, similarity) that a question names, the best for each kind and identifier."""
    named = nodes.filter(text.names_phrase(F.lit(question), F.col("node_type"), F.col("identifier")))
    return ranked(named, [F.desc("similarity"), "node_id"], ["node_type", "identifier"]).filter("rank = 1").drop("rank")


def first_wins(rows: DataFrame, key: list, by: list) -> DataFrame:
    """The first row of each key."""
    return ranked(rows, by, key, "_n").filter("_n = 1").drop("_n")
