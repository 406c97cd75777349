"""Chunking, deduplication, scopes, packing of context, and page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SIZE, OVERLAP = 500, 100


def token_windows(rows: DataFrame, key: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each window of tokens: every start below the token count gives one, so a tail may repeat the end of the window before."""
    if size <= overlap:
        raise ValueError("size must exceed overlap")
    split = rows.select(key, text.tokens(F.col("text")).alias("t"))
    return split.filter(F.size("t") > 0).select(key, "t", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(size - overlap))).alias("w", "start")).select(
        key, (F.col("w") + 1).alias("chunk_number"), "start", F.size(F.slice("t", F.col("start") + 1, size)).alias("token_count"), F.array_join(F.slice("t", F.col("start") + 1, size), " ").alias("text")
    )


def dedup_exact(chunks: DataFrame, key: list[str], order: str, document: str) -> DataFrame:
    """The first chunk of each key, renumbered from 1 inside its document."""
    w = Window.partitionBy(*key).orderBy(order)
    kept = chunks.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return kept.withColumn("new_number", F.row_number().over(Window.partitionBy(document).orderBy(order)))


def context_owner(rows: DataFrame, key: list[str], index: str) -> DataFrame:
    """Whose body a row shows: the longest body of its key that contains its own, then the first. Equal bodies are compared once, and only with bodies as long or longer."""
    bodies = rows.groupBy(*key, "body").agg(F.min(index).alias("_o")).withColumn("_n", F.char_length("body"))
    longer = bodies.select(*key, F.col("body").alias("_b"), F.col("_o").alias("_first"), F.col("_n").alias("_long"))
    inside = bodies.join(longer, key).filter("_long >= _n AND contains(_b, body)")
    best = inside.groupBy(*key, "body").agg(F.min(F.struct((-F.col("_long")).alias("l"), F.col("_first").alias("owner"))).alias("best"))
    return rows.join(best, [*key, "body"]).select(*key, index, F.col("best.owner").alias("owner"))


def next_boundary(scopes: DataFrame, key: str, start: list[str]) -> DataFrame:
    """A scope ends where the next one of its document starts."""
    return scopes.withColumn("end", F.lead(F.struct(*start)).over(Window.partitionBy(key).orderBy(*start)))


def order_violations(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value lies under the greatest known one before."""
    before = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("floor", before).filter(F.col(value) < F.col("floor"))


def resequenced(rows: DataFrame, parent: str, by: list[Column]) -> DataFrame:
    return rows.withColumn("new_sequence", F.row_number().over(Window.partitionBy(parent).orderBy(*by)) - 1)


def page_median(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact statistics of counts; the median is the floor of the middle."""
    return rows.groupBy(*by).agg(F.min(value).alias("low"), F.floor(F.percentile(value, 0.5)).cast("long").alias("median"), F.max(value).alias("high"), F.round(F.avg(value), 4).alias("mean"), F.sum(value).cast("long").alias("total"))


def recommend_size(pages: DataFrame) -> DataFrame:
    """Least chunk size from the median page on with under two chunks a page on average and at most a tenth of the pages over two; else the greatest page. pages: (owner, tokens). Counts of page sizes stand in for pages, so work follows the distinct sizes."""
    counts = pages.groupBy("owner", "tokens").agg(F.count("*").alias("n"))
    # median over weighted sizes
    run = F.sum("n").over(Window.partitionBy("owner").orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("owner"))
    spread = counts.withColumn("run", run).withColumn("total", total)
    middle = spread.groupBy("owner").agg(
        F.min(F.when(F.col("run") >= F.floor((F.col("total") + 1) / 2), F.col("tokens"))).alias("a"), F.min(F.when(F.col("run") >= F.floor(F.col("total") / 2) + 1, F.col("tokens"))).alias("b"), F.max("tokens").alias("high"), F.max("total").alias("total")
    )
    middle = middle.select("owner", F.greatest(F.lit(1), F.floor((F.col("a") + F.col("b")) / 2)).cast("int").alias("low"), F.greatest(F.lit(1), "high").cast("int").alias("high"), "total")
    sizes = counts.groupBy("owner").agg(F.collect_list(F.struct("tokens", "n")).alias("sizes"))

    def fits(size):
        chunks = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + F.ceil(x["tokens"] / size) * x["n"])
        many = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + F.when(x["tokens"] > 2 * size, x["n"]).otherwise(0))
        return (chunks < 2 * F.col("total")) & (many <= F.floor(F.col("total") / 10))

    # both counts fall as the size grows, so halving finds the least size that fits; the greatest page always does
    def halve(a, _):
        middle_ = F.floor((a["low"] + a["high"]) / 2).cast("int")
        fit = fits(middle_)
        return F.struct(F.when(fit, a["low"]).otherwise(F.least(a["high"], middle_ + 1)).alias("low"), F.when(fit, middle_).otherwise(a["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct("low", "high"), halve, lambda a: a["high"])
    return middle.join(sizes, "owner").select("owner", found.alias("size"))


def routine_lines(pages: DataFrame, least: int = 3) -> DataFrame:
    """Signatures of lines that stand on at least so many pages of a document."""
    return pages.filter(F.trim("text") != "").groupBy("owner", text.line_signature(F.col("text")).alias("signature")).agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least)


def fingerprint(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """MD5 of a group's rows in any order."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.groupBy(*key).agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")).alias("fingerprint"), F.count("*").alias("n"))


def multiset_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more often on one side: missing (only in a) and extra (only in b) counts."""
    n = lambda t, name: t.groupBy(*key).agg(F.count("*").alias(name))
    both = n(a, "x").join(n(b, "y"), key, "full").na.fill(0, ["x", "y"])
    return both.filter("x <> y").select(*key, F.greatest(F.lit(0).cast("long"), F.col("x") - F.col("y")).alias("missing"), F.greatest(F.lit(0).cast("long"), F.col("y") - F.col("x")).alias("extra"))


def context_labels(rows: DataFrame, request: str, index: str, document: str, path: str) -> DataFrame:
    """Labels of evidence in first-seen order of a request: E of the row, D of its document, H of its path inside the document (null without a path) and parent, the H one level up."""
    first = rows.groupBy(request, document).agg(F.min(index).alias("_i"))
    docs = first.select(request, document, F.concat(F.lit("D"), F.row_number().over(Window.partitionBy(request).orderBy("_i"))).alias("document_label"))
    prefixes = rows.filter(F.size(path) > 0).select(request, index, document, F.col(path).alias("_p"), F.explode(F.sequence(F.lit(1), F.size(path))).alias("_d")).withColumn("_p", F.slice("_p", F.lit(1), F.col("_d")))
    seen = prefixes.groupBy(request, document, "_p").agg(F.min(F.struct(index, "_d")).alias("_i"))
    label = seen.select(request, document, "_p", F.concat(F.lit("H"), F.row_number().over(Window.partitionBy(request).orderBy("_i"))).alias("hierarchy"))
    evidence = F.concat(F.lit("E"), F.row_number().over(Window.partitionBy(request).orderBy(index))).alias("evidence")
    out = rows.select(request, index, document, F.col(path).alias("_p"), evidence).withColumn("_up", F.when(F.size("_p") > 1, F.slice("_p", F.lit(1), F.greatest(F.lit(0), F.size("_p") - 1))))
    up = label.select(request, document, F.col("_p").alias("_up"), F.col("hierarchy").alias("parent"))
    return out.join(docs, [request, document]).join(label, [request, document, "_p"], "left").join(up, [request, document, "_up"], "left").select(request, index, "evidence", "document_label", "hierarchy", "parent")


def chunk_problems(chunks: DataFrame, nodes: DataFrame, document: str, order: list[str], number: str, page: str, node: str) -> DataFrame:
    """Per document: chunks whose node isn't known, whether numbers run 1, 2, … in order, and whether pages never go back."""
    w = Window.partitionBy(document).orderBy(*order)
    rows = chunks.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(page).over(w)).join(nodes.select(F.col(node)).distinct().withColumn("_known", F.lit(True)), node, "left")
    return rows.groupBy(document).agg(F.count(F.when(F.col("_known").isNull(), 1)).alias("invalid_nodes"), F.every(F.col(number) == F.col("_n")).alias("sequential"), F.every(F.coalesce(F.col("_before") <= F.col(page), F.lit(True))).alias("pages_in_order"))
