"""Bounded repair of returned hierarchies: requested corrections and insertions, taken for a document as a whole or not at all.

Nodes are (document_id, node_id, parent_id, sequence_no, node_type, identifier, title, start_page); children are numbered from 0.
failures: (document_id, node_id) entries to correct. missing: (document_id, candidate_id, parent_id, insert_index, entry, node_type) entries that may
be inserted, entry "" for the candidate itself and "0", "0/1" for what stands below it.
corrections: (document_id, node_id, identifier, title, start_page). insertions: (document_id, candidate_id, entry, node_type, identifier, title, start_page), entry null
where the answer is that there is none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .references import entry_key
from .trees import cut

ITEM, CANDIDATE = ["document_id", "node_id"], ["document_id", "candidate_id"]
FIELDS = ["identifier", "title", "start_page"]


def keep_supported(corrections: DataFrame, nodes: DataFrame, supported: DataFrame) -> DataFrame:
    """The corrections, but a title that one blanks stays if the text supports it (supported: document_id, node_id)."""
    old = nodes.select(*ITEM, F.col("title").alias("_old")).join(supported.select(*ITEM).distinct(), ITEM, "left_semi")
    return corrections.join(old, ITEM, "left").withColumn("title", F.when((F.col("title") == "") & (F.coalesce("_old", F.lit("")) != ""), F.col("_old")).otherwise(F.col("title"))).select(corrections.columns)


def _corrected(nodes: DataFrame, corrections: DataFrame) -> DataFrame:
    new = corrections.select(*ITEM, *(F.col(c).alias(f"_{c}") for c in FIELDS), F.lit(True).alias("_new"))
    return nodes.join(new, ITEM, "left").withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in FIELDS}).select(nodes.columns)


def problems(nodes: DataFrame, failures: DataFrame, missing: DataFrame, corrections: DataFrame, insertions: DataFrame) -> DataFrame:
    """document_id, problem: why a document's answer is refused."""
    told = lambda rows, name: rows.select("document_id", F.lit(name).alias("problem"))
    # the same entries, of the same kinds, as the candidate has
    shape = lambda t: t.filter("entry IS NOT NULL").select(*CANDIDATE, "entry", F.col("node_type"))
    given = shape(insertions)
    wanted = shape(missing).join(given.select(*CANDIDATE).distinct(), CANDIDATE, "left_semi")
    # an inserted entry that equals a child of its parent, as corrected, or another one inserted there
    ident, title = entry_key()
    keyed = lambda t, own: t.select("document_id", "parent_id", "node_type", ident.alias("i"), title.alias("t"), (F.coalesce("identifier", F.lit("")) != "").alias("h"), own.alias("own"))
    roots = insertions.filter("entry = ''").join(missing.filter("entry = ''").select(*CANDIDATE, "parent_id", "insert_index"), CANDIDATE)
    new, old = keyed(roots, F.col("candidate_id")), keyed(_corrected(nodes, corrections), F.lit(None).cast("string"))
    a, b = new.alias("a"), old.unionByName(new).alias("b")
    same = "a.document_id = b.document_id AND a.parent_id = b.parent_id AND a.node_type = b.node_type AND (b.own IS NULL OR a.own < b.own) AND CASE WHEN a.h AND b.h THEN a.i = b.i ELSE a.t = b.t END"
    found = [
        told(corrections.join(failures, ITEM, "left_anti"), "unexpected_correction"),
        told(corrections.groupBy(*ITEM).count().filter("count > 1"), "repeated_correction"),
        told(failures.join(corrections, ITEM, "left_anti"), "no_correction"),
        told(corrections.filter("identifier IS NULL OR title IS NULL OR start_page < 1"), "correction_fields"),
        told(insertions.join(missing, CANDIDATE, "left_anti"), "unexpected_insertion"),
        told(insertions.groupBy(*CANDIDATE, F.coalesce("entry", F.lit("")).alias("entry")).count().filter("count > 1"), "repeated_insertion"),
        told(missing.join(insertions, CANDIDATE, "left_anti"), "no_decision"),
        told(insertions.filter("entry IS NOT NULL AND (identifier IS NULL OR title IS NULL OR start_page IS NULL OR start_page < 1)"), "insertion_fields"),
        told(given.join(missing.select(*CANDIDATE).distinct(), CANDIDATE, "left_semi").exceptAll(wanted).unionByName(wanted.exceptAll(given)), "insertion_shape"),
        told(a.join(b, F.expr(same)).select("a.document_id"), "insertion_exists"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def applied(nodes: DataFrame, failures: DataFrame, missing: DataFrame, corrections: DataFrame, insertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, with their answers where a document's is sound and as they were elsewhere, and the problems of the others. Insertions stand before the child that has their index, in order of candidate_id."""
    wrong = cut(problems(nodes, failures, missing, corrections, insertions))
    sound = lambda t: t.join(wrong, "document_id", "left_anti")
    rows = _corrected(nodes, sound(corrections))
    places = missing.filter("entry = ''").select(*CANDIDATE, "parent_id", "insert_index")
    name = lambda entry: F.concat_ws(":", "document_id", F.lit("new"), "candidate_id", entry)
    new = sound(insertions).filter("entry IS NOT NULL").join(places, CANDIDATE)
    top = F.col("entry") == ""
    inner = F.when(F.contains(F.col("entry"), F.lit("/")), F.regexp_replace("entry", "/[^/]*$", "")).otherwise(F.lit(""))
    new = new.select(
        "document_id", name(F.col("entry")).alias("node_id"), F.when(top, F.col("parent_id")).otherwise(name(inner)).alias("parent_id"), F.when(top, F.col("insert_index")).otherwise(F.regexp_extract("entry", "[0-9]*$", 0).try_cast("int")).alias("sequence_no"),
        "node_type", *FIELDS, F.when(top, F.col("candidate_id")).alias("_candidate"),
    )
    grown = new.filter("_candidate IS NOT NULL").select("document_id", "parent_id").distinct().withColumn("_grown", F.lit(True))
    both = rows.select(*new.columns[:-1], F.lit(None).cast("string").alias("_candidate")).unionByName(new).join(grown, ["document_id", "parent_id"], "left")
    place = F.row_number().over(Window.partitionBy("document_id", "parent_id").orderBy("sequence_no", F.asc_nulls_last("_candidate"))) - 1
    return both.withColumn("_place", place).withColumn("sequence_no", F.when(F.col("_grown"), F.col("_place")).otherwise(F.col("sequence_no"))).select(*new.columns[:-1]), wrong


def repaired(nodes: DataFrame, validate: Callable[[DataFrame], tuple[DataFrame, DataFrame]], request: Callable[[DataFrame, DataFrame, DataFrame, int], tuple[DataFrame, DataFrame]], attempts: int) -> tuple[DataFrame, DataFrame]:
    """The nodes after at most so many attempts, and (document_id, attempt, accepted, problem). validate gives failures and missing, request the answers to them. An answer that makes a sound entry fail, where nothing was missing, is refused. Stops when nothing fails."""
    if attempts < 0:
        raise ValueError("attempts must not be negative")
    spark = nodes.sparkSession
    history = spark.createDataFrame([], "document_id long, attempt int, accepted boolean, problem string")
    for attempt in range(1, attempts + 1):
        failures, missing = (cut(t) for t in validate(nodes))
        asked = failures.select("document_id").unionByName(missing.select("document_id")).distinct()
        if asked.isEmpty():
            break
        corrections, insertions = (cut(t) for t in request(nodes, failures, missing, attempt))
        proposed, wrong = applied(nodes, failures, missing, corrections, insertions)
        proposed = cut(proposed)
        worse = validate(proposed)[0].join(failures, ITEM, "left_anti").join(missing, "document_id", "left_anti").select("document_id", F.lit("new_failure").alias("problem")).distinct()
        refused = cut(wrong.unionByName(worse.join(wrong, "document_id", "left_anti")))
        nodes = cut(proposed.join(refused, "document_id", "left_anti").unionByName(nodes.select(*proposed.columns).join(refused, "document_id", "left_semi")))
        why = refused.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("problem")), ",").alias("problem"))
        history = history.unionByName(asked.join(why, "document_id", "left").select(F.col("document_id").cast("long").alias("document_id"), F.lit(attempt).alias("attempt"), F.col("problem").isNull().alias("accepted"), "problem"))
    return nodes, history
