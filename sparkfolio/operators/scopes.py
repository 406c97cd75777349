"""Scopes of nodes over pages: text from a node's opening to the next one's, chunks of them, and their checks.

Nodes: document_id, node_id, node_type, identifier, title, start_page, start_character (from 0). Pages: document_id, page_number, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def filled(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) != ""


def has_anchor(title: str = "title", identifier: str = "identifier") -> Column:
    return filled(F.col(title)) | filled(F.col(identifier))


def anchored(nodes: DataFrame) -> DataFrame:
    """Nodes but tables that have a title or an identifier."""
    return nodes.filter((F.upper("node_type") != "TABLE") & has_anchor())


def scope_bounds(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Anchored nodes with a full position and end_page, end_character (exclusive): where the next one starts, or the document ends."""
    last = pages.groupBy("document_id").agg(F.max(F.struct("page_number", F.char_length("text").alias("n"))).alias("last"))
    held = anchored(nodes).filter("start_page IS NOT NULL AND start_character IS NOT NULL").join(last, "document_id")
    after = F.lead(F.struct("start_page", "start_character")).over(Window.partitionBy("document_id").orderBy("start_page", "start_character", "node_id"))
    return held.withColumn("after", after).select(*nodes.columns, F.coalesce("after.start_page", "last.page_number").alias("end_page"), F.coalesce("after.start_character", "last.n").alias("end_character"))


def scope_errors(bounds: DataFrame) -> DataFrame:
    """Scopes that end where they start or before."""
    return bounds.filter("(end_page, end_character) <= (start_page, start_character)")


def scope_texts(bounds: DataFrame, pages: DataFrame) -> DataFrame:
    """The scopes with their text: pages between the bounds, joined by line ends. Joined by document and page, so a page's text moves once for each scope on it."""
    own = bounds.filter("(end_page, end_character) > (start_page, start_character)").withColumn("page_number", F.explode(F.sequence("start_page", "end_page")))
    first = F.when(F.col("page_number") == F.col("start_page"), F.col("start_character")).otherwise(0)
    stop = F.when(F.col("page_number") == F.col("end_page"), F.col("end_character")).otherwise(F.char_length("text"))
    part = F.substring("text", first + 1, F.greatest(F.lit(0), stop - first))
    rows = own.join(pages, ["document_id", "page_number"]).withColumn("part", F.struct("page_number", part.alias("text")))
    joined = rows.groupBy("document_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "\n").alias("text"))
    return bounds.join(joined, ["document_id", "node_id"])


def anchor_text() -> Column:
    return F.concat_ws(" ", F.when(filled(F.col("identifier")), F.trim("identifier")), F.when(filled(F.col("title")), F.trim("title")))


def scope_chunks(scopes: DataFrame) -> DataFrame:
    """document_id, node_id, chunk_number (from 1 in a document), page_number, page_numbers of scopes that hold more than their title; an end page of which nothing is used is left out."""
    last = F.when(F.col("end_character") > 0, F.col("end_page")).otherwise(F.greatest("start_page", F.col("end_page") - 1))
    kept = scopes.filter(F.lower(text.collapse(F.col("text"))) != F.lower(text.collapse(anchor_text())))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("start_page", "start_character", "node_id"))
    return kept.select("document_id", "node_id", number.alias("chunk_number"), F.col("start_page").alias("page_number"), F.sequence("start_page", last).alias("page_numbers"), "text")


def scope_problems(scopes: DataFrame) -> DataFrame:
    """document_id, node_id, problem: empty text, text that doesn't begin with the anchor, an end that isn't the next start."""
    w = Window.partitionBy("document_id").orderBy("start_page", "start_character", "node_id")
    after = F.lead(F.struct(F.col("start_page").alias("p"), F.col("start_character").alias("c"))).over(w)
    rows = scopes.withColumn("after", after)
    found = F.array_compact(
        F.array(
            F.when(F.trim("text") == "", "empty"),
            F.when(~F.startswith(text.compact(F.col("text")), text.compact(anchor_text())), "anchor_mismatch"),
            F.when(F.col("after").isNotNull() & ((F.col("after.p") != F.col("end_page")) | (F.col("after.c") != F.col("end_character"))), "boundary"),
        )
    )
    return rows.select("document_id", "node_id", F.explode(found).alias("problem"))


def mapping_problems(nodes: DataFrame) -> DataFrame:
    """node_id and problem of page mappings: anchors without position, ranges that are incomplete or run backwards or leave the parent's, characters on tables or on nodes without anchor. nodes: parent_id and end_page besides."""
    parent = nodes.select(F.col("document_id"), F.col("node_id").alias("parent_id"), F.col("start_page").alias("ps"), F.col("end_page").alias("pe"))
    table = F.upper("node_type") == "TABLE"
    rows = nodes.join(parent, ["document_id", "parent_id"], "left")
    found = F.array_compact(
        F.array(
            F.when(~table & has_anchor() & (F.col("start_page").isNull() | F.col("start_character").isNull()), "missing_anchor"),
            F.when(F.col("start_page").isNull() | F.col("end_page").isNull(), "incomplete_range"),
            F.when(F.col("end_page") < F.col("start_page"), "invalid_range"),
            F.when(F.col("end_page").isNotNull() & F.col("pe").isNotNull() & ((F.col("start_page") < F.col("ps")) | (F.col("end_page") > F.col("pe"))), "parent_range"),
            F.when(table & F.col("start_character").isNotNull(), "table_character"),
            F.when(~has_anchor() & ~table & F.col("start_character").isNotNull(), "unanchored_character"),
        )
    )
    return rows.select("document_id", "node_id", F.explode(found).alias("problem"))
