"""Tables that go on over pages: evidence for each pair of fragments, clear gaps, rows of merged tables, and the nodes that tables belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import grids

# The page's upper and lower share that counts as margin, pages from which a margin's line is routine, signals that a headerless pair needs, rows that a header has at most, slack of a line inside a region.
MARGIN, ROUTINE_PAGES, SUPPORT, HEADER_ROWS, SLACK = 0.12, 3, 3, 3, 0.5
# Kinds of nodes that may own a table themselves.
OWNERS = ["SCHEDULE", "HEADING"]
# Groups of phrases of a front page's records, pages that are looked at, groups that such a page holds at least.
FRONT_MATTER = [["first enacted", "originally enacted"], ["revised", "revision"], ["latest amendment", "last amended"], ["previous reprint", "reprint"], ["date of publication", "published on"], ["date of commencement", "commencement date"]]
FRONT_PAGES, FRONT_GROUPS = 12, 3
KEY = ["document_id", "page", "table_number"]


def page_lines(words: DataFrame) -> DataFrame:
    """document_id, page, line, line_top, line_bottom, boxes, signature and number (a number alone) of the lines of words (document_id, page, x0, top, bottom, text)."""
    p = words.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "bottom", "text"))).alias("words"))
    w = p.select("document_id", "page", F.explode(F.arrays_zip(grids.lines_of_words(F.col("words.top")).alias("line"), F.col("words").alias("word"))).alias("w")).select("document_id", "page", "w.line", "w.word.*")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "top", "text"))), lambda x: x["text"]), " ")
    lines = w.groupBy("document_id", "page", "line").agg(F.min("top").alias("line_top"), F.max("bottom").alias("line_bottom"), F.collect_list(F.struct("top", "bottom")).alias("boxes"), told.alias("told"))
    return lines.withColumns({"signature": text.line_signature(F.col("told")), "number": F.regexp_like(F.trim("told"), F.lit("^[0-9]+$"))}).drop("told")


def blocked(regions: DataFrame, words: DataFrame, heights: DataFrame, images: DataFrame) -> DataFrame:
    """region_id of regions (document_id, region_id, page, top, bottom) that hold a line other than a page number or routine line in a margin, or an image (document_id, page, top, bottom), or whose page (document_id, page, height) isn't known."""
    at = ["document_id", "page"]
    margin = (F.col("line_bottom") <= F.col("height") * MARGIN) | (F.col("line_top") >= F.col("height") * (1 - MARGIN))
    lines = page_lines(words).join(heights, at).withColumn("margin", margin)
    routine = lines.filter("margin").groupBy("document_id", "signature").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= ROUTINE_PAGES).select("document_id", "signature", F.lit(True).alias("routine"))
    loose = lines.join(routine, ["document_id", "signature"], "left").filter(~(F.col("margin") & (F.col("number") | F.coalesce("routine", F.lit(False))))).select(*at, "boxes")
    inside = F.exists("boxes", lambda b: (b["bottom"] > F.col("top") + SLACK) & (b["top"] < F.col("bottom") - SLACK))
    pictures = images.select(*at, F.col("top").alias("_top"), F.col("bottom").alias("_bottom"))
    hits = [
        regions.join(loose, at).filter(inside),
        regions.join(pictures, at).filter("_bottom > top AND _top < bottom"),
        regions.join(heights, at, "left_anti"),
    ]
    return hits[0].select("region_id").unionByName(hits[1].select("region_id")).unionByName(hits[2].select("region_id")).distinct()


def _shown(rows: Column) -> Column:
    """Rows of non-blank values, white space collapsed, in lower case; rows without any left out."""
    values = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.filter(F.transform(r, lambda v: F.lower(text.collapse(F.coalesce(v, F.lit(""))))), lambda v: v != ""))
    return F.filter(values, lambda r: F.size(r) > 0)


def decided(fragments: DataFrame, words: DataFrame | None = None, heights: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """For each fragment whether it goes on from the one before it in its document.

    Fragments are (document_id, page, table_number, column_count, x0, y0, x1, y1, page_width, page_height, boxes, rows). Four conditions are
    mandatory: the next page, its first table after the last one, a start near the top and an end near the bottom. Then a repeated
    header suffices, and without one a compatible row and three signals in all. A pair that fails only at the bottom merges if header,
    columns and edges agree and words, heights and images, if given, show that nothing lies between. Results: logical (number of
    the table), merges, support, reasons (comma-joined), warning (mandatory conditions met, not merged). Null sides and
    empty geometry satisfy no condition. Empty table: no rows.
    """
    boxes = F.filter(F.coalesce("boxes", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")), lambda b: b.isNotNull())
    f = grids.with_spans(fragments.withColumn("b", boxes))
    f = f.withColumns({"edges": F.transform("xs", lambda x: x / F.col("page_width")), "wide": (F.col("x1") - F.col("x0")) / F.col("page_width"), "shown": F.slice(_shown(F.col("rows")), 1, HEADER_ROWS)})
    f = f.withColumn("final", F.max("table_number").over(Window.partitionBy("document_id", "page")))
    facts = F.struct("page", "table_number", "final", "column_count", "edges", "spans", "wide", "shown", "y1", "page_height")
    w = Window.partitionBy("document_id").orderBy("page", "table_number")
    f = f.withColumn("was", F.lag(facts).over(w))
    was = lambda c: F.col(f"was.{c}")
    header = (F.size("shown") > 0) & (F.size(was("shown")) > 0) & (F.get("shown", F.lit(0)) == F.get(was("shown"), F.lit(0)))
    signals = {
        "consecutive": F.col("page") == was("page") + 1,
        "order": (was("table_number") == was("final")) & (F.col("table_number") == 1),
        "columns": F.col("column_count") == was("column_count"),
        "edges": grids.aligned(was("edges"), F.col("edges")),
        "bottom": was("y1") / was("page_height") >= grids.LOW_EDGE,
        "top": F.col("y0") / F.col("page_height") <= grids.HIGH_EDGE,
        "row": grids.rows_compatible(was("spans"), F.col("spans")),
        "width": F.abs(was("wide") - F.col("wide")) <= grids.TOLERANCE,
        "header": header,
    }
    f = f.withColumns({f"has_{k}": F.col("was").isNotNull() & F.coalesce(v, F.lit(False)) for k, v in signals.items()})
    has = {k: F.col(f"has_{k}") for k in signals}
    headerless = ~has["header"] & has["row"]
    support = sum((has[k].cast("int") for k in ("columns", "edges", "row", "width", "header")), F.lit(0))
    mandatory = has["consecutive"] & has["order"] & has["bottom"] & has["top"]
    f = f.withColumns({"support": support, "mandatory": mandatory, "headerless": headerless})
    f = f.withColumn("sure", F.col("mandatory") & (has["header"] | (F.col("headerless") & (F.col("support") >= SUPPORT))))
    guarded = ~F.col("sure") & ~has["bottom"] & has["consecutive"] & has["order"] & has["top"] & has["header"] & has["columns"] & has["edges"]
    if words is None:
        f = f.withColumn("cleared", F.lit(False))
    else:
        pairs = f.filter(guarded).withColumn("region_id", F.concat_ws(":", *KEY))
        first = pairs.select("document_id", "region_id", was("page").alias("page"), was("y1").alias("top")).join(heights, ["document_id", "page"], "left").select("document_id", "region_id", "page", "top", F.col("height").alias("bottom"))
        regions = first.unionByName(pairs.select("document_id", "region_id", "page", F.lit(0.0).alias("top"), F.col("y0").alias("bottom")))
        cleared = pairs.join(blocked(regions, words, heights, images), "region_id", "left_anti").select(*KEY, F.lit(True).alias("cleared"))
        f = f.join(cleared, KEY, "left").withColumn("cleared", F.coalesce("cleared", F.lit(False)))
    reasons = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in has.items()), F.when(F.col("headerless"), F.lit("headerless")), F.when(F.col("cleared"), F.lit("clear_gap"))))
    f = f.withColumn("merges", F.col("sure") | F.col("cleared"))
    f = f.withColumn("logical", F.sum(F.when(F.col("merges"), 0).otherwise(1)).over(w).cast("int"))
    return f.select(*KEY, "logical", "merges", "support", F.array_join(reasons, ",").alias("reasons"), (F.col("mandatory") & ~F.col("merges")).alias("warning"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """Cells (document_id, logical, page, table_number, row_start, row_end, column_start, column_end, value) of merged tables with rows numbered on over their fragments.

    Leading rows (three at most) of a later fragment that stand, with the same values and columns, among the first fragment's first three are
    left out: the longest such run. A cell that spans out of them stays. Empty table: no rows.
    """
    table = ["document_id", "logical"]
    one = F.struct("row_start", "column_start", "column_end", F.lower("value").alias("value"))
    f = cells.groupBy(*table, "page", "table_number").agg(F.max("row_end").alias("height"), F.collect_list(F.when(F.col("row_start") <= HEADER_ROWS, one)).alias("top"))
    row = lambda r: F.array_sort(F.transform(F.filter("top", lambda c: c["row_start"] == r), lambda c: F.struct(c["column_start"].alias("a"), c["column_end"].alias("b"), c["value"].alias("v"))))
    f = f.withColumn("head", F.transform(F.sequence(F.lit(1), F.least(F.lit(HEADER_ROWS), F.col("height"))), row))
    w = Window.partitionBy(*table).orderBy("page", "table_number")
    f = f.withColumns({"first": F.first("head").over(w), "place": F.row_number().over(w)})

    def repeats(n):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("first") - n + 1))
        return (F.size("head") >= n) & (F.size("first") >= n) & F.exists(starts, lambda s: F.slice("first", s, n) == F.slice("head", 1, n))

    count = F.when(F.col("place") == 1, 0)
    for n in range(HEADER_ROWS, 0, -1):
        count = count.when(repeats(n), n)
    f = f.withColumn("repeated", count.otherwise(0))
    before = F.sum(F.greatest(F.lit(0), F.col("height") - F.col("repeated"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    f = f.select(*table, "page", "table_number", "repeated", (F.coalesce(before, F.lit(0)) - F.col("repeated")).cast("int").alias("shift"))
    kept = cells.join(f, [*table, "page", "table_number"]).filter(F.col("row_end") > F.col("repeated"))
    return kept.select(*table, "page", "table_number", (F.col("row_start") + F.col("shift")).alias("row_start"), (F.col("row_end") + F.col("shift")).alias("row_end"), "column_start", "column_end", "value")


def sizes(cells: DataFrame) -> DataFrame:
    """document_id, logical, row_count, column_count and pages (distinct, in order, comma-joined) of merged tables."""
    pages = F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",")
    return cells.groupBy("document_id", "logical").agg(F.max("row_end").alias("row_count"), F.max("column_end").alias("column_count"), pages.alias("pages"))


def untraced(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Cells whose value no source cell (document_id, page, table_number, value) of their fragment has."""
    return cells.join(sources, ["document_id", "page", "table_number", "value"], "left_anti")


def linked(tables: DataFrame, nodes: DataFrame) -> DataFrame:
    """document_id, number, node_id, how: the node that each table (document_id, number, start_page, end_page) belongs to.

    Nodes are (document_id, node_id, node_type, position in depth-first order, start_page, end_page). In the tables' order, each takes the one free TABLE node of its
    pages (exact); else, if as many tables as TABLE nodes begin on its page, the one of the same place (order); else the one free SCHEDULE or
    HEADING of its pages (owner); else, if there is none to choose from, a node is to be made (new). Otherwise it is ambiguous.
    Tables without pages are no_pages; if no root reaches a TABLE node of the document (null position), all are disconnected. What is free depends on the tables
    before, so a document is one group: its tables and their possible nodes, not its text.
    """
    out = "document_id long, number long, node_id string, how string"

    def run(given, known):
        from collections import defaultdict

        import pandas as pd

        inside = known[known["node_type"].str.upper() == "TABLE"].sort_values("position")
        lost = inside["position"].isna().any()
        by_range, by_start, owners = defaultdict(list), defaultdict(list), defaultdict(list)
        for n in inside.itertuples():
            by_range[n.start_page, n.end_page].append(n.node_id)
            by_start[n.start_page].append(n.node_id)
        for n in known[known["node_type"].str.upper() != "TABLE"].itertuples():
            owners[n.start_page, n.end_page].append(n.node_id)
        given = given.sort_values("number")
        turns = {}
        for page, some in given.groupby("start_page"):
            if len(some) == len(by_start[page]):
                turns |= dict(zip(some["number"], by_start[page], strict=True))
        used, rows = set(), []
        for t in given.itertuples():
            node, pages = None, (t.start_page, t.end_page)
            free = [n for n in by_range[pages] if n not in used]
            own = [n for n in owners[pages] if n not in used]
            if lost:
                how = "disconnected"
            elif t.start_page != t.start_page or t.end_page != t.end_page:
                how = "no_pages"
            elif len(free) == 1:
                node, how = free[0], "exact"
            elif turns.get(t.number, None) not in {None, *used}:
                node, how = turns[t.number], "order"
            elif len(own) == 1:
                node, how = own[0], "owner"
            elif free or own or set(by_start[t.start_page]) - used:
                how = "ambiguous"
            else:
                how = "new"
            used.add(node)
            rows.append((t.document_id, t.number, node, how))
        return pd.DataFrame(rows, columns=["document_id", "number", "node_id", "how"])

    of = F.col("document_id").cast("long").alias("document_id")
    ranges = [F.col(c).cast("double").alias(c) for c in ("start_page", "end_page")]
    wanted = nodes.filter(F.upper("node_type").isin("TABLE", *OWNERS)).select(of, "node_id", "node_type", F.col("position").cast("double").alias("position"), *ranges)
    return tables.select(of, F.col("number").cast("long").alias("number"), *ranges).groupBy("document_id").cogroup(wanted.groupBy("document_id")).applyInPandas(run, out)


def front_matter_pages(pages: DataFrame) -> DataFrame:
    """document_id, page_number of early pages (document_id, page_number, text) that hold phrases of at least three groups of front-matter records."""
    told = F.lower(text.collapse(F.coalesce("text", F.lit(""))))
    found = [F.greatest(*(F.contains(told, F.lit(p)).cast("int") for p in group)) for group in FRONT_MATTER]
    return pages.filter((F.col("page_number") <= FRONT_PAGES) & (sum(found, F.lit(0)) >= FRONT_GROUPS)).select("document_id", "page_number")


def profile_problems(documents: DataFrame, tables: DataFrame, required: DataFrame) -> DataFrame:
    """document_id, position, problem of table profiles (position 0: the document's).

    Documents are (document_id, page_count, told_count); tables (document_id, position, table_id, start_page, end_page, column_count, columns, regions of page, left, top, right,
    bottom); required (document_id, page_number) are pages that some table must cover. A table without a valid range is checked no further.
    """
    t = tables.join(documents.select("document_id", "page_count"), "document_id")
    valid = F.coalesce((F.col("start_page") >= 1) & (F.col("start_page") <= F.col("end_page")) & (F.col("end_page") <= F.col("page_count")), F.lit(False))
    repeated = F.row_number().over(Window.partitionBy("document_id", "table_id").orderBy("position")) > 1
    regions = F.coalesce("regions", F.array().cast("array<struct<page:int,left:int,top:int,right:int,bottom:int>>"))
    bad = F.filter(regions, lambda r: ~F.coalesce((r["left"] < r["right"]) & (r["top"] < r["bottom"]), F.lit(False)))
    t = t.withColumns({"valid": valid, "repeated": repeated})
    more = F.concat(
        F.array(
            F.when(F.coalesce(F.size("columns"), F.lit(0)) != F.col("column_count"), F.lit("headings")),
            F.when(~F.transform(regions, lambda r: r["page"]).eqNullSafe(F.sequence("start_page", "end_page")), F.lit("region_pages")),
        ),
        F.transform(bad, lambda r: F.concat(F.lit("region "), r["page"].cast("string"))),
    )
    kinds = F.concat(F.array(F.when(F.col("repeated"), F.lit("repeated_id"))), F.when(F.col("valid"), more).otherwise(F.array(F.lit("range"))))
    own = t.select("document_id", "position", F.explode(F.array_compact(kinds)).alias("problem"))
    count = documents.filter(~F.col("told_count").eqNullSafe(F.col("page_count"))).select("document_id", F.lit(0).alias("position"), F.lit("page_count").alias("problem"))
    covered = t.filter("valid").select("document_id", F.explode(F.sequence("start_page", "end_page")).alias("page_number")).distinct()
    open_ = required.join(covered, ["document_id", "page_number"], "left_anti").select("document_id", F.lit(0).alias("position"), F.concat(F.lit("front matter "), F.col("page_number").cast("string")).alias("problem"))
    return own.unionByName(count).unionByName(open_)
