"""Tables as geometry: overlap, containment, continuation and cell grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where a fragment must end and begin on its page, how near edges lie, share of edges that must be near.
LOW_EDGE, HIGH_EDGE, TOLERANCE, SHARE = 0.85, 0.15, 0.01, 0.75
#: Pages of a bucket of ranges.
BUCKET = 16


def overlaps(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Pairs of boxes (id, x0, y0, x1, y1) on one page whose insides meet."""
    x, y = a.alias("a"), b.alias("b")
    return x.join(y, F.expr(f"a.{on} = b.{on} AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0")).select(F.col(f"a.{on}"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def range_parent(ranges: DataFrame, nodes: DataFrame, on: str) -> DataFrame:
    """The deepest, then tightest node that contains a range; null if the choice is not unique. Nodes are dealt to the buckets of pages that they span, a range looks only into that of its start."""
    spread = nodes.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("node_start") / BUCKET), F.floor(F.col("node_end") / BUCKET)))).filter("node_end >= node_start")
    held = ranges.withColumn("_bucket", F.floor(F.col("start") / BUCKET)).join(spread, [on, "_bucket"]).filter("node_start <= start AND node_end >= end").drop("_bucket")
    best = F.struct((-F.col("depth")).alias("d"), (F.col("node_end") - F.col("node_start")).alias("span"))
    tied = held.withColumn("best", best).withColumn("low", F.min(best).over(Window.partitionBy(on, "range_id"))).filter("best = low")
    return tied.groupBy(on, "range_id").agg(F.when(F.count("*") == 1, F.min("node_id")).alias("node_id"), F.count("*").alias("ties"))


def aligned(a: Column, b: Column) -> Column:
    """Whether at least 0.75 of the shorter list of edges lies within 0.01 of an edge of the longer."""
    less, more = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    near = F.filter(less, lambda x: F.exists(more, lambda y: F.abs(x - y) <= TOLERANCE))
    return (F.size(less) > 0) & (F.size(near) >= SHARE * F.size(less))


def merged(fragments: DataFrame) -> DataFrame:
    """Number of the logical table of each fragment (document_id, page, table_number, top, bottom, edges, header): it goes on from the fragment before if that one ends low on the page before, this one starts high, the edges align and the headers are equal."""
    w = Window.partitionBy("document_id").orderBy("page", "table_number")
    before = lambda c: F.lag(c).over(w)
    goes_on = (F.col("page") == before("page") + 1) & (before("bottom") >= LOW_EDGE) & (F.col("top") <= HIGH_EDGE) & aligned(F.col("edges"), before("edges")) & (F.lower("header") == F.lower(before("header")))
    rows = fragments.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    return rows.withColumn("logical", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w).cast("int"))


def cells(rows: DataFrame) -> DataFrame:
    """table_id, row, column (from 1), value of non-blank cells, from (table_id, rows: array of arrays)."""
    r = rows.select("table_id", F.posexplode("rows").alias("r", "row"))
    return r.select("table_id", "r", F.posexplode("row").alias("c", "value")).filter(F.trim("value") != "").select("table_id", (F.col("r") + 1).alias("row_number"), (F.col("c") + 1).alias("column_number"), F.trim("value").alias("value"))


def table_text(cells_: DataFrame) -> DataFrame:
    """A line of text for each row: "Row n: column c: value; …"."""
    one = F.struct("column_number", F.concat(F.lit("column "), F.col("column_number").cast("string"), F.lit(": "), F.col("value")).alias("t"))
    line = cells_.groupBy("table_id", "row_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "; ").alias("t"))
    return line.select("table_id", "row_number", F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(": "), F.col("t")).alias("text"))


def lines_of_words(words: Column, gap: float = 3.0) -> Column:
    """Line number of each word's top in sorted order: a new line when a top lies over ``gap`` from the line's first word."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("out"))

    def step(a, top):
        new = a["first"].isNull() | (F.abs(top - a["first"]) > gap)
        line = F.when(new, a["line"] + 1).otherwise(a["line"])
        return F.struct(F.when(new, top).otherwise(a["first"]).alias("first"), line.alias("line"), F.array_append(a["out"], line).alias("out"))

    return F.aggregate(F.array_sort(words), start, step, lambda a: a["out"])


def matrix_problems(profile: DataFrame, tables: DataFrame) -> DataFrame:
    """document_id, position, problem: how returned tables (columns, row_count, rows of row_number, cells, source_pages) differ from the profile (data_row_count) at the same position."""
    at, facts = ["document_id", "position"], ["table_id", "title", "start_page", "end_page", "column_count"]
    p = profile.select(*at, *(F.col(c).alias(f"x_{c}") for c in [*facts, "data_row_count"]), F.lit(True).alias("wanted"))
    both = p.join(tables.withColumn("given", F.lit(True)), at, "full")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    wide = F.col("x_column_count")

    def row(r, i):
        name = F.concat(F.lit("row "), (i + 1).cast("string"))
        pages = r["source_pages"]
        return F.array(
            F.when(~r["row_number"].eqNullSafe(i + 1), F.concat(name, F.lit(": number"))),
            F.when(size(r["cells"]) != wide, F.concat(name, F.lit(": cells"))),
            F.when(size(pages) == 0, F.concat(name, F.lit(": no pages"))).when(F.exists(pages, lambda x: ~x.between(F.col("x_start_page"), F.col("x_end_page"))), F.concat(name, F.lit(": pages outside"))),
        )

    whole = [F.when(~F.col(c).eqNullSafe(F.col(f"x_{c}")), F.lit(c)) for c in facts]
    whole += [F.when(size("columns") != wide, F.lit("headings")), F.when(~F.col("row_count").eqNullSafe(F.col("x_data_row_count")) | (size("rows") != F.col("x_data_row_count")), F.lit("row_count"))]
    found = F.concat(F.array(*whole), F.coalesce(F.flatten(F.transform("rows", row)), F.array().cast("array<string>")))
    kind = F.when(F.col("given").isNull(), F.array(F.lit("missing"))).when(F.col("wanted").isNull(), F.array(F.lit("unexpected"))).otherwise(found)
    return both.select(*at, F.explode(F.array_compact(kind)).alias("problem"))


def _folded(values: Column, within: float = 0.1) -> Column:
    """Distinct sorted coordinates; one within 0.1 of the last that stayed is the same line."""
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) > within), F.array_append(a, x)).otherwise(a))


def row_spans(boxes: DataFrame) -> DataFrame:
    """fragment_id, spans: for each row of cells from the top, the columns (from 1) between which each covering cell (x0, y0, x1, y1) lies."""
    c = boxes.groupBy("fragment_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("b"))
    return with_spans(c).filter("size(ys) > 1").select("fragment_id", "spans")


def with_spans(c: DataFrame) -> DataFrame:
    """Rows of boxes (b) with their distinct coordinates (xs, ys) and spans; spans are empty without two rows' edges."""
    c = c.withColumn("xs", _folded(F.concat("b.x0", "b.x1"))).withColumn("ys", _folded(F.concat("b.y0", "b.y1")))

    def place(x):
        far = F.transform("xs", lambda e: F.abs(e - x))
        return F.array_position(far, F.array_min(far)).cast("int")

    def spans(i):
        inside = F.filter("b", lambda b: (b["y0"] <= F.get("ys", i) + 0.1) & (b["y1"] >= F.get("ys", i + 1) - 0.1))
        return F.array_sort(F.transform(inside, lambda b: F.struct(place(b["x0"]).alias("start"), place(b["x1"]).alias("end"))))

    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ys") - 2)), spans)
    return c.withColumn("spans", F.when(F.size("ys") > 1, rows).otherwise(F.slice(rows, 1, 0)))


def rows_compatible(before: Column, after: Column) -> Column:
    """Whether the first row of the fragment after is spanned as one of the last three rows of the fragment before; false without rows."""
    last = F.slice(F.reverse(before), 1, 3)
    return F.coalesce(F.array_contains(last, F.get(after, F.lit(0))), F.lit(False))


def with_standalone_tables(nodes: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (document_id, node_id, parent_id, node_type, depth, sequence_no, start_page, start_character, end_page) with a TABLE node under the one closest container of each table (document_id, table_id, start_page, end_page), children of those containers numbered anew by place; and the tables without exactly one such container, with the number of equally close ones."""
    inner = nodes.filter("upper(node_type) <> 'TABLE' AND start_page IS NOT NULL AND end_page IS NOT NULL").select("document_id", "node_id", "depth", F.col("start_page").alias("node_start"), F.col("end_page").alias("node_end"))
    ranges = tables.select("document_id", F.col("table_id").alias("range_id"), F.col("start_page").alias("start"), F.col("end_page").alias("end"))
    found = range_parent(ranges, inner, "document_id").select("document_id", F.col("range_id").alias("table_id"), F.col("node_id").alias("parent_id"), "ties")
    placed = tables.join(found, ["document_id", "table_id"], "left")
    problems = placed.filter("parent_id IS NULL").select("document_id", "table_id", F.coalesce("ties", F.lit(0)).alias("containers"))
    depth = nodes.select("document_id", F.col("node_id").alias("parent_id"), F.col("depth").alias("_depth"))
    new = placed.filter("parent_id IS NOT NULL").join(depth, ["document_id", "parent_id"]).select(
        "document_id", F.concat_ws(":", "document_id", "table_id", "start_page", "end_page").alias("node_id"), "parent_id", F.lit("TABLE").alias("node_type"), (F.col("_depth") + 1).alias("depth"), F.lit(0).alias("sequence_no"), "start_page", F.lit(None).cast("int").alias("start_character"), "end_page"
    )
    rows = nodes.select(*new.columns).unionByName(new.join(nodes, ["document_id", "node_id"], "left_anti"))
    grown = found.filter("parent_id IS NOT NULL").select("document_id", "parent_id").distinct().withColumn("_grown", F.lit(True))
    place = F.row_number().over(Window.partitionBy("document_id", "parent_id").orderBy(F.asc_nulls_last("start_page"), F.asc_nulls_last("start_character"), "sequence_no", "node_id")) - 1
    out = rows.join(grown, ["document_id", "parent_id"], "left").withColumn("_place", place)
    return out.withColumn("sequence_no", F.when(F.col("_grown"), F.col("_place")).otherwise(F.col("sequence_no"))).select(*new.columns), problems
