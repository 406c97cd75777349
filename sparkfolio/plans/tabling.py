"""Queries of table continuation, merged rows, table-to-node links and table profiles, with their SQL; cases that the driver's tables don't hold stand as VALUES."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import continuation
from ..sources import tables
from .indexing import PAGES, _fixture
from .queries import query

FRAGMENT = "document_id int, page int, table_number int, column_count int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>, rows array<array<string>>"


def fragment(document, page, number, y0, y1, rows, columns=2, xs=(50.0, 200.0, 350.0)):
    """A grid of rows over equal bands on a page of 400 x 800."""
    high = (y1 - y0) / max(1, len(rows))
    boxes = [(a, y0 + i * high, b, y0 + (i + 1) * high) for i in range(len(rows)) for a, b in zip(xs, xs[1:], strict=False)]
    return (document, page, number, columns, xs[0], y0, xs[-1], y1, 400.0, 800.0, boxes, rows)


H, A, B = ["Name", "Sum"], ["a", "1"], ["b", "2"]
FRAGMENTS = [
    # 1: repeated header, headerless with support, then a page without the next
    fragment(1, 1, 1, 100.0, 740.0, [H, A]), fragment(1, 2, 1, 40.0, 760.0, [["NAME", " sum "], B]), fragment(1, 3, 1, 50.0, 700.0, [A, B]), fragment(1, 5, 1, 50.0, 300.0, [H, A]),
    # 2: ends too high, yet header, columns and edges agree: the gap decides; 3 has text in the gap; 4 no page known
    fragment(2, 1, 1, 100.0, 500.0, [H, A]), fragment(2, 2, 1, 60.0, 700.0, [H, B]), fragment(3, 1, 1, 100.0, 500.0, [H, A]), fragment(3, 2, 1, 60.0, 700.0, [H, B]), fragment(4, 1, 1, 100.0, 500.0, [H, A]), fragment(4, 2, 1, 60.0, 700.0, [H, B]),
    # 5: mandatory conditions met, other shape: a warning; 6: the second table of a page isn't first; no geometry
    fragment(5, 1, 1, 100.0, 740.0, [H, A]), fragment(5, 2, 1, 40.0, 300.0, [["x", "y", "z"]], 3, (20.0, 90.0, 160.0, 230.0)), fragment(6, 1, 1, 10.0, 50.0, [H, A]), fragment(6, 1, 2, 100.0, 790.0, [H, A]), fragment(6, 2, 2, 40.0, 300.0, [H, A]), fragment(6, 3, 1, 40.0, 300.0, []),
]
WORDS = "(2, 1, 10D, 20D, 30D, 'Act'), (2, 2, 10D, 20D, 30D, 'Act'), (2, 3, 10D, 20D, 30D, 'Act'), (2, 1, 190D, 770D, 780D, '7'), (2, 1, 60D, 120D, 130D, 'Name'), (3, 1, 10D, 600D, 610D, 'Between'), (3, 2, 10D, 20D, 30D, 'once')"
HEIGHTS, IMAGES = "(2, 1, 800D), (2, 2, 800D), (2, 3, 800D), (3, 1, 800D), (3, 2, 800D), (4, 1, 800D)", "(2, 2, 500D, 600D)"


def _decided(spark):
    f = spark.createDataFrame(FRAGMENTS, FRAGMENT)
    return continuation.decided(f, _fixture(spark, "document_id, page, x0, top, bottom, text", WORDS), _fixture(spark, "document_id, page, height", HEIGHTS), _fixture(spark, "document_id, page, top, bottom", IMAGES))


@query("""SELECT * FROM (VALUES (1, 1, 1, 1, false, 0, '', false), (1, 2, 1, 1, true, 5, 'consecutive,order,columns,edges,bottom,top,row,width,header', false), (1, 3, 1, 1, true, 4, 'consecutive,order,columns,edges,bottom,top,row,width,headerless', false), (1, 5, 1, 2, false, 4, 'order,columns,edges,bottom,top,row,width,headerless', false),
 (2, 1, 1, 1, false, 0, '', false), (2, 2, 1, 1, true, 5, 'consecutive,order,columns,edges,top,row,width,header,clear_gap', false), (3, 1, 1, 1, false, 0, '', false), (3, 2, 1, 2, false, 5, 'consecutive,order,columns,edges,top,row,width,header', false), (4, 1, 1, 1, false, 0, '', false), (4, 2, 1, 2, false, 5, 'consecutive,order,columns,edges,top,row,width,header', false),
 (5, 1, 1, 1, false, 0, '', false), (5, 2, 1, 2, false, 0, 'consecutive,order,bottom,top', true), (6, 1, 1, 1, false, 0, '', false), (6, 1, 2, 2, false, 5, 'columns,edges,top,row,width,header', false), (6, 2, 2, 3, false, 5, 'consecutive,columns,edges,bottom,top,row,width,header', false), (6, 3, 1, 4, false, 2, 'consecutive,order,columns,top,width', false))
 t(document_id, page, table_number, logical, merges, support, reasons, warning)""")
def table_continuation(spark, d):
    return _decided(spark)


CELL = "document_id, logical, page, table_number, row_start, row_end, column_start, column_end, value"


@query(f"""WITH f AS (SELECT l_orderkey AS document_id, l_linenumber AS page, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2), g AS (SELECT document_id, page, unnest(range(1, 3 + k % 2)) AS r, k FROM f),
c AS (SELECT document_id, page, r, CASE WHEN r = 1 THEN 'Head' WHEN r = 2 AND k % 3 = 0 THEN 'sub' ELSE 'v' || k || '.' || r END AS v, k FROM g), b AS (SELECT document_id, page, max(r) AS height, max(v) FILTER (r = 2) AS second, max(v) FILTER (r = 3) AS third FROM c GROUP BY 1, 2),
o AS (SELECT *, first(second) OVER w AS one, first(third) OVER w AS two, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY document_id ORDER BY page)), p AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN second = one AND third = two THEN 3 WHEN second = one THEN 2 ELSE 1 END AS rep FROM o),
s AS (SELECT *, coalesce(sum(height - rep) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - rep AS shift FROM p)
SELECT c.document_id, c.page, (c.r + shift)::INTEGER AS row_start, c.v AS value FROM c JOIN s ON s.document_id = c.document_id AND s.page = c.page WHERE c.r > rep""")
def table_rows(spark, d):
    f = tables.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page")).agg(F.min("l_partkey").alias("k"))
    c = f.selectExpr("document_id", "1 AS logical", "page", "1 AS table_number", "explode(sequence(1, CAST(2 + k % 2 AS INT))) AS row_start", "k").selectExpr(
        "document_id", "logical", "page", "table_number", "row_start", "row_start AS row_end", "1 AS column_start", "1 AS column_end", "CASE WHEN row_start = 1 THEN 'Head' WHEN row_start = 2 AND k % 3 = 0 THEN 'sub' ELSE concat('v', k, '.', row_start) END AS value"
    )
    return continuation.merged_cells(c).select("document_id", "page", "row_start", "value")


SPANNED = "(1, 1, 1, 1, 1, 2, 1, 1, 'Head'), (1, 1, 1, 1, 1, 1, 2, 2, 'x'), (1, 1, 1, 1, 2, 2, 2, 2, 'y'), (1, 1, 1, 1, 3, 3, 1, 2, 'one'), (1, 1, 2, 1, 1, 2, 1, 1, 'HEAD'), (1, 1, 2, 1, 1, 1, 2, 2, 'X'), (1, 1, 2, 1, 2, 2, 2, 2, 'z'), (1, 1, 2, 1, 3, 3, 1, 2, 'two'), (1, 1, 3, 1, 1, 1, 2, 2, 'y'), (1, 1, 3, 1, 2, 2, 1, 2, 'three')"


@query("SELECT * FROM (VALUES (1, 1, 6, 2, '1,2,3')) t(document_id, logical, row_count, column_count, pages)")
def table_sizes(spark, d):
    """Of page 2 the first row goes, of page 3 the first (it is the first fragment's second); the cell that spans out stays."""
    return continuation.sizes(continuation.merged_cells(_fixture(spark, CELL, SPANNED)))


@query("SELECT * FROM (VALUES (1, 1, 'zz')) t(document_id, page, value)")
def table_untraced(spark, d):
    sources = _fixture(spark, CELL, SPANNED).select("document_id", "page", "table_number", "value")
    return continuation.untraced(_fixture(spark, CELL, SPANNED + ", (1, 1, 1, 1, 4, 4, 1, 1, 'zz')"), sources).select("document_id", "page", "value")


LINK_TABLES = "(1, 1, 2, 3), (1, 2, 5, 5), (1, 3, 5, 6), (1, 4, 8, 9), (1, 5, 20, 20), (1, 6, 12, 12), (1, 7, NULL, NULL), (1, 8, 2, 3), (2, 1, 1, 1), (3, 1, 4, 4), (3, 2, 4, 4), (3, 3, 4, 4)"
LINK_NODES = "(1, 'a', 'TABLE', 1, 2, 3), (1, 'b', 'table', 2, 5, 7), (1, 'c', 'TABLE', 3, 5, 7), (1, 's', 'SCHEDULE', 4, 8, 9), (1, 'h', 'HEADING', 5, 12, 12), (1, 'i', 'SCHEDULE', 6, 12, 12), (1, 'p', 'PART', 0, 1, 30), (2, 'x', 'TABLE', NULL, 1, 1), (3, 'u', 'TABLE', 1, 4, 4), (3, 'v', 'TABLE', 2, 4, 4)"


@query("SELECT * FROM (VALUES (1, 1, 'a', 'exact'), (1, 2, 'b', 'order'), (1, 3, 'c', 'order'), (1, 4, 's', 'owner'), (1, 5, NULL, 'new'), (1, 6, NULL, 'ambiguous'), (1, 7, NULL, 'no_pages'), (1, 8, NULL, 'new'), (2, 1, NULL, 'disconnected'), (3, 1, NULL, 'ambiguous'), (3, 2, NULL, 'ambiguous'), (3, 3, NULL, 'ambiguous')) t(document_id, number, node_id, how)")
def table_links(spark, d):
    return continuation.linked(_fixture(spark, "document_id, number, start_page, end_page", LINK_TABLES), _fixture(spark, "document_id, node_id, node_type, position, start_page, end_page", LINK_NODES))


@query(f"""WITH {PAGES}, q AS (SELECT document_id, page_number, CASE WHEN document_id % 3 = 0 THEN 'First  enacted 1955; REVISED 1981; last amended 2022' WHEN document_id % 3 = 1 THEN 'revised revision reprint' ELSE text END AS text FROM p)
SELECT document_id, page_number FROM q WHERE page_number <= 12 AND document_id % 3 = 0 AND text LIKE 'First%'""")
def front_matter(spark, d):
    p = tables.doc_pages(spark, d).withColumn("text", F.expr("CASE WHEN document_id % 3 = 0 THEN 'First  enacted 1955; REVISED 1981; last amended 2022' WHEN document_id % 3 = 1 THEN 'revised revision reprint' ELSE text END"))
    return continuation.front_matter_pages(p).select("document_id", "page_number")


PROFILE = """(1, 1, 't', 1, 2, 2, array('a', 'b'), array(named_struct('page', 1, 'left', 0, 'top', 0, 'right', 9, 'bottom', 9), named_struct('page', 2, 'left', 9, 'top', 0, 'right', 9, 'bottom', 9))), (1, 2, 't', 3, 3, 1, array('a', 'b'), array(named_struct('page', 4, 'left', 0, 'top', 0, 'right', 9, 'bottom', 9))),
 (1, 3, 'u', 3, 9, 1, array('a'), NULL), (1, 4, 'v', 4, 4, 1, array('a'), array(named_struct('page', 4, 'left', 0, 'top', 0, 'right', 9, 'bottom', 9))), (2, 1, 't', NULL, 1, 1, NULL, NULL)"""


@query("SELECT * FROM (VALUES (1, 0, 'front matter 5'), (1, 1, 'region 2'), (1, 2, 'repeated_id'), (1, 2, 'headings'), (1, 2, 'region_pages'), (1, 3, 'range'), (2, 0, 'page_count'), (2, 1, 'range')) t(document_id, position, problem)")
def table_profile_problems(spark, d):
    documents = _fixture(spark, "document_id, page_count, told_count", "(1, 5, 5), (2, 3, 2), (3, 1, 1)")
    return continuation.profile_problems(documents, _fixture(spark, "document_id, position, table_id, start_page, end_page, column_count, columns, regions", PROFILE), _fixture(spark, "document_id, page_number", "(1, 5), (1, 4)"))
