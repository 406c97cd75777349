"""Queries of page layout, drawn tables, topics and settled passes, with their SQL; page words and payments stand as VALUES."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts, layout, profiles
from ..sources import files, tables
from .indexing import _fixture
from .queries import query

DRAWN = ["+------+--------------+", "| Head | x            |", "+      +--------------+", "|      | longer value |", "+------+--------------+", "| one two three four  |", "| five six seven      |", "+------+--------------+"]


@query(f"SELECT '1' AS table_id, array_to_string({DRAWN!r}, chr(10)) AS text")
def table_drawn(spark, d):
    return layout.drawn(_fixture(spark, "table_id, row_start, row_end, column_start, column_end, value", "(1, 1, 2, 1, 1, 'Head'), (1, 1, 1, 2, 2, 'x'), (1, 2, 2, 2, 2, 'longer value'), (1, 3, 3, 1, 2, 'one two three four five six seven')"))


LINES = "('a', 10, 10, 30, 18), ('a', 10, 100, 120, 18), ('a', 30, 10, 40, 38), ('a', 30, 105, 110, 38), ('a', 50, 10, 45, 58), ('a', 51, 104, 112, 58), ('b', 10, 10, 30, 18), ('b', 10, 100, 120, 18), ('b', 30, 10, 40, 38), ('c', 10, 10, 30, 18), ('c', 10, 40, 60, 18), ('c', 30, 1, 2, 38), ('c', 50, 1, 2, 58), ('d', 10, 10, 30, 18), ('d', 10, 100, 120, 18), ('d', 30, 5, 200, 38), ('d', 50, 1, 2, 58)"


@query("SELECT 'a' AS region_id, '10.0,72.5,120.0' AS columns, '10.0,24.0,44.0,58.0' AS rows")
def borderless_tables(spark, d):
    """b has two lines, c one heading (its words lie close), d a word across the only gap."""
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return layout.borderless(_fixture(spark, "region_id, top, x0, x1, bottom", LINES)).select("region_id", told("columns"), told("rows"))


@query("SELECT * FROM (VALUES ('g', 60.0, 195.0, 540.0, 716.0), ('h', 60.0, 96.0, 540.0, 716.0), ('i', 60.0, 400.0, 540.0, 600.0)) t(region_id, x0, y0, x1, y1)")
def refined_regions(spark, d):
    regions = "(1, 'g', 1, 600D, 800D, true, array('', 'Item: name'), 100, 0, 900, 1000), (1, 'h', 1, 600D, 800D, false, array('Item'), 100, 0, 900, 1000), (1, 'i', 2, 600D, 800D, true, array('Item'), 100, 500, 900, 750)"
    r = layout.region_boxes(_fixture(spark, "document_id, region_id, page, page_width, page_height, is_first, headings, left, top, right, bottom", regions))
    return layout.refined_boxes(r, _fixture(spark, "document_id, page, x0, top, text", "(1, 1, 70D, 300D, 'item'), (1, 1, 70D, 200D, 'ITEM,'), (1, 1, 70D, 90D, 'item'), (1, 1, 20D, 120D, 'item'), (1, 2, 70D, 390D, 'item')"))


@query("""WITH t AS (SELECT c_nationkey AS document_id, c_custkey AS position, c_mktsegment AS title, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)
SELECT document_id, string_agg(CASE WHEN position % 2 = 1 THEN lower(title) ELSE title END, '|' ORDER BY position) AS topics FROM t WHERE n = 1 GROUP BY 1""")
def topics(spark, d):
    n = tables.read(spark, d, "customer").selectExpr("c_nationkey AS document_id", "c_custkey AS position", "CASE WHEN c_custkey % 2 = 1 THEN lower(c_mktsegment) ELSE concat('  ', c_mktsegment, ' ') END AS title")
    return profiles.topics(n).withColumn("topics", F.array_join("topics", "|"))


@query("""SELECT * FROM (VALUES ('s1', 'paid', TIMESTAMP '2026-01-31', TIMESTAMP '2026-02-28'), ('s2', 'review', NULL, NULL), ('s3', 'review', NULL, NULL), ('s5', 'review', NULL, NULL), ('s8', 'paid', TIMESTAMP '2026-02-05', TIMESTAMP '2026-03-05')) t(session_id, status, period_start, period_end)""")
def pass_settlement(spark, d):
    orders = _fixture(spark, "session_id, user_id, status, period_end", "('s1', 1, 'pending', NULL), ('s2', 1, 'pending', NULL), ('s3', 2, 'pending', NULL), ('s4', 2, 'paid', TIMESTAMP '2026-03-01'), ('s5', 3, 'pending', NULL), ('s6', 4, 'pending', NULL), ('s7', 5, 'paid', NULL), ('s8', 6, 'pending', NULL)")
    paid = "('s1', 'e1', 2, true, TIMESTAMP '2026-01-31'), ('s2', 'e2', 3, true, TIMESTAMP '2026-02-01'), ('s3', 'e3', 4, true, TIMESTAMP '2026-02-01'), ('s5', 'e4', 5, true, TIMESTAMP '2026-02-01'), ('s6', 'e5', 6, false, TIMESTAMP '2026-02-01'), ('s7', 'e6', 7, true, TIMESTAMP '2026-02-01'), ('s8', 'e7', 1, true, TIMESTAMP '2026-02-05'), ('s8', 'e8', 9, true, TIMESTAMP '2026-02-09'), ('s9', 'e9', 9, true, TIMESTAMP '2026-02-09')"
    return accounts.settled_passes(orders, _fixture(spark, "session_id, event_id, place, verified, charged_at", paid), _fixture(spark, "user_id, status", "(3, 'active'), (6, 'canceled')"), F.to_timestamp(F.lit("2026-02-10")))


@query()
def file_inventory(spark, d):
    """Files can't be listed in the SQL check's views."""
    return files.files(spark, d, "region.parquet").select("filename", "size", "file_hash", "head")
