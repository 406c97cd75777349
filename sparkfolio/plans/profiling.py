"""Queries of checks and comparisons of returned hierarchies, with their SQL; cases that the driver's tables don't hold stand as VALUES."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles
from ..sources import tables
from .indexing import _fixture
from .queries import query

NODE = "document_id, node_id, parent_id, sequence_no, node_type, identifier, title, start_page, opening_text"
TREE = """(1, 'r', NULL, 0, 'DOCUMENT', '', '', 1, NULL), (1, 'a', 'r', 0, 'PART', 'I', 'One', 2, NULL), (1, 'b', 'r', 1, 'HEADING', '', 'H', 2, 'open'), (1, 'c', 'b', 0, 'HEADING', '', 'Sub', 3, NULL), (1, 'd', 'a', 0, 'SECTION', '1', 'S', 1, NULL),
 (1, 'e', 'a', 1, 'SECTION', '1', 'S', 3, 'Same text'), (1, 'f', 'a', 2, 'SECTION', '1', ' S', 2, 'Same  text'), (1, 'g', 'a', 3, 'ODD', '', 'x', 9, NULL), (1, 'h', 'a', 4, 'CLAUSE', ' ', '', NULL, NULL), (1, 'i', 'h', 0, 'TABLE', '', '', 4, 'x'),
 (1, 'j', 'b', 1, 'DOCUMENT', NULL, NULL, 3, NULL), (1, 'k', 'b', 2, 'SECTION', '9', 'K', 3, NULL), (2, 'r2', NULL, 0, 'PART', 'x', '', 2, NULL)"""


@query("""SELECT * FROM (VALUES (1, 'c', 'nested_heading'), (1, 'd', 'before_parent'), (1, 'f', 'repeated'), (1, 'f', 'before_sibling'), (1, 'g', 'type'), (1, 'g', 'outside'), (1, 'h', 'unnamed'), (1, 'h', 'no_page'), (1, 'i', 'opening'), (1, 'j', 'inner_document'), (1, 'j', 'identifier'), (1, 'j', 'title'), (1, 'b', 'mixed'),
 (2, 'r2', 'root_type'), (2, 'r2', 'root_label'), (2, 'r2', 'root_page'), (2, 'r2', 'no_children')) t(document_id, node_id, problem)""")
def node_problems(spark, d):
    return profiles.node_problems(_fixture(spark, NODE, TREE), _fixture(spark, "document_id, page_count", "(1, 5)"))


@query("SELECT * FROM (VALUES (1, 2, 'classification'), (1, 3, 'nodes_differ'), (2, 0, 'order'), (3, 0, 'order')) t(document_id, page, problem)")
def coverage_problems(spark, d):
    records = "(1, 0, 1, 'new_nodes_start_here'), (1, 1, 2, 'other'), (1, 2, 3, 'no_new_nodes_start_here'), (2, 0, 2, 'new_nodes_start_here'), (2, 1, 1, 'no_new_nodes_start_here')"
    return profiles.coverage_problems(_fixture(spark, "document_id, page_count", "(1, 3), (2, 2), (3, 1)"), _fixture(spark, "document_id, place, page_label, classification", records), _fixture(spark, "document_id, start_page", "(1, 1), (1, 3), (1, 3), (2, 2)"))


def _openings(page: int, lines: list[str]) -> str:
    return f"[[PAGE_LABEL: {page}]]\n" + "\n".join(lines) + "\n"


@query("SELECT * FROM (VALUES (1, 'no_sections', '1,2,3,4,5,6'), (2, 'few_sections', '4,5,6,7,8,9,10,11'), (3, 'no_subsections', '10')) t(document_id, problem, examples)")
def completeness_problems(spark, d):
    """4 has no legal form; the sections of 5 stand in its schedule; 6 has half of its sections."""
    names = lambda n: [f"{i}. Name" for i in range(1, n + 1)]
    docs = [(1, 2, _openings(1, names(6))), (2, 2, _openings(1, names(12)) + _openings(2, names(20)[12:])), (3, 1, _openings(1, [f"({i}) Words" for i in range(1, 11)])), (4, 1, _openings(1, names(9))), (5, 2, _openings(1, ["none"]) + _openings(2, names(9))), (6, 1, _openings(1, names(20)))]
    nodes = [(1, "PART", "I", 1), (2, "SECTION", "1.", 1), (2, "SECTION", "2", 1), (2, "SECTION", " 3. ", 1), (3, "SECTION", "1", 1), (4, "TABLE", "", 1), (5, "PART", "I", 1), (5, "SCHEDULE", "", 2)] + [(6, "SECTION", f"{i}", 1) for i in range(1, 11)]
    return profiles.completeness_problems(spark.createDataFrame(docs, "document_id int, page_count int, text string"), spark.createDataFrame(nodes, "document_id int, node_type string, identifier string, start_page int"))


@query("SELECT * FROM (VALUES ('b', 'before_sibling'), ('a2', 'before_ancestor'), ('a2', 'before_sibling')) t(node_id, problem)")
def page_order_problems(spark, d):
    return profiles.page_order_problems(_fixture(spark, "node_id, parent_id, sequence_no, start_page", "('r', NULL, 0, 1), ('a', 'r', 0, 3), ('a1', 'a', 0, 5), ('a2', 'a', 1, 2), ('b', 'r', 1, 4), ('c', 'r', 2, NULL), ('c1', 'c', 0, 2), ('d', 'r', 3, 5)"))


@query("""WITH o AS (SELECT c_nationkey || '/' || c_custkey AS path, c_custkey % 50 AS p, c_custkey % 7 AS k FROM customer), n AS (SELECT path, CASE WHEN k = 1 THEN p + 1 WHEN k <> 2 THEN p END AS p FROM o WHERE k > 0 UNION ALL SELECT path, p FROM o WHERE k = 3 UNION ALL SELECT 'x/' || path, p FROM o WHERE k = 4),
g AS (SELECT path, count(*) AS n, min(p) AS q FROM n GROUP BY 1) SELECT path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN q IS NULL THEN 'unknown_page' WHEN q > 40 THEN 'invalid_page' WHEN q = p THEN 'match' ELSE 'differs' END AS status, CASE WHEN n = 1 THEN q END AS page FROM o LEFT JOIN g USING (path)
UNION ALL SELECT path, 'extra', p FROM n WHERE path LIKE 'x/%'""")
def path_comparison(spark, d):
    o = tables.read(spark, d, "customer").selectExpr("array(CAST(c_nationkey AS STRING), CAST(c_custkey AS STRING)) AS path", "c_custkey % 50 AS start_page", "c_custkey % 7 AS k")
    n = o.filter("k > 0").selectExpr("path", "CASE WHEN k = 1 THEN start_page + 1 WHEN k <> 2 THEN start_page END AS start_page")
    n = n.unionByName(o.filter("k = 3").select("path", "start_page")).unionByName(o.filter("k = 4").selectExpr("concat(array('x'), path) AS path", "start_page"))
    return profiles.compared(o.drop("k"), n, spark.range(0, 41).withColumnRenamed("id", "page_number")).withColumn("path", F.array_join("path", "/"))


FAMILY = """t AS (SELECT 'n' || n_nationkey AS node_id, NULL AS parent_id, n_nationkey::BIGINT AS s, n_regionkey::DOUBLE AS far FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, 0 FROM customer),
w AS (SELECT a.node_id AS root, a.node_id, a.far, [a.s] AS o FROM t a WHERE parent_id IS NULL UNION ALL SELECT a.node_id, b.node_id, a.far, [a.s, b.s] FROM t a JOIN t b ON b.parent_id = a.node_id), c AS (SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 11 = 0 THEN 'lost' ELSE 'c' || o_custkey END AS node_id, o_orderkey % 3 AS chunk_number FROM orders UNION ALL SELECT -1 - n_nationkey, 'n' || n_nationkey, 0 FROM nation)"""


def _family(spark, d):
    nodes = tables.read(spark, d, "nation").selectExpr("concat('n', n_nationkey) AS node_id", "CAST(NULL AS STRING) AS parent_id", "CAST(n_nationkey AS BIGINT) AS sequence_no", "'NATION' AS node_type", "CAST(n_nationkey AS STRING) AS identifier", "CAST(n_regionkey AS DOUBLE) AS similarity", "'n' AS title", "0 AS depth")
    people = tables.read(spark, d, "customer").selectExpr("concat('c', c_custkey) AS node_id", "concat('n', c_nationkey) AS parent_id", "CAST(c_custkey AS BIGINT) AS sequence_no", "'CUSTOMER' AS node_type", "c_name AS identifier", "0D AS similarity", "'c' AS title", "1 AS depth")
    orders = tables.read(spark, d, "orders").selectExpr("CAST(o_orderkey AS BIGINT) AS chunk_id", "CASE WHEN o_orderkey % 11 = 0 THEN 'lost' ELSE concat('c', o_custkey) END AS node_id", "CAST(o_orderkey % 3 AS BIGINT) AS chunk_number")
    return nodes.unionByName(people), orders.unionByName(tables.read(spark, d, "nation").selectExpr("CAST(-1 - n_nationkey AS BIGINT) AS chunk_id", "concat('n', n_nationkey) AS node_id", "0L AS chunk_number"))


@query(f"WITH {FAMILY} SELECT chunk_id, root AS exact_anchor_id, row_number() OVER (ORDER BY far DESC, o, chunk_number, chunk_id) AS place FROM w JOIN c USING (node_id) WHERE root IN ('n3', 'n12')")
def exact_bundle(spark, d):
    return profiles.exact_bundle(*_family(spark, d), "what is nation 3 in the part and where is NATION (12)?")


@query(f"WITH {FAMILY} SELECT chunk_id, row_number() OVER (ORDER BY o NULLS LAST, chunk_number, chunk_id) AS number FROM c LEFT JOIN w USING (node_id)")
def chunk_order(spark, d):
    nodes, chunks = _family(spark, d)
    return profiles.chunk_order(chunks, nodes)


FILES = """('2026-01-01', '20260101-101010_01234567-89ab-cdef-0123-456789abcdef.json', '2026-01-01T10:10:10+00:00', TIMESTAMP '2026-02-01'), ('2026-01-02', '20260101-101010_01234567-89ab-cdef-0123-456789abcdef.json.tmp', NULL, TIMESTAMP '2026-01-01'), ('2026-01-03', '20260101-101010_01234567-89ab-cdef-0123-456789abcdef.json', '2026-01-01T10:10:10', TIMESTAMP '2026-02-01'),
 ('2026-01-04', 'notes.json', '2026-01-01T10:10:10+00:00', TIMESTAMP '2026-01-01'), ('other', '20260101-101010_01234567-89ab-cdef-0123-456789abcdef.json', '2026-01-01T10:10:10+00:00', TIMESTAMP '2026-01-01'), ('2026-01-05', '20260101-101010_01234567-89ab-cdef-0123-456789abcdef.json', 'broken +00:00', TIMESTAMP '2026-01-01'), ('2026-01-06', '20260101-101010_01234567-89ab-cdef-0123-456789abcdef.json', '2026-01-30T10:10:10Z', TIMESTAMP '2026-01-01')"""


@query("SELECT * FROM (VALUES ('2026-01-01'), ('2026-01-02'), ('2026-01-05')) t(folder)")
def capture_expiry(spark, d):
    return profiles.expired(_fixture(spark, "folder, name, started_at, modified", FILES), F.to_timestamp(F.lit("2026-02-02")), 14).select("folder")


MAP_NODES = """(1, 'r', NULL, 0, 'DOCUMENT', '', ''), (1, 'h', 'r', 0, 'HEADING', NULL, 'My Act'), (1, 'p1', 'r', 1, 'PART', NULL, 'Part One'), (1, 's', 'p1', 0, 'SECTION', '1.', NULL), (1, 't', 'p1', 1, 'TABLE', NULL, NULL), (1, 'p2', 'r', 2, 'PART', NULL, 'Part Two'), (1, 'z', 'p2', 0, 'SECTION', NULL, 'gone'), (1, 'y', 'p2', 1, 'CLAUSE', '', ' '), (1, 'x', 'p2', 2, 'SECTION', '4.', NULL),
 (2, 'a', NULL, 0, 'PART', NULL, 'x'), (2, 'b', NULL, 0, 'PART', NULL, 'y'), (3, 'a', NULL, 0, 'SECTION', NULL, 'Beta'), (3, 'b', NULL, 1, 'SECTION', NULL, 'Alpha'), (4, 'a', NULL, 0, 'SECTION', NULL, 'One'), (4, 'b', NULL, 1, 'SECTION', NULL, 'Two'), (4, 't', 'b', 0, 'TABLE', NULL, NULL)"""
MAP_PAGES = "(1, 1, 'My Act  Contents Part One Part Two'), (1, 2, 'Part  One\\n1. Scope\\nthe  text 11.'), (1, 3, 'PART TWO\\nLast words. 4. end 14.'), (3, 1, 'Alpha Beta'), (4, 1, 'Two One'), (4, 2, 'T wo and more')"


@query("""SELECT * FROM (VALUES (1, 'r', 1, NULL, 3, NULL), (1, 'h', 1, 0, 3, NULL), (1, 'p1', NULL, NULL, NULL, 'ambiguous'), (1, 's', NULL, NULL, NULL, 'parent_unresolved'), (1, 't', NULL, NULL, NULL, 'parent_unresolved'), (1, 'p2', 3, 0, 3, NULL), (1, 'z', NULL, NULL, NULL, 'not_found'), (1, 'y', 3, NULL, 3, NULL), (1, 'x', 3, 21, 3, NULL),
 (2, 'a', NULL, NULL, NULL, 'invalid_hierarchy'), (2, 'b', NULL, NULL, NULL, 'invalid_hierarchy'), (3, 'a', NULL, NULL, NULL, 'conflict'), (3, 'b', NULL, NULL, NULL, 'conflict'), (4, 'a', 1, 4, 2, NULL), (4, 'b', 2, 0, 2, NULL), (4, 't', 2, NULL, 2, NULL)) t(document_id, node_id, start_page, start_character, end_page, reason)""")
def candidate_mapping(spark, d):
    return profiles.map_candidates(_fixture(spark, "document_id, node_id, parent_id, sequence_no, node_type, identifier, title", MAP_NODES), _fixture(spark, "document_id, page_number, text", MAP_PAGES))
