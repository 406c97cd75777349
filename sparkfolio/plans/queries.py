"""Every query of the engine over the driver's tables, with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import documents, grids, metering, retrieval, rewrites, trees
from ..sources import tables
from ..streaming import usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"
CHUNKS = f"SELECT e.vec_id AS chunk_id, d.doc_id AS document_id, d.source AS owner_id, e.label AS node_id, {COSINE} AS similarity FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"
USAGE = "SELECT event_id, user_id, event_type AS activity, value::DECIMAL(20,10) AS cost, ts FROM events"


def _query(spark, d):
    return tables.read(spark, d, "embeddings").filter("vec_id = 0")


@query(f"WITH c AS ({CHUNKS}) SELECT chunk_id, document_id, similarity FROM c WHERE similarity >= 0.2 ORDER BY similarity DESC, chunk_id LIMIT 20")
def vector_topk(spark, d):
    return retrieval.vector_topk(tables.doc_chunks(spark, d), _query(spark, d), threshold=0.2).select("chunk_id", "document_id", "similarity")


@query(f"WITH c AS ({CHUNKS}) SELECT chunk_id, similarity FROM c WHERE similarity >= 0.1 AND owner_id = 'src3' ORDER BY similarity DESC, chunk_id LIMIT 20")
def vector_topk_owned(spark, d):
    return retrieval.vector_topk(tables.owned(tables.doc_chunks(spark, d), "src3"), _query(spark, d), threshold=0.1).select("chunk_id", "similarity")


@query(f"WITH c AS ({CHUNKS}) SELECT chunk_id, similarity FROM c WHERE similarity >= 0.1 AND chunk_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY similarity DESC, chunk_id LIMIT 20")
def vector_topk_excluding(spark, d):
    bad = tables.read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return retrieval.vector_topk(tables.doc_chunks(spark, d), _query(spark, d), threshold=0.1, excluded=bad).select("chunk_id", "similarity")


@query(f"WITH c AS ({CHUNKS}) SELECT owner_id, chunk_id, similarity, row_number() OVER (PARTITION BY owner_id ORDER BY similarity DESC, chunk_id) AS rank FROM c WHERE similarity >= 0.05 QUALIFY rank <= 3")
def vector_topk_per_owner(spark, d):
    return retrieval.topk_within(retrieval.similarity(tables.doc_chunks(spark, d), _query(spark, d), 0.05), "owner_id", 3).select("owner_id", "chunk_id", "similarity", "rank")


@query(f"""WITH c AS ({CHUNKS}), n AS (SELECT node_id, max(similarity) AS node_similarity FROM c WHERE similarity >= 0.05 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT chunk_id, node_id, node_similarity, similarity FROM c JOIN n USING (node_id) WHERE similarity >= 0.05 ORDER BY node_similarity DESC, similarity DESC, chunk_id LIMIT 20""")
def node_hierarchy_search(spark, d):
    return retrieval.two_stage(tables.doc_chunks(spark, d), _query(spark, d), 3, 20, 0.05).select("chunk_id", "node_id", "node_similarity", "similarity")


def _lists(spark, d):
    """Three lists; ranks count all rows of a list, also those that the threshold drops afterwards. Exact rows bypass it."""
    every = retrieval.similarity(tables.doc_chunks(spark, d), _query(spark, d), -1.0)
    lists = retrieval.ranked(every.withColumn("path", F.expr("CASE node_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'node' ELSE 'exact' END")), [F.desc("similarity"), "chunk_id"], ["path"])
    return lists.filter("path = 'exact' OR similarity >= 0.1")


LISTS = f"WITH c AS ({CHUNKS}), l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, chunk_id) AS rank FROM (SELECT *, CASE node_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'node' ELSE 'exact' END AS path FROM c) QUALIFY path = 'exact' OR similarity >= 0.1)"
WEIGHTS = {"vector": 1.0, "node": 1.0, "exact": 2.0}


@query(LISTS + """ SELECT chunk_id, round(sum(CASE path WHEN 'exact' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 6) AS hybrid_score, min(CASE path WHEN 'vector' THEN 0 WHEN 'node' THEN 1000000 ELSE 2000000 END + rank)::BIGINT AS first_seen,
 string_agg(DISTINCT path, ',' ORDER BY path) AS match_types FROM l GROUP BY 1""")
def rrf_fuse(spark, d):
    return retrieval.fuse(_lists(spark, d).select("path", "rank", "chunk_id"), WEIGHTS)


@query(LISTS + """, t AS (SELECT chunk_id, owner_id AS document_id, ascii(path) AS document_order, row_number() OVER (PARTITION BY owner_id ORDER BY rank, chunk_id) AS turn FROM l)
SELECT chunk_id, turn, document_order, document_id FROM t ORDER BY turn, document_order, chunk_id LIMIT 25""")
def round_robin_cap(spark, d):
    rows = _lists(spark, d).select("chunk_id", F.col("owner_id").alias("document_id"), F.ascii("path").alias("document_order"), "rank")
    return retrieval.round_robin(rows, 25)


@query(LISTS + """, r AS (SELECT chunk_id, path = 'exact' AND rank <= 5 AS is_anchor, node_id AS unit, similarity AS score FROM l), u AS (SELECT count(DISTINCT unit) AS n FROM r WHERE is_anchor),
e AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS p FROM r WHERE NOT is_anchor) SELECT chunk_id, is_anchor, unit AS retrieval_unit_id, score AS hybrid_score FROM r WHERE is_anchor
UNION ALL SELECT chunk_id, is_anchor, unit, score FROM e, u WHERE p <= greatest(0, 20 - n)""")
def unit_cap(spark, d):
    rows = _lists(spark, d).select("chunk_id", ((F.col("path") == "exact") & (F.col("rank") <= 5)).alias("is_anchor"), F.col("node_id").alias("retrieval_unit_id"), F.col("similarity").alias("hybrid_score"))
    return retrieval.unit_cap(rows, 20)


QUESTION = "What is NATION_3 in region of the part and where is NATION_12?"


@query("""WITH w AS (SELECT n_nationkey, n_name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM nation), q AS (SELECT 'what is nation 3 in region of the part and where is nation 12' AS k)
SELECT n_nationkey AS document_id, round(CASE WHEN contains(q.k, w.k) THEN 1.0 ELSE 0.5 END::DOUBLE, 6) AS name_score, contains(q.k, w.k) AS exact_name, 0.0::DOUBLE AS topic_score,
 round(CASE WHEN contains(q.k, w.k) THEN (0.5 + 0.35 * 0.3) / 1.0 ELSE 0.35 * 0.3 / 0.5 END::DOUBLE, 6) AS combined_score, contains(q.k, w.k) AND row_number() OVER (ORDER BY contains(q.k, w.k) DESC, n_nationkey) <= 3 AS selected FROM w, q""")
def route_documents(spark, d):
    rows = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("document_id"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("filename"), F.array(F.lit("budget rules")).alias("topics"), F.lit(0.3).alias("description_similarity"))
    return retrieval.route(rows, QUESTION)


@query("""SELECT 'NATION' AS node_type, n_nationkey::VARCHAR AS identifier, n_name AS node_id, n_regionkey::DOUBLE AS similarity FROM nation WHERE contains(' what is nation 3 in region of the part and where is nation 12 ', ' nation ' || n_nationkey || ' ')""")
def exact_identifier_anchor(spark, d):
    n = tables.read(spark, d, "nation").select(F.lit("NATION").alias("node_type"), F.col("n_nationkey").cast("string").alias("identifier"), F.col("n_name").alias("node_id"), F.col("n_regionkey").cast("double").alias("similarity"))
    return retrieval.identifier_anchor(n, QUESTION)


TREE = """t AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY k) - 1 AS sequence_no FROM (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, 0 AS depth, r_regionkey::BIGINT AS k, r_name AS title FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, n_nationkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2, c_custkey, c_name FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 3, o_orderkey, o_orderpriority FROM orders))"""


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT node_id AS root_id, node_id, 0 AS distance FROM t WHERE depth = 1 UNION ALL SELECT w.root_id, t.node_id, w.distance + 1 FROM w JOIN t ON t.parent_id = w.node_id) SELECT * FROM w""")
def subtree_expand(spark, d):
    return trees.descendants(tables.tree_nodes(spark, d, orders=True), "depth = 1")


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT node_id, [sequence_no] AS o FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, list_append(w.o, t.sequence_no) FROM w JOIN t ON t.parent_id = w.node_id) SELECT node_id, (row_number() OVER (ORDER BY o, node_id))::INTEGER AS position FROM w""")
def subtree_dfs_order(spark, d):
    return trees.dfs_order(tables.tree_nodes(spark, d, orders=True))


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT node_id, title AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, w.path || ' > ' || t.title FROM w JOIN t ON t.parent_id = w.node_id) SELECT * FROM w""")
def ancestor_path(spark, d):
    return trees.paths(tables.tree_nodes(spark, d, orders=True)).select("node_id", F.array_join("path", " > ").alias("path"))


@query("""WITH r AS (SELECT 's' || s_suppkey AS source_id, 'NATION_' || (s_nationkey + 5 * (s_suppkey % 2)) AS key FROM supplier), t AS (SELECT 'n' || n_nationkey AS node_id, n_name AS key FROM nation UNION ALL SELECT 'x' || n_nationkey, n_name FROM nation WHERE n_nationkey < 4),
g AS (SELECT key, count(*) AS n, min(node_id) AS target_id FROM t GROUP BY 1) SELECT source_id, r.key, CASE WHEN n = 1 THEN target_id END AS target_id, CASE coalesce(n, 0) WHEN 1 THEN 'linked' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status FROM r LEFT JOIN g ON g.key = r.key""")
def reference_links(spark, d):
    refs = tables.read(spark, d, "supplier").selectExpr("concat('s', s_suppkey) AS source_id", "concat('NATION_', s_nationkey + 5 * (s_suppkey % 2)) AS key")
    n = tables.read(spark, d, "nation")
    return trees.resolve_references(refs, n.selectExpr("concat('n', n_nationkey) AS node_id", "n_name AS key").union(n.filter("n_nationkey < 4").selectExpr("concat('x', n_nationkey)", "n_name")))


@query("""WITH t AS (SELECT c_custkey AS node_id, CASE WHEN c_custkey % 7 = 0 THEN 1000000000 ELSE c_nationkey END AS parent_id, c_custkey % 40 AS s, 1 + (c_custkey % 11 = 0)::INTEGER AS depth FROM customer)
SELECT node_id, 'missing_parent' AS problem FROM t WHERE parent_id = 1000000000 UNION ALL SELECT node_id, 'wrong_depth' FROM t WHERE parent_id <> 1000000000 AND depth <> 1
UNION ALL SELECT node_id, 'duplicate_sequence' FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, s ORDER BY node_id) AS n FROM t) WHERE n > 1""")
def hierarchy_problems(spark, d):
    c = tables.read(spark, d, "customer").selectExpr("c_custkey AS node_id", "CAST(CASE WHEN c_custkey % 7 = 0 THEN 1000000000 ELSE c_nationkey END AS BIGINT) AS parent_id", "CAST(c_custkey % 40 AS INT) AS sequence_no", "CAST(1 + int(c_custkey % 11 = 0) AS INT) AS depth")
    n = tables.read(spark, d, "nation").selectExpr("-1 - CAST(n_nationkey AS BIGINT) AS node_id", "CAST(NULL AS BIGINT) AS parent_id", "n_nationkey AS sequence_no", "0 AS depth")
    return trees.problems(c.withColumn("parent_id", F.expr("CASE WHEN parent_id = 1000000000 THEN 1000000000 ELSE -1 - parent_id END")).unionByName(n))


@query("SELECT o_custkey AS user_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS period_id, max(o_orderdate) AS period_start, max(o_orderdate) + INTERVAL 1 MONTH AS period_end FROM orders GROUP BY 1")
def latest_period_per_user(spark, d):
    return metering.latest(tables.periods(spark, d), "user_id", [F.desc("period_start"), F.desc("period_id")])


@query("SELECT o_orderkey AS period_id, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS month_end, o_orderdate + INTERVAL 14 DAY AS trial_end FROM orders")
def calendar_month(spark, d):
    first, last = numbers.month_window(F.col("period_start"))
    return tables.periods(spark, d).select("period_id", first.alias("month_start"), last.alias("month_end"), F.expr("period_start + INTERVAL 14 DAYS").alias("trial_end"))


@query(f"SELECT user_id, activity, count(*) AS calls, sum(cost)::DECIMAL(20,10) AS cost FROM ({USAGE}) GROUP BY ALL")
def usage_summary(spark, d):
    return metering.usage_summary(tables.usage_events(spark, d))


@query(f"SELECT user_id, count(*) FILTER (activity = 'click') AS n_click, count(*) FILTER (activity = 'view') AS n_view, sum(cost)::DECIMAL(20,10) AS cost FROM ({USAGE}) GROUP BY 1")
def filtered_usage(spark, d):
    return metering.filtered_usage(tables.usage_events(spark, d), ["click", "view"])


@query(f"""WITH e AS ({USAGE}), u AS (SELECT user_id, sum(cost) AS used FROM e WHERE event_id % 3 <> 0 GROUP BY 1), h AS (SELECT user_id, sum(cost) AS held FROM e WHERE event_id % 3 = 0 GROUP BY 1),
r AS (SELECT coalesce(u.user_id, h.user_id) AS user_id, coalesce(used, 0)::DECIMAL(20,10) AS used, coalesce(held, 0)::DECIMAL(20,10) AS held FROM u FULL JOIN h ON u.user_id = h.user_id)
SELECT *, least(100.0, round_even(used::DOUBLE / 2000 * 100, 2)) AS percent, used >= 2000 AS blocked, used + held + 100 <= 2000 AS admitted FROM r""")
def admission_check(spark, d):
    e = tables.usage_events(spark, d)
    return metering.admission(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0"), 2000, 100)


COST_MODELS = ["gpt-5-mini", "gpt-6.1-sol-2026-01-01", "gpt-5.6-terra", "text-embedding-3-small", "other"]


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, ['gpt-5-mini', 'gpt-6.1-sol-2026-01-01', 'gpt-5.6-terra', 'text-embedding-3-small', 'other'][1 + l_partkey % 5] AS model, (l_quantity * 10000)::BIGINT AS i, (l_quantity * 10)::BIGINT AS k, (l_quantity * 20)::BIGINT AS o FROM lineitem),
r AS (SELECT *, CASE model WHEN 'gpt-5-mini' THEN 0.25 WHEN 'other' THEN NULL WHEN 'text-embedding-3-small' THEN 0.02 ELSE 2.0 END::DECIMAL(10,4) AS a, CASE model WHEN 'gpt-5-mini' THEN 0.025 WHEN 'gpt-5.6-terra' THEN 0.2 WHEN 'text-embedding-3-small' THEN 0.02 WHEN 'other' THEN NULL ELSE 0.10 END::DECIMAL(10,4) AS b,
 CASE model WHEN 'gpt-5-mini' THEN 2.0 WHEN 'gpt-5.6-terra' THEN 12.0 WHEN 'text-embedding-3-small' THEN 0 WHEN 'other' THEN NULL ELSE 10.0 END::DECIMAL(10,4) AS c, CASE WHEN i > 272000 AND (model LIKE 'gpt-5.6-%' OR model LIKE 'gpt-6.1-sol%') THEN 2 ELSE 1 END AS m FROM c)
SELECT l_orderkey, l_linenumber, model, round((((i - k) * a * m + k * b * m + o * c * CASE m WHEN 2 THEN 1.5 ELSE 1.0 END)::DOUBLE / 1000000), 10) AS cost FROM r""")
def ai_cost(spark, d):
    rows = tables.read(spark, d, "lineitem").withColumn("model", F.get(F.array(*map(F.lit, COST_MODELS)), (F.col("l_partkey") % 5).cast("int")))
    part = lambda n: (F.col("l_quantity") * n).cast("long")
    return rows.select("l_orderkey", "l_linenumber", "model", F.round(numbers.token_cost(F.col("model"), part(10000), part(10), part(20)).cast("double"), 10).alias("cost"))


@query(f"""WITH p AS (SELECT o_custkey AS user_id, o_orderkey AS period_id, o_orderdate AS s, o_orderdate + INTERVAL 1 MONTH AS t FROM orders), e AS ({USAGE})
SELECT p.user_id, p.period_id, coalesce(sum(cost) FILTER (ts >= s AND ts < t), 0)::DECIMAL(20,10) AS cost FROM p LEFT JOIN e ON e.user_id = p.user_id GROUP BY ALL""")
def period_usage(spark, d):
    return metering.period_usage(tables.usage_events(spark, d), tables.periods(spark, d))


HOLDS = """WITH e AS (SELECT l_orderkey AS reservation_id, l_linenumber AS seq, CASE WHEN l_linenumber = 1 THEN 'held' ELSE ['completed', 'missing', 'rejected', 'error', 'held', 'ping'][1 + l_partkey % 6] END AS event FROM lineitem),
h AS (SELECT reservation_id, min(seq) AS h FROM e WHERE event = 'held' GROUP BY 1), f AS (SELECT h.reservation_id, min_by(event, (seq, event)) FILTER (event IN ('completed', 'missing', 'rejected', 'error') AND (seq, event) > (h, 'held')) AS x FROM h JOIN e ON e.reservation_id = h.reservation_id GROUP BY 1)
SELECT reservation_id, CASE x WHEN 'completed' THEN 'settled' WHEN 'rejected' THEN 'released' WHEN 'missing' THEN 'uncertain' WHEN 'error' THEN 'uncertain' ELSE 'held' END AS state, (x IS NULL OR x IN ('missing', 'error')) AS open FROM f"""


@query(HOLDS)
def open_holds(spark, d):
    return metering.open_holds(_hold_events(tables.read(spark, d, "lineitem")))


def _hold_events(lines):
    kinds = F.get(F.array(*map(F.lit, ["completed", "missing", "rejected", "error", "held", "ping"])), (F.col("l_partkey") % 6).cast("int"))
    return lines.select(F.col("l_orderkey").alias("reservation_id"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_linenumber") == 1, "held").otherwise(kinds).alias("event"))


@query("SELECT doc_id AS document_id, generate_subscripts(l, 1)::INTEGER AS page_number, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def page_split(spark, d):
    return tables.doc_pages(spark, d)


TOKENS = "list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, len(t), 400)) AS s FROM t)
SELECT doc_id, (s / 400)::INTEGER + 1 AS chunk_number, s::INTEGER AS start, len(t[s + 1:s + 500])::INTEGER AS token_count, array_to_string(t[s + 1:s + 500], ' ') AS text FROM w""")
def token_windows(spark, d):
    return documents.token_windows(tables.read(spark, d, "documents"), "doc_id")


PAGES = "SELECT doc_id, source AS owner, generate_subscripts(l, 1) AS page, unnest(l) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)"


def _pages(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", F.col("source").alias("owner"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return docs.select("doc_id", "owner", (F.col("p") + 1).alias("page"), "text")


@query(f"""WITH p AS ({PAGES}), k AS (SELECT *, row_number() OVER (PARTITION BY owner, lower(trim(regexp_replace(text, '[ \\t\\r\\f\\x0B]+', ' ', 'g'))) ORDER BY doc_id, page) AS n FROM p) SELECT doc_id, page, owner FROM k WHERE n = 1""")
def content_dedup(spark, d):
    return retrieval.first_wins(_pages(spark, d), ["owner", F.lower(text.collapse(F.col("text")))], ["doc_id", "page"]).select("doc_id", "page", "owner")


@query(f"""WITH p AS ({PAGES}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY page) AS n FROM p) SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY page))::INTEGER AS new_number FROM k WHERE n = 1""")
def chunk_dedup(spark, d):
    return documents.dedup_exact(_pages(spark, d), ["doc_id", "text"], "page", "doc_id").select("doc_id", "page", "new_number")


@query(f"""WITH p AS ({PAGES}), r AS (SELECT doc_id, page, text AS body FROM p WHERE length(text) > 0), j AS (SELECT a.doc_id, a.page, b.page AS owner, row_number() OVER (PARTITION BY a.doc_id, a.page ORDER BY length(b.body) DESC, b.page) AS n FROM r a JOIN r b ON a.doc_id = b.doc_id AND contains(b.body, a.body)) SELECT doc_id, page, owner::INTEGER AS owner FROM j WHERE n = 1""")
def context_reuse(spark, d):
    rows = _pages(spark, d).filter("length(text) > 0").select("doc_id", F.col("text").alias("body"), "page")
    return documents.context_owner(rows, ["doc_id"], "page")


@query(f"""WITH t AS (SELECT owner, len({TOKENS}) AS n FROM ({PAGES})) SELECT owner, min(n)::INTEGER AS low, floor(median(n))::BIGINT AS median, max(n)::INTEGER AS high, round(avg(n), 4) AS mean, sum(n)::BIGINT AS total FROM t GROUP BY 1""")
def page_token_median(spark, d):
    return documents.page_median(_pages(spark, d).select("owner", F.size(text.tokens(F.col("text"))).alias("n")), "n", ["owner"])


@query(f"""WITH p AS (SELECT owner, len({TOKENS}) AS tokens FROM ({PAGES})), m AS (SELECT owner, greatest(1, floor(median(tokens)))::INTEGER AS low, greatest(1, max(tokens))::INTEGER AS high, count(*) AS total FROM p GROUP BY 1),
t AS (SELECT owner, high, total, unnest(range(low, high + 1)) AS size FROM m), c AS (SELECT owner, tokens, count(*) AS n FROM p GROUP BY ALL),
x AS (SELECT t.owner, any_value(high) AS high, any_value(total) AS total, size, sum(ceil(tokens / size) * n) AS chunks, sum(CASE WHEN ceil(tokens / size) > 2 THEN n ELSE 0 END) AS many FROM t JOIN c ON c.owner = t.owner GROUP BY t.owner, size)
SELECT owner, coalesce(min(size) FILTER (chunks < 2 * total AND many <= floor(total / 10)), max(high))::INTEGER AS size FROM x GROUP BY 1""")
def chunk_size_recommend(spark, d):
    return documents.recommend_size(_pages(spark, d).select("owner", F.size(text.tokens(F.col("text"))).alias("tokens")))


@query(f"""SELECT owner, regexp_replace(lower(trim(regexp_replace(text, '[ \\t\\r\\f\\x0B]+', ' ', 'g'))), '\\b\\d+\\b', '#', 'g') AS signature, count(DISTINCT page) AS pages FROM ({PAGES}) WHERE trim(text) <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 3""")
def routine_lines(spark, d):
    return documents.routine_lines(_pages(spark, d))


@query("SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER w AS next_start FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def scope_lead(spark, d):
    return documents.next_boundary(tables.read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate", F.col("end.o_orderdate").alias("next_start"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM orders) WHERE o_orderdate < floor")
def order_violations(spark, d):
    return documents.order_violations(tables.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal NULLS LAST, c_custkey) - 1 AS new_sequence FROM customer")
def sibling_resequence(spark, d):
    return documents.resequenced(tables.read(spark, d, "customer"), "c_nationkey", [F.asc_nulls_last("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", F.col("new_sequence").cast("long").alias("new_sequence"))


@query("SELECT l_orderkey, md5(string_agg(l_partkey || '|' || l_suppkey || '|' || l_returnflag, chr(10) ORDER BY l_partkey || '|' || l_suppkey || '|' || l_returnflag)) AS fingerprint, count(*) AS n FROM lineitem GROUP BY 1")
def table_fingerprint(spark, d):
    return documents.fingerprint(tables.read(spark, d, "lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_returnflag"])


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS y FROM supplier GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, greatest(0, coalesce(x, 0) - coalesce(y, 0)) AS missing, greatest(0, coalesce(y, 0) - coalesce(x, 0)) AS extra FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(x, 0) <> coalesce(y, 0)""")
def multiset_diff(spark, d):
    return documents.multiset_difference(tables.read(spark, d, "customer").selectExpr("c_nationkey AS k"), tables.read(spark, d, "supplier").selectExpr("s_nationkey AS k"), ["k"])


@query("SELECT p_partkey, round(len(list_intersect(w, q)) / len(w), 6) AS share FROM (SELECT p_partkey, list_distinct(string_split(lower(p_type), ' ')) AS w, ['promo', 'standard', 'tin', 'steel'] AS q FROM part)")
def set_overlap(spark, d):
    return tables.read(spark, d, "part").select("p_partkey", F.round(text.overlap(F.array_distinct(F.split(F.lower("p_type"), " ")), F.array(*map(F.lit, ["promo", "standard", "tin", "steel"]))), 6).alias("share"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name || ' / ' || p_brand), '[a-z0-9]+'), ' ') AS normalized, regexp_replace(p_brand || ' (new) ..', '[^A-Za-z0-9._-]+', '_', 'g').trim('._') AS folder, lower(regexp_replace(p_type, '\\s+', '', 'g')) AS compacted, regexp_replace(lower(p_name), '\\b\\d+\\b', '#', 'g') AS signature FROM part")
def text_keys(spark, d):
    p = tables.read(spark, d, "part")
    return p.select("p_partkey", text.normalize_text(F.concat_ws(" / ", "p_name", "p_brand")).alias("normalized"), text.safe_name(F.concat("p_brand", F.lit(" (new) .."))).alias("folder"), text.compact(F.col("p_type")).alias("compacted"), text.line_signature(F.col("p_name")).alias("signature"))


@query("WITH k AS (SELECT conv_id, turn FROM conversations WHERE turn >= 2) SELECT conv_id, turn, (SELECT count(*) FROM k x WHERE x.conv_id = c.conv_id) > 0 AS stays FROM conversations c")
def retention_purge(spark, d):
    c = tables.read(spark, d, "conversations")
    at = F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, CAST(turn AS INT))")
    m = c.select(F.col("conv_id").alias("conversation_id"), "turn", at.alias("created_at"))
    _, kept = metering.purge(m, m.groupBy("conversation_id").agg(F.min("created_at").alias("created_at")), dt.datetime(2024, 1, 3))
    return c.select("conv_id", "turn").join(kept.select(F.col("conversation_id").alias("conv_id"), F.lit(True).alias("stays")), "conv_id", "left").select("conv_id", "turn", F.coalesce("stays", F.lit(False)).alias("stays"))


@query("""WITH a AS (SELECT c_custkey AS u, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AS sub, ['active', 'none', 'canceled', 'past_due', 'trialing'][1 + c_custkey % 5] AS st, c_custkey % 2 = 0 AS cancels FROM customer),
o AS (SELECT o_custkey AS u, o_orderkey % 4 AS sub, o_orderstatus AS st, o_orderdate + INTERVAL 1 MONTH AS e FROM orders), p AS (SELECT u, max(e) FILTER (st = 'O') AS paid, bool_or(st = 'F') AS review FROM o GROUP BY 1), s AS (SELECT u, sub, max(e) AS e FROM o GROUP BY 1, 2),
x AS (SELECT a.*, CASE WHEN a.sub IS NULL OR a.st IN ('none', 'canceled') THEN paid END AS pass, s.e, review FROM a LEFT JOIN p ON p.u = a.u LEFT JOIN s ON s.u = a.u AND s.sub = a.sub)
SELECT u AS user_id, CASE WHEN pass > TIMESTAMP '1997-01-01' THEN 'pass_active' WHEN pass IS NOT NULL THEN 'pass_expired' ELSE st END AS status, CASE WHEN pass IS NULL THEN 'subscription' ELSE 'fpx' END AS access_type, pass IS NULL AND cancels AS cancels, coalesce(pass, e) AS period_end, coalesce(review, false) AS payment_review FROM x""")
def billing_status(spark, d):
    a = tables.read(spark, d, "customer").selectExpr("c_custkey AS user_id", "CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AS subscription_id", "element_at(array('active', 'none', 'canceled', 'past_due', 'trialing'), int(1 + c_custkey % 5)) AS subscription_status", "c_custkey % 2 = 0 AS cancel_at_period_end")
    o = tables.read(spark, d, "orders").selectExpr("o_custkey AS user_id", "o_orderkey % 4 AS subscription_id", "CASE o_orderstatus WHEN 'O' THEN 'paid' WHEN 'F' THEN 'review' ELSE 'open' END AS status", "CAST(o_orderdate AS TIMESTAMP) AS period_start", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MONTH AS period_end")
    return metering.billing_status(a, o, o, dt.datetime(1997, 1, 1))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1995-06-01' THEN 'failed' ELSE o_orderstatus END AS status FROM orders")
def stale_processing(spark, d):
    o = tables.read(spark, d, "orders")
    late = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp"))
    return rewrites.update(o, late, {"o_orderstatus": F.lit("failed")}).select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("WITH c AS (SELECT c_custkey, c_name, 0 AS v, 0 AS s FROM customer UNION ALL SELECT c_custkey + 100, 'new ' || c_name, c_custkey % 3, 1 FROM customer) SELECT c_custkey, c_name, v FROM c QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC, s DESC) = 1")
def upsert_latest(spark, d):
    c = tables.read(spark, d, "customer")
    return rewrites.upsert(c.selectExpr("c_custkey", "c_name", "0L AS v"), c.selectExpr("c_custkey + 100 AS c_custkey", "concat('new ', c_name) AS c_name", "c_custkey % 3 AS v"), ["c_custkey"], "v")


@query("SELECT s_suppkey AS k FROM supplier UNION ALL SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_absent(spark, d):
    return rewrites.insert_absent(tables.read(spark, d, "supplier").selectExpr("s_suppkey AS k"), tables.read(spark, d, "customer").selectExpr("c_custkey AS k"), ["k"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, d):
    o = tables.read(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return rewrites.cascade_delete(o, tables.read(spark, d, "lineitem"), "l_orderkey", "o_orderstatus = 'F'")[1].select("l_orderkey", "l_linenumber")


BOX = "doc_id // 20 AS page, doc_id AS id, (doc_id * 37 % 100)::DOUBLE AS x0, (doc_id * 53 % 100)::DOUBLE AS y0, (doc_id * 37 % 100 + 12)::DOUBLE AS x1, (doc_id * 53 % 100 + 9)::DOUBLE AS y1"


@query(f"WITH b AS (SELECT {BOX} FROM documents) SELECT a.page, a.id AS a_id, b.id AS b_id FROM b a JOIN b ON a.page = b.page AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0 AND a.id < b.id")
def bbox_overlap(spark, d):
    # boxes are made from ids, up to 20 on a page
    b = tables.read(spark, d, "documents").selectExpr("doc_id div 20 AS page", "doc_id AS id", "double(doc_id * 37 % 100) AS x0", "double(doc_id * 53 % 100) AS y0", "double(doc_id * 37 % 100 + 12) AS x1", "double(doc_id * 53 % 100 + 9) AS y1")
    return grids.overlaps(b, b, "page").filter("a_id < b_id")


@query("""WITH n AS (SELECT c_nationkey AS grp, c_custkey AS node_id, 1 + c_custkey % 3 AS depth, c_custkey % 50 AS node_start, c_custkey % 50 + 10 + 5 * (c_custkey % 4) AS node_end FROM customer), r AS (SELECT s_nationkey AS grp, s_suppkey AS range_id, s_suppkey % 40 + 5 AS start, s_suppkey % 40 + 8 AS stop FROM supplier),
h AS (SELECT r.grp, range_id, node_id, rank() OVER (PARTITION BY r.grp, range_id ORDER BY depth DESC, node_end - node_start) AS k FROM r JOIN n ON n.grp = r.grp AND node_start <= start AND node_end >= stop) SELECT grp, range_id, CASE WHEN count(*) = 1 THEN min(node_id) END AS node_id, count(*) AS ties FROM h WHERE k = 1 GROUP BY ALL""")
def range_parent(spark, d):
    n = tables.read(spark, d, "customer").selectExpr("c_nationkey AS grp", "c_custkey AS node_id", "1 + c_custkey % 3 AS depth", "c_custkey % 50 AS node_start", "c_custkey % 50 + 10 + 5 * (c_custkey % 4) AS node_end")
    r = tables.read(spark, d, "supplier").selectExpr("s_nationkey AS grp", "s_suppkey AS range_id", "s_suppkey % 40 + 5 AS start", "s_suppkey % 40 + 8 AS end")
    return grids.range_parent(r, n, "grp")


FRAGMENTS = [(1, 1, 1, 0.1, 0.9, [0.1, 0.5, 0.9], "A B"), (1, 2, 1, 0.1, 0.95, [0.1, 0.505, 0.9], "a b"), (1, 3, 1, 0.1, 0.5, [0.1, 0.3, 0.7], "A B"), (1, 5, 1, 0.1, 0.9, [0.1, 0.3, 0.7], "A B"), (1, 6, 1, 0.12, 0.6, [0.1, 0.3, 0.7], "A B"), (1, 6, 2, 0.7, 0.9, [0.1, 0.3, 0.7], "A B")]


@query("SELECT * FROM (VALUES (1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 2), (1, 5, 1, 3), (1, 6, 1, 3), (1, 6, 2, 4)) AS t(document_id, page, table_number, logical)")
def table_merge(spark, d):
    f = spark.createDataFrame(FRAGMENTS, "document_id int, page int, table_number int, top double, bottom double, edges array<double>, header string")
    return grids.merged(f).select("document_id", "page", "table_number", "logical")


@query("""WITH r AS (SELECT doc_id AS table_id, row_number, list_filter(list_transform(string_split(line, ' '), lambda x, i: {'c': i, 'v': trim(x)}), lambda x: x.v <> '') AS c FROM (SELECT doc_id, generate_subscripts(l, 1) AS row_number, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
SELECT table_id, row_number::INTEGER AS row_number, 'Row ' || row_number || ': ' || array_to_string(list_transform(c, lambda x: 'column ' || x.c || ': ' || x.v), '; ') AS text FROM r WHERE len(c) > 0""")
def table_text(spark, d):
    rows = tables.read(spark, d, "documents").select(F.col("doc_id").alias("table_id"), F.transform(F.split("text", "\n"), lambda x: F.split(x, " ")).alias("rows"))
    return grids.table_text(grids.cells(rows))


@query("""WITH r AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN [role] ELSE [role, string_split(coalesce(text, ''), ' ')[1]] END AS p FROM conversations),
d AS (SELECT conv_id, role, 'D' || row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS document_label FROM r GROUP BY 1, 2),
x AS (SELECT conv_id, role, turn, 1 AS n, p[1:1] AS q FROM r UNION ALL SELECT conv_id, role, turn, 2, p FROM r WHERE len(p) > 1),
h AS (SELECT conv_id, role, q, 'H' || row_number() OVER (PARTITION BY conv_id ORDER BY min(turn * 10 + n)) AS hierarchy FROM x GROUP BY 1, 2, 3)
SELECT r.conv_id, r.turn, 'E' || row_number() OVER (PARTITION BY r.conv_id ORDER BY r.turn) AS evidence, document_label, h.hierarchy, u.hierarchy AS parent
FROM r JOIN d ON d.conv_id = r.conv_id AND d.role = r.role JOIN h ON h.conv_id = r.conv_id AND h.role = r.role AND h.q = r.p LEFT JOIN h u ON u.conv_id = r.conv_id AND u.role = r.role AND len(r.p) > 1 AND u.q = r.p[1:1]""")
def context_legend(spark, d):
    rows = tables.read(spark, d, "conversations").withColumn("path", F.when(F.col("turn") % 3 == 0, F.array("role")).otherwise(F.array("role", F.split(F.coalesce("text", F.lit("")), " ")[0])))
    return documents.context_labels(rows, "conv_id", "turn", "role", "path")


@query("""WITH c AS (SELECT *, row_number() OVER w AS n, lag(l_suppkey) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey)), k AS (SELECT p_partkey FROM part WHERE p_size <= 25)
SELECT l_orderkey, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM k)) AS invalid_nodes, bool_and(l_linenumber = n) AS sequential, bool_and(b IS NULL OR b <= l_suppkey) AS pages_in_order FROM c GROUP BY 1""")
def chunk_violations(spark, d):
    parts = tables.read(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return documents.chunk_problems(tables.read(spark, d, "lineitem"), parts, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], "l_linenumber", "l_suppkey", "l_partkey")


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS ln, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS i FROM lineitem), n AS (SELECT o, count(*) AS n FROM l GROUP BY 1), x AS (SELECT o_orderkey AS o, n, 2 + o_orderkey % 2 AS w FROM orders LEFT JOIN n ON n.o = o_orderkey)
SELECT o AS document_id, problem FROM (SELECT o, 'missing' AS problem FROM x WHERE n IS NULL UNION ALL SELECT o, unnest(['column_count', 'headings']) FROM x WHERE n IS NOT NULL AND w <> 2 UNION ALL SELECT o, 'row_count' FROM x WHERE n <> 4
UNION ALL SELECT l.o, 'row ' || i || ': number' FROM l WHERE ln <> i UNION ALL SELECT l.o, 'row ' || i || ': cells' FROM l JOIN x USING (o) WHERE w <> 2 UNION ALL SELECT l.o, 'row ' || i || ': pages outside' FROM l WHERE ln > 4)""")
def table_matrix_problems(spark, d):
    o = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("position"), F.col("o_orderkey").cast("string").alias("table_id"), F.lit("lines").alias("title"), F.lit(1).alias("start_page"), F.lit(4).alias("end_page"), (F.col("o_orderkey") % 2 + 2).cast("int").alias("column_count"), F.lit(4).alias("data_row_count"))
    rows = tables.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("r"))
    shape = F.transform("r", lambda x: F.struct(x["l_linenumber"].alias("row_number"), F.array(x["l_returnflag"], x["l_linestatus"]).alias("cells"), F.array(x["l_linenumber"]).alias("source_pages")))
    t = rows.select("document_id", F.lit(0).alias("position"), F.col("document_id").cast("string").alias("table_id"), F.lit("lines").alias("title"), F.lit(1).alias("start_page"), F.lit(4).alias("end_page"), F.lit(2).alias("column_count"), F.array(F.lit("flag"), F.lit("status")).alias("columns"), F.size("r").alias("row_count"), shape.alias("rows"))
    return grids.matrix_problems(o, t).select("document_id", "problem")


BOXES = [(1, 0.0, 0.0, 10.0, 5.0), (1, 10.0, 0.0, 30.05, 5.0), (1, 0.0, 5.0, 30.0, 9.0), (2, 0.0, 0.0, 12.0, 4.0), (2, 12.0, 0.0, 30.0, 4.0), (3, 0.0, 0.0, 8.0, 4.0), (3, 8.0, 0.0, 16.0, 4.0), (3, 16.0, 0.0, 30.0, 4.0), (4, 0.0, 1.0, 8.0, 3.0), (4, 8.0, 1.0, 16.0, 3.0), (4, 16.0, 1.0, 30.0, 3.0)]


@query("SELECT * FROM (VALUES (1, NULL), (2, true), (3, false), (4, true)) AS t(fragment_id, compatible)")
def row_span_match(spark, d):
    s = grids.row_spans(spark.createDataFrame(BOXES, "fragment_id int, x0 double, y0 double, x1 double, y1 double"))
    before = F.lag("spans").over(Window.partitionBy("document_id").orderBy("fragment_id"))
    s = s.withColumn("document_id", F.lit(1)).withColumn("before", before)
    return s.select("fragment_id", F.when(F.col("before").isNotNull(), grids.rows_compatible(F.col("before"), F.col("spans"))).alias("compatible"))


@query("""WITH n AS (SELECT c_nationkey AS document_id, 'c' || c_custkey AS node_id, CASE WHEN c_custkey > 50 THEN 'c' || (c_custkey - 25) END AS parent_id, 1 + c_custkey % 3 AS depth, c_custkey % 7 AS sequence_no, c_custkey % 50 AS start_page, c_custkey % 50 + 10 + 5 * (c_custkey % 4) AS end_page FROM customer),
r AS (SELECT s_nationkey AS document_id, s_suppkey AS t, s_suppkey % 40 + 5 AS a, s_suppkey % 40 + 8 AS b FROM supplier), h AS (SELECT r.*, node_id, depth, rank() OVER (PARTITION BY r.document_id, t ORDER BY depth DESC, end_page - start_page) AS k FROM r JOIN n ON n.document_id = r.document_id AND start_page <= a AND end_page >= b),
f AS (SELECT document_id, t, a, b, min(node_id) AS parent_id, min(depth) AS depth FROM h WHERE k = 1 GROUP BY ALL HAVING count(*) = 1), u AS (SELECT document_id, node_id, parent_id, 'SECTION' AS node_type, depth, sequence_no, start_page, end_page FROM n
UNION ALL SELECT document_id, document_id || ':' || t || ':' || a || ':' || b, parent_id, 'TABLE', depth + 1, 0, a, b FROM f)
SELECT document_id, node_id, parent_id, node_type, depth, CASE WHEN (document_id, parent_id) IN (SELECT document_id, parent_id FROM f) THEN row_number() OVER (PARTITION BY document_id, parent_id ORDER BY start_page, sequence_no, node_id) - 1 ELSE sequence_no END AS sequence_no, start_page, end_page FROM u""")
def standalone_tables(spark, d):
    n = tables.read(spark, d, "customer").selectExpr(
        "c_nationkey AS document_id", "concat('c', c_custkey) AS node_id", "CASE WHEN c_custkey > 50 THEN concat('c', c_custkey - 25) END AS parent_id", "'SECTION' AS node_type", "1 + c_custkey % 3 AS depth", "c_custkey % 7 AS sequence_no", "c_custkey % 50 AS start_page", "CAST(NULL AS INT) AS start_character", "c_custkey % 50 + 10 + 5 * (c_custkey % 4) AS end_page"
    )
    t = tables.read(spark, d, "supplier").selectExpr("s_nationkey AS document_id", "s_suppkey AS table_id", "s_suppkey % 40 + 5 AS start_page", "s_suppkey % 40 + 8 AS end_page")
    return grids.with_standalone_tables(n, t)[0].drop("start_character")


@query()
def flatten_tree(spark, d):
    n, r = tables.read(spark, d, "nation"), tables.read(spark, d, "region")
    kids = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.lit("SECTION").alias("type"), F.col("n_nationkey").cast("string").alias("identifier"), F.col("n_name").alias("title")))).alias("children"))
    tree = r.join(kids, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").cast("long").alias("document_id"), F.to_json(F.struct(F.lit("PART").alias("type"), F.col("r_name").alias("title"), "children")).alias("hierarchy"))
    return trees.flatten(tree)


@query()
def page_map_forward(spark, d):
    p = tables.doc_pages(spark, d)
    nodes = p.filter("trim(text) <> ''").select("document_id", F.col("page_number").cast("int").alias("position"), F.concat_ws(":", "document_id", "page_number").alias("node_id"), F.substring_index("text", " ", 3).alias("title"), F.col("page_number").cast("int").alias("page_hint"))
    return trees.map_pages_forward(nodes, p)


def _streamed(spark, d, f, name, mode="append"):
    return usage.run_once(f, name, mode)


def _events_alone(spark, d):
    return usage.EVENTS, spark.readStream.schema(usage.EVENTS).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_idempotent(spark, d):
    return _streamed(spark, d, usage.idempotent(_events_alone(spark, d)[1]).select("event_id", "user_id", "event_type"), "stream_idempotent")


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, user_id, count(*) AS n, sum(value::DECIMAL(20,10))::DECIMAL(30,10) AS cost FROM events GROUP BY ALL")
def stream_usage_window(spark, d):
    return _streamed(spark, d, usage.window_totals(_events_alone(spark, d)[1]), "stream_usage_window", "complete").select(F.col("window.start").alias("start"), "user_id", "n", "cost")


@query(f"SELECT reservation_id, state FROM ({HOLDS})")
def stream_holds(spark, d):
    lines = spark.readStream.schema(tables.read(spark, d, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    return usage.holds(_hold_events(lines), "stream_holds")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import indexing, layouts, profiling, repairing, tabling  # noqa: E402, F401  (register their queries)
