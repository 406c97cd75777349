"""Queries of scopes, references, validators, caches and accounts, with their SQL. Small cases that the driver's tables don't hold stand as VALUES, the same for both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import accounts, caches, references, scopes, trees
from ..sources import tables
from .queries import query


def _fixture(spark, columns: str, values: str):
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def _anchors(spark, d):
    """An anchor on every third line that has a word, named by its first word, behind which it begins on every sixth."""
    p = tables.doc_pages(spark, d).filter("page_number % 3 = 1 AND trim(split(text, ' ')[0]) <> ''")
    return p.selectExpr("document_id", "concat(document_id, ':', page_number) AS node_id", "CASE WHEN page_number % 15 = 1 AND page_number > 1 THEN 'TABLE' ELSE 'SECTION' END AS node_type", "CAST(NULL AS STRING) AS identifier", "split(text, ' ')[0] AS title", "CAST(page_number AS INT) AS start_page", "CAST(CASE WHEN page_number % 6 = 4 THEN 1 ELSE 0 END AS INT) AS start_character")


PAGES = "p AS (SELECT doc_id AS document_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_number, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"
SCOPES = f"""{PAGES}, n AS (SELECT document_id, document_id || ':' || page_number AS node_id, string_split(text, ' ')[1] AS title, page_number AS start_page, CASE WHEN page_number % 6 = 4 THEN 1 ELSE 0 END AS start_character
 FROM p WHERE page_number % 3 = 1 AND trim(string_split(text, ' ')[1]) <> '' AND NOT (page_number % 15 = 1 AND page_number > 1)),
l AS (SELECT document_id, max(page_number) AS lp, max_by(length(text), page_number) AS ln FROM p GROUP BY 1),
b AS (SELECT n.*, coalesce(lead(start_page) OVER w, lp) AS end_page, coalesce(lead(start_character) OVER w, ln) AS end_character FROM n JOIN l USING (document_id) WINDOW w AS (PARTITION BY document_id ORDER BY start_page, start_character)),
s AS (SELECT b.document_id, b.node_id, any_value(b.title) AS title, any_value(b.start_page) AS start_page, any_value(b.start_character) AS start_character, any_value(b.end_page) AS end_page, any_value(b.end_character) AS end_character,
 string_agg(CASE WHEN page_number = start_page AND page_number = end_page THEN substr(text, start_character + 1, end_character - start_character) WHEN page_number = start_page THEN substr(text, start_character + 1) WHEN page_number = end_page THEN substr(text, 1, end_character) ELSE text END, chr(10) ORDER BY page_number) AS text
 FROM b JOIN p ON p.document_id = b.document_id AND page_number BETWEEN start_page AND end_page WHERE (end_page, end_character) > (start_page, start_character) GROUP BY 1, 2)"""


def _scopes(spark, d):
    pages = tables.doc_pages(spark, d)
    return scopes.scope_texts(scopes.scope_bounds(_anchors(spark, d), pages), pages)


@query(f"WITH {SCOPES} SELECT document_id, node_id, start_page, start_character, end_page, end_character, md5(text) AS text FROM s")
def scope_text(spark, d):
    return _scopes(spark, d).select("document_id", "node_id", "start_page", "start_character", "end_page", "end_character", F.md5("text").alias("text"))


@query(f"""WITH {SCOPES}, k AS (SELECT * FROM s WHERE lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <> lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))))
SELECT document_id, node_id, row_number() OVER (PARTITION BY document_id ORDER BY start_page, start_character) AS chunk_number, start_page AS page_number, array_to_string(range(start_page, CASE WHEN end_character > 0 THEN end_page ELSE greatest(start_page, end_page - 1) END + 1), ',') AS page_numbers FROM k""")
def scope_chunks(spark, d):
    return scopes.scope_chunks(_scopes(spark, d)).select("document_id", "node_id", "chunk_number", "page_number", F.array_join(F.transform("page_numbers", lambda x: x.cast("string")), ",").alias("page_numbers"))


@query(f"""WITH {SCOPES}, z AS (SELECT *, lower(regexp_replace(text, '\\s+', '', 'g')) AS a, lower(regexp_replace(title, '\\s+', '', 'g')) AS t, lead(start_page) OVER w AS np, lead(start_character) OVER w AS nc FROM s WINDOW w AS (PARTITION BY document_id ORDER BY start_page, start_character))
SELECT document_id, node_id, 'empty' AS problem FROM z WHERE trim(text) = '' UNION ALL SELECT document_id, node_id, 'anchor_mismatch' FROM z WHERE NOT starts_with(a, t) UNION ALL SELECT document_id, node_id, 'boundary' FROM z WHERE np <> end_page OR nc <> end_character""")
def scope_problems(spark, d):
    return scopes.scope_problems(_scopes(spark, d))


MAPPED = "('d', 'r', NULL, 'ROOT', NULL, NULL, 1, NULL, 9), ('d', 'a', 'r', 'SECTION', '1', 'A', 1, 0, 4), ('d', 'b', 'r', 'SECTION', '2', NULL, NULL, 3, 5), ('d', 'c', 'a', 'CLAUSE', '(a)', ' ', 2, 5, 6), ('d', 'e', 'a', 'TABLE', NULL, 'T', 3, 7, 3), ('d', 'f', 'a', 'CLAUSE', ' ', NULL, 3, 2, 3), ('d', 'g', 'r', 'SECTION', '3', 'G', 8, NULL, 7), ('e', 'a', NULL, 'PART', NULL, 'X', 1, 0, NULL)"
MAPPED_COLUMNS = "document_id, node_id, parent_id, node_type, identifier, title, start_page, start_character, end_page"


@query(f"""WITH t({MAPPED_COLUMNS}) AS (VALUES {MAPPED}), r AS (SELECT t.*, u.start_page AS ps, u.end_page AS pe, trim(coalesce(t.title, '')) <> '' OR trim(coalesce(t.identifier, '')) <> '' AS anchor FROM t LEFT JOIN t u ON u.document_id = t.document_id AND u.node_id = t.parent_id)
SELECT document_id, node_id, 'missing_anchor' AS problem FROM r WHERE node_type <> 'TABLE' AND anchor AND (start_page IS NULL OR start_character IS NULL)
UNION ALL SELECT document_id, node_id, 'incomplete_range' FROM r WHERE start_page IS NULL OR end_page IS NULL UNION ALL SELECT document_id, node_id, 'invalid_range' FROM r WHERE end_page < start_page
UNION ALL SELECT document_id, node_id, 'parent_range' FROM r WHERE start_page IS NOT NULL AND end_page IS NOT NULL AND ps IS NOT NULL AND pe IS NOT NULL AND (start_page < ps OR end_page > pe)
UNION ALL SELECT document_id, node_id, 'table_character' FROM r WHERE node_type = 'TABLE' AND start_character IS NOT NULL UNION ALL SELECT document_id, node_id, 'unanchored_character' FROM r WHERE NOT anchor AND node_type <> 'TABLE' AND start_character IS NOT NULL""")
def mapping_problems(spark, d):
    return scopes.mapping_problems(_fixture(spark, MAPPED_COLUMNS, MAPPED))


PROVISIONS = "('act', NULL, 'ACT', ''), ('p1', 'act', 'PART', 'PART I'), ('s1', 'p1', 'SECTION', '1.'), ('s1a', 's1', 'SUBSECTION', '(1)'), ('s1ai', 's1a', 'CLAUSE', '(a)'), ('s1b', 's1', 'SUBSECTION', '(1A)'), ('s2', 'p1', 'SECTION', 'Section 2'), ('s2a', 's2', 'SUBSECTION', '(1)'), ('s3', 'act', 'SECTION', '3'), ('s3x', 'act', 'SECTION', '3.'), ('s4', 'act', 'SECTION', '4')"
CITED = "('s2a', 'SECTION', '1', '(1)(a)'), ('s1b', 'SECTION', 'section 2', NULL), ('s4', 'SECTION', '1.', ' (1) '), ('s2', 'SECTION', '3', NULL), ('s2', 'SECTION', '99', ''), ('s4', 'SECTION', '77', NULL), ('s3', 'SUBSECTION', '(1A)', NULL)"
GRAPH = f"""n(node_id, parent_id, node_type, identifier) AS (VALUES {PROVISIONS}), c(source_id, node_type, identifier, sub_identifier) AS (VALUES {CITED}),
w AS (SELECT node_id AS a, node_id AS b, '' AS path FROM n UNION ALL SELECT w.a, n.node_id, w.path || n.identifier FROM w JOIN n ON n.parent_id = w.b),
x AS (SELECT w.a, w.b, n.node_type AS kind, regexp_replace(lower(regexp_replace(n.identifier, '^(PART|SECTION|CHAPTER|ARTICLE)\\s+', '', 'i')), '[^a-z0-9]', '', 'g') AS base, rtrim(lower(regexp_replace(w.path, '\\s+', '', 'g')), '.') AS child FROM w JOIN n ON n.node_id = w.a),
g AS (SELECT kind, base, child, count(*) AS k, min(b) AS target_id FROM x GROUP BY ALL),
r AS (SELECT c.source_id, c.node_type AS kind, c.identifier, rtrim(lower(regexp_replace(coalesce(c.sub_identifier, ''), '\\s+', '', 'g')), '.') AS child, regexp_replace(lower(regexp_replace(c.identifier, '^(PART|SECTION|CHAPTER|ARTICLE)\\s+', '', 'i')), '[^a-z0-9]', '', 'g') AS base FROM c),
v AS (SELECT r.source_id, r.kind, r.identifier, r.child, CASE WHEN k = 1 THEN target_id END AS target_id, CASE WHEN k = 1 THEN 'linked' WHEN k IS NULL THEN 'missing' ELSE 'ambiguous' END AS status FROM r LEFT JOIN g USING (kind, base, child)),
sc AS (SELECT DISTINCT a FROM w WHERE b IN ('s1b', 's2'))"""


def _graph(spark):
    return _fixture(spark, "node_id, parent_id, node_type, identifier", PROVISIONS), _fixture(spark, "source_id, node_type, identifier, sub_identifier", CITED), _fixture(spark, "node_id", "('s1b'), ('s2')")


@query(f"WITH RECURSIVE {GRAPH} SELECT * FROM v")
def reference_targets(spark, d):
    return references.resolved(*_graph(spark)[:2])


@query(f"""WITH RECURSIVE {GRAPH} SELECT w.b AS linked_id, 'outgoing' AS direction, source_id, target_id FROM v JOIN w ON w.a = v.target_id WHERE status = 'linked' AND source_id IN (SELECT a FROM sc)
UNION ALL SELECT w.b, 'incoming', source_id, target_id FROM v JOIN w ON w.a = v.source_id WHERE status = 'linked' AND target_id IN (SELECT a FROM sc)""")
def reference_following(spark, d):
    return references.followed(*_graph(spark))


@query(f"WITH RECURSIVE {GRAPH} SELECT source_id, identifier, status FROM v WHERE status <> 'linked' AND source_id IN (SELECT a FROM sc)")
def reference_unresolved(spark, d):
    return references.unresolved(*_graph(spark))


@query("""WITH r AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings WHERE vec_id % 4 = 0), k AS (SELECT vec_id AS chunk_id FROM embeddings WHERE label IN (2, 3))
SELECT coalesce(r.chunk_id, k.chunk_id) AS chunk_id, row_number() OVER (ORDER BY place NULLS LAST, coalesce(r.chunk_id, k.chunk_id)) AS place, concat_ws(',', CASE WHEN r.chunk_id IS NOT NULL THEN 'chunk_vector' END, CASE WHEN k.chunk_id IS NOT NULL THEN 'reference_following' END) AS match_types FROM r FULL JOIN k ON r.chunk_id = k.chunk_id""")
def reference_chunks(spark, d):
    chunks = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("node_id"))
    ranked = trees.numbered(chunks.filter("chunk_id % 4 = 0").select("chunk_id"), ["chunk_id"], "place").withColumn("match_types", F.array(F.lit("chunk_vector")))
    return references.linked_chunks(ranked, _fixture(spark, "linked_id", "('2'), ('3'), ('2')"), chunks).withColumn("match_types", F.array_join("match_types", ","))


OLD = "('r', NULL, 'ACT', NULL, 'Act'), ('a', 'r', 'PART', 'I', 'One'), ('a1', 'a', 'SECTION', '1.', 'Name'), ('a2', 'a', 'SECTION', '2', 'Gone'), ('b', 'r', 'PART', 'II', 'Two'), ('b1', 'b', 'SECTION', NULL, 'Twice'), ('c', 'r', 'PART', 'III', 'Three'), ('c1', 'c', 'SECTION', '9', 'Below')"
NEW = "('R', NULL, 'ACT', NULL, 'Act'), ('A', 'R', 'PART', 'i', 'Other'), ('A1', 'A', 'SECTION', '1', 'Renamed'), ('B', 'R', 'PART', NULL, 'TWO'), ('B1', 'B', 'SECTION', NULL, 'twice'), ('B2', 'B', 'SECTION', '7', 'Twice!')"
NODE = "node_id, parent_id, node_type, identifier, title"


@query(f"""WITH RECURSIVE o({NODE}) AS (VALUES {OLD}), n({NODE}) AS (VALUES {NEW}), z AS (SELECT o.node_id AS a, o.parent_id AS pa, n.node_id AS b, n.parent_id AS pb FROM o JOIN n ON o.node_type = n.node_type AND CASE WHEN coalesce(o.identifier, '') <> '' AND coalesce(n.identifier, '') <> ''
 THEN regexp_replace(lower(o.identifier), '[^a-z0-9]', '', 'g') = regexp_replace(lower(n.identifier), '[^a-z0-9]', '', 'g') ELSE regexp_replace(lower(coalesce(o.title, '')), '[^a-z0-9]', '', 'g') = regexp_replace(lower(coalesce(n.title, '')), '[^a-z0-9]', '', 'g') END),
u AS (SELECT *, count(*) OVER (PARTITION BY a, pb) AS k FROM z), m AS (SELECT 'r' AS a, 'R' AS b UNION ALL SELECT u.a, u.b FROM m JOIN u ON u.pa = m.a AND u.pb = m.b AND u.k = 1)
SELECT o.node_id, CASE WHEN max(u.k) > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM m JOIN o ON o.parent_id = m.a LEFT JOIN u ON u.a = o.node_id AND u.pb = m.b WHERE o.node_id NOT IN (SELECT a FROM m) GROUP BY 1""")
def tree_diff(spark, d):
    return references.missing_entries(_fixture(spark, NODE, OLD), _fixture(spark, NODE, NEW))


@query("WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 7 THEN c_custkey + 1 WHEN c_custkey % 10 = 8 THEN c_custkey - 1 ELSE c_custkey - 1 END AS up FROM customer), w AS (SELECT id FROM t WHERE up IS NULL UNION ALL SELECT t.id FROM w JOIN t ON t.up = w.id) SELECT id AS node_id FROM t WHERE id NOT IN (SELECT id FROM w)")
def hierarchy_unreachable(spark, d):
    c = tables.read(spark, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS node_id", "CAST(CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 7 THEN c_custkey + 1 ELSE c_custkey - 1 END AS BIGINT) AS parent_id", "1 AS sequence_no", "c_name AS title")
    return trees.unreachable(c)


CACHE = "SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL"


@query(f"WITH k AS ({CACHE}), m AS (SELECT doc_id, source, coalesce(sha256(text) IN (SELECT h FROM k), false) AS hit FROM documents) SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 + 1 AS batch, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 100) AS place FROM m WHERE NOT hit")
def embedding_cache_misses(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", "source", "text")
    cache = docs.filter("doc_id % 3 = 0 AND text IS NOT NULL").select(F.lit("m").alias("model"), F.lit(1).alias("version"), caches.text_key(F.col("text")).alias("text_hash"), F.array(F.lit(1.0)).alias("vector"))
    stale = cache.withColumn("version", F.lit(0)).unionByName(docs.select(F.lit("m").alias("model"), F.lit(0).alias("version"), caches.text_key(F.col("text")).alias("text_hash"), F.array(F.lit(1.0)).alias("vector")))
    return caches.batches(caches.looked_up(docs, cache.unionByName(stale), "m", 1).filter("NOT hit").select("doc_id", "source"), "source", "doc_id")


@query("SELECT source AS owner_id, sha256(coalesce(text, '')) AS file_hash, min(doc_id) AS document_id FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1, 2 HAVING (source, sha256(coalesce(text, ''))) NOT IN (SELECT (source, sha256(coalesce(text, ''))) FROM documents WHERE doc_id % 5 = 0)")
def unregistered_documents(spark, d):
    rows = tables.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("owner_id"), caches.text_key(F.col("text")).alias("file_hash"))
    return caches.unregistered(rows.filter("document_id % 5 <> 0"), rows.filter("document_id % 5 = 0").select("owner_id", "file_hash"))


@query("SELECT doc_id AS document_id, source AS owner_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT e.vec_id, 'src' || (e.vec_id % 4) FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id AND d.source = 'src' || (e.vec_id % 4)")
def owned_append(spark, d):
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("owner_id"))
    new = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.concat(F.lit("src"), F.col("vec_id") % 4).alias("owner_id"))
    return caches.owned_append(docs.filter("document_id % 2 = 0"), new, docs, "document_id")


UPLOADS = """SELECT doc_id, source, 'f' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END AS filename, n_chars * CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 3000 END AS size, CASE WHEN doc_id % 7 = 0 THEN '<html' ELSE '%PDF-1.7' END AS head, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'pro' ELSE 'free' END AS code, (doc_id % 40)::BIGINT AS held_documents, doc_id * 100000 AS held_bytes FROM documents"""


def _uploads(spark, d):
    return tables.read(spark, d, "documents").selectExpr(
        "doc_id", "source", "concat('f', doc_id, CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END) AS filename", "n_chars * CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 3000 END AS size", "CASE WHEN doc_id % 7 = 0 THEN '<html' ELSE '%PDF-1.7' END AS head",
        "CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'pro' ELSE 'free' END AS code", "doc_id % 40 AS held_documents", "doc_id * 100000 AS held_bytes",
    )


@query(f"""WITH u AS ({UPLOADS}) SELECT doc_id, CASE WHEN code = 'pro' THEN 'pro' ELSE 'trial' END AS plan, CASE WHEN NOT lower(filename).ends_with('.pdf') THEN 'unsupported_name' WHEN size = 0 OR size > 15 * 1024 * 1024 THEN 'size' WHEN NOT starts_with(head, '%PDF-') THEN 'not_a_pdf'
 WHEN held_documents >= CASE WHEN code = 'pro' THEN 250 ELSE 25 END THEN 'document_limit' WHEN held_bytes + size > CASE WHEN code = 'pro' THEN 2147483648 ELSE 52428800 END THEN 'storage_limit' ELSE 'accepted' END AS decision,
 held_documents * 13 + n <= CASE WHEN code = 'pro' THEN 5000 ELSE 500 END AS pages_allowed, 'users/' || source || '/documents/' || doc_id || '/' || filename AS path, 'f' || doc_id AS title FROM u JOIN (SELECT doc_id, doc_id % 90 AS n FROM documents) USING (doc_id)""")
def upload_admission(spark, d):
    u = accounts.with_plan(_uploads(spark, d), "code")
    decision = accounts.upload_decision(*(F.col(c) for c in ("filename", "size", "head", "held_documents", "held_bytes", "max_documents", "max_bytes")))
    pages = accounts.pages_allowed(F.col("held_documents") * 13, F.col("doc_id") % 90, F.col("max_pages"))
    return u.select("doc_id", "plan", decision.alias("decision"), pages.alias("pages_allowed"), text.storage_path(F.col("source"), F.col("doc_id").cast("string"), F.concat(F.lit("some folder/"), "filename")).alias("path"), text.bare_title(F.col("filename")).alias("title"))


@query("SELECT event_id, ((value * 10000000000 + 6) // 7)::BIGINT AS held, octet_length(encode(event_type)) + 1024 AS tokens, epoch_ms(ts) // 3600000 AS hour FROM (SELECT event_id, event_type, ts, floor(value * 100)::HUGEINT AS value FROM events)")
def reservation_bounds(spark, d):
    e = tables.read(spark, d, "events").select("event_id", "event_type", "ts", F.floor(F.col("value") * 100).cast("decimal(20,0)").alias("value"))
    return e.select("event_id", (accounts.ceiling((F.col("value").cast("decimal(26,16)") / 7).cast("decimal(38,16)")) * F.lit(10**10).cast("decimal(11,0)")).cast("long").alias("held"), accounts.request_tokens(F.col("event_type")).alias("tokens"), accounts.hour_window(F.col("ts")).alias("hour"))


MESSAGES = "(1, 'File is ENCRYPTED'), (2, 'over the page limit; spend limit'), (3, 'insufficient_quota'), (4, 'bad node scopes'), (5, 'Page mapping resolved 0 nodes'), (6, 'table 3 not matched'), (7, 'table alone'), (8, 'Invalid XREF'), (9, NULL), (10, 'Table profile validation failed')"


@query("SELECT * FROM (VALUES (1, 'encrypted'), (2, 'page_limit'), (3, 'spend_limit'), (4, 'scope_boundary'), (5, 'page_mapping'), (6, 'table_link'), (7, 'unexpected'), (8, 'damaged'), (9, 'unexpected'), (10, 'table_link')) t(id, kind)")
def error_kinds(spark, d):
    return _fixture(spark, "id, message", MESSAGES).select("id", text.error_kind(F.col("message")).alias("kind"))


URLS = "(1, 'https://a.example/x'), (2, 'http://localhost:3000/b'), (3, 'http://a.example'), (4, 'https://u:p@a.example/'), (5, 'https://a.example/?q=1'), (6, 'https://a.example/#f'), (7, 'ftp://a.example'), (8, ''), (9, NULL), (10, 'http://127.0.0.1')"


@query("SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false), (5, false), (6, false), (7, false), (8, false), (9, false), (10, true)) t(id, safe)")
def safe_urls(spark, d):
    return _fixture(spark, "id, url", URLS).select("id", text.safe_url(F.col("url")).alias("safe"))


LAWS = "(1, '[[PAGE_LABEL: 1]]\\n10. Scope of law\\n(1) First\\n2. Name\\n(2A) x\\n[[PAGE_LABEL:  2]] \\n67A. Rest\\n 3.no blank\\n67. Day'), (2, 'no pages'), (3, NULL)"


@query("SELECT * FROM (VALUES (1, '2,10,67,67A', '1,2A', '1,2'), (2, '', '', ''), (3, '', '', '')) t(id, sections, subsections, pages)")
def section_openings(spark, d):
    body = F.coalesce("body", F.lit(""))
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(text.section_numbers(body)), lambda x: F.struct(text.natural_key(x).alias("key"), x.alias("x")))), lambda s: s["x"])
    return _fixture(spark, "id, body", LAWS).select("id", F.array_join(ordered, ",").alias("sections"), F.array_join(text.subsection_numbers(body), ",").alias("subsections"), F.array_join(F.transform(text.labelled_pages(body), lambda p: p["label"].cast("string")), ",").alias("pages"))


@query("SELECT c_mktsegment AS node_type, count(*) AS n FROM customer GROUP BY 1")
def node_counts(spark, d):
    return tables.read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("node_type")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, length(p_name) - length(replace(p_name, 'a', '')) AS n, strpos(p_name, 'a') - 1 AS first FROM part")
def anchor_matches(spark, d):
    found = text.all_matches(F.col("p_name"), F.lit("A"))
    return tables.read(spark, d, "part").select("p_partkey", F.size(found).alias("n"), F.coalesce(F.array_min(found), F.lit(-1)).alias("first"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Document: other' || chr(10) || text WHEN doc_id % 3 = 1 THEN text ELSE text END AS text FROM documents WHERE text IS NOT NULL AND n_chars < 400""")
def label_strip(spark, d):
    rows = tables.read(spark, d, "documents").filter("text IS NOT NULL AND n_chars < 400").withColumn("path", F.array(F.lit("a"), F.lit("b")))
    told = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Document: other\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Document: t\nHierarchy: a > b\n"), "text")).otherwise(F.concat(F.lit("Document: t. "), "text"))
    kind = F.when(F.col("doc_id") % 3 == 2, "table").otherwise("text")
    return rows.select("doc_id", text.provision_text(told, F.lit("t"), F.col("path"), kind).alias("text"))


@query("SELECT o_custkey AS user_id, o_orderkey AS pass_id, CASE WHEN EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F' AND p.o_orderdate + INTERVAL 1 MONTH > TIMESTAMP '1996-01-01') THEN 'review' ELSE 'paid' END AS status FROM orders o WHERE o_orderstatus = 'O'")
def pass_conflicts(spark, d):
    o = tables.read(spark, d, "orders").selectExpr("o_custkey AS user_id", "o_orderkey AS pass_id", "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'paid' ELSE 'other' END AS status", "CAST(o_orderdate AS TIMESTAMP) AS period_start", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MONTH AS period_end")
    return accounts.conflicting(o, F.to_timestamp(F.lit("1996-01-01")))


@query("""WITH l AS (SELECT user_id AS id, event_id AS place, CASE WHEN event_id % 2 = 0 THEN event_type END AS a, props AS b FROM events) SELECT id, arg_min(a, place) AS a, arg_min(b, place) AS b FROM l GROUP BY 1""")
def merge_first(spark, d):
    rows = tables.read(spark, d, "events").selectExpr("user_id AS id", "event_id AS place", "CASE WHEN event_id % 2 = 0 THEN event_type END AS a", "props AS b")
    return caches.merged(rows, "id", "place", ["a", "b"])


@query("WITH v AS (SELECT vec_id, label FROM embeddings WHERE label % 2 = 0) SELECT doc_id, label FROM documents LEFT JOIN v ON v.vec_id = doc_id")
def version_left_join(spark, d):
    """The right side is filtered by its version before the join, so that rows without one stay."""
    v = tables.read(spark, d, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("doc_id"), "label")
    return tables.read(spark, d, "documents").select("doc_id").join(v, "doc_id", "left")
