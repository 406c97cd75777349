"""The ten operators as queries over the driver's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact, gam, jaccard, langid, licences, packing, placement, secrets, tiling
from .common import table


def vocabulary() -> str:
    """Place of the tokenizer's vocabulary file, outside this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat.digest_chats(chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SHARD_NAMES = [f"shard-{i:03d}" for i in range(placement.SHARDS)]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", placement.lookup_table(SHARD_NAMES))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scans, op2_decontamination, op3_chat_formatting, op4_best_fit_packing, op5_quality_classifier, op6_sharding, op7_jaccard_join, op8_secret_scans, op9_language_id, op10_exact_dedup, pipeline]
    return {f.__name__: f for f in own}


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([\[<])(/?(INST|SYS|ROLE|NAME)\]|/?s>)', '\1' || '\\' || '\2', 'g') AS safe FROM t),
p AS (SELECT *, row_number() OVER w - 1 AS place, lag(CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE '*' END) OVER w AS before,
  CASE role WHEN 'system' THEN '[SYS]' || safe || '[/SYS]' WHEN 'user' THEN '[INST]' || safe || '[/INST]' WHEN 'assistant' THEN '<s>' || safe || '</s>' ELSE '[ROLE]' || role || '[/NAME]' || safe || '[/ROLE]' END AS told
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE role = 'user' END AS fits FROM p)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(told))::BIGINT AS formatted_chars, bool_and(fits) AS valid, coalesce(min(place) FILTER (NOT fits), -1)::INTEGER AS wrong
FROM f GROUP BY conv_id"""

EXACT_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS c FROM t)
SELECT doc_id, keep_id, c AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k"""


def _spans_sql(kind: str) -> str:
    expression, group, least, _ = secrets.RULES[kind]
    quoted = expression.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {list(secrets.RULES).index(kind)} AS place, least_ok, start, start + m AS stop FROM (
  SELECT doc_id, i, length(g[i]) >= {least} AS least_ok, length(f[i]) AS m, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, f, g, s, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS f, regexp_extract_all(text, '{quoted}', {group}) AS g, string_split_regex(text, '{quoted}') AS s FROM t))) WHERE least_ok"""


SECRETS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({" UNION ALL ".join(_spans_sql(k) for k in secrets.RULES)}),
b AS (SELECT doc_id, kind, place, start, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS told FROM a),
c AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(told, ',' ORDER BY start, place) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg(told, ',' ORDER BY start, place) AS spans FROM b GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN c ON t.doc_id = c.doc_id"""


def _place_sql() -> str:
    held = placement.lookup_table(SHARD_NAMES)
    slot = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {len(held)})::INTEGER"
    return f"SELECT doc_id, {slot} AS slot, ({held})[{slot} + 1]::INTEGER AS shard FROM documents"


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"op1_license_scans": licences.oracle(), "op3_chat_formatting": CHAT_SQL, "op6_sharding": _place_sql(), "op8_secret_scans": SECRETS_SQL, "op10_exact_dedup": EXACT_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
