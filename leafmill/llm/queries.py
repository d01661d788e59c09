"""Queries of this subpackage: each applies one operator to its whole table and returns its full result.

Where SQL can express only some of an operator's columns, a query of its own gives these, from the same operator, with the SQL for them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import core
from . import chat, crf_pii, html_layout, langid, media, mixing, multiset_hash, ngram_join, packing, repair_ids


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(core.table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(core.table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents")
    found = langid.predictions(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = repair_ids.write_shards(core.table(spark, sf_dir, "documents"), core.work_folder(spark, "ids"), end_id=1)
    return repair_ids.read_shards(manifest)


def op5_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(core.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "expected", "copies", "cut")


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(core.table(spark, sf_dir, "documents"))


def op7_chat_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.turn", "t.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op8_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_pii.report(core.table(spark, sf_dir, "documents"))


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(core.table(spark, sf_dir, "documents"), end_id=2)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = core.work_folder(spark, "media")
    media.write_archives(core.table(spark, sf_dir, "documents"), folder)
    return media.features(media.read_archives(spark, folder))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pareto_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def fingerprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_multiset_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_crf_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict:
    found = (op1_ngram_jaccard_join, op2_html_layout, op3_language_id, op4_repair_token_ids, op5_pareto_mixing, op6_multiset_fingerprints, op7_chat_rendering, op8_crf_personal_data, op9_nnls_packing, op10_media_columns)
    return {f.__name__: f for f in (*found, mixing_targets, fingerprint_texts, personal_data_counts, media_payloads)}


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTROLS = "'" + "|".join(re.escape(c) for c in chat.CONTROL) + "'"


def _escaped_size(c: str) -> str:
    """Characters of an escaped text: backslashes count twice, and each control string gets one."""
    doubled = f"replace({c}, '\\', '\\\\')"
    return f"(length({doubled}) + len(regexp_extract_all({doubled}, {_CONTROLS})))"


_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) - i + 1] AS INTEGER) WHEN CAST(d[length(d) - i + 1] AS INTEGER) > 4 THEN 2 * CAST(d[length(d) - i + 1] AS INTEGER) - 9 ELSE 2 * CAST(d[length(d) - i + 1] AS INTEGER) END)) % 10 = 0"""
_ORACLES = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[][] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END)) AS g FROM d),
k AS (SELECT doc_id, g, CASE WHEN len(g) > 0 THEN md5(CAST(to_json(g) AS VARCHAR)) END AS node FROM s),
n AS (SELECT node, any_value(g) AS g, len(any_value(g)) AS size, min(doc_id) AS least FROM k WHERE node IS NOT NULL GROUP BY node),
u AS (SELECT node, size, md5(CAST(to_json(x) AS VARCHAR)) AS x FROM (SELECT node, size, unnest(g) AS x FROM n)),
e AS (SELECT a.node AS p, b.node AS q FROM u a JOIN u b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))),
ee AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
r AS (SELECT node, node AS far FROM n UNION SELECT r.node, ee.q FROM r JOIN ee ON r.far = ee.p),
c AS (SELECT r.node, min(n.least) AS component_id FROM r JOIN n ON n.node = r.far GROUP BY r.node)
SELECT k.doc_id, CAST(len(k.g) AS BIGINT) AS n_shingles, coalesce(c.component_id, k.doc_id) AS component_id FROM k LEFT JOIN c ON c.node = k.node""",
    "mixing_targets": f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
c AS (SELECT source, source_size, CAST(w AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(size) FROM d) AS wanted FROM s),
l AS (SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / w, source) AS k FROM c),
best AS (SELECT coalesce(min_by(level, k) FILTER (level <= cap / w), 1e300) AS level FROM l)
SELECT doc_id, size, source_size, round(least(cap, w * best.level), 6) AS target FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source, best""",
    "fingerprint_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC, t), first_value(t) OVER (ORDER BY doc_id DESC, t)) AS follow FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(t[1:n - n // 3] || CASE WHEN n >= 3 THEN follow[1:n // 3] ELSE '' END) AS edited_sha256 FROM n""",
    "op7_chat_rendering": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, k, ['user', 'assistant'][k + 1], '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS k))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum({len(chat.frame([("", "")]))} + {_escaped_size("role")} + {_escaped_size("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id""",
    "personal_data_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: coalesce(try_cast(p AS UHUGEINT), 999))) <= 255)) AS BIGINT) AS n_ip,
CAST(len(list_filter(card, lambda d: length(d) BETWEEN 16 AND 19 AND {_LUHN})) AS BIGINT) AS n_card, CAST(len(list_filter(phone, lambda d: length(d) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM m""",
    "media_payloads": r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n, greatest(1, (octet_length(b) + 575) // 576) * 576 AS p FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(p AS BIGINT) AS payload_bytes, sha256(b || repeat(unhex('FF'), p - n)) AS payload_sha256 FROM n""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can express. Compression, layouts, tokenizers, Viterbi decoding and packings have none; tests hold them against brute force or round trips."""
    return dict(_ORACLES)
