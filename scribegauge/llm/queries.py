"""The registered queries of this subpackage and the SQL that gives their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .language_id import identify
from .licenses import CONTAINMENT, TEMPLATES, licensed
from .mixing import mix_sources
from .near_dedup import near_dedup
from .quality import score_quality
from .secrets import RULES, scan_secrets
from .url_filter import judge_urls
from .warc import round_trip


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans_found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES if r.base]
    base = F.filter("spans_found", lambda s: s["base"])
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans_found")).alias("spans"))


def _spans_sql(rule, order: int) -> str:
    """DuckDB: the rule's spans as a list of structs (s, o, e), by the lengths of matches and of what lies between them."""
    pattern = rule.pattern.replace("'", "''")
    return f"""list_transform(list_filter(range(1, len(regexp_extract_all(t, '{pattern}')) + 1),
      lambda i: length(regexp_extract_all(t, '{pattern}', {rule.group})[i]) >= {rule.least}),
      lambda i: {{'s': (list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda x: length(x))), 0))::BIGINT,
        'o': {order}, 'e': (list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i], lambda x: length(x))))::BIGINT}})"""


_KINDS = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
_BASES = ", ".join(str(i) for i, r in enumerate(RULES) if r.base)
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(list_concat({", ".join(_spans_sql(r, i) for i, r in enumerate(RULES))})) AS a FROM d)
SELECT doc_id, {", ".join(f"len(list_filter(a, lambda x: x.o = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(RULES) if r.base)},
  sha256(coalesce(array_to_string(list_transform(list_filter(a, lambda x: x.o IN ({_BASES})), lambda x: ({_KINDS})[x.o + 1] || ':' || x.s || ':' || x.e), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(a, lambda x: ({_KINDS})[x.o + 1] || ':' || x.s || ':' || x.e), ','), '') AS spans
FROM f
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "agreeing", "compared")


def op7_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, keep_text=False).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op4_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup(docs, keep_text=False).select("doc_id", "class_id", "copy_of", "kept")


_B32 = """list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i * 5 + 1, 5))::BIGINT >> s) & 31)::INTEGER + 1, 1)), 'string_agg', '')), 'string_agg', '')"""
OP2_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to, true AS verified FROM f
"""


def op10_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licensed(docs).select("doc_id", "license", "template", "matched", "shingles", F.round("containment", 6).alias("containment"))


def _tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


_SHINGLES_SQL = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(i, name, notice.replace("'", "''")) for i, (name, notice) in enumerate(TEMPLATES))
OP10_SQL = f"""
WITH tw AS MATERIALIZED (SELECT template, license, {_tokens_sql("notice")} AS w FROM (VALUES {_TEMPLATE_ROWS}) v(template, license, notice)),
t AS MATERIALIZED (SELECT template, license, {_SHINGLES_SQL} AS k FROM tw),
dw AS MATERIALIZED (SELECT doc_id, {_tokens_sql("coalesce(text, '')")} AS w FROM documents),
d AS (SELECT doc_id, unnest({_SHINGLES_SQL}) AS s FROM dw),
u AS (SELECT template, license, len(k) AS shingles, unnest(k) AS s FROM t),
m AS (SELECT doc_id, license, template, shingles, count(*) AS matched FROM d JOIN u USING (s) GROUP BY ALL)
SELECT doc_id, license, template::INTEGER AS template, matched, shingles::BIGINT AS shingles, round(matched / shingles, 6) AS containment
FROM m WHERE matched / shingles >= {CONTAINMENT}
"""


def op3_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op4_judge_urls": op4_judge_urls,
    "op3_score_quality": op3_score_quality,
    "op7_identify_language": op7_identify_language,
    "op6_decontaminate": op6_decontaminate,
    "op10_scan_licenses": op10_scan_licenses,
    "op5_scan_secrets": op5_scan_secrets,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mix_sources": op9_mix_sources,
}

ORACLE_SQL = {
    "op2_warc_round_trip": OP2_SQL,
    "op10_scan_licenses": OP10_SQL,
    "op5_scan_secrets": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
}
