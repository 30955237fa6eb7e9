"""Registered queries of the scoring and audit operators, and the SQL that gives their results.

Stand-ins among the driver's tables: consecutive turns of a conversation are reference and prediction; documents are
cases, with their source as scenario and their label as confidence; events are timings in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as X
from .functions import tokens as T
from .operators import aggregate, audit, cases, runs, scores, segments


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, reference, prediction): each turn but a conversation's last, and the turn after it."""
    turns = _table(spark, sf_dir, "conversations")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", "turn", "role", F.col("text").alias("reference"), following.alias("prediction")).where("prediction is not null and reference is not null")


def _rounded(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("position", F.col("doc_id"))
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    level = F.when(F.col("quality") == 1, "user_confirmed_real_audio").when(F.col("quality") == 0, "auto_screened_public_subtitle")
    status = F.when(F.col("toxic") == 0, "ready").when(F.col("toxic") == 1, "deferred").otherwise("needs_reference")
    weight = (F.col("n_chars") % 7 + 1).cast("double")
    return docs.join(labels, "doc_id", "left").withColumns({"case_id": F.col("doc_id"), "scenario": F.col("source"), "language": F.col("lang"), "review_level": level, "status": status, "weight": weight})


def normalized_text(spark, sf_dir):
    normal = X.normalize(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", normal.alias("normal")).select("doc_id", F.md5("normal").alias("normal_md5"), F.char_length("normal").cast("long").alias("normal_chars"))


def token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("normal"))
    count = lambda x, n: x.cast("long").alias(n)
    return docs.select("doc_id", count(T.character_count(F.col("normal")), "n_cer"), count(T.word_count(F.col("normal")), "n_wer"), count(T.hybrid_count(F.col("normal")), "n_hybrid"))


def _pair_rates(spark, sf_dir, metric):
    df = pairs(spark, sf_dir).withColumns({"a": T.metric_tokens(F.lit(metric), F.col("reference")), "b": T.metric_tokens(F.lit(metric), F.col("prediction"))})
    df = df.withColumn("distance", T.token_distance(F.col("a"), F.col("b")))
    return df.select("conv_id", "turn", F.col("distance").cast("long").alias("distance"), _rounded(T.error_rate(F.col("a"), F.col("b"), F.col("distance")), "error_rate"))


def cer_pairs(spark, sf_dir):
    df = pairs(spark, sf_dir).select("conv_id", "turn", X.normalize(F.col("reference")).alias("a"), X.normalize(F.col("prediction")).alias("b"))
    df = df.withColumns({"n": T.character_count(F.col("a")), "m": T.character_count(F.col("b")), "distance": T.character_distance(F.col("a"), F.col("b"))})
    rate = F.when(F.col("n") > 0, F.col("distance") / F.col("n")).when(F.col("m") == 0, 0.0).otherwise(1.0)
    return df.select("conv_id", "turn", F.col("distance").cast("long").alias("distance"), _rounded(rate, "error_rate"))


def wer_pairs(spark, sf_dir):
    return _pair_rates(spark, sf_dir, "wer")


def hybrid_pairs(spark, sf_dir):
    return _pair_rates(spark, sf_dir, "hybrid_ter")


def hallucination_flags(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumns({"a": T.words(X.normalize(F.col("reference"))), "b": T.words(X.normalize(F.col("prediction")))})
    df = df.withColumns(scores.hallucination(F.col("a"), F.col("b")))
    df = df.withColumns(scores.quality_flags(F.col("length_ratio"), F.col("excess_repetition_rate"), F.col("repetition_score"), F.lit("with_hotwords")))
    return df.select("conv_id", "turn", F.col("reference_token_count").cast("long").alias("n_reference"), F.col("prediction_token_count").cast("long").alias("n_prediction"), _rounded(F.col("repetition_rate"), "repetition_rate"), _rounded(F.col("hallucination_score"), "hallucination_score"), F.array_join("quality_flags", ",").alias("flags"), F.col("context_prompt_failure").alias("failed"))


def punctuation_f1(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumns({"a": T.sentence_marks(F.col("reference")), "b": T.sentence_marks(F.col("prediction"))})
    p, r, f = T.multiset_scores(F.col("a"), F.col("b"))
    return df.select("conv_id", "turn", _rounded(p, "p"), _rounded(r, "r"), _rounded(f, "f1"))


def keyword_f1(spark, sf_dir):
    """The reference's first five words are the terms that the next turn should hold."""
    df = pairs(spark, sf_dir).withColumns({"a": X.normalize(F.col("reference")), "b": X.normalize(F.col("prediction"))})
    df = df.withColumn("terms", F.slice(F.split("reference", " "), 1, 5))
    df = df.withColumn("found", scores.expected_terms(F.col("terms"), F.col("a"), F.col("b")))
    out = scores.term_scores(F.col("found"), "keyword")
    return df.select("conv_id", "turn", out["keyword_matched"].cast("long").alias("matched"), out["keyword_total"].cast("long").alias("total"), _rounded(out["keyword_f1"], "f1"))


def number_extract(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(N.extract_numbers(F.col("text")), "|").alias("numbers")).where("numbers <> ''")


def score_pairs(spark, sf_dir):
    """The whole record of each pair of turns, by words."""
    strings = F.array().cast("array<string>")
    df = pairs(spark, sf_dir).withColumns({"metric": F.lit("wer"), "keywords": F.slice(F.split("reference", " "), 1, 5), "numbers": strings, "punctuation": F.lit("normal")})
    return scores.measured(df).select("conv_id", "turn", "role", _rounded(F.col("primary_error_rate"), "error_rate"), _rounded(F.col("keyword_f1"), "keyword_f1"), _rounded(F.col("punctuation_f1"), "punctuation_f1"), _rounded(F.col("hallucination_score"), "hallucination_score"), _rounded(F.col("text_score_90"), "text_score_90"))


def role_scores(spark, sf_dir):
    """The flagship: scored pairs, and their weighted mean by role."""
    scored = score_pairs(spark, sf_dir).withColumn("weight", (F.col("turn") % 3 + 1).cast("double"))
    return scored.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(aggregate.weighted_mean(F.col("text_score_90"), F.col("weight")), 3).alias("weighted_text_score_90"))


def _document_records(spark, sf_dir):
    """Records with a score of 90 less the share of repeated word 4-grams, so that aggregates have something to add."""
    df = cases.with_weights(document_cases(spark, sf_dir).where("text is not null"))
    df = df.withColumn("__words", F.split(F.lower("text"), " ")).withColumn("text_score_90", 90 * (1 - T.repetition_rate(F.col("__words"))))
    null = F.lit(None).cast("double")
    extra = {c: null for _, (test, cols) in aggregate.DIAGNOSTICS.items() for c in cols}
    spanish = F.col("lang") == "es"
    extra |= {"script_normalized_text_score_90": F.when(spanish, F.col("text_score_90") + 1), "script_normalized_delta_text_score_90": F.when(spanish, F.lit(1.0))}
    return df.withColumns(extra | {"hotword_total": (F.col("n_chars") % 3).cast("int"), "hotword_f1": (F.col("n_chars") % 5) / 4.0})


def weighted_overall(spark, sf_dir):
    out = aggregate.overall(_document_records(spark, sf_dir))
    kept = ["case_count", "weighted_text_score_90", "unweighted_text_score_90", "script_normalized_case_count", "weighted_script_normalized_text_score_90", "weighted_script_normalized_delta_text_score_90", "japanese_orthographic_alias_case_count", "weighted_japanese_orthographic_alias_text_score_90", "hotword_case_count", "weighted_hotword_f1", "unweighted_hotword_f1"]
    return out.select(*[_rounded(F.col(c), c) if t == "double" else F.col(c) for c, t in out.dtypes if c in kept])


def weighted_by_scenario(spark, sf_dir):
    out = aggregate.by_scenario(_document_records(spark, sf_dir))
    kept = ["scenario", "weight", "raw_weight", "case_count", "weighted_text_score_90", "script_normalized_case_count", "weighted_script_normalized_text_score_90", "hotword_case_count", "hotword_weight", "weighted_hotword_f1"]
    return out.select(*[_rounded(F.col(c), c) if t == "double" else F.col(c) for c, t in out.dtypes if c in kept])


def language_scenario_rollup(spark, sf_dir):
    out = aggregate.rollup(_document_records(spark, sf_dir), "language", "scenario")
    return out.select("language", "scenario", "case_count", _rounded(F.col("weight"), "weight"), _rounded(F.col("weighted_text_score_90"), "weighted_text_score_90"))


def scope_skip(spark, sf_dir):
    prediction = F.when(F.col("n_chars") % 2 == 0, F.col("text"))
    return document_cases(spark, sf_dir).select("case_id", F.coalesce(cases.skip_reason("benchmark", F.col("status"), F.col("review_level"), prediction), F.lit("scored")).alias("benchmark"), F.coalesce(cases.skip_reason("all", F.col("status"), F.col("review_level"), prediction), F.lit("scored")).alias("every"))


def weight_list(spark, sf_dir):
    return cases.weight_list(document_cases(spark, sf_dir), "ready").select("case_id", "confidence_weight_tier", "confidence_weight_multiplier", "effective_weight")


def tier_summary(spark, sf_dir):
    return aggregate.tier_summary(cases.with_weights(document_cases(spark, sf_dir)))


def category_profile(spark, sf_dir):
    docs = document_cases(spark, sf_dir).withColumn("duration", cases.duration_bucket((F.col("n_chars") / 15.0)))
    return aggregate.category_counts(docs, ["language", "scenario", "duration"])


def duration_buckets(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(cases.duration_bucket(F.col("value") * 10).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def _timings(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("value").alias("duration_sec"), (F.col("event_id") % 10 / 10.0).alias("infer_sec"))


def run_rtf(spark, sf_dir):
    out = runs.run_totals(_timings(spark, sf_dir), "event_type")
    return out.select("event_type", "case_count", *[F.round(c, 4).alias(c) for c in ("total_audio_sec", "total_infer_sec", "overall_rtf")])


def apportioned_seconds(spark, sf_dir):
    rows = _timings(spark, sf_dir).withColumn("group_infer_sec", F.lit(3600.0)).drop("infer_sec")
    return runs.apportioned(rows, "event_type").select("event_id", "event_type", _rounded(F.col("infer_sec"), "infer_sec"))


def nearest_split(spark, sf_dir):
    """For each user and each minute mark, the nearest event of that user within a minute."""
    seconds = F.unix_timestamp("ts")
    points = _table(spark, sf_dir, "events").select("user_id", seconds.alias("point"))
    aims = points.select("user_id", (F.floor(F.col("point") / 3600) * 3600 + 1800).cast("long").alias("aim")).distinct()
    return segments.nearest(points.distinct(), aims, "user_id", 1800.0)


def page_marks(spark, sf_dir):
    text = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_events(text)).alias("without_events_md5"), F.size(T.sentence_marks(text)).cast("long").alias("marks"), text.rlike(X.SIMPLE_MARK).alias("has_mark"))


def _inline(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


NUMBER_VECTORS = [("一百五十", "150"), ("五百", "500"), ("十", "10"), ("零五", "5"), ("一二三", "123"), ("一万二", "10002"), ("三万亿", "100030000"), ("三点五", "3.5"), ("点五", "0.5"), ("一点", "一点"), ("一两", "一两"), ("1.5亿", "150000000"), ("3万5", "30005"), ("1,234", "1234"), ("12.5%", "12.5%"), ("1.2.3", "1.2.3")]


def chinese_numbers(spark, sf_dir):
    return _inline(spark, [(a,) for a, _ in NUMBER_VECTORS], "token string").select("token", N.number_token(F.col("token")).alias("number"))


TEXT_VECTORS = [("math", "八十八拆成八乘十一", "88拆成8×11"), ("math", "88拆成8×11", "88拆成8×11"), ("furigana", "制度（せいど）", "制度"), ("alias", "春とハル", "HaruとHaru"), ("tags", "<|zh|> 你好 <|x|>", "你好")]


def text_vectors(spark, sf_dir):
    df = _inline(spark, [x[:2] for x in TEXT_VECTORS], "kind string, input string")
    groups = F.array(F.array(F.lit("Haru"), F.lit("春"), F.lit("ハル")))
    out = F.when(F.col("kind") == "math", N.math_normal(F.col("input"))).when(F.col("kind") == "furigana", X.strip_furigana(F.col("input"))).when(F.col("kind") == "alias", X.fold_aliases(F.col("input"), groups)).otherwise(X.strip_model_tags(F.col("input")))
    return df.select("kind", "input", out.alias("output"))


PLAN_VECTORS = [("none", 400.0, [], [(0.0, 120.0), (120.0, 240.0), (240.0, 400.0)]), ("silences", 400.0, [(101.0, 103.0), (130.0, 132.0)], [(0.0, 131.0), (131.0, 251.0), (251.0, 400.0)])]


def segment_plans(spark, sf_dir):
    audio = _inline(spark, [(a, d, s, None) for a, d, s, _ in PLAN_VECTORS], "audio_id string, duration double, silences array<struct<start:double,end:double>>, speech_starts array<bigint>")
    return segments.segment_plan(audio).select("audio_id", F.col("index").cast("int").alias("index"), "start", "end")


def merged_conversations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("audio_id"), F.col("turn").alias("index"), "text")
    return segments.merge_texts(turns).select("audio_id", F.md5("text").alias("text_md5"), F.char_length("text").alias("chars"))


def conversation_subtitles(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("audio_id"), F.col("turn").alias("index"), "text", (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2).alias("end"))
    return segments.subtitles(turns).select("audio_id", F.md5("srt").alias("srt_md5"), F.char_length("srt").cast("long").alias("srt_chars"))


def manifest_violations(spark, sf_dir):
    sound = '{"case_id":"%s","phase":"1","status":"ready","priority":"p","scenario":"s","language":"zh","source_type":"t","source":{},"segment":{"start_sec":0,"end_sec":null,"duration_sec":5},"speakers":[],"acoustic_conditions":[],"primary_error_metric":"%s","weight":%s,"reference":{"status":"ready","path":"data/benchmark_references/a.ref.txt","punctuation":"normal"},"keywords":[],"numbers":[]}'
    raw = _inline(spark, [(0, sound % ("a", "cer", "1")), (1, sound % ("a", "ter", "-1")), (2, '{"case_id":"b"}')], "position int, json string")
    texts = _inline(spark, [("data/benchmark_references/a.ref.txt", "没有标点")], "path string, text string")
    return audit.violations(raw, texts).select("position", "case_id", "rule", "level")


def score_records(spark, sf_dir):
    """The full record of each pair of turns: by characters, with terms, numbers, hotwords and diagnostics."""
    strings = F.lit(None).cast("array<string>")
    terms = F.slice(F.split("reference", " "), 1, 5)
    df = pairs(spark, sf_dir).withColumns({"case_id": F.concat_ws("-", "conv_id", "turn"), "scenario": F.col("role"), "language": F.lit("ja"), "priority": F.lit("p"), "weight": F.lit(1.0), "primary_error_metric": F.lit("cer"), "status": F.lit("ready"), "review_level": F.lit("user_confirmed_real_audio"), "punctuation": F.lit("normal"), "keywords": terms, "numbers": F.array(F.lit("12"), F.lit("3rd")), "hotwords": terms, "alias_groups": F.array(F.array(F.lit("the"), F.lit("that"))), "itn_domain": F.lit("math_formula"), "itn_domains": strings})
    out = scores.score_cases(df, "with_hotwords")
    return out.select("case_id", "scenario", *[_rounded(F.col(c), c) for c in ("effective_weight", "primary_error_rate", "text_score_90", "weighted_text_score_90", "hotword_f1", "number_f1", "math_normalized_error_rate", "math_itn_format_score_10", "japanese_furigana_stripped_text_score_90", "japanese_orthographic_alias_text_score_90")])


def hotword_presence(spark, sf_dir):
    some = F.when(F.col("n_chars") % 3 == 1, F.array().cast("array<string>")).when(F.col("n_chars") % 3 == 2, F.array(F.lit("x")))
    return aggregate.hotword_presence(document_cases(spark, sf_dir).withColumn("hotwords", some))


def manifest_totals(spark, sf_dir):
    return aggregate.totals(document_cases(spark, sf_dir))


def confirmed_cases(spark, sf_dir):
    return cases.confirmed(document_cases(spark, sf_dir)).select("case_id", "language", "scenario")


def marked_punctuation(spark, sf_dir):
    docs = document_cases(spark, sf_dir).withColumns({"reference": F.col("text"), "method": F.lit(None).cast("string"), "punctuation": F.lit("normal")})
    return audit.mark_punctuation(docs).where("changed").select("case_id", "punctuation")


def case_buckets(spark, sf_dir):
    kind = F.when(F.col("n_chars") % 4 == 0, "real_long_benchmark").when(F.col("n_chars") % 4 == 1, "composed_benchmark_stress")
    return document_cases(spark, sf_dir).select("case_id", cases.bucket(kind, F.col("scenario"), F.col("status"), F.col("review_level")).alias("bucket"))


def routes(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", cases.route(F.lit("auto"), F.col("value") * 20).alias("pipeline"))


def language_hints(spark, sf_dir):
    hints = [cases.language_hint(F.col("lang"), s).alias(s) for s in ("code_or_null", "code_or_auto", "name", "locale", "code_or_self")]
    return _table(spark, sf_dir, "documents").select("doc_id", *hints)


def first_cases(spark, sf_dir):
    return cases.first_cases(document_cases(spark, sf_dir), 20).select("case_id", "scenario")


def silence_intervals(spark, sf_dir):
    lines = ["silence_start: 2.5", "silence_start: 3.0", "silence_end: 4.5 | silence_duration: 1.5", "silence_end: 9"]
    return segments.silences(_inline(spark, [("a", i, x) for i, x in enumerate(lines)], "audio_id string, line_no int, line string"))


QUERIES = {f.__name__: f for f in (normalized_text, token_counts, cer_pairs, wer_pairs, hybrid_pairs, hallucination_flags, punctuation_f1, keyword_f1, number_extract, score_pairs, role_scores, weighted_overall, weighted_by_scenario, language_scenario_rollup, scope_skip, weight_list, tier_summary, category_profile, duration_buckets, run_rtf, apportioned_seconds, nearest_split, page_marks, chinese_numbers, text_vectors, segment_plans, merged_conversations, conversation_subtitles, manifest_violations, score_records, hotword_presence, manifest_totals, confirmed_cases, marked_punctuation, case_buckets, routes, language_hints, first_cases, silence_intervals)}


# --- SQL -----------------------------------------------------------------------------------------------------------

_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_IDEOGRAPHS = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
_ARABIC = r"\x{600}-\x{6ff}"


def _events_sql(t: str) -> str:
    return f"regexp_replace({t}, '\\[[^\\]]+\\]', ' ', 'g')"


def _normal_sql(t: str, keep: bool = False) -> str:
    low = f"lower({_events_sql(t)})"
    if not keep:
        low = rf"regexp_replace({low}, '[^\p{{L}}\p{{N}}_{_SPACES}{_IDEOGRAPHS}{_ARABIC}.%-]', ' ', 'g')"
    return f"trim(regexp_replace({low}, '[{_SPACES}]+', ' ', 'g'))"


_LATIN = "[a-zA-Z]+(?:[-''][a-zA-Z]+)*"
_NUMBER = r"\p{Nd}+(?:[,.]\p{Nd}+)*(?:st|nd|rd|th)?"


def _words_sql(normal: str) -> str:
    return f"regexp_extract_all({normal}, '{_LATIN}|{_NUMBER}')"


def _hybrid_sql(t: str) -> str:
    return f"regexp_extract_all({_normal_sql(t)}, '(?i)[{_IDEOGRAPHS}]|{_NUMBER}%?|[{_ARABIC}]+|{_LATIN}')"


def _characters_sql(t: str) -> str:
    """DuckDB's levenshtein counts bytes: letters of the tables' languages beyond ASCII become capitals, which lower-cased
    texts don't have otherwise."""
    return f"translate(regexp_replace({_normal_sql(t)}, '[{_SPACES}]+', '', 'g'), 'àâäáçéèêëíîïñóôöúùûüßœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


_PAIRS = """p AS (SELECT * FROM (SELECT conv_id, turn, role, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prediction FROM conversations)
  WHERE prediction IS NOT NULL AND reference IS NOT NULL)"""
_PAIR_WORDS = f"{_PAIRS}, w AS MATERIALIZED (SELECT *, {_words_sql(_normal_sql('reference'))} AS a, {_words_sql(_normal_sql('prediction'))} AS b FROM p)"


def _repetition_sql(t: str) -> str:
    grams = f"list_transform(range(1, len({t}) - 2), lambda i: array_to_string({t}[i:i + 3], chr(1)))"
    return f"CASE WHEN len({t}) >= 8 THEN (len({t}) - 3 - len(list_distinct({grams})))::DOUBLE / (len({t}) - 3) ELSE 0.0 END"


_HALLUCINATION = f"""h AS (SELECT *, len(a) AS na, len(b) AS nb, CASE WHEN len(a) > 0 THEN len(b)::DOUBLE / len(a) WHEN len(b) > 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS ratio,
  {_repetition_sql('a')} AS ra, {_repetition_sql('b')} AS rb FROM w),
  i AS (SELECT *, greatest(0.0, rb - ra) AS excess, CASE WHEN na = 0 THEN 1 - least(1.0, nb / 50.0) WHEN ratio < 0.6 THEN ratio / 0.6 WHEN ratio <= 1.6 THEN 1.0 ELSE 1 - least(1.0, (ratio - 1.6) / 1.4) END AS ls FROM h),
  j AS (SELECT *, 1 - least(1.0, excess * 4) AS rs, 0.65 * ls + 0.35 * (1 - least(1.0, excess * 4)) AS hs FROM i)"""


def _marks_sql(t: str) -> str:
    return rf"regexp_extract_all(regexp_replace(regexp_replace({t}, '(\p{{Nd}})[,.]', '\1', 'g'), '[,.](\p{{Nd}})', '\1', 'g'), '[，。！？；：!?;:,.]')"


_CASES = """l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
  c AS (SELECT d.*, d.doc_id AS case_id, CASE quality WHEN 1 THEN 'user_confirmed_real_audio' WHEN 0 THEN 'auto_screened_public_subtitle' END AS review_level,
    CASE toxic WHEN 0 THEN 'ready' WHEN 1 THEN 'deferred' ELSE 'needs_reference' END AS status, (n_chars % 7 + 1)::DOUBLE AS weight FROM documents d LEFT JOIN l USING (doc_id)),
  t AS (SELECT *, coalesce(review_level, CASE WHEN status = 'ready' THEN 'ready_reference' ELSE 'other' END) AS tier FROM c),
  m AS (SELECT *, CASE tier WHEN 'user_confirmed_real_audio' THEN 3.0 WHEN 'auto_screened_public_subtitle' THEN 2.0 WHEN 'ready_reference' THEN 1.0 ELSE 0.2 END::DOUBLE AS mult FROM t),
  e AS (SELECT *, weight * mult AS ew FROM m)"""
_RECORDS = f"""{_CASES}, x AS MATERIALIZED (SELECT *, string_split(lower(text), ' ') AS ws FROM e WHERE text IS NOT NULL),
  r AS (SELECT *, 90 * (1 - ({_repetition_sql('ws')})) AS score, n_chars % 3 AS hot, (n_chars % 5) / 4.0 AS hf FROM x)"""
_WM = "sum({v} * ew) FILTER (WHERE {w}) / greatest(sum(ew) FILTER (WHERE {w}), 1e-9)"


def _wm(value: str, where: str = "true") -> str:
    return f"round({_WM.format(v=value, w=where)}, 6)"


def _values(rows) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)


def _bucket_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN 'unknown' " + " ".join(f"WHEN {v} < {b} THEN '{n}'" for b, n in cases.DURATIONS) + " ELSE '>4.5h' END"


_DISTANCE = """d AS (WITH RECURSIVE d(conv_id, turn, i, r) AS (SELECT conv_id, turn, 0::BIGINT, range(0, len(b) + 1)::BIGINT[] FROM w
  UNION ALL SELECT d.conv_id, d.turn, i + 1, list_reduce(range(1, len(b) + 1)::BIGINT[], lambda acc, j: list_append(acc, least(acc[-1] + 1, r[j + 1] + 1, r[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END)), [i + 1]::BIGINT[])
  FROM d JOIN w USING (conv_id, turn) WHERE i < len(a)) SELECT conv_id, turn, arg_max(r[-1], i) AS distance FROM d GROUP BY ALL)"""

ORACLE_SQL = {
    "normalized_text": f"SELECT doc_id, md5(n) AS normal_md5, length(n) AS normal_chars FROM (SELECT doc_id, {_normal_sql('text')} AS n FROM documents)",
    "token_counts": rf"""WITH n AS (SELECT doc_id, {_normal_sql('text')} AS n FROM documents)
      SELECT doc_id, length(regexp_replace(n, '[{_SPACES}]+', '', 'g')) AS n_cer, len({_words_sql('n')})::BIGINT AS n_wer, len(regexp_extract_all(n, '(?i)[{_IDEOGRAPHS}]|{_NUMBER}%?|[{_ARABIC}]+|{_LATIN}'))::BIGINT AS n_hybrid FROM n""",
    "hallucination_flags": f"""WITH {_PAIR_WORDS}, {_HALLUCINATION},
      k AS (SELECT *, list_filter([CASE WHEN ratio < 0.8 THEN 'under_transcription' WHEN ratio > 1.3 THEN 'over_transcription' END, CASE WHEN excess > 0.08 OR rs < 0.7 THEN 'excess_repetition' END], lambda x: x IS NOT NULL) AS f FROM j)
      SELECT conv_id, turn, na AS n_reference, nb AS n_prediction, round(rb, 6) AS repetition_rate, round(hs, 6) AS hallucination_score,
        coalesce(array_to_string(CASE WHEN len(f) > 0 THEN list_append(f, 'context_prompt_instability') ELSE f END, ','), '') AS flags, len(f) > 0 AS failed FROM k""",
    "punctuation_f1": f"""WITH {_PAIRS}, w AS MATERIALIZED (SELECT *, {_marks_sql('reference')} AS a, {_marks_sql('prediction')} AS b FROM p),
      o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS s FROM w),
      q AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE s::DOUBLE / len(b) END AS p, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE s::DOUBLE / len(a) END AS r FROM o)
      SELECT conv_id, turn, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM q""",
    "keyword_f1": f"""WITH {_PAIRS}, k AS MATERIALIZED (SELECT conv_id, turn, {_normal_sql('reference')} AS a, {_normal_sql('prediction')} AS b, unnest(string_split(reference, ' ')[1:5]) AS term FROM p),
      n AS (SELECT *, {_normal_sql('term')} AS x FROM k), g AS (SELECT conv_id, turn, count(*) FILTER (WHERE x <> '' AND contains(a, x)) AS total, count(*) FILTER (WHERE x <> '' AND contains(a, x) AND contains(b, x)) AS matched FROM n GROUP BY ALL)
      SELECT conv_id, turn, matched, total, round(CASE WHEN total = 0 THEN 1.0 ELSE matched::DOUBLE / total END, 6) AS f1 FROM g""",
    "number_extract": rf"""SELECT * FROM (SELECT doc_id, array_to_string(list_transform(regexp_extract_all({_normal_sql('text', True)}, '(?i)\p{{Nd}}+(?:[,.]\p{{Nd}}+)*(?:st|nd|rd|th)?%?'), lambda x: replace(x, ',', '')), '|') AS numbers FROM documents) WHERE numbers <> ''""",
    "weighted_overall": f"""WITH {_RECORDS} SELECT count(*) AS case_count, {_wm('score')} AS weighted_text_score_90, round(avg(score), 6) AS unweighted_text_score_90, count(*) FILTER (WHERE lang = 'es') AS script_normalized_case_count,
      {_wm('(score + 1)', "lang = 'es'")} AS weighted_script_normalized_text_score_90, {_wm('1.0', "lang = 'es'")} AS weighted_script_normalized_delta_text_score_90, 0::BIGINT AS japanese_orthographic_alias_case_count, NULL::DOUBLE AS weighted_japanese_orthographic_alias_text_score_90,
      count(*) FILTER (WHERE hot > 0) AS hotword_case_count, {_wm('hf', 'hot > 0')} AS weighted_hotword_f1, round(avg(hf) FILTER (WHERE hot > 0), 6) AS unweighted_hotword_f1 FROM r""",
    "weighted_by_scenario": f"""WITH {_RECORDS} SELECT source AS scenario, round(sum(ew), 6) AS weight, round(sum(weight), 6) AS raw_weight, count(*) AS case_count, {_wm('score')} AS weighted_text_score_90, count(*) FILTER (WHERE lang = 'es') AS script_normalized_case_count,
      {_wm('(score + 1)', "lang = 'es'")} AS weighted_script_normalized_text_score_90, count(*) FILTER (WHERE hot > 0) AS hotword_case_count, round(coalesce(sum(ew) FILTER (WHERE hot > 0), 0.0), 6) AS hotword_weight, {_wm('hf', 'hot > 0')} AS weighted_hotword_f1 FROM r GROUP BY source""",
    "language_scenario_rollup": f"WITH {_RECORDS} SELECT lang AS language, source AS scenario, count(*) AS case_count, round(sum(ew), 6) AS weight, {_wm('score')} AS weighted_text_score_90 FROM r GROUP BY ROLLUP (lang, source)",
    "scope_skip": f"""WITH {_CASES} SELECT case_id, CASE WHEN NOT coalesce(status = 'ready' AND review_level IS NOT NULL, false) THEN 'outside_scope_benchmark' WHEN n_chars % 2 <> 0 OR text IS NULL THEN 'prediction_missing' ELSE 'scored' END AS benchmark,
      CASE WHEN status <> 'ready' THEN 'reference_not_ready' WHEN n_chars % 2 <> 0 OR text IS NULL THEN 'prediction_missing' ELSE 'scored' END AS every FROM e""",
    "weight_list": f"WITH {_CASES} SELECT case_id, tier AS confidence_weight_tier, mult AS confidence_weight_multiplier, ew AS effective_weight FROM e WHERE status = 'ready'",
    "tier_summary": f"WITH {_CASES} SELECT v.tier AS confidence_weight_tier, count(e.case_id) AS n, min(ew) AS least, max(ew) AS most FROM (VALUES {_values([(t,) for t in cases.MULTIPLIERS])}) v(tier) LEFT JOIN e ON e.tier = v.tier GROUP BY v.tier",
    "category_profile": f"""WITH u AS (SELECT doc_id, unnest([{{'c': 'language', 'v': coalesce(lang, 'unknown')}}, {{'c': 'scenario', 'v': coalesce(source, 'unknown')}}, {{'c': 'duration', 'v': {_bucket_sql('(n_chars / 15.0)')}}}]) AS x FROM documents)
      SELECT x.c AS category, x.v AS value, count(*) AS n, min(doc_id) AS first_position FROM u GROUP BY ALL""",
    "duration_buckets": f"SELECT {_bucket_sql('(value * 10)')} AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "run_rtf": "SELECT event_type, count(*) AS case_count, round(sum(value), 4) AS total_audio_sec, round(sum(event_id % 10 / 10.0), 4) AS total_infer_sec, round(CASE WHEN sum(value) > 0 THEN sum(event_id % 10 / 10.0) / sum(value) END, 4) AS overall_rtf FROM events GROUP BY event_type",
    "apportioned_seconds": "SELECT event_id, event_type, round(CASE WHEN sum(value) OVER (PARTITION BY event_type) > 0 THEN 3600.0 * value / sum(value) OVER (PARTITION BY event_type) ELSE 0.0 END, 6) AS infer_sec FROM events",
    "nearest_split": """WITH p AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT AS point FROM events), a AS (SELECT DISTINCT user_id, (point // 3600 * 3600 + 1800)::BIGINT AS aim FROM p)
      SELECT a.user_id, aim, arg_min(point, abs(point - aim) * 10000000000 + point) AS point FROM a JOIN p ON a.user_id = p.user_id AND abs(point - aim) <= 1800 GROUP BY ALL""",
    "page_marks": f"SELECT page_id, md5({_events_sql('html')}) AS without_events_md5, len({_marks_sql('html')})::BIGINT AS marks, regexp_matches(html, '[，。！？；：,.!?;:]') AS has_mark FROM pages",
    "chinese_numbers": f"SELECT * FROM (VALUES {_values(NUMBER_VECTORS)}) v(token, number)",
    "text_vectors": f"SELECT * FROM (VALUES {_values(TEXT_VECTORS)}) v(kind, input, output)",
    "segment_plans": "SELECT audio_id, \"index\"::INTEGER AS \"index\", s::DOUBLE AS start, e::DOUBLE AS \"end\" FROM (VALUES " + _values([(a, i, s, e) for a, _, _, bounds in PLAN_VECTORS for i, (s, e) in enumerate(bounds, 1)]) + ") v(audio_id, \"index\", s, e)",
    "conversation_subtitles": r"""WITH t AS (SELECT conv_id, turn, trim(text) AS text, turn * 2.5 AS s FROM conversations WHERE trim(coalesce(text, '')) <> ''),
      n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, [s, s + 2] AS z FROM t),
      f AS (SELECT *, list_transform(z, lambda x: printf('%02d:%02d:', (x // 3600)::INTEGER, ((x % 3600) // 60)::INTEGER) || replace(printf('%06.3f', (x % 60)::DOUBLE), '.', ',')) AS k FROM n),
      g AS (SELECT conv_id, string_agg(n || chr(10) || k[1] || ' --> ' || k[2] || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM f GROUP BY conv_id)
      SELECT conv_id::VARCHAR AS audio_id, md5(srt) AS srt_md5, length(srt) AS srt_chars FROM g""",
}

_ERROR = "CASE WHEN len(a) = 0 THEN CASE WHEN len(b) = 0 THEN 0.0 ELSE 1.0 END ELSE distance::DOUBLE / len(a) END"
_KEYWORDS = ORACLE_SQL["keyword_f1"].removeprefix(f"WITH {_PAIRS}, ").replace("SELECT conv_id, turn, matched, total, round(CASE WHEN total = 0 THEN 1.0 ELSE matched::DOUBLE / total END, 6)", "SELECT conv_id, turn, CASE WHEN total = 0 THEN 1.0 ELSE matched::DOUBLE / total END")
_PUNCTUATION = ORACLE_SQL["punctuation_f1"].removeprefix(f"WITH {_PAIRS}, ").replace("w AS MATERIALIZED", "v AS MATERIALIZED").replace("FROM w)", "FROM v)").replace("round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6)", "CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END")
_SCORED = f"""{_PAIR_WORDS}, {_DISTANCE}, {_HALLUCINATION}, kf AS (WITH {_KEYWORDS}), pf AS (WITH {_PUNCTUATION}),
  z AS (SELECT j.conv_id, j.turn, j.role, {_ERROR} AS error, kf.f1 AS kf1, pf.f1 AS pf1, hs FROM j JOIN d USING (conv_id, turn) JOIN kf USING (conv_id, turn) JOIN pf USING (conv_id, turn)),
  y AS (SELECT *, 50 * (1 - least(1.0, error)) + 15 * kf1 + 10 + 10 * hs + 5 * pf1 AS score FROM z)"""
ORACLE_SQL |= {
    "cer_pairs": f"WITH {_PAIRS}, c AS (SELECT conv_id, turn, {_characters_sql('reference')} AS a, {_characters_sql('prediction')} AS b FROM p) SELECT conv_id, turn, levenshtein(a, b)::BIGINT AS distance, round(CASE WHEN length(a) > 0 THEN levenshtein(a, b)::DOUBLE / length(a) WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END, 6) AS error_rate FROM c",
    "hybrid_pairs": f"WITH {_PAIR_WORDS.replace(_words_sql(_normal_sql('reference')), _hybrid_sql('reference')).replace(_words_sql(_normal_sql('prediction')), _hybrid_sql('prediction'))}, {_DISTANCE} SELECT conv_id, turn, distance::BIGINT AS distance, round({_ERROR}, 6) AS error_rate FROM d JOIN w USING (conv_id, turn)",
    "wer_pairs": f"WITH {_PAIR_WORDS}, {_DISTANCE} SELECT conv_id, turn, distance::BIGINT AS distance, round({_ERROR}, 6) AS error_rate FROM d JOIN w USING (conv_id, turn)",
    "score_pairs": f"WITH {_SCORED} SELECT conv_id, turn, role, round(error, 6) AS error_rate, round(kf1, 6) AS keyword_f1, round(pf1, 6) AS punctuation_f1, round(hs, 6) AS hallucination_score, round(score, 6) AS text_score_90 FROM y",
    "role_scores": f"WITH {_SCORED} SELECT role, count(*) AS n, round(sum(score * (turn % 3 + 1)) / sum(turn % 3 + 1), 3) AS weighted_text_score_90 FROM y GROUP BY role",
}
ORACLE_SQL |= {
    "hotword_presence": "SELECT count(*) FILTER (WHERE n_chars % 3 = 0) AS missing, count(*) FILTER (WHERE n_chars % 3 = 2) AS present, count(*) FILTER (WHERE n_chars % 3 = 1) AS explicit_empty FROM documents",
    "manifest_totals": f"WITH {_CASES} SELECT count(*) AS cases, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status <> 'ready') AS candidates, coalesce(sum(weight), 0.0) AS raw_weight FROM e",
    "confirmed_cases": f"WITH {_CASES} SELECT case_id, lang AS language, source AS scenario FROM e WHERE review_level = 'user_confirmed_real_audio'",
    "marked_punctuation": rf"WITH {_CASES} SELECT case_id, 'none' AS punctuation FROM e WHERE status = 'ready' AND regexp_matches(text, '[^{_SPACES}]') AND NOT regexp_matches(text, '[，。！？；：,.!?;:]')",
    "case_buckets": f"""WITH {_CASES} SELECT case_id, CASE WHEN status = 'ready' AND review_level IS NOT NULL THEN CASE WHEN n_chars % 4 = 0 THEN 'benchmark_long' ELSE 'benchmark_short' END WHEN n_chars % 4 = 1 THEN 'engineering_stress'
      WHEN status = 'ready' THEN 'backup_ready' WHEN status = 'deferred' THEN 'candidate_deferred' ELSE 'candidate_needs_reference' END AS bucket FROM e""",
    "routes": "SELECT event_id, CASE WHEN value * 20 >= 1200 THEN 'vad_chunked' ELSE 'single_pass' END AS pipeline FROM events",
    "language_hints": "SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' END AS code_or_null, CASE WHEN lang = 'en' THEN 'en' ELSE 'auto' END AS code_or_auto, CASE WHEN lang = 'en' THEN '英文' ELSE 'auto' END AS name, 'en-US' AS locale, lang AS code_or_self FROM documents",
    "first_cases": "SELECT doc_id AS case_id, source AS scenario FROM documents ORDER BY doc_id LIMIT 20",
    "silence_intervals": "SELECT 'a' AS audio_id, 3.0::DOUBLE AS start, 4.5::DOUBLE AS \"end\"",
}
