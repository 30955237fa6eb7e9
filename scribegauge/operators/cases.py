"""Cases: confidence tiers and weights, scopes, reasons to skip, labels, durations and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the weighting policy.
MULTIPLIERS = {"user_confirmed_real_audio": 3.0, "auto_screened_public_subtitle": 2.0, "ready_reference": 1.0, "other": 0.2}
BENCHMARK_LEVELS = ("user_confirmed_real_audio", "auto_screened_public_subtitle")
CONTEXT_MODES, NATIVE_MODES, MODE_ALIASES = ("with_context_terms", "prompt_context"), ("native_hotwords",), {"with_hotwords": "with_context_terms"}
#: Upper bounds in seconds and the labels below them; the label of 9000 to 16200 s is the established one.
DURATIONS = ((30, "<30s"), (60, "30-60s"), (180, "60-180s"), (600, "3-10m"), (1200, "10-20m"), (2700, "20-45m"), (5400, "45-90m"), (9000, "90-150m"), (16200, "3.5-4.5h"))
LONG_AUDIO_SECONDS = 1200
SCOPES = ("benchmark", "ready", "all")


def tier(status: Column, review_level: Column) -> Column:
    return F.when(review_level.isin(*BENCHMARK_LEVELS), review_level).when(status == "ready", "ready_reference").otherwise("other")


def is_benchmark(status: Column, review_level: Column) -> Column:
    return F.coalesce((status == "ready") & review_level.isin(*BENCHMARK_LEVELS), F.lit(False))


def in_scope(scope: str, status: Column, review_level: Column) -> Column:
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    ready = F.coalesce(status == "ready", F.lit(False))
    return {"all": F.lit(True), "ready": ready, "benchmark": is_benchmark(status, review_level)}[scope]


def multiplier(tier_name: Column, configured: dict[str, float] | None = None) -> Column:
    """The tier's multiplier; configured ones override the defaults, unknown tiers have the default of 'other'."""
    known = MULTIPLIERS | (configured or {})
    out = F.lit(MULTIPLIERS["other"])
    for name, value in known.items():
        out = F.when(tier_name == name, F.lit(float(value))).otherwise(out)
    return out


def with_weights(cases: DataFrame, configured: dict[str, float] | None = None) -> DataFrame:
    """Adds confidence_weight_tier, confidence_weight_multiplier and effective_weight."""
    cases = cases.withColumn("confidence_weight_tier", tier(F.col("status"), F.col("review_level")))
    cases = cases.withColumn("confidence_weight_multiplier", multiplier(F.col("confidence_weight_tier"), configured))
    return cases.withColumn("effective_weight", F.col("weight").cast("double") * F.col("confidence_weight_multiplier"))


def hotword_mode(mode: Column) -> Column:
    out = mode
    for old, new in MODE_ALIASES.items():
        out = F.when(mode == old, new).otherwise(out)
    return out


def prompt_mechanism(mode: Column) -> Column:
    named = hotword_mode(mode)
    return F.when(named.isin(*CONTEXT_MODES), "prompt_context_terms").when(named.isin(*NATIVE_MODES), "native_hotword_bias").otherwise(named)


def skip_reason(scope: str, status: Column, review_level: Column, prediction: Column) -> Column:
    """Why a case isn't scored, the first reason that holds; null if it is."""
    return (
        F.when(~in_scope(scope, status, review_level), f"outside_scope_{scope}")
        .when(~F.coalesce(status == "ready", F.lit(False)), "reference_not_ready")
        .when(prediction.isNull(), "prediction_missing")
    )


def bucket(case_type: Column, scenario: Column, status: Column, review_level: Column) -> Column:
    """One of six groups of the dataset profile."""
    return (
        F.when(is_benchmark(status, review_level), F.when(case_type.eqNullSafe("real_long_benchmark"), "benchmark_long").otherwise("benchmark_short"))
        .when(case_type.eqNullSafe("composed_benchmark_stress") | scenario.eqNullSafe("long_form_stress"), "engineering_stress")
        .when(status == "ready", "backup_ready")
        .when(status == "deferred", "candidate_deferred")
        .otherwise("candidate_needs_reference")
    )


def duration(duration_sec: Column, start_sec: Column, end_sec: Column) -> Column:
    return F.coalesce(duration_sec.cast("double"), F.when(end_sec > start_sec, end_sec - start_sec))


def duration_bucket(seconds: Column) -> Column:
    out = F.lit(">4.5h")
    for bound, label in reversed(DURATIONS):
        out = F.when(seconds < bound, label).otherwise(out)
    return F.when(seconds.isNull(), "unknown").otherwise(out)


#: What a language's prefix becomes, and what other languages become, for each way in which runners name languages.
LANGUAGE_STYLES = {
    "code_or_null": ({"zh": "zh", "en": "en", "ja": "ja"}, None),
    "zh_en_only": ({"zh": "zh", "en": "en"}, None),
    "code_or_auto": ({"zh": "zh", "en": "en", "ja": "ja"}, "auto"),
    "name": ({"zh": "中文", "en": "英文", "ja": "日文"}, "auto"),
    "locale": ({"zh": "zh-CN", "ja": "ja-JP"}, "en-US"),
}


def language_hint(language: Column, style: str = "code_or_null") -> Column:
    """A runner's language hint, by a style of LANGUAGE_STYLES or 'code_or_self' (null for auto and empty). The style
    'name' leaves the mixed language zh-en to the model."""
    if style == "code_or_self":
        return F.when((language == "auto") | (language == ""), None).otherwise(F.coalesce(language_hint(language), language))
    known, other = LANGUAGE_STYLES[style]
    out = F.lit(other).cast("string")
    for prefix, hint in known.items():
        fits = F.startswith(language, F.lit(prefix))
        out = F.when(fits & (language != "zh-en") if style == "name" else fits, hint).otherwise(out)
    return out


def route(requested: Column, seconds: Column, threshold: float = LONG_AUDIO_SECONDS) -> Column:
    """The pipeline asked for; 'auto' is chunked from the threshold on, and single where the duration is unknown."""
    return F.when(requested != "auto", requested).when(seconds >= threshold, "vad_chunked").otherwise("single_pass")


def first_of(value: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), other)


def math_applies(scenario: Column, numbers: Column, keywords: Column, itn_domain: Column, itn_domains: Column, reference: Column) -> Column:
    from ..functions.numbers import MATH_SYMBOL

    declared = itn_domain.eqNullSafe("math_formula") | F.coalesce(F.array_contains(itn_domains, "math_formula"), F.lit(False))
    listed = F.coalesce(F.size(numbers) > 0, F.lit(False))
    written = reference.rlike(MATH_SYMBOL) | F.coalesce(F.array_join(keywords, " ").rlike(MATH_SYMBOL), F.lit(False))
    return declared | (scenario.eqNullSafe("student_lecture") & listed & written)


def find_case(cases: DataFrame, case_id: str, position: str = "position") -> DataFrame:
    """The first case of that id; KeyError if there is none."""
    found = cases.where(F.col("case_id") == case_id)
    if found.isEmpty():
        raise KeyError(case_id)
    return found.orderBy(position).limit(1) if position in cases.columns else found.limit(1)


def first_cases(cases: DataFrame, limit: int, position: str = "position") -> DataFrame:
    """The first cases in manifest order; a limit of 0 is none."""
    return cases.orderBy(position).limit(limit) if limit else cases


def allowed(cases: DataFrame, case_ids: list[str]) -> DataFrame:
    return cases.where(F.col("case_id").isin(*case_ids)) if case_ids else cases


def by_length(cases: DataFrame, length: str | None = None) -> DataFrame:
    """All cases, or only 'long' or 'short' ones; a case without a type is short."""
    long = F.col("case_type").eqNullSafe("real_long_benchmark")
    if length not in (None, "long", "short"):
        raise ValueError(f"unknown length: {length}")
    return cases if length is None else cases.where(long if length == "long" else ~long)


def confirmed(cases: DataFrame) -> DataFrame:
    """Cases that a user confirmed, with the media they come from."""
    source = first_of(F.col("source.bvid"), F.col("source.url")) if dict(cases.dtypes).get("source", "").startswith("struct") else F.lit(None).cast("string")
    return cases.where(F.col("review_level") == BENCHMARK_LEVELS[0]).select("case_id", "language", "scenario", source.alias("media"))


def clips(cases: DataFrame, audio_root: str, extension: str = "wav") -> DataFrame:
    """What a materialised clip is listed as: id, path, duration (one that is positive), language and hotwords."""
    known = F.col("duration_sec").cast("double")
    seconds = F.coalesce(F.when(known > 0, known), F.when(F.col("end_sec") > F.col("start_sec"), F.col("end_sec") - F.col("start_sec")))
    path = F.concat(F.lit(audio_root.rstrip("/") + "/"), F.col("case_id").cast("string"), F.lit(f".{extension}"))
    return cases.select("case_id", path.alias("audio_path"), seconds.alias("duration_sec"), "language", F.coalesce("hotwords", F.array().cast("array<string>")).alias("hotwords"))


def last_by_id(rows: DataFrame, position: str = "position") -> DataFrame:
    """One row of each case id: the last in manifest order."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(position))))
    return ranked.where("__rank = 1").drop("__rank")


def weight_list(cases: DataFrame, scope: str = "benchmark", tiers: list[str] | None = None, configured: dict[str, float] | None = None) -> DataFrame:
    """Cases by effective weight, largest first, then by tier and id."""
    listed = with_weights(cases.where(in_scope(scope, F.col("status"), F.col("review_level"))), configured)
    if tiers:
        listed = listed.where(F.col("confidence_weight_tier").isin(*tiers))
    return listed.orderBy(F.desc("effective_weight"), "confidence_weight_tier", "case_id")
