"""Whole jobs: scoring a folder of predictions, and profiling a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import aggregate, cases, scores


@dataclass(frozen=True)
class Report:
    records: DataFrame
    overall: DataFrame
    by_scenario: DataFrame
    skipped: DataFrame


def report(joined: DataFrame, scope: str = "benchmark", mode: str = "zero_shot", configured: dict[str, float] | None = None, to_simplified=None) -> Report:
    """Scores and aggregates of cases with reference and prediction; what isn't scored is listed with the reason."""
    judged = joined.withColumn("reason", cases.skip_reason(scope, F.col("status"), F.col("review_level"), F.col("prediction")))
    taken = judged.where("reason is null").withColumn("reference", F.coalesce("reference", F.raise_error(F.concat(F.lit("no reference text: "), "case_id")).cast("string")))
    records = scores.score_cases(taken.drop("reason"), mode, configured, to_simplified)
    return Report(records, aggregate.overall(records), aggregate.by_scenario(records), judged.where("reason is not null").select("case_id", "reason"))


def score_folder(spark: SparkSession, manifest: str, references: str, predictions: str, scope: str = "benchmark", mode: str = "zero_shot") -> Report:
    """Score a folder of <case_id>.txt predictions against a manifest and a folder of reference texts."""
    whole = sources.read_manifest(spark, manifest)
    policy = whole.select("policy.case_weighting.confidence_weight_multipliers").first()
    texts = sources.read_texts(spark, references, ".ref.txt").withColumn("path", F.concat(F.lit("data/benchmark_references/"), "name", F.lit(".ref.txt")))
    joined = sources.with_texts(sources.manifest_cases(whole), texts, sources.read_texts(spark, predictions).withColumnRenamed("name", "case_id"))
    return report(joined, scope, mode, policy[0] if policy else None)


def profile(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Top counts of each category of each bucket of cases, by bucket and category, most first."""
    grouped = rows.withColumn("bucket", cases.bucket(*[F.col(c) for c in ("case_type", "scenario", "status", "review_level")]))
    grouped = grouped.withColumn("duration", cases.duration_bucket(cases.duration(F.col("duration_sec"), F.col("start_sec"), F.col("end_sec"))))
    columns = ["language", "scenario", "source_type", "priority", "duration", "punctuation"]
    named = grouped.withColumns({c: F.concat_ws("/", "bucket", F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in columns})
    return aggregate.category_counts(named, columns, limit=limit).orderBy(F.substring_index("value", "/", 1), "category", F.desc("n"), "first_position")
