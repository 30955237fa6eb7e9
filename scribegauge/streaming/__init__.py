"""Scoring of predictions as their files arrive. Scoring is stateless; only running aggregates have state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scores import measured


def arriving(spark: SparkSession, folder: str, schema: str = "case_id string, text string, arrived timestamp") -> DataFrame:
    """A stream of predictions (JSON lines) from a folder."""
    return spark.readStream.schema(schema).json(folder)


def scored(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """Scores of streamed predictions against static cases (case_id, reference, metric, keywords, numbers, punctuation,
    scenario, effective_weight)."""
    pairs = predictions.withColumnRenamed("text", "prediction").join(cases, "case_id")
    return measured(pairs)


def running_means(scores: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Weighted means per scenario and window of arrival; predictions later than the watermark are left out."""
    seen = scores.withWatermark("arrived", watermark).groupBy(F.window("arrived", window), "scenario")
    sums = seen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text_score_90") * F.col("effective_weight")).alias("weighted"), F.sum("effective_weight").alias("weight"))
    return sums.select("window", "scenario", "n", (F.col("weighted") / F.greatest("weight", F.lit(1e-9))).alias("weighted_text_score_90"))


def score_to(predictions: DataFrame, cases: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's scores to a Parquet folder; a replayed batch overwrites its own part."""

    def append(batch: DataFrame, epoch: int) -> None:
        columns = ["case_id", "primary_error_rate", "text_score_90"]
        scored(batch, cases).select(*columns).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return predictions.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
