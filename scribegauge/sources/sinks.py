"""Writers: reports, predictions, listings and subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY = ("case_count", "weighted_text_score_90", "unweighted_text_score_90", "hotword_case_count", "weighted_hotword_f1")


def write_report(folder: str, records: DataFrame, overall: DataFrame, by_scenario: DataFrame, skipped: DataFrame) -> None:
    """cases, aggregate, by_scenario and skipped as JSON tables below a folder."""
    for name, df in (("cases", records), ("aggregate", overall), ("by_scenario", by_scenario), ("skipped", skipped)):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def report_document(overall: DataFrame, by_scenario: DataFrame) -> DataFrame:
    """One row, one JSON document: the aggregate, with a map of scenarios. Scenarios are few by their nature."""
    mapped = by_scenario.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scenario", F.struct(*[c for c in by_scenario.columns if c != "scenario"]))))).alias("by_scenario"))
    return overall.withColumn("__k", F.lit(1)).join(mapped.withColumn("__k", F.lit(1)), "__k").drop("__k").select(F.to_json(F.struct("*")).alias("document"))


def summary(overall: DataFrame) -> DataFrame:
    return overall.select(*SUMMARY)


def write_predictions(predictions: DataFrame, folder: str) -> None:
    """(run_id, case_id, text) as Parquet, a folder a run."""
    predictions.write.mode("overwrite").partitionBy("run_id").parquet(folder)


def write_prediction_files(predictions: DataFrame, folder: str) -> None:
    """One text file in a folder of its own for each case (case_id=...), for exchange with other tools."""
    predictions.select("case_id", F.col("text").alias("value")).repartition("case_id").write.mode("overwrite").partitionBy("case_id").text(folder)


def write_tsv(rows: DataFrame, folder: str, decimals: int = 2) -> None:
    shown = [F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).write.mode("overwrite").csv(folder, sep="\t", header=True)


def write_json_lines(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def write_subtitles(srt: DataFrame, folder: str) -> None:
    """(audio_id, srt), a folder an audio."""
    srt.select("audio_id", F.col("srt").alias("value")).write.mode("overwrite").partitionBy("audio_id").text(folder)


def write_run_metrics(runs: DataFrame, cases: DataFrame, folder: str) -> None:
    """A JSON document for each run: its header (run_id, ...) with the list of its cases (run_id, case_id, ...) by id.
    A run without cases has an empty list. As the format has one document a run, use write_json_lines for endless runs."""
    fields = [c for c in cases.columns if c != "run_id"]
    listed = cases.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("case_id", *[c for c in fields if c != "case_id"]))).alias("cases"))
    whole = runs.join(listed, "run_id", "left").withColumn("cases", F.coalesce("cases", F.array().cast(listed.schema["cases"].dataType)))
    whole.drop("run_id").write.mode("overwrite").option("maxRecordsPerFile", 1).option("ignoreNullFields", "false").json(folder)


def write_audio_manifest(clips: DataFrame, folder: str, source_manifest: str, audio_root: str, generated_by: str = "scribegauge") -> None:
    """One JSON document: what it was made from, and the materialised clips (operators.cases.clips) by id."""
    listed = clips.agg(F.array_sort(F.collect_list(F.struct("case_id", "audio_path", "duration_sec", "language", "hotwords"))).alias("cases"))
    header = [F.lit(x).alias(n) for n, x in (("source_manifest", source_manifest), ("generated_by", generated_by), ("audio_root", audio_root))]
    listed.select(*header, "cases").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
