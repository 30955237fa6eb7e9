"""Readers: manifests, text folders, audio manifests, run metrics and folder sizes; all through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

CASE = """case_id string, phase string, status string, priority string, scenario string, language string, source_type string, case_type string,
source struct<url string, video_id string, bvid string>, segment struct<start_sec double, end_sec double, duration_sec double>,
primary_error_metric string, weight double,
reference struct<status string, review_level string, path string, punctuation string, method string, reviewed_at string>,
keywords array<string>, numbers array<string>, hotwords array<string>, orthographic_aliases string, acceptable_aliases string,
formatting struct<itn_domain string, itn_domains array<string>>"""
MANIFEST = f"policy struct<case_weighting: struct<confidence_weight_multipliers: map<string,double>>>, phase1_scenario_weights map<string,double>, cases array<struct<{CASE}>>"
AUDIO = "source_manifest string, generated_by string, audio_root string, cases array<struct<case_id string, audio_path string, duration_sec double, language string, hotwords array<string>>>"
RUN = "model string, case_count long, load_sec double, total_audio_sec double, total_infer_sec double, overall_rtf double, peak_rss_gb double, wall_sec double, model_disk_gb double, cases array<struct<case_id string, audio_path string, duration_sec double, infer_sec double, rtf double, error string, prediction_chars long>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest: policy, phase1_scenario_weights, cases."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def alias_values(listed: Column) -> Column:
    """array<array<string>> from the JSON of alias groups: lists, or objects with a canonical value and aliases."""
    groups = F.try_variant_get(F.try_parse_json(listed), "$", "array<variant>")
    text = lambda v: F.try_variant_get(v, "$", "array<string>")

    def one(group: Column) -> Column:
        named = F.concat(F.array(F.coalesce(F.try_variant_get(group, "$.canonical", "string"), F.lit(""))), F.coalesce(F.try_variant_get(group, "$.aliases", "array<string>"), F.array().cast("array<string>")))
        return F.coalesce(text(group), F.when(F.schema_of_variant(group).rlike("^OBJECT"), named), F.array().cast("array<string>"))

    return F.transform(groups, one)


def manifest_cases(manifest: DataFrame) -> DataFrame:
    """A row a case, with its position; nested fields that scores need are lifted to columns."""
    rows = manifest.select(F.posexplode("cases").alias("position", "case")).select("position", "case.*")
    listed = F.coalesce(F.nullif(F.col("orthographic_aliases"), F.lit("[]")), F.col("acceptable_aliases"))
    return rows.withColumns({
        "case_status": F.col("status"), "status": F.col("reference.status"), "review_level": F.col("reference.review_level"), "punctuation": F.col("reference.punctuation"),
        "method": F.col("reference.method"), "path": F.col("reference.path"), "itn_domain": F.col("formatting.itn_domain"), "itn_domains": F.col("formatting.itn_domains"),
        "alias_groups": alias_values(listed), "start_sec": F.col("segment.start_sec"), "end_sec": F.col("segment.end_sec"), "duration_sec": F.col("segment.duration_sec"),
    }).drop("reference", "formatting", "segment", "orthographic_aliases", "acceptable_aliases")


def raw_cases(spark: SparkSession, path: str) -> DataFrame:
    """(position, json): each case as it stands, for audits that tell missing fields from empty ones."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    return whole.select(F.posexplode(F.try_variant_get("v", "$.cases", "array<variant>")).alias("position", "case")).select("position", F.to_json("case").alias("json"))


def read_texts(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(name, text) of the files of a folder; names without the suffix, texts stripped."""
    rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    return rows.where(F.endswith("file", F.lit(suffix))).select(F.left("file", F.char_length("file") - len(suffix)).alias("name"), strip(F.col("value")).alias("text"))


def with_texts(cases: DataFrame, references: DataFrame, predictions: DataFrame) -> DataFrame:
    """cases plus reference (path, text) and prediction (case_id, text) texts; missing ones are null."""
    wanted = references.select(F.col("path"), F.col("text").alias("reference"))
    return cases.join(wanted, "path", "left").join(predictions.select("case_id", F.col("text").alias("prediction")), "case_id", "left")


def read_audio_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIO).json(path, multiLine=True).select(F.posexplode("cases").alias("position", "case")).select("position", "case.*")


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Run headers, and their cases with the file name as run_id."""
    runs = spark.read.schema(RUN).json(path, multiLine=True).withColumn("run_id", F.col("_metadata.file_name"))
    return runs.drop("cases"), runs.select("run_id", F.explode("cases").alias("case")).select("run_id", "case.*")


def folder_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the sizes of all files below a folder, added up without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _wav_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def wav_durations(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sample_rate, channels, duration_sec) from the headers; no sample is decoded."""
    import io
    import wave

    import pandas as pd

    def probed(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rows.append((name, w.getframerate(), w.getnchannels(), w.getnframes() / w.getframerate()))
            yield pd.DataFrame(rows, columns=["name", "sample_rate", "channels", "duration_sec"])

    return _wav_files(spark, folder).mapInPandas(probed, "name string, sample_rate int, channels int, duration_sec double")


def read_wav(spark: SparkSession, folder: str, mean_of_channels: bool = True, sample_rate: int | None = None) -> DataFrame:
    """(name, sample_rate, channels, duration_sec, samples array<float>) of PCM WAV files of 8 to 32 bits a sample.

    Samples lie between -1 and 1, as the mean of the channels or the first of them. With sample_rate given, a file of
    another rate is an error.
    """
    import io
    import wave

    import numpy as np
    import pandas as pd

    def numbers(raw: bytes, width: int) -> np.ndarray:
        if width == 1:
            return np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
        # the bytes of a sample, lowest first, become the high ones of 32 bits
        padded = np.zeros((len(raw) // width, 4), np.uint8)
        padded[:, 4 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
        return (padded.view("<i4").ravel() / 2.0**31).astype(np.float32)

    def decoded(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rate, channels, frames = w.getframerate(), w.getnchannels(), w.getnframes()
                    if sample_rate is not None and rate != sample_rate:
                        raise ValueError(f"{name} has {rate} samples a second, not {sample_rate}")
                    samples = numbers(w.readframes(frames), w.getsampwidth()).reshape(-1, channels)
                rows.append((name, rate, channels, frames / rate, (samples.mean(axis=1) if mean_of_channels else samples[:, 0]).tolist()))
            yield pd.DataFrame(rows, columns=["name", "sample_rate", "channels", "duration_sec", "samples"])

    return _wav_files(spark, folder).mapInPandas(decoded, "name string, sample_rate int, channels int, duration_sec double, samples array<float>")
