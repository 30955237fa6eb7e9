"""Runs of a model: totals, real-time factors, shares of a batch, and the hook for transcribers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GIB = 1024.0**3


def rtf(infer_sec: Column, duration_sec: Column) -> Column:
    """Inference seconds per second of audio; null for no audio."""
    return F.when(duration_sec > 0, infer_sec / duration_sec)


def run_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, sums, their ratio and the peak memory of each run."""
    sums = [F.count(F.lit(1)).alias("case_count"), F.sum("duration_sec").alias("total_audio_sec"), F.sum("infer_sec").alias("total_infer_sec")]
    peak = [(F.max("rss_bytes") / GIB).alias("peak_rss_gb")] if "rss_bytes" in rows.columns else []
    return rows.groupBy(*keys).agg(*sums, *peak).withColumn("overall_rtf", rtf(F.col("total_infer_sec"), F.col("total_audio_sec")))


def apportioned(rows: DataFrame, group: str = "language") -> DataFrame:
    """Each case's part of its group's inference seconds, by its part of the group's audio."""
    # summed before the join, whose large side adaptive execution can split or leave where it is: a group may hold most rows
    sums = rows.groupBy(F.col(group).alias("__group")).agg(F.sum("duration_sec").alias("group_audio_sec"))
    audio = F.col("group_audio_sec")
    return rows.join(sums, F.col(group).eqNullSafe(F.col("__group"))).drop("__group").withColumn("infer_sec", F.when(audio > 0, F.col("group_infer_sec") * F.col("duration_sec") / audio).otherwise(0.0))


def with_case_metadata(audio: DataFrame, cases: DataFrame) -> DataFrame:
    """Audio cases with what is known of their cases; of repeated case ids the last counts."""
    from .cases import last_by_id

    return audio.join(last_by_id(cases), "case_id", "left")


def run_hotwords(mode: Column, global_terms: Column, case_terms: Column) -> Column:
    """The run's terms, and in the mode with_hotwords the case's too."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(global_terms, none), F.when(mode == "with_hotwords", F.coalesce(case_terms, none)).otherwise(none))


def transcribe(audio: DataFrame, transcriber: Callable[[pd.DataFrame], list[str]]) -> DataFrame:
    """audio (case_id, audio_path, duration_sec) plus text, error, infer_sec and rtf. The transcriber gets one case at a
    time; what it raises becomes that case's error, with an empty text, and the run goes on."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors, seconds = [], [], []
            for i in range(len(batch)):
                began = time.perf_counter()
                try:
                    texts.append(transcriber(batch.iloc[i : i + 1])[0])
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  recorded, as a run must not end with one case
                    texts.append("")
                    errors.append(repr(error))
                seconds.append(time.perf_counter() - began)
            yield batch[["case_id", "audio_path", "duration_sec"]].assign(text=texts, error=errors, infer_sec=seconds)

    out = audio.select("case_id", "audio_path", "duration_sec").mapInPandas(each, "case_id string, audio_path string, duration_sec double, text string, error string, infer_sec double")
    return out.withColumn("rtf", rtf(F.col("infer_sec"), F.col("duration_sec")))
