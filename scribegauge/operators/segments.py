"""Long audio: silences, segment plans, overlap merge and subtitles. One audio's intervals are the largest group."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, timestamp_label

PLAN = "audio_id string, index int, start double, end double, extract_start double, extract_end double, duration double, extract_duration double"


def silences(lines: DataFrame) -> DataFrame:
    """(audio_id, start, end) from log lines (audio_id, line_no, line): each end with the last start since the end before."""
    number = lambda name: F.regexp_extract("line", rf"{name}:\s*([0-9.]+)", 1)
    marks = lines.select("audio_id", "line_no", F.nullif(number("silence_start"), F.lit("")).cast("double").alias("opened"), F.nullif(number("silence_end"), F.lit("")).cast("double").alias("closed"))
    marks = marks.withColumn("closed", F.when(F.col("opened").isNull(), F.col("closed"))).where("opened is not null or closed is not null")
    order = Window.partitionBy("audio_id").orderBy("line_no")
    paired = marks.withColumn("start", F.lag("opened").over(order))
    return paired.where("closed is not null and start is not null").select("audio_id", "start", F.col("closed").alias("end"))


def cut_after(start: float, duration: float, middles: list[float], target: float, most: float, least: float) -> float:
    """The silence middle nearest to start + target within [start + least, start + most], else the target itself."""
    aim, low, high = (min(duration, start + x) for x in (target, least, most))
    inside = middles[bisect.bisect_left(middles, low) : bisect.bisect_right(middles, high)]
    return min(inside, key=lambda m: abs(m - aim)) if inside else min(aim, high)


def plan_by_silence(duration: float, middles: list[float], target: float = 120.0, most: float = 180.0, least: float = 20.0) -> list[float]:
    """Boundaries from 0 to duration. Parts over most are cut, a cut within a second goes to the target, and a last part
    under least joins the one before."""
    if not 0 < least <= target <= most:
        raise ValueError("need 0 < least <= target <= most")
    middles, bounds = sorted(middles), [0.0]
    while duration - bounds[-1] > most:
        at = cut_after(bounds[-1], duration, middles, target, most, least)
        bounds.append(at if at > bounds[-1] + 1.0 else min(duration, bounds[-1] + target))
    if duration > bounds[-1]:
        bounds.append(duration)
    return _merged_tail(bounds, least)


def _merged_tail(bounds: list, least: float) -> list:
    return [*bounds[:-2], bounds[-1]] if len(bounds) > 2 and bounds[-1] - bounds[-2] < least else bounds


def nearest_splits(total: int, starts: list[int], target: int) -> list[int]:
    """0, total and, for each multiple of target below total, the nearest of 0, total and the starts (the earlier of two)."""
    points = np.unique([0, total, *starts])
    aims = np.arange(target, total, target)
    right = np.clip(np.searchsorted(points, aims), 1, len(points) - 1)
    nearer_right = points[right] - aims < aims - points[right - 1]
    return sorted({0, total, *points[np.where(nearer_right, right, right - 1)].tolist()})


def plan_by_speech(total: int, starts: list[int], target: int, most: int, least: int) -> list[int]:
    """Sample numbers that bound segments: nearest speech starts, over-long parts divided evenly, a short tail merged."""
    bounds = [0]
    splits = nearest_splits(total, starts, target)
    for low, high in zip(splits, splits[1:], strict=False):
        parts = max(1, math.ceil((high - low) / most))
        for at in [int(low + i * ((high - low) / parts)) for i in range(1, parts)] + [high]:
            if at > bounds[-1]:
                bounds.append(at)
    return _merged_tail(bounds, least)


def plan_rows(audio_id: str, bounds: list[float], duration: float, overlap: float = 0.0) -> pd.DataFrame:
    """Segments between boundaries; inner sides are extended by the overlap. Seconds are rounded last."""
    start, end = np.array(bounds[:-1], float), np.array(bounds[1:], float)
    first, last = np.arange(len(start)) == 0, np.arange(len(start)) == len(start) - 1
    low = np.maximum(0.0, start - np.where(first, 0.0, overlap))
    high = np.minimum(duration, end + np.where(last, 0.0, overlap))
    each = lambda x: [round(float(v), 3) for v in x]
    return pd.DataFrame({"audio_id": audio_id, "index": np.arange(1, len(start) + 1), "start": each(start), "end": each(end), "extract_start": each(low), "extract_end": each(high), "duration": each(end - start), "extract_duration": each(high - low)})


def segment_plan(audio: DataFrame, target: float = 120.0, most: float = 180.0, least: float = 20.0, overlap: float = 0.0, sample_rate: int = 16000) -> DataFrame:
    """PLAN rows for audio (audio_id, duration, silences array<struct<start,end>>, speech_starts array<bigint>). Audio with
    speech starts is cut by them (overlap does not apply there), other audio by its silences."""
    if overlap < 0:
        raise ValueError("overlap must not be negative")

    def planned(batches):
        for batch in batches:
            made = []
            for row in batch.itertuples():
                if row.speech_starts is not None and len(row.speech_starts):
                    bounds = plan_by_speech(int(row.duration * sample_rate), [int(x) for x in row.speech_starts], int(target * sample_rate), int(most * sample_rate), int(least * sample_rate))
                    made.append(plan_rows(row.audio_id, [b / sample_rate for b in bounds], row.duration))
                else:
                    middles = [(s["start"] + s["end"]) / 2 for s in (row.silences if row.silences is not None else [])]
                    made.append(plan_rows(row.audio_id, plan_by_silence(row.duration, middles, target, most, least), row.duration, overlap))
            yield pd.concat(made) if made else pd.DataFrame({c.split()[0]: [] for c in PLAN.split(", ")})

    return audio.select("audio_id", "duration", "silences", "speech_starts").mapInPandas(planned, PLAN)


def with_method(audio: DataFrame, requested: str = "auto") -> DataFrame:
    """The segmenter that applies: by speech where starts are known, else by silence, with the reason."""
    if requested not in ("auto", "speech", "silence"):
        raise ValueError(f"unknown segmenter: {requested}")
    known = F.coalesce(F.size("speech_starts") > 0, F.lit(False))
    method = F.lit("silence") if requested == "silence" else F.when(known, "speech").otherwise("silence" if requested == "auto" else F.raise_error(F.lit("no speech segments")).cast("string"))
    return audio.withColumns({"method": method, "fallback_reason": F.when(F.lit(requested == "auto") & ~known, "no speech segments")})


def nearest(points: DataFrame, aims: DataFrame, group: str, width: float) -> DataFrame:
    """(group, aim, point): for each aim the nearest point at most width away, the smaller of two. Aims meet the points of
    their own and the neighbouring cells of that width, so no aim sees all points of its group."""
    cells = aims.withColumn("__cell", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: (F.floor(F.col("aim") / width) + d).cast("long"))))
    near = cells.join(points.withColumn("__cell", F.floor(F.col("point") / width).cast("long")), [group, "__cell"])
    near = near.where(F.abs(F.col("point") - F.col("aim")) <= width)
    return near.groupBy(group, "aim").agg(F.min(F.struct(F.abs(F.col("point") - F.col("aim")).alias("gap"), "point")).alias("best")).select(group, "aim", F.col("best.point").alias("point"))


def _compact(text: str) -> tuple[str, list[int]]:
    kept = [i for i, c in enumerate(text) if not c.isspace()]
    lowered = [text[i].lower() for i in kept]
    ends = [i for i, c in zip(kept, lowered, strict=True) for _ in c]
    return "".join(lowered), ends


def trimmed(before: str, text: str, least: int = 12, most: int = 160) -> str:
    """text without the longest start, of least to most characters besides spaces, that before ends with."""
    if least <= 0:
        return text
    (tail, _), (head, ends) = _compact(before), _compact(text)
    sizes = range(min(most, len(tail), len(head)), least - 1, -1)
    size = next((n for n in sizes if tail.endswith(head[:n])), 0)
    return text[ends[size - 1] + 1 :].lstrip() if size else text


def merged(texts: list[str], least: int = 12, most: int = 160) -> str:
    out = ""
    for text in (t.strip() for t in texts):
        fresh = trimmed(out[-3 * most :], text, least, most) if out else text
        if fresh:
            out = f"{out.rstrip()}\n{fresh}" if out else fresh
    return out.strip()


def merge_texts(segments: DataFrame, least: int = 12, most: int = 160) -> DataFrame:
    """(audio_id, text) from (audio_id, index, text), overlaps of neighbours trimmed."""

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        texts = group.sort_values("index", kind="stable")["text"].fillna("")
        return pd.DataFrame({"audio_id": [group["audio_id"].iloc[0]], "text": [merged(list(texts), least, most)]})

    return segments.select("audio_id", "index", "text").groupBy("audio_id").applyInPandas(joined, "audio_id string, text string")


def subtitle(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat_ws("\n", number.cast("string"), F.concat_ws(" --> ", timestamp_label(start), timestamp_label(end)), text, F.lit(""))


def subtitles(segments: DataFrame) -> DataFrame:
    """(audio_id, srt): numbered entries of the segments with text, in order."""
    rows = segments.withColumn("__text", strip(F.coalesce("text", F.lit("")))).where("__text <> ''")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("audio_id").orderBy("index")))
    entry = F.struct(F.col("__n"), subtitle(F.col("__n"), F.col("start"), F.col("end"), F.col("__text")).alias("entry"))
    return rows.groupBy("audio_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"]), "\n").alias("srt"))
