"""Weighted aggregates of score records, and profiles. One partial and one final hash aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cases import MULTIPLIERS

FLOOR = 1e-9
#: What is averaged where it applies: the column, and the name of its count.
DIAGNOSTICS = {
    "script_normalized": ("script_normalized_text_score_90", ("script_normalized_text_score_90", "script_normalized_delta_text_score_90")),
    "japanese_furigana_stripped": ("japanese_furigana_stripped_text_score_90", ("japanese_furigana_stripped_text_score_90", "japanese_furigana_stripped_delta_text_score_90")),
    "japanese_orthographic_alias": ("japanese_orthographic_alias_text_score_90", ("japanese_orthographic_alias_text_score_90", "japanese_orthographic_alias_delta_text_score_90")),
}


def weighted_mean(value: Column, weight: Column, applies: Column | None = None) -> Column:
    """Sum of value * weight over the sum of weights (never below a floor); null where no row applies."""
    applies = value.isNotNull() if applies is None else applies
    top, bottom = F.sum(F.when(applies, value * weight)), F.sum(F.when(applies, weight))
    return F.when(F.count_if(applies) > 0, top / F.greatest(bottom, F.lit(FLOOR)))


def _columns(unweighted: bool) -> list[Column]:
    weight, hot = F.col("effective_weight"), F.col("hotword_total") > 0
    out = [F.count(F.lit(1)).alias("case_count"), weighted_mean(F.col("text_score_90"), weight, F.lit(True)).alias("weighted_text_score_90")]
    if unweighted:
        out.append(F.avg("text_score_90").alias("unweighted_text_score_90"))
    for name, (test, values) in DIAGNOSTICS.items():
        applies = F.col(test).isNotNull()
        out.append(F.count_if(applies).alias(f"{name}_case_count"))
        for value in values:
            out.append(weighted_mean(F.col(value), weight, applies).alias(f"weighted_{value}"))
            if unweighted and name == "script_normalized":
                out.append(F.avg(F.when(applies, F.col(value))).alias(f"unweighted_{value}"))
    out += [F.count_if(hot).alias("hotword_case_count"), weighted_mean(F.col("hotword_f1"), weight, hot).alias("weighted_hotword_f1")]
    if unweighted:
        out.append(F.avg(F.when(hot, F.col("hotword_f1"))).alias("unweighted_hotword_f1"))
    return out


def overall(records: DataFrame) -> DataFrame:
    """One row; of no records too, with counts 0 and nulls."""
    return records.agg(*_columns(True))


def by_scenario(records: DataFrame, *more: str) -> DataFrame:
    """A row for each scenario (and each value of more columns)."""
    weights = [F.sum("effective_weight").alias("weight"), F.sum(F.col("weight").cast("double")).alias("raw_weight")]
    hot = F.col("hotword_total") > 0
    weights += [F.coalesce(F.sum(F.when(hot, F.col("effective_weight"))), F.lit(0.0)).alias("hotword_weight"), F.coalesce(F.sum(F.when(hot, F.col("weight").cast("double"))), F.lit(0.0)).alias("raw_hotword_weight")]
    weights += [F.coalesce(F.sum(F.when(F.col(test).isNotNull(), F.col("effective_weight"))), F.lit(0.0)).alias(f"{name}_weight") for name, (test, _) in DIAGNOSTICS.items()]
    return records.groupBy("scenario", *more).agg(*weights, *_columns(False))


def rollup(records: DataFrame, *columns: str) -> DataFrame:
    """Counts and weighted means at every level of a breakdown, such as language and scenario. Columns beyond a row's level
    are null; level, the grouping id, tells them from null values: 0 where none is left out."""
    return records.rollup(*columns).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("case_count"), F.sum("effective_weight").alias("weight"), weighted_mean(F.col("text_score_90"), F.col("effective_weight"), F.lit(True)).alias("weighted_text_score_90"))


def category_counts(cases: DataFrame, columns: list[str], position: str = "position", limit: int | None = None) -> DataFrame:
    """(category, value, n, first_position): counts of each column's values, most first, ties by first position."""
    from pyspark.sql import Window

    pairs = cases.select(position, F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])).alias("x"))
    counts = pairs.groupBy("x.category", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_position"))
    if limit is None:
        return counts
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "first_position")))
    return ranked.where(F.col("rank") <= limit)


def tier_summary(weighted: DataFrame) -> DataFrame:
    """Count and range of effective weights for each of the tiers, those without cases too."""
    tiers = weighted.sparkSession.createDataFrame([(t,) for t in MULTIPLIERS], "confidence_weight_tier string")
    found = weighted.groupBy("confidence_weight_tier").agg(F.count(F.lit(1)).alias("n"), F.min("effective_weight").alias("least"), F.max("effective_weight").alias("most"))
    return F.broadcast(tiers).join(found, "confidence_weight_tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hotword_presence(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_if(F.col("hotwords").isNull()).alias("missing"), F.count_if(F.size("hotwords") > 0).alias("present"), F.count_if(F.size("hotwords") == 0).alias("explicit_empty"))


def totals(cases: DataFrame) -> DataFrame:
    ready = F.coalesce(F.col("status") == "ready", F.lit(False))
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if(ready).alias("ready"), F.count_if(~ready).alias("candidates"), F.coalesce(F.sum(F.col("weight").cast("double")), F.lit(0.0)).alias("raw_weight"))
