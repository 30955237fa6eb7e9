"""Benchmark decontamination by spaced seeds, with built-in functions only.

A seed is the hash of the tokens at the set places of a fixed mask; the other places may differ. Every position of
every text is hashed under every mask and joined with the seeds of the benchmark's items. A hit fixes a diagonal of
text and item; along it tokens are compared in place, and the pair counts if some window of consecutive tokens agrees
in enough places. The two masks were chosen so that any window of 13 tokens with at most two substitutions holds a hit,
wherever the substitutions are. Items shorter than the window, but not than a mask, have seeds of whole runs besides: as
many disjoint runs as an item may have substitutions, and one more, so that one of them is whole. Items shorter than a
mask are looked up whole: a text overlaps one where it holds all its tokens in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, need, text_of, unioned, without, written
from .lookup import owners_of, rows_with, rows_without, text_key, texts_of, token_hashes

MASKS = ("11010111", "11110011")
WINDOW, AGREEMENT = 13, 0.8


def _seeds(tokens: Column, masks: tuple[str, ...]) -> Column:
    """array<long> of a token array: for every position in turn the seed under each mask."""
    span = len(masks[0])

    def at(i: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(m), *[F.get(tokens, i + k) for k, bit in enumerate(mask) if bit == "1"]) for m, mask in enumerate(masks)])

    return F.when(F.size(tokens) >= span, F.flatten(F.transform(F.sequence(F.lit(0), F.size(tokens) - span), at)))


def _positions(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    return rows.select(*keep, F.posexplode_outer(_seeds(F.col("__sg_tokens"), masks)).alias("__sg_pos", "seed")).withColumn("__sg_pos", (F.col("__sg_pos") / len(masks)).cast("int"))


def _runs(rows: DataFrame, keep: list[str], length: int) -> DataFrame:
    tokens = F.col("__sg_tokens")
    at = F.transform(F.sequence(F.lit(0), F.size(tokens) - length), lambda i: F.xxhash64(F.lit(-length), *[F.get(tokens, i + k) for k in range(length)]))
    return rows.select(*keep, F.posexplode_outer(F.when(F.size(tokens) >= length, at)).alias("__sg_pos", "seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, agreement: float = AGREEMENT) -> DataFrame:
    """(__sg_key, item_id, agreeing, compared): distinct texts of docs and the items that they overlap.

    agreeing of compared tokens are equal along the best diagonal. An item shorter than the window is compared as a
    whole, and one shorter than a mask has to agree in every token.
    """
    if len({len(m) for m in masks}) != 1:
        raise ValueError("masks must be equally long")
    items = benchmark.select(F.col(item_column).alias("item_id"), token_hashes(text_of(item_text_column)).alias("__sg_tokens")).distinct()
    items = written(items.withColumn("__sg_item", F.xxhash64("item_id", "__sg_tokens")), "benchmark-items")
    # e substitutions leave one of e + 1 runs whole
    size = F.size("__sg_tokens")
    run = F.when(size < len(masks[0]), size).otherwise(F.floor(size / (F.floor(size * (1 - agreement) + 1e-9) + 1)).cast("int"))
    short = items.where((size > 0) & (size < window)).withColumn("__sg_run", run)
    lengths = sorted(r[0] for r in short.select("__sg_run").distinct().collect())
    seeds = unioned([_positions(items, ["__sg_item"], masks), *[_runs(short.where(F.col("__sg_run") == n), ["__sg_item"], n) for n in lengths]])
    seeds = written(seeds.withColumnRenamed("__sg_pos", "__sg_at").distinct(), "benchmark-seeds")
    text = text_of(text_column)
    rows = docs.select(text_key(text).alias("__sg_key"), token_hashes(text).alias("__sg_tokens"))
    hits = owners_of(unioned([_positions(rows, ["__sg_key"], masks), *[_runs(rows, ["__sg_key"], n) for n in lengths]]), seeds)
    hits = written(hits.select("__sg_key", "__sg_item", (F.col("__sg_pos") - F.col("__sg_at")).alias("__sg_diagonal")).distinct(), "benchmark-hits")
    texts = texts_of(docs, text_column, hits.select("__sg_key").distinct()).select(F.reverse("__sg_key").alias("__sg_other"), token_hashes(F.col("__sg_text")).alias("__sg_tokens"))
    pairs = hits.join(texts, F.reverse("__sg_key") == F.col("__sg_other")).join(items.withColumnRenamed("__sg_tokens", "__sg_item_tokens"), "__sg_item")
    low = F.greatest(F.lit(0), -F.col("__sg_diagonal"))
    high = F.least(F.size("__sg_item_tokens"), F.size("__sg_tokens") - F.col("__sg_diagonal")) - 1
    same = F.transform(F.sequence(low, high), lambda k: (F.get("__sg_item_tokens", k) == F.get("__sg_tokens", k + F.col("__sg_diagonal"))).cast("int"))
    pairs = pairs.select("__sg_key", "item_id", same.alias("__sg_same"), F.least(F.lit(window), F.size("__sg_item_tokens")).alias("__sg_window"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    starts = F.sequence(F.lit(1), F.size("__sg_same") - F.col("__sg_window") + 1)
    enough = F.exists(starts, lambda s: total(F.slice("__sg_same", s, F.col("__sg_window"))) >= agreement * F.col("__sg_window"))
    found = pairs.where(F.size("__sg_same") >= F.col("__sg_window")).where(enough).select("__sg_key", "item_id", F.struct(total(F.col("__sg_same")).alias("agreeing"), F.size("__sg_same").alias("compared")).alias("__sg_best"))
    best = found.groupBy("__sg_key", "item_id").agg(F.max("__sg_best").alias("__sg_best"))
    found = written(best.select("__sg_key", "item_id", "__sg_best.agreeing", "__sg_best.compared"), "benchmark-overlaps")
    discard(items, seeds, hits)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """docs plus item_id, agreeing and compared: a row for each row of docs and each item that its text overlaps.

    Null and empty texts and items overlap nothing; equal texts have equal overlaps, repeated items count once; empty
    tables give no rows. Input columns named as an output are replaced.
    """
    need(docs, text_column)
    docs = without(docs, "item_id", "agreeing", "compared")
    return rows_with(docs, text_column, overlaps(docs, benchmark, text_column, **options))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows of docs that overlap no item, with docs' columns. Cases are as in contaminated()."""
    need(docs, text_column)
    docs = without(docs)
    return rows_without(docs, text_column, overlaps(docs, benchmark, text_column, **options).select("__sg_key").distinct())
