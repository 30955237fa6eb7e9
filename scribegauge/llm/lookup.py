"""What the two searches for known passages share: tokens, text keys, seed lookups and the texts that they hit.

Built-in functions only. Verdicts depend on the text alone, so they are found once for each distinct text and carried
to its rows afterwards; a text that a third of all rows repeat costs one verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from .common import text_of, unioned

#: Seeds are broadcast up to this number (8 bytes each and their owner: some 100 MB); more are joined by a shuffle.
MOST_BROADCAST_SEEDS = 2_000_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of a text's tokens: runs of letters and digits, lower-cased."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def text_key(text: Column) -> Column:
    return F.md5(text)


def owners_of(positions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Join exploded positions (seed, ...) with seeds (seed, ...); broadcast only if they are few."""
    few = seeds.limit(MOST_BROADCAST_SEEDS + 1).count() <= MOST_BROADCAST_SEEDS
    return positions.join(F.broadcast(seeds) if few else seeds, "seed")


def texts_of(docs: DataFrame, text_column: str, keys: DataFrame) -> DataFrame:
    """(__sg_key, __sg_text) for the keys, one row each. A fixed-size filter keeps all other texts from the shuffle."""
    log2_bits = bitfilter.log2_bits_for(keys.count())
    text = text_of(text_column)
    rows = docs.select(text.alias("__sg_text"), text_key(text).alias("__sg_key"))
    probed = bitfilter.with_maybe(rows, F.col("__sg_key"), bitfilter.seen(keys, "__sg_key", log2_bits), log2_bits, "__sg_maybe")
    return probed.where("__sg_maybe").groupBy("__sg_key").agg(F.first("__sg_text").alias("__sg_text"))


def split_by(docs: DataFrame, text_column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with __sg_key: rows whose text surely has none of the keys, and the others."""
    log2_bits = bitfilter.log2_bits_for(keys.count())
    rows = docs.withColumn("__sg_key", text_key(text_of(text_column)))
    probed = bitfilter.with_maybe(rows, F.col("__sg_key"), bitfilter.seen(keys, "__sg_key", log2_bits), log2_bits, "__sg_maybe")
    return probed.where(~F.col("__sg_maybe")).drop("__sg_maybe"), probed.where("__sg_maybe").drop("__sg_maybe")


def rows_with(docs: DataFrame, text_column: str, verdicts: DataFrame) -> DataFrame:
    """docs joined with verdicts (__sg_key, ...) on their text. The hot side of the join can be split as it runs."""
    _, maybe = split_by(docs, text_column, verdicts.select("__sg_key").distinct())
    other = verdicts.withColumn("__sg_other", F.reverse("__sg_key")).drop("__sg_key")
    return maybe.join(other, F.reverse("__sg_key") == F.col("__sg_other")).drop("__sg_key", "__sg_other")


def rows_without(docs: DataFrame, text_column: str, keys: DataFrame) -> DataFrame:
    """docs without the rows whose text has one of the keys (distinct). Rows that surely have none don't shuffle."""
    free, maybe = split_by(docs, text_column, keys)
    other = keys.select(F.reverse("__sg_key").alias("__sg_other"))
    return unioned([free.drop("__sg_key"), maybe.join(other, F.reverse("__sg_key") == F.col("__sg_other"), "left_anti").drop("__sg_key")])
