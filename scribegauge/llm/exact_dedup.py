"""Exact deduplication by two-pass Bloom filtering, with built-in functions only.

Pass one counts, per cell of a fixed-size Bloom filter, the rows whose text hash falls there; cells hit twice or more
form the filter of possibly repeated hashes. Pass two probes it: rows that are surely alone pass straight through, and
only the possibly repeated ones shuffle, by SHA-256. A crowded filter only makes more rows shuffle; results stay exact.

A hot group is combined on the map side; its rows meet their group's summary in a join whose both sides are dealt by
that join alone, so that adaptive execution can split the hot side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from .common import need, text_of, unioned, without, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", log2_bits: int | None = None) -> DataFrame:
    """docs plus keep_id, group_size, kept and text_sha256, one row for each row of docs.

    Texts are equal when they are after lower-casing A-Z; a null text equals an empty one. The row with the largest id
    stays; a null id is below all others. Of rows that repeat both id and text exactly one stays. An empty table gives
    no rows. Input columns named as an output are replaced. log2_bits: size of the filter, by default for 16 bits a row.
    """
    need(docs, id_column, text_column)
    docs = without(docs, "keep_id", "group_size", "kept", "text_sha256")
    rows = written(docs.withColumn("text_sha256", F.sha2(ascii_lower(text_of(text_column)), 256)).withColumn("__sg_row", F.monotonically_increasing_id()), "exact-keys")
    log2_bits = log2_bits or bitfilter.log2_bits_for(rows.count())
    pages = bitfilter.seen_twice(rows, "text_sha256", log2_bits)
    probed = bitfilter.with_maybe(rows, F.col("text_sha256"), pages, log2_bits, "__sg_maybe")

    alone = probed.where(~F.col("__sg_maybe")).withColumns({"keep_id": F.col(id_column), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    maybe = probed.where("__sg_maybe")
    groups = (
        maybe.groupBy("text_sha256")
        .agg(F.max(F.struct(F.col(id_column).alias("id"), F.col("__sg_row").alias("row"))).alias("__sg_keep"), F.count(F.lit(1)).alias("group_size"))
        .select(F.reverse("text_sha256").alias("__sg_key"), F.col("__sg_keep.id").alias("keep_id"), F.col("__sg_keep.row").alias("__sg_keep_row"), "group_size")
    )
    repeated = maybe.join(groups, F.reverse("text_sha256") == F.col("__sg_key")).withColumn("kept", F.col("__sg_row") == F.col("__sg_keep_row"))
    names = [*docs.columns, "keep_id", "group_size", "kept", "text_sha256"]
    return unioned([part.select(*[F.col(f"`{c}`") for c in names]) for part in (alone, repeated)])
