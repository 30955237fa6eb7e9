"""Bloom filters made and probed with built-in functions only.

A filter is a table of pages (page, bits): 2^15 bits a page, so 2^log2_bits bits take 2^(log2_bits - 3) bytes in all,
whatever is put in. That bound makes it safe to broadcast. A crowded filter answers "maybe" more often; it never
answers "no" wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 15
#: 2^30 bits are 128 MiB, the largest filter that is broadcast.
LEAST_LOG2, MOST_LOG2 = 20, 30


def log2_bits_for(rows: int, bits_per_row: int = 16) -> int:
    """Bits for so many rows, within the fixed bounds."""
    return min(MOST_LOG2, max(LEAST_LOG2, (max(1, rows) * bits_per_row - 1).bit_length()))


def cells(key: Column, log2_bits: int) -> list[Column]:
    """Two cells of a 64-bit key, from two independent mixes of it."""
    mask = (1 << log2_bits) - 1
    return [F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit(mask)) for salt in (11, 47)]


def _pages(cells_of: DataFrame) -> DataFrame:
    """(page, bits) from distinct cells. Cells are dealt by page before they are packed, so no task makes all pages."""
    return (
        cells_of.select(F.shiftright("cell", PAGE_BITS).alias("page"), F.col("cell").bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).alias("at"))
        .repartition("page")
        .groupBy("page")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
    )


def seen_twice(keys: DataFrame, key: str, log2_bits: int) -> DataFrame:
    """The filter of cells that two rows or more hit. Counts are combined on the map side, so a hot key costs one row a task."""
    return _pages(
        keys.select(F.explode(F.array(*cells(F.col(key), log2_bits))).alias("cell"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def seen(keys: DataFrame, key: str, log2_bits: int) -> DataFrame:
    """The filter of all keys."""
    return _pages(keys.select(F.explode(F.array(*cells(F.col(key), log2_bits))).alias("cell")).distinct())


def with_maybe(df: DataFrame, key: Column, pages: DataFrame, log2_bits: int, name: str) -> DataFrame:
    """df with a boolean: false where the key is surely not in the filter. Nothing is shuffled: the filter is broadcast."""
    kept, tests = df.columns, []
    for i, cell in enumerate(cells(key, log2_bits)):
        page, bits, at = f"__sg_page{i}", f"__sg_bits{i}", f"__sg_at{i}"
        df = df.withColumn(at, cell).join(F.broadcast(pages.select(F.col("page").alias(page), F.col("bits").alias(bits))), F.shiftright(at, PAGE_BITS) == F.col(page), "left")
        inside = F.col(at).bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("shiftright", byte, inside.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
        tests.append(F.coalesce(bit == 1, F.lit(False)))
    return df.withColumn(name, tests[0] & tests[1]).select(*[F.col(f"`{c}`") for c in kept], name)
