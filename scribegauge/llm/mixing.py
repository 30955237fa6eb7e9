"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. Each source gets a target in tokens; it is taken whole as often
as fits, and the rest is a budget that a subset of its documents has to fill. A proportional share of every length is
taken first; what is left is a small budget, filled by a bounded-knapsack dynamic programme over the lengths still
there. The programme sees lengths and counts only, one source a time. Which documents of a length are taken is
decided by a seeded hash.

Hot sources or lengths: a length's documents are dealt to BUCKETS buckets of the seeded hash, and counts of buckets
say how many each gives, so that ranks are needed within a bucket only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need, text_of, without, written

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: About the largest budget that is left to the dynamic programme, in tokens.
MOST_CELLS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most_repeats: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in order of code points, null last, take the weights in turn. With shares s.t. target = min(cap, level *
    weight), the level is found from the sources sorted by cap / weight: those below it are at their cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    at = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    capped = Window.orderBy("__sg_ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = capped.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    rows = sizes.withColumn("__sg_weight", weight).withColumn("__sg_cap", most_repeats * F.col("source_size")).withColumn("__sg_ratio", F.col("__sg_cap") / F.col("__sg_weight"))
    rows = rows.withColumn("__sg_total", F.sum("source_size").over(every) * F.lit(float(total_share)))
    rows = rows.withColumn("__sg_left", F.col("__sg_total") - F.coalesce(F.sum("__sg_cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("__sg_weights", F.sum("__sg_weight").over(every) - F.coalesce(F.sum("__sg_weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("__sg_level", F.col("__sg_left") / F.col("__sg_weights"))
    # the first source whose cap isn't below its level sets the level; those of later sources are no higher
    level = F.max(F.when(F.col("__sg_ratio") >= F.col("__sg_level"), F.col("__sg_level"))).over(every)
    return rows.withColumn("target", F.least("__sg_cap", F.coalesce(level, F.lit(float("inf"))) * F.col("__sg_weight"))).select("source", "source_size", "target")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to the budget as can be, not above.

    lengths: distinct and positive. The proportional share of each length is rounded down, and a bounded knapsack fills
    the rest. If it cannot fill all of it, the share gives back documents of every length, twice as many each time, and
    the knapsack tries again with more to choose from; without a share it chooses freely, so what it then finds is the
    optimum. A rest above MOST_CELLS first takes whole documents, largest lengths first, down to about that size.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    # sums are multiples of the lengths' common divisor, so a rest below it can't be filled
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    lengths, budget = lengths // unit, budget // unit
    share = np.minimum(counts, np.floor(counts * (budget * unit / total)).astype(np.int64))
    missed, back = budget + 1, 0
    while True:
        held = np.maximum(share - back, 0)
        while int((held * lengths).sum()) > budget:  # the share's quotient was rounded up
            held = np.maximum(held - 1, 0)
        held = held + _bulk(lengths, counts - held, budget - int((held * lengths).sum()) - MOST_CELLS)
        held = held + _knapsack(lengths, counts - held, budget - int((held * lengths).sum()))
        left = budget - int((held * lengths).sum())
        if left < missed:
            take, missed = held, left
        if missed == 0 or back >= share.max():
            return take
        back = max(1, 2 * back)


def _bulk(lengths: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """Whole documents that fit in room, largest lengths first."""
    take = np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable") if room > 0 else ():
        take[i] = min(int(counts[i]), room // int(lengths[i]))
        room -= int(take[i]) * int(lengths[i])
    return take


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the largest sum up to the budget. Sets of reachable sums are the bits of one integer; counts
    are split into powers of two. The set before each part that added to it is kept, so the taken parts can be read back."""
    take = np.zeros(len(lengths), dtype=np.int64)
    usable = [i for i in range(len(lengths)) if counts[i] > 0 and lengths[i] <= budget]
    reach, mask, steps = 1, (1 << (budget + 1)) - 1, []
    for i in sorted(usable, key=lambda i: int(lengths[i])):
        left, part = min(int(counts[i]), budget // int(lengths[i])), 1
        while left > 0 and not reach >> budget & 1:
            part = min(part, left)
            grown = (reach | reach << part * int(lengths[i])) & mask
            if grown != reach:
                steps.append((i, part, reach))
            reach, left, part = grown, left - part, part * 2
    at = reach.bit_length() - 1
    for i, part, earlier in reversed(steps):
        if not earlier >> at & 1:
            take[i] += part
            at -= part * int(lengths[i])
    return take


def _plan(source: pd.DataFrame) -> pd.DataFrame:
    """Base copies and the number of documents that get one more, for every length of one source."""
    size, target = int(source["__sg_source_size"].iloc[0]), float(source["__sg_target"].iloc[0])
    base = int(np.floor(target / size + 1e-12)) if size else 0
    lengths, counts = source["size"].to_numpy(np.int64), source["n"].to_numpy(np.int64)
    more = fit_counts(lengths, counts, int(round(target)) - base * size) if size else np.zeros(len(lengths), np.int64)
    return pd.DataFrame({"__sg_source": source["__sg_source"], "size": lengths, "__sg_base": base, "__sg_more": more})


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, most_repeats: float = 2.0, seed: int = 20240607) -> DataFrame:
    """docs plus size, source_size, target, copies and taken, one row for each row of docs.

    size: runs of anything but ASCII white space (a null text has none). The sources share total_share of all sizes by
    their weights, none more than most_repeats times its own size. copies: how often the mix takes the document; taken =
    copies * size. A source's taken words are at most its rounded target and miss it by less than the smallest gap that
    its documents can fill. A null source is a source of its own; documents without words are taken as often as their
    source is whole. An empty table gives no rows. Reruns give the same copies for rows of different ids or sizes; rows
    that repeat id and size may swap theirs. Input columns named as an output are replaced.
    """
    need(docs, id_column, text_column, source_column)
    outputs = ("size", "source_size", "target", "copies", "taken")
    docs = without(docs, *outputs)
    key = F.xxhash64(F.lit(seed), F.col(id_column).cast("string"))
    source = _keyed(F.col(source_column).cast("string"))
    rows = written(docs.withColumns({"size": F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long"), "__sg_source": source, "__sg_hash": key, "__sg_bucket": F.pmod(key, F.lit(BUCKETS)).cast("int")}), "mix-sizes")
    buckets = written(rows.groupBy("__sg_source", "size", "__sg_bucket").agg(F.count(F.lit(1)).alias("n")), "mix-buckets")
    lengths = buckets.groupBy("__sg_source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("__sg_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(sizes.withColumn("source", F.expr("substr(__sg_source, 2)")).withColumn("source", F.when(F.col("__sg_source") != "-", F.col("source"))), weights, total_share, most_repeats)
    aims = written(aims.select(_keyed(F.col("source")).alias("__sg_source"), F.col("source_size").alias("__sg_source_size"), F.col("target").alias("__sg_target")), "mix-targets")
    counted = lengths.where("size > 0").join(aims, "__sg_source")
    plans = counted.groupBy("__sg_source").applyInPandas(_plan, "__sg_source string, size long, __sg_base int, __sg_more long")
    ordered = Window.partitionBy("__sg_source", "size").orderBy("__sg_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        buckets.join(plans, ["__sg_source", "size"])
        .withColumn("__sg_before", F.coalesce(F.sum("n").over(ordered), F.lit(0)))
        .select("__sg_source", "size", "__sg_bucket", "__sg_base", F.greatest(F.lit(0), F.least("n", F.col("__sg_more") - F.col("__sg_before"))).alias("__sg_quota"))
    )
    dealt = ["__sg_source", "size", "__sg_bucket"]
    ranked = rows.withColumn("__sg_rank", F.row_number().over(Window.partitionBy(*dealt).orderBy("__sg_hash", id_column)))
    mixed = ranked.join(quotas, dealt, "left").join(F.broadcast(aims) if _few(aims) else aims, "__sg_source", "left")
    copies = F.coalesce(F.col("__sg_base"), F.floor(F.col("__sg_target") / F.col("__sg_source_size") + 1e-12), F.lit(0)) + (F.col("__sg_rank") <= F.coalesce("__sg_quota", F.lit(0))).cast("int")
    mixed = mixed.withColumns({"source_size": F.col("__sg_source_size"), "target": F.col("__sg_target"), "copies": copies.cast("long")}).withColumn("taken", F.col("copies") * F.col("size"))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], *outputs)


def _keyed(source: Column) -> Column:
    """A source as a key that no null is; it sorts as the source does, except that null is '-'."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


#: Sources whose targets are broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000


def _few(aims: DataFrame) -> bool:
    return aims.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
