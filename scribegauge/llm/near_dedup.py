"""Near-deduplication by Order MinHash, verified by banded alignment.

A text's k-mers are runs of K words (single words in short texts), each labelled with the number of its earlier occurrences.
Of each of SKETCHES permutations a text keeps its TAKEN least labelled k-mers in the order in which the text has them; their
hash is a sketch (Marcais et al., 2019). Two texts that share a sketch are candidates. Texts of the same words are one
class first; only one text of a class goes on.

In the buckets of the first few sketches each member is compared with the bucket's leader, which joins large groups of
near copies at linear cost. Links are joined to components. After that, each pair of a bucket that is still in different
components is linked or rejected in bounded blocks: by length and counts of words, which can rule a link out but not
in, and else by the exact edit distance over words, computed in a diagonal band as wide as the similarity allows. The
smallest id of each component stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from . import bitfilter
from .common import discard, need, unioned, with_python, without, written
from .components import components
from .grams import BASE, _powers_of, mixed, packed, word_hashes, words_in

SIMILARITY = 0.8
SKETCHES, TAKEN = 56, 3
#: k, and the least and most words of the texts that are sketched by it. The spans overlap by more than the similarity
#: lets lengths differ, so that any two texts that can be linked have a k in common.
SPANS = ((1, 4, 40), (2, 32, 1 << 62))
#: Sketches whose buckets' leaders are compared first.
FIRST = 8
#: Counters of a text's bag of words; members and words of a salt.
BAG, BLOCK, BLOCK_WORDS = 256, 2000, 1 << 21
#: K-mers that a permutation has to sort in a longer text, on average.
_SORTED = 18
_OTHER_BASE = 0xD1342543DE82EF95
_BANDS = [int(x) | 1 for x in mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(BASE))]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and how many each text has."""
    found, counts = [], np.zeros(len(texts), np.int64)
    for numbers, held in packed([t.lower() for t in texts]):
        points, joints, starts, ends = words_in(held)
        found.append(word_hashes(points, starts, ends) if len(starts) else np.zeros(0, np.uint64))
        piece = np.searchsorted(joints, starts, side="right") - 1
        counts += np.bincount(np.asarray(numbers)[piece], minlength=len(texts)) if len(starts) else 0
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def _labelled(owner: np.ndarray, kmers: np.ndarray) -> np.ndarray:
    """Hashes of k-mers together with the number of their earlier occurrences in the same text."""
    order = np.lexsort((kmers, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (kmers[order][1:] != kmers[order][:-1])
    first = np.flatnonzero(new)
    seen = np.zeros(len(order), np.uint64)
    seen[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return mixed(kmers + seen * np.uint64(_OTHER_BASE))


def sketches_of(words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each text its sketches, SKETCHES for each k of SPANS that its number of words allows. A text of fewer than
    TAKEN k-mers has sketches of all of them."""
    begin = np.cumsum(counts) - counts
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k, least, most in SPANS:
        length = np.where((counts >= least) & (counts <= most), counts - k + 1, 0)
        texts = np.flatnonzero(length)
        if not len(texts):
            continue
        length = length[texts]
        ends = np.cumsum(length)
        owner = np.repeat(np.arange(len(texts)), length)
        place = np.arange(len(owner)) + np.repeat(begin[texts] - ends + length, length)
        kmers = np.full(len(owner), k, np.uint64)
        for i in range(k):
            kmers = kmers * np.uint64(BASE) + words[place + i]
        hashes = _labelled(owner, kmers)
        # only k-mers below a text's limit are sorted; a text that has too few of them there is sorted whole
        limit = np.repeat(np.where(length > _SORTED, (np.minimum(_SORTED / length, 1.0) * 2.0**53).astype(np.uint64) << np.uint64(11), np.uint64(2**64 - 1)), length)
        taken = np.minimum(length, TAKEN)
        starts = np.cumsum(taken) - taken
        rank = np.arange(int(taken.sum())) - np.repeat(starts, taken)
        for band, factor in enumerate(_BANDS):
            values = hashes * np.uint64(factor)
            low = values <= limit
            held = np.bincount(owner[low], minlength=len(texts)) if len(texts) > 1 else np.array([low.sum()])
            if (held < taken).any():
                low |= (held < taken)[owner]
            at = np.flatnonzero(low)
            order = np.argsort(owner[at].astype(np.uint64) << np.uint64(40) | values[at] >> np.uint64(24), kind="stable")
            held = np.bincount(owner[at], minlength=len(texts))
            inside = np.arange(len(at)) - np.repeat(np.cumsum(held) - held, held)
            chosen = at[np.sort(order[inside < np.repeat(taken, held)])]
            total = np.add.reduceat(hashes[chosen] * _powers_of(BASE, TAKEN)[rank], starts)
            owners.append(texts)
            found.append(mixed(total + np.uint64(k * SKETCHES + band)))
    owner = np.concatenate(owners)
    keys = np.concatenate(found)[np.argsort(owner, kind="stable")]
    return np.split(keys, np.cumsum(np.bincount(owner, minlength=len(counts)))[:-1]) if len(counts) else []


def sequences_of(words: np.ndarray, counts: np.ndarray) -> list[str]:
    """128-bit keys of the texts' word sequences."""
    begin = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(begin, counts)
    longest = int(counts.max()) if len(counts) else 0
    keys = []
    for base in (BASE, _OTHER_BASE):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers_of(base, max(1, longest))[place], dtype=np.uint64)])
        keys.append(mixed(sums[begin + counts] - sums[begin] + counts.astype(np.uint64)))
    return [f"{a:016x}{b:016x}" for a, b in zip(*keys, strict=True)]


def bags_of(words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """For each text BAG counters of its words by hash, up to 255. An edit raises at most one of them and lowers at most one."""
    owner = np.repeat(np.arange(len(counts)), counts)
    held = np.bincount(owner * BAG + (words % np.uint64(BAG)).astype(np.int64), minlength=len(counts) * BAG)
    return [row.tobytes() for row in np.minimum(held, 255).astype(np.uint8).reshape(-1, BAG)]


def blocks(texts: list[str], characters: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of whole texts of about so many characters, so that working arrays stay small."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > characters:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit distance over words is at most (1 - similarity) of the longer text's length."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return edit_distance_within(a, b, most, exact=False) <= most


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int, exact: bool = True) -> int:
    """The edit distance of two word sequences if it is at most most, else more than most. Not exact: at most most if it is."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if not exact and max(len(a), len(b)) <= most:
        return most
    listed, other = a.tolist(), b.tolist()
    words, others = set(listed), set(other)
    if max(len(words), len(others)) - len(words & others) > most:
        return most + 1
    most_here = min(most, max(len(a), len(b)))
    return _banded(listed, other, most_here) if len(a) > most_here else _whole(listed, other)


def _whole(a: list[int], b: list[int]) -> int:
    """The edit distance by whole columns of the table, each as bits of integers: for remainders that a band would cover."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for x in b:
        equal = places.get(x, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(right & last)
        distance -= bool(left & last)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(diagonal | right)) & full, right & diagonal & full
    return distance


def _banded(a: list[int], b: list[int], most: int) -> int:
    """The table's diagonals from -most to most, one column at a time, as bits of integers.

    Bit r of a vector belongs to row column - most + r. up and down hold where the value rises or falls from the row
    above. Along the lowest diagonal the distance is known from the start (most); once the band's lower edge reaches the
    last row, it is followed along that row. Needs len(a) > most.
    """
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down, distance = full ^ ((1 << most) - 1), 0, most
    turn = len(a) - most
    lowest = 1 << (width - 1)
    for column, x in enumerate(b, 1):
        first = column - most - 1
        held = places.get(x, 0)
        equal = (held >> first if first >= 0 else held << -first) & full
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        if column <= turn:
            distance += not diagonal & lowest
        else:
            last = 1 << (len(a) - column + most)
            distance += bool(right & last)
            distance -= bool(left & last)
        diagonal >>= 1
        up, down = (left | ~(diagonal | right)) & full, diagonal & right
    return distance


def _sketched(docs: DataFrame, text_column: str, keep_text: bool) -> DataFrame:
    def compute(texts: list[str | None]) -> dict:
        made: dict[str, list] = {"__sg_sequence": [], "__sg_sketches": [], "__sg_words": [], "__sg_bag": []}
        for block in blocks([t or "" for t in texts]):
            words, counts = words_of(block)
            ends = np.cumsum(counts)
            made["__sg_sequence"] += sequences_of(words, counts)
            made["__sg_sketches"] += [x.view(np.int64) for x in sketches_of(words, counts)]
            made["__sg_bag"] += bags_of(words, counts)
            made["__sg_words"] += [words[e - c : e].astype(np.uint32).view(np.int32) for e, c in zip(ends, counts, strict=True)]
        return made

    fields = [StructField("__sg_sequence", StringType()), StructField("__sg_sketches", ArrayType(LongType())), StructField("__sg_words", ArrayType(IntegerType())), StructField("__sg_bag", BinaryType())]
    return with_python(docs, text_column, compute, fields, keep_text)


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """pairs (node, leader) plus alike. Words of texts that no pair names are kept from the shuffle by a fixed-size filter."""
    nodes = pairs.select(F.explode(F.array("node", "leader")).alias("node")).distinct()
    log2_bits = bitfilter.log2_bits_for(pairs.count() * 2)
    needed = bitfilter.with_maybe(words, F.col("node"), bitfilter.seen(nodes, "node", log2_bits), log2_bits, "__sg_maybe").where("__sg_maybe").drop("__sg_maybe")
    both = pairs.join(needed.withColumnRenamed("words", "a"), "node").join(needed.select(F.col("node").alias("leader"), F.col("words").alias("b")), "leader").select("node", "leader", "a", "b")

    def compared(batches):
        import pyarrow as pa

        for batch in batches:
            sides = []
            for name in ("a", "b"):
                column = batch.column(name)
                values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                sides.append([values[ends[i] : ends[i + 1]] for i in range(len(column))])
            same = [alike(x, y, similarity) for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("leader"), pa.array(same, pa.bool_())], names=["node", "leader", "alike"])

    return both.mapInArrow(compared, "node long, leader long, alike boolean")


def links_of(members: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between the leader of each bucket of members (node, key) and those that are alike."""
    leaders = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("by"), "node")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = leaders.select(F.bitwise_not("key").alias("other"), F.col("least.node").alias("leader"))
    led = members.join(leaders, F.bitwise_not("key") == F.col("other")).where("node <> leader")
    return _alike_of(written(led.select("node", "leader").distinct(), "near-pairs"), words, similarity)


def _alike_of(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    links = written(_verified(pairs, words, similarity).where("alike").select(F.col("node").alias("u"), F.col("leader").alias("v")), "near-links")
    discard(pairs)
    return links


def settled(block: dict[str, np.ndarray], sketches: list[np.ndarray], words: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between a block's members of different roots: enough of them that every pair that is alike, and has its least
    common sketch as the block's key, gets connected. Pairs nearest by their bags are compared first, and pairs that
    links of this block already connect are not compared."""
    # by length, so that the members whose lengths fit lie together
    order = np.lexsort((block["count"], block["salt"]))
    node, root, count, home, salt, key = (block[k][order] for k in ("node", "root", "count", "home", "salt", "key"))
    bags = np.ascontiguousarray(block["bag"][order].T)  # a counter of all members lies together
    sketches, words = [sketches[i] for i in order], [words[i] for i in order]
    sums = bags.sum(axis=0, dtype=np.int64)
    cut = int(np.searchsorted(salt, salt[0], side="right"))
    here, there = (0, cut), (cut, len(node))
    if there[0] < there[1] and there[1] - there[0] < cut:
        here, there = there, here
    lefts, rights, fars = [], [], []
    for i in range(*here):
        first, last = there if there[0] < there[1] else (i + 1, here[1])
        first = first + int(np.searchsorted(count[first:last], math.floor(count[i] * similarity) - 1))
        last = first + int(np.searchsorted(count[first:last], math.ceil(count[i] / max(similarity, 1e-9)) + 1, side="right"))
        at = slice(first, last)
        most = ((1 - similarity) * np.maximum(count[i], count[at]) + 1e-9).astype(np.int64)
        fit = (root[at] != root[i]) & (home[at] | home[i]) & (np.abs(count[at] - count[i]) <= most) & (key[at] == key[i])
        if not fit.any():
            continue
        # at most BAG * 255, which 16 bits without a sign hold
        far = np.abs(bags[:, at] - bags[:, i : i + 1]).view(np.uint16).sum(axis=0, dtype=np.uint16).astype(np.int64)
        possible = np.flatnonzero(fit & ((far + np.abs(sums[at] - sums[i])) // 2 <= most))
        if len(possible):
            lefts.append(np.full(len(possible), i, np.int32))
            rights.append((first + possible).astype(np.int32))
            fars.append(far[possible])
    if not lefts:
        return []
    left, right = np.concatenate(lefts), np.concatenate(rights)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    links: list[tuple[int, int]] = []
    held: dict[int, set[int]] = {}

    def least_common(i: int, j: int) -> int:
        for x in (i, j):
            if x not in held:
                held[x] = set(sketches[x].tolist())
        return min(held[i] & held[j])

    def compare(i: int, j: int) -> None:
        a, b = top(int(root[i])), top(int(root[j]))
        if a != b and alike(words[i], words[j], similarity):
            above[max(a, b)] = min(a, b)
            links.append((int(node[i]), int(node[j])))

    near = np.concatenate(fars)
    order = np.argsort(near, kind="stable")
    left, right, near = left[order], right[order], 1.0 / (1 + near[order])

    def open_pairs() -> np.ndarray:
        tops = np.array([top(int(x)) for x in root])
        return np.flatnonzero(tops[left] != tops[right])

    # first the members that are nearest to the others on average, such as the middle of a star: this order only saves time
    rest, tried = np.arange(len(left)), np.zeros(len(node), bool)
    for _ in range(8):
        if len(rest) <= len(node):
            break
        pairs = np.bincount(left[rest], minlength=len(node)) + np.bincount(right[rest], minlength=len(node))
        total = np.bincount(left[rest], near[rest], len(node)) + np.bincount(right[rest], near[rest], len(node))
        middle = int(np.where(tried | (2 * pairs < pairs.max()), -1.0, total / np.maximum(pairs, 1)).argmax())
        tried[middle] = True
        for k in rest[(left[rest] == middle) | (right[rest] == middle)].tolist():
            compare(int(left[k]), int(right[k]))
        rest = open_pairs()
    # each member with its nearest; then all that is left
    _, least = np.unique(np.stack([left[rest], right[rest]], axis=1).ravel(), return_index=True)
    for k in rest[np.unique(least // 2)].tolist():
        compare(int(left[k]), int(right[k]))
    for k in open_pairs().tolist():
        i, j = int(left[k]), int(right[k])
        if top(int(root[i])) != top(int(root[j])) and least_common(i, j) == key[i]:
            compare(i, j)
    return links


_NUMBERS = ("bucket", "first", "second", "node", "root", "count", "home", "salt", "key")


def _settled_blocks(similarity: float):
    """For mapInArrow: rows come sorted by block; a block may go on in the next batch."""

    def flat(batch, name: str) -> list[np.ndarray]:
        column = batch.column(name)
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [values[ends[r] : ends[r + 1]] for r in range(len(column))]

    def settle(batches):
        import pyarrow as pa

        def closed(parts: list) -> pa.RecordBatch | None:
            if sum(len(p[0]["node"]) for p in parts) < 2:
                return None
            block = {c: np.concatenate([p[0][c] for p in parts]) for c in _NUMBERS}
            block["bag"] = np.frombuffer(b"".join(x for p in parts for x in p[1]), np.uint8).reshape(-1, BAG).astype(np.int16)
            links = settled(block, [x for p in parts for x in p[2]], [x for p in parts for x in p[3]], similarity)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["u", "v"]) if links else None

        held, last = [], None
        for batch in batches:
            numbers = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _NUMBERS}
            bags, sketches, words = batch.column("bag").to_pylist(), flat(batch, "sketches"), flat(batch, "words")
            new = np.zeros(batch.num_rows, bool)
            for c in ("bucket", "first", "second"):
                new[1:] |= numbers[c][1:] != numbers[c][:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                name = tuple(int(numbers[c][a]) for c in ("bucket", "first", "second"))
                if held and name != last:
                    if (out := closed(held)) is not None:
                        yield out
                    held = []
                held.append(({c: numbers[c][a:b] for c in _NUMBERS}, bags[a:b], sketches[a:b], words[a:b]))
                last = name
        if held and (out := closed(held)) is not None:
            yield out

    return settle


def _crossing(members: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that connect all members (node, key, count) which share a key, have different roots (u, root) and are alike.

    A bucket falls into groups of like lengths; a member belongs to its own group and to the next, so that any two texts
    whose lengths allow a link meet. Of a group the members of its largest component need no comparison with each other.
    Where a group is too large for one block, they and the others are dealt into salts of bounded size; each two salts of the others, and each of these and each of
    the largest component's, meet in a block. What is compared grows with the square of the texts of a group that are not
    alike; what a task holds does not.
    """
    members = members.join(roots, members["node"] == roots["u"], "left").select("node", "key", "count", F.coalesce("root", "node").alias("root"))
    members = rooted = written(members, "near-rooted")
    mixed_keys = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select(F.bitwise_not("key").alias("other"))
    members = members.join(mixed_keys, F.bitwise_not("key") == F.col("other")).drop("other")
    # a little more than the ratio that a link allows, so that rounding can't part two texts
    step = math.log(1.0001 / max(similarity, 1e-9))
    own = F.floor(F.log(F.col("count").cast("double")) / step)
    members = members.withColumn("own", own).withColumn("group", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("home", F.col("own") == F.col("group"))
    members = written(members.withColumn("bucket", F.xxhash64("key", "group")).drop("own", "group"), "near-grouped")
    discard(rooted)
    parts = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("count").cast("long")).alias("w"), F.max("home").alias("home"))
    groups = parts.groupBy("bucket").agg(F.max(F.struct("n", "root", "w")).alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("home").alias("any")).where("roots > 1 and any")

    def salts(n, w):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_WORDS), F.lit(1)).cast("int")

    groups = groups.select(F.bitwise_not("bucket").alias("other"), F.col("most.root").alias("major"), salts(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("few"), salts(F.col("most.n"), F.col("most.w")).alias("many"), salts(F.col("n"), F.col("w")).alias("whole"))
    # what fits in one block as a whole goes there: few is 0 then, and the one salt is the largest component's
    groups = groups.withColumn("few", F.when(F.col("whole") == 1, 0).otherwise(F.col("few"))).withColumn("many", F.when(F.col("whole") == 1, 1).otherwise(F.col("many"))).drop("whole")
    dealt = members.join(groups, F.bitwise_not("bucket") == F.col("other")).withColumn("in_major", (F.col("few") == 0) | (F.col("root") == F.col("major")))
    dealt = dealt.withColumn("salt", F.when(F.col("in_major"), F.col("few") + F.pmod(F.xxhash64("node", "bucket"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node", "bucket"), F.col("few"))).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("in_major"), F.greatest("few", F.lit(1))).otherwise(F.col("few") + F.col("many")) - 1)))
    dealt = dealt.select("bucket", F.least("salt", "with").alias("first"), F.greatest("salt", "with").alias("second"), "node", "root", "count", "home", "salt", "key")
    dealt = written(dealt, "near-dealt")
    discard(members)
    wanted = dealt.select("node").distinct()
    log2_bits = bitfilter.log2_bits_for(dealt.count())
    needed = bitfilter.with_maybe(texts, F.col("node"), bitfilter.seen(wanted, "node", log2_bits), log2_bits, "__sg_maybe").where("__sg_maybe").drop("__sg_maybe")
    blocks_of = dealt.join(needed, "node").select(*_NUMBERS, "bag", "sketches", "words").repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    links = written(blocks_of.mapInArrow(_settled_blocks(similarity), "u long, v long"), "near-links")
    discard(dealt)
    return links


def linked_classes(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(u, root) for the nodes of members (node, count, band, key) that links connect; texts: (node, bag, sketches, words)."""
    links = links_of(members.where(F.col("band") % SKETCHES < FIRST).select("node", "key"), texts.select("node", "words"), similarity)
    more = _crossing(members, components(links), texts, similarity)
    return components(links.unionByName(more))


def _members(classes: DataFrame) -> DataFrame:
    """(node, count, band, key): sketches that more than one class has, by a fixed-size filter; some others pass, too."""
    members = classes.select("node", "count", F.posexplode("sketches").alias("band", "key"))
    shared = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "near-shared")
    log2_bits = bitfilter.log2_bits_for(shared.count())
    maybe = bitfilter.with_maybe(members, F.col("key"), bitfilter.seen(shared, "key", log2_bits), log2_bits, "__sg_maybe")
    members = written(maybe.where("__sg_maybe").drop("__sg_maybe"), "near-members")
    discard(shared)
    return members


def _numbered(docs: DataFrame, id_column: str, text_column: str, keep_text: bool) -> tuple[DataFrame, DataFrame, str]:
    """Rows with a number, their sketches by that number (the same table where texts are not kept), and the name of the
    id beside the sketches. Texts lie apart from the sketches, so that these can be deleted when classes are known."""
    number = F.monotonically_increasing_id()
    if not keep_text:
        rows = written(_sketched(docs, text_column, False).withColumn("__sg_row", number), "near-rows")
        return rows, rows, id_column
    rows = written(docs.withColumn("__sg_row", number), "near-rows")
    narrow = rows.select("__sg_row", F.col(f"`{id_column}`").alias("__sg_id"), F.col(f"`{text_column}`"))
    return rows, written(_sketched(narrow, text_column, False), "near-sketches"), "__sg_id"


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, keep_text: bool = True) -> DataFrame:
    """docs plus class_id, copy_of and kept, one row for each row of docs.

    Words are runs of anything but white space, lower-cased. copy_of: the smallest id among rows of the same words in the
    same order; class_id: the smallest id among all rows that links connect; a link joins texts whose edit distance over
    words is at most (1 - similarity) of the longer's words. kept: true for one row of each class, that of class_id (a
    null id is above all others; of rows that repeat the id exactly one is kept). Texts without words (null, empty, blank)
    are copies of each other. Texts of fewer than four words are linked with texts of the same words only, which is all that
    similarity 0.8 allows; below 0.8 more links of short texts can be missed. An empty table gives no rows. Input columns named as an output are replaced. keep_text: false leaves the text out.
    """
    need(docs, id_column, text_column)
    docs = without(docs, "class_id", "copy_of", "kept")
    rows, sketched, named = _numbered(docs, id_column, text_column, keep_text)
    least = F.min(F.struct(F.col(named).isNull().alias("none"), F.col(named).alias("id"), F.col("__sg_row").alias("row")))
    classes = written(sketched.groupBy("__sg_sequence").agg(least.alias("least"), F.count(F.lit(1)).alias("n")).select("__sg_sequence", "least", "n", F.col("least.row").alias("node")), "near-classes")
    texts = sketched.select(F.col("__sg_row").alias("node"), F.col("__sg_bag").alias("bag"), F.col("__sg_sketches").alias("sketches"), F.col("__sg_words").alias("words"))
    firsts = sketched.select("__sg_row", "__sg_sketches", F.size("__sg_words").alias("count")).join(classes.select("node"), F.col("__sg_row") == F.col("node"), "left_semi")
    members = _members(firsts.select(F.col("__sg_row").alias("node"), "count", F.col("__sg_sketches").alias("sketches")))
    roots = written(linked_classes(members, texts, similarity), "near-roots")
    discard(members)

    every = roots.select("u", "root").unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    linked = written(classes.select("node", "least").join(every, F.col("node") == F.col("u")).select("node", "least", "root"), "near-linked")
    tops = linked.groupBy("root").agg(F.min("least").alias("top")).select(F.bitwise_not("root").alias("other"), "top")
    linked_to = linked.join(tops, F.bitwise_not("root") == F.col("other")).select(F.col("node").alias("u"), "top")
    known = classes.join(linked_to, F.col("node") == F.col("u"), "left").where((F.col("n") > 1) | F.col("top").isNotNull()).select(F.reverse("__sg_sequence").alias("other"), "least", F.coalesce("top", "least").alias("top"))
    shared = sketched.select("__sg_row", "__sg_sequence").join(known, F.reverse("__sg_sequence") == F.col("other"))
    shared = written(shared.select(F.col("__sg_row").alias("__sg_of"), F.col("top.id").alias("__sg_class"), F.col("least.id").alias("__sg_copy"), (F.col("__sg_row") == F.col("top.row")).alias("__sg_kept")), "near-shared-rows")
    discard(classes, roots, linked, *([sketched] if keep_text else []))

    # only rows that may share a class are shuffled; the others pass straight through
    log2_bits = bitfilter.log2_bits_for(shared.count())
    names = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text_column]
    probed = bitfilter.with_maybe(rows.select("__sg_row", *names), F.col("__sg_row"), bitfilter.seen(shared, "__sg_of", log2_bits), log2_bits, "__sg_maybe")
    own = F.col(f"`{id_column}`")
    alone = probed.where(~F.col("__sg_maybe")).select(*names, own.alias("class_id"), own.alias("copy_of"), F.lit(True).alias("kept"))
    found = probed.where("__sg_maybe").join(shared, F.col("__sg_row") == F.col("__sg_of"), "left")
    single = F.col("__sg_of").isNull()
    found = found.select(*names, F.when(single, own).otherwise(F.col("__sg_class")).alias("class_id"), F.when(single, own).otherwise(F.col("__sg_copy")).alias("copy_of"), F.coalesce("__sg_kept", F.lit(True)).alias("kept"))
    return unioned([alone, found])
