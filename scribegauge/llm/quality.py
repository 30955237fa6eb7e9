"""Quality scores by supervised subword embeddings.

A text is the mean of learned vectors of its words and of the character n-grams inside its words (a word's boundaries
count as characters) and of the event that a word repeats the one before, all hashed into BUCKETS rows; a softmax layer over the mean gives the class. Training is plain
stochastic gradient descent in numpy over whole texts of a bounded sample of labelled rows. As the output layer is
linear, a trained model reduces to one number per bucket, and a text's score needs their mean only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import crc_of, need, text_of, with_python, without
from .grams import BASE, mixed, packed, word_hashes, words_in

LOG2_BUCKETS, DIMENSIONS, LENGTHS = 18, 8, (3, 4)
#: About so many labelled texts are drawn to train on, by a hash of their id.
SAMPLE_ROWS = 3000
#: The bucket of the one word pair that is hashed by its form: a word and the same word again.
AGAIN = 77
EPOCHS, RATE, SEED = 5, 0.25, 1


def features(held: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, number of the piece) for words and for n-grams of each length, over several pieces of text."""
    points, joints, starts, ends = words_in(held)
    shift = np.uint64(64 - LOG2_BUCKETS)
    out = []
    if not len(starts):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    owner = np.zeros(len(points), np.int64)
    owner[joints[:-1]] = 1
    owner = np.cumsum(owner) - 1
    words, whose = word_hashes(points, starts, ends), owner[starts]
    out.append(((words >> shift).astype(np.int64), whose))
    again = np.flatnonzero((words[1:] == words[:-1]) & (whose[1:] == whose[:-1])) + 1
    out.append((np.full(len(again), AGAIN, np.int64), whose[again]))
    inside = np.zeros(len(points) + 1, np.int64)
    inside[starts] += 1
    inside[ends] -= 1
    space = 1 - np.cumsum(inside)[:-1]
    spaces = np.concatenate([[0], np.cumsum(space)])
    symbols = np.where(space == 1, 32, points).astype(np.uint64) + np.uint64(1)
    for n in LENGTHS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        total = np.zeros(count, np.uint64)
        for k in range(n):
            total = total * np.uint64(BASE) + symbols[k : k + count]
        # no space but at either end, and not spaces alone
        valid = np.flatnonzero((spaces[n - 1 : n - 1 + count] - spaces[1 : 1 + count]) == 0)
        out.append(((mixed(total[valid] + np.uint64(n)) >> shift).astype(np.int64), owner[valid + 1]))
    return out


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, and their shares."""
    found = [b for _, held in packed([text]) for b, _ in features(held)]
    buckets, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return buckets, (counts / max(1, counts.sum())).astype(np.float32)


class Model:
    """gain[bucket]: what a bucket's vector adds to the log-odds of class 1; bias: those of an empty text."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        rng = np.random.default_rng(SEED)
        vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << LOG2_BUCKETS, DIMENSIONS)).astype(np.float32)
        out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
        if len(labels):
            bias[1] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
        bags = [_bag(t) for t in texts]
        steps, done = EPOCHS * len(bags), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(bags)):
                rate = np.float32(RATE * (1 - done / steps))
                done += 1
                buckets, shares = bags[i]
                if not len(buckets):
                    continue
                mean = shares @ vectors[buckets]
                logits = mean @ out + bias
                chance = np.exp(logits - logits.max())
                chance /= chance.sum()
                chance[labels[i]] -= 1
                back = out @ chance
                out -= rate * np.outer(mean, chance)
                bias -= rate * np.float32(0.1) * chance
                # shares of a text's buckets are tiny; scaling by their number keeps steps of a useful size
                vectors[buckets] -= np.outer(np.minimum(shares * len(buckets), 4) * rate, back)
        self.gain = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        for numbers, held in packed([t or "" for t in texts]):
            for buckets, owner in features(held):
                sums += np.bincount(np.asarray(numbers)[owner], weights=self.gain[buckets], minlength=len(texts)) if len(owner) else 0
                counts += np.bincount(np.asarray(numbers)[owner], minlength=len(texts)) if len(owner) else 0
        return 1 / (1 + np.exp(-np.clip(self.bias + sums / np.maximum(counts, 1), -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, rows: int) -> DataFrame:
    """(id, text, label) of about rows labelled texts whose crc32 mod 5 isn't 0. The sample's ids are few by this bound."""
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & (F.pmod(crc_of(id_column), F.lit(5)) != 0))
    known = known.groupBy(id_column).agg(F.max(F.col(label_column).cast("int")).alias("__sg_label"))
    rate = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(3), F.col(id_column).cast("string")), F.lit(1 << 30)) < int(rate * (1 << 30)))
    return docs.select(F.col(id_column), text_of(text_column).alias("__sg_text")).join(F.broadcast(drawn), id_column)


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample_rows: int = SAMPLE_ROWS, keep_text: bool = True) -> DataFrame:
    """docs plus held_out and score, one row for each row of docs.

    labels: (id, label 0 or 1); of several labels of an id the largest counts, null labels and ids don't. The model learns
    from labelled rows whose crc32(id as text) mod 5 isn't 0; the others are held out (a null id counts as empty text and
    is held out). score: the chance of label 1; null and empty texts get that of the training rows as a whole, and so do
    all texts where there is nothing to learn from (0.5). An empty table gives no rows. Input columns named as an output
    are replaced. keep_text: false leaves the text out.
    """
    need(docs, id_column, text_column)
    need(labels, id_column, label_column)
    docs = without(docs, "held_out", "score")
    sample = training_sample(docs, labels, id_column, text_column, label_column, sample_rows).toArrow().to_pandas()
    sample = sample.sort_values([id_column, "__sg_text"], kind="stable") if len(sample) else sample
    model = docs.sparkSession.sparkContext.broadcast(_fitted(sample))
    rows = docs.withColumn("held_out", F.pmod(crc_of(id_column), F.lit(5)) == 0)
    return with_python(rows, text_column, lambda texts: {"score": model.value.scores(texts)}, [StructField("score", DoubleType())], keep_text)


def _fitted(sample: pd.DataFrame) -> Model:
    return Model(list(sample["__sg_text"]), (sample["__sg_label"].to_numpy(np.int64) > 0).astype(np.int64)) if len(sample) else Model([], np.zeros(0, np.int64))
