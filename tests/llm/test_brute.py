"""Near-deduplication, language models, training of the quality model and the pipeline against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scribegauge.llm import quality
from scribegauge.llm.language_id import Model, identify
from scribegauge.llm.licenses import TEMPLATES, licensed
from scribegauge.llm.near_dedup import near_dedup
from scribegauge.llm.secrets import scan_secrets

DOCS = "doc_id long, text string"


def rows(df):
    return [r.asDict() for r in df.collect()]


def vocabulary(seed, letters, n=80):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n)]


ENGLISH, FRENCH = vocabulary(1, "thenwasigrol"), vocabulary(2, "éàeulqjxvzçm")


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def edited(rng, text, edits):
    out = text.split()
    for k in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[f"new{k}"], [out[at], f"new{k}"], []])
    return " ".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near_classes(docs):
    """{row number: least id of its class}, by the edit distance of all pairs."""
    split = [(t or "").lower().split() for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            longer = max(len(split[i]), len(split[j]))
            if abs(len(split[i]) - len(split[j])) > 0.2 * longer or top(i) == top(j):
                continue
            common = sum((Counter(split[i]) & Counter(split[j])).values())
            if longer - common <= 0.2 * longer + 1e-9 and distance(split[i], split[j]) <= int(0.2 * longer + 1e-9):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[top(i)].append(d)
    return {i: min(least[top(i)]) for i in range(len(docs))}


def test_near_classes_of_all_pairs(spark):
    rng = random.Random(31)
    docs = []
    for n in (4, 6, 9, 15, 24, 40, 70, 110):
        base = prose(rng, ENGLISH, n)
        docs += [(len(docs) + k, edited(rng, base, round(n * share))) for k, share in enumerate((0, 0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3))]
    found = {r["doc_id"]: r["class_id"] for r in rows(near_dedup(spark.createDataFrame(docs, DOCS)))}
    wanted = near_classes(docs)
    assert found == {docs[i][0]: c for i, c in wanted.items()} and 8 < len(set(found.values())) < len(docs)


def plain_symbols(text):
    return re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text)).lstrip(" ")


class PlainKneserNey:
    """Interpolated Kneser-Ney by its definition, of one language: dictionaries of strings."""

    def __init__(self, texts, alphabet, order=4):
        self.order, self.floor = order, 1.0 / (len(alphabet) + 1)
        padded = ["\0" * (order - 1) + plain_symbols(t) for t in texts]
        raw = Counter(p[i - order + 1 : i + 1] for p in padded for i in range(order - 1, len(p)))
        self.counts = {order: raw}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.total, self.kinds, self.discount = {}, {}, {}
        for n, counts in self.counts.items():
            self.total[n], self.kinds[n] = Counter(), Counter()
            for g, c in counts.items():
                self.total[n][g[:-1]] += c
                self.kinds[n][g[:-1]] += 1
            ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
            self.discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def chance(self, gram):
        n = len(gram)
        if n == 0:
            return self.floor
        lower, context = self.chance(gram[1:]), gram[:-1]
        if not self.total[n][context]:
            return lower
        held = self.counts[n].get(gram, 0)
        return (max(held - self.discount[n], 0) + self.discount[n] * self.kinds[n][context] * lower) / self.total[n][context]

    def entropy(self, text):
        s = "\0" * (self.order - 1) + plain_symbols(text)
        places = range(self.order - 1, len(s))
        return -sum(math.log(self.chance(s[i - self.order + 1 : i + 1])) for i in places) / max(1, len(places))


def plain_models(texts):
    alphabet = {c for held in texts.values() for t in held for c in plain_symbols(t)}
    return {lang: PlainKneserNey(held, alphabet) for lang, held in texts.items()}


def test_entropies_are_those_of_plain_kneser_ney():
    rng = random.Random(5)
    texts = {"a": [prose(rng, ENGLISH, 30) for _ in range(5)], "b": [prose(rng, FRENCH, 30) + ", 12!" for _ in range(5)]}
    asked = [prose(rng, ENGLISH, 9), prose(rng, FRENCH, 9), "Thé WAS; été?", "qqq Ω zz", texts["a"][0], "x"]
    got, _ = Model(texts).cross_entropies(asked)
    plain = plain_models(texts)
    assert got == pytest.approx(np.array([[plain[x].entropy(t) for x in ("a", "b")] for t in asked]), abs=2e-4)


def test_identified_languages_are_those_of_plain_kneser_ney(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, ENGLISH if i % 2 else FRENCH, rng.randrange(1, 40)), "en" if i % 2 else "fr") for i in range(150)]
    docs += [(200, "nothing learnt", None), (201, "12", "en"), docs[3], docs[3]]
    found = rows(identify(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("rejected", F.lit("clash"))))
    learnt = defaultdict(list)
    for d, t, lang in docs:
        if lang and zlib.crc32(str(d).encode()) % 3 != 1:
            learnt[lang].append(t)
    plain = plain_models(learnt)
    assert len(found) == len(docs) and len({str(r) for r in found if r["doc_id"] == 3}) == 1
    for r in found:
        if r["doc_id"] == 201:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        entropies = {lang: m.entropy(r["text"]) for lang, m in plain.items()}
        assert r["lang_pred"] == min(entropies, key=entropies.get) and r["cross_entropy"] == pytest.approx(min(entropies.values()), abs=5e-4)


def test_equal_entropies_go_to_the_least_name(spark):
    docs = [(i, "same words for both", lang) for i in range(40) for lang in ("b", "a")]
    found = rows(identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")))
    assert {r["lang_pred"] for r in found} == {"a"} and all(r["score"] == pytest.approx(0.5) for r in found)


def test_quality_training_is_plain_gradient_descent():
    rng = random.Random(7)
    texts = [prose(rng, ENGLISH if i % 2 else FRENCH, rng.randrange(0, 12)) for i in range(24)] + ["same same word"]
    labels = np.array([i % 2 for i in range(25)])
    size, dims = 1 << quality.LOG2_BUCKETS, quality.DIMENSIONS

    def plain_bag(text):
        words = text.split()
        found = [int(b) for w in words for part, _ in quality.features([w]) for b in part]
        return Counter(found + [quality.AGAIN for x, y in zip(words, words[1:], strict=False) if x == y])

    order = np.random.default_rng(quality.SEED)
    vectors = order.uniform(-1 / dims, 1 / dims, (size, dims)).astype(np.float32).astype(float)
    out, bias = np.zeros((dims, 2)), np.array([0.0, math.log((labels.sum() + 0.5) / (25 - labels.sum() + 0.5))])
    steps, done = quality.EPOCHS * 25, 0
    for _ in range(quality.EPOCHS):
        for i in order.permutation(25):
            rate = quality.RATE * (1 - done / steps)
            done += 1
            bag = plain_bag(texts[i])
            if not bag:
                continue
            total = sum(bag.values())
            mean = sum(vectors[b] * c / total for b, c in bag.items())
            logits = mean @ out + bias
            error = np.exp(logits) / np.exp(logits).sum()
            error[labels[i]] -= 1
            back = out @ error
            out = out - rate * np.outer(mean, error)
            bias = bias - 0.1 * rate * error
            for b, c in bag.items():
                vectors[b] -= min(c / total * len(bag), 4) * rate * back
    model = quality.Model(texts, labels)
    asked = [*texts, "unknown thé", "", None, "w " * 5000]
    wanted = []
    for t in asked:
        bag = plain_bag(t or "")
        mean = sum(vectors[b] * c for b, c in bag.items()) / max(1, sum(bag.values())) if bag else np.zeros(dims)
        logits = mean @ out + bias
        wanted.append(1 / (1 + math.exp(logits[0] - logits[1])))
    assert model.scores(asked) == pytest.approx(wanted, abs=2e-3)


def test_repeated_rows_and_clashing_names(spark):
    notice = TEMPLATES[4][1]
    docs = spark.createDataFrame([(1, notice), (1, notice), (2, "token=abcdefgh"), (2, "token=abcdefgh")], DOCS)
    clash = docs.withColumns({"spans_found": F.lit("mine"), "matched": F.lit(0), "license": F.lit("x"), "note": F.lit("kept")})
    secrets = rows(scan_secrets(clash))
    assert sorted((r["doc_id"], len(r["spans_found"]), r["note"]) for r in secrets) == [(1, 0, "kept")] * 2 + [(2, 1, "kept")] * 2
    matched = [(r["doc_id"], r["template"], r["note"]) for r in rows(licensed(clash))]
    assert len(matched) == 2 * len(set(matched)) and (1, 4, "kept") in matched and all(d == 1 for d, _, _ in matched)


def overlapping(text, item, window=13, share=0.8):
    a, b = ([w for w in re.split(r"[^\w]+|_", t.lower()) if w] for t in (text, item))
    w = min(window, len(b))
    for d in range(-len(b) + 1, len(a)) if set(a) & set(b) else ():
        same = [a[k + d] == b[k] for k in range(len(b)) if 0 <= k + d < len(a)]
        if any(sum(same[i : i + w]) >= share * w for i in range(len(same) - w + 1)):
            return True
    return False


def plain_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(size.values())
    target, left = {}, list(names)
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * size[s]]
        target |= {s: 2.0 * size[s] for s in over} or {s: level * weight[s] for s in left}
        left = [s for s in left if s not in target]
    return target


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through, too. What language ID rejects is
    taken from identify(), whose entropies have a test of their own; all later stages are worked out here."""
    rng = random.Random(11)
    items = [(k, prose(rng, ENGLISH, n)) for k, n in enumerate((6, 10, 16, 30))]
    docs = []

    def add(text, lang="en", source="web", times=1):
        docs.extend([(len(docs), text, lang, source, len(text or ""))] * times)

    for i in range(60):
        add(prose(rng, ENGLISH if i % 3 else FRENCH, rng.randrange(6, 60)), "en" if i % 3 else "fr", rng.choice(["web", "books", "é", None]))
    for i in range(20):
        add(docs[i][1].upper() if i % 2 else edited(rng, docs[i][1], len(docs[i][1].split()) // 9), docs[i][2], "copies")
    for _, item in items:
        add(f"{prose(rng, ENGLISH, 12)} {item} {prose(rng, ENGLISH, 12)}")
        add(edited(rng, item, 0).title(), None)
    add(None), add("", None), add("12 34"), add("zzqx kkjw " * 20, None), add(prose(rng, ENGLISH, 6000), "en", None), add(prose(rng, ENGLISH, 33), times=3)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"kept": F.lit("k"), "class_id": F.lit(0), "score": F.lit("s"), "item_id": F.lit("i"), "note": F.lit("n")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    rejected = {r["doc_id"] for r in rows(identify(df.drop("class_id"))) if r["rejected"]}
    assert {d for d, t, *_ in docs if not re.search("[a-z]", (t or "").lower())} < rejected
    groups = defaultdict(list)
    for d, t, _, s, _ in docs:
        if d not in rejected:
            groups[t.lower().encode() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t).encode()].append((d, t, s))
    kept = sorted((max(g, key=lambda x: x[0]) for g in groups.values()), key=lambda x: x[0])
    classes = near_classes([(d, t) for d, t, _ in kept])
    unique = [x for i, x in enumerate(kept) if classes[i] == x[0]]
    clean = [x for x in unique if not any(overlapping(x[1], item) for _, item in items)]
    assert len(docs) - len(rejected) > len(kept) > len(unique) > len(clean) > 40

    size = defaultdict(int)
    for _, t, s in clean:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    target, of = plain_targets(dict(size)), {d: s for d, _, s in clean}
    found = rows(corpus_pipeline.run(spark, str(tmp_path)))
    taken = defaultdict(int)
    for r in found:
        assert r["doc_id"] in of and 0 < r["taken"] <= 2 * r["size"] and r["note"] == "n" and r["kept"] == "k"
        assert r["target"] == pytest.approx(target[of[r["doc_id"]]])
        taken[of[r["doc_id"]]] += r["taken"]
    assert len({r["doc_id"] for r in found}) == len(found)
    assert {d for d in of if target[of[d]] >= size[of[d]]} <= {r["doc_id"] for r in found}
    for s in size:
        reached, whole = {0}, int(target[s] / size[s] + 1e-12) * size[s]
        for _, t, own in clean:
            reached |= {x + len(t.split()) for x in reached} if own == s else set()
        assert taken[s] == whole + max(x for x in reached if x <= round(target[s]) - whole)
