"""Exact deduplication, secrets, decontamination and licenses against brute force on small fixtures."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from scribegauge.llm import bitfilter
from scribegauge.llm.decontaminate import contaminated, decontaminate
from scribegauge.llm.exact_dedup import exact_dedup
from scribegauge.llm.licenses import TEMPLATES, licensed
from scribegauge.llm.secrets import RULES, scan_secrets, trigram_query

DOCS = "doc_id long, text string"


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(rng, n, base=400):
    return " ".join(f"w{rng.randrange(base)}" for _ in range(n))


def test_filters_never_miss(spark):
    keys = spark.range(3000).withColumn("k", F.concat(F.lit("k"), F.col("id").cast("string")))
    pages = bitfilter.seen(keys.where("id < 500"), "k", 20)
    found = bitfilter.with_maybe(keys, F.col("k"), pages, 20, "maybe")
    assert found.where("id < 500 and not maybe").count() == 0 and found.where("id >= 500 and maybe").count() < 100
    twice = bitfilter.seen_twice(keys.where("id < 900").unionByName(keys.where("id < 40")), "k", 20)
    assert bitfilter.with_maybe(keys, F.col("k"), twice, 20, "maybe").where("id < 40 and not maybe").count() == 0


@pytest.mark.parametrize("bits", [None, 20])
def test_exact_dedup(spark, bits):
    data = [(1, "Aa"), (2, "aA"), (3, "É"), (4, "é"), (5, None), (6, ""), (None, "aa"), (7, "x"), (7, "x"), (8, "unique")] + [(100 + i, "hot") for i in range(50)]
    found = rows(exact_dedup(spark.createDataFrame(data, DOCS).withColumn("kept", F.lit("mine")).withColumn("__sg_row", F.lit(0)), log2_bits=bits))
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    assert len(found) == len(data)
    groups = {}
    for r in found:
        assert r["text_sha256"] == hashlib.sha256(lower(r["text"]).encode()).hexdigest()
        groups.setdefault(lower(r["text"]), []).append(r)
    for key, held in groups.items():
        ids = [i for i, t in data if lower(t) == key]
        assert {r["keep_id"] for r in held} == {max((i for i in ids if i is not None), default=None)}
        assert all(r["group_size"] == len(ids) for r in held) and sum(r["kept"] for r in held) == 1
        assert all(r["doc_id"] == r["keep_id"] for r in held if r["kept"])
    assert rows(exact_dedup(spark.createDataFrame([], DOCS))) == []


def brute_spans(text):
    out = []
    for order, rule in enumerate(RULES):
        loose = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.get(rule.kind, rule.pattern)
        least = {"access": 16, "hex": 32}.get(rule.kind, rule.least)
        out += [(m.start(), order, m.end()) for m in re.finditer(loose, text, re.A) if len(m.group(rule.group)) >= least]
    return [f"{RULES[o].kind}:{s}:{e}" for s, o, e in sorted(out)]


def test_secrets(spark):
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "abcd1234", "é", "😀", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef" * 4, "\n", "ghp_" + "a" * 36, "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----", "token: secret: abcdefgh1"]
    data = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "z" * 200_000 + "token=abcdefgh")]
    data += [(2000 + i, "token=abcdefgh") for i in range(30)]
    found = rows(scan_secrets(spark.createDataFrame(data, DOCS)))
    assert len(found) == len(data)
    for r in found:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans_found"]] == brute_spans(r["text"] or ""), r["text"]
    assert rows(scan_secrets(spark.createDataFrame([], DOCS))) == []


def test_trigram_queries_hold_for_every_match():
    assert trigram_query("[0-9a-f]{32,}") == []
    assert trigram_query("AKIA[A-Z0-9]{12,}") == [[["aki", "kia"]]]
    assert trigram_query("ab?c") == [] and trigram_query("(foo|b)x") == []
    assert sorted(map(sorted, trigram_query("colou?r")[0])) == [["col", "lor", "olo"], ["col", "lou", "olo", "our"]]


def brute_overlaps(text, item, window=13, share=0.8):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    a, b = split(text), split(item)
    w = min(window, len(b))
    if not b:
        return False
    if len(b) < 8:
        share = 1.0
    for d in range(-len(b), len(a) + 1):
        same = [a[k + d] == b[k] for k in range(len(b)) if 0 <= k + d < len(a)]
        if any(sum(same[i : i + w]) >= share * w for i in range(len(same) - w + 1)):
            return True
    return False


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate([5, 9, 13, 20, 35, 60])] + [(50, None), (51, ""), (3, "dup " + words(rng, 12))]
    docs = [(i, words(rng, rng.randrange(5, 200))) for i in range(60)]
    for k, (_, item) in enumerate(items[:6]):
        for subs in range(3):
            changed = item.split()
            for _ in range(subs):
                changed[rng.randrange(len(changed))] = "changed"
            docs.append((100 + 10 * k + subs, f"{words(rng, 20)} {' '.join(changed)}. {words(rng, 20)}"))
            docs.append((200 + 10 * k + subs, " ".join(changed).upper()))
    docs += [(None, items[4][1]), (900, None), (901, ""), (902, items[4][1]), (902, items[4][1]), (903, words(rng, 20000) + " " + items[5][1])]
    df, bench = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["text"]) for r in rows(contaminated(df, bench))}
    wanted = {(d, i, t) for d, t in docs for i, item in items if d != 903 and brute_overlaps(t, item)}
    assert {f for f in found if f[0] != 903} == wanted and any(f[0] == 903 for f in found)
    clean = rows(decontaminate(df.drop("item_id"), bench))
    flagged = {t for _, _, t in found}
    assert sorted((r["doc_id"] or -1) for r in clean) == sorted((d or -1) for d, t in docs if t not in flagged)
    assert rows(contaminated(df, bench.where("false"))) == [] and rows(contaminated(df.where("false"), bench)) == []


def test_decontamination_of_items_shorter_than_the_window(spark):
    rng = random.Random(6)
    items = [(n, words(rng, n)) for n in range(8, 13)]
    docs = []
    for n, item in items:
        for a in range(n):
            for b in range(a, n):
                changed = ["x" if k in (a, b) else w for k, w in enumerate(item.split())]
                docs.append((len(docs), f"{words(rng, 3)} {' '.join(changed)} {words(rng, 3)}"))
    found = {(r["doc_id"], r["item_id"]) for r in rows(contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")))}
    assert found == {(d, i) for d, t in docs for i, item in items if brute_overlaps(t, item)}


def shingles(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_licenses(spark):
    rng = random.Random(9)
    docs = [(i, words(rng, 80)) for i in range(20)] + [(900, None), (901, ""), (902, "one two"), (None, TEMPLATES[0][1])]
    for k, (_, notice) in enumerate(TEMPLATES):
        docs.append((100 + k, f"{words(rng, 30)} {notice}\n{words(rng, 30)}"))
        changed = notice.split()
        changed[len(changed) // 2] = "changed"
        docs.append((200 + k, " ".join(changed)))
        docs.append((300 + k, " ".join(notice.split()[: int(len(notice.split()) * 0.9)])))
    docs.append((903, words(rng, 20000) + " " + TEMPLATES[4][1]))
    found = {(r["doc_id"], r["template"], r["matched"]) for r in rows(licensed(spark.createDataFrame(docs, DOCS).withColumn("license", F.lit(1))))}
    wanted = set()
    for d, t in docs:
        have = shingles(t)
        for k, (_, notice) in enumerate(TEMPLATES):
            need = shingles(notice)
            if need and len(need & have) / len(need) >= 0.8:
                wanted.add((d, k, len(need & have)))
    assert found == wanted and any(f[0] == 903 for f in found)
    assert rows(licensed(spark.createDataFrame([], DOCS))) == []


def test_licenses_of_five_shingles(spark):
    notice = "a b c d e f g h i"
    docs = [(k, " ".join(["z"] * k + ["a b c d e f g h other"])) for k in range(4)] + [(9, "b c d e f g h i"), (10, "z b c d e f g h i")]
    known = spark.createDataFrame([(0, "X", notice)], "template int, license string, notice string")
    assert {(r["doc_id"], r["matched"]) for r in rows(licensed(spark.createDataFrame(docs, DOCS), templates=known))} == {(d, 4) for d, _ in docs}
