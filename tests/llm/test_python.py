"""Near-deduplication, WARC, quality, URLs, language ID, mixing and the pipeline."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribegauge.llm import near_dedup as nd
from scribegauge.llm.components import components
from scribegauge.llm.language_id import Model, identify, keep_identified
from scribegauge.llm.mixing import fit_counts, mix_sources
from scribegauge.llm.quality import score_quality
from scribegauge.llm.url_filter import RULES, judge_urls, segment
from scribegauge.llm.warc import chunked, dechunked, parse_warc, payload_of, read_warc, round_trip, write_warc

DOCS = "doc_id long, text string"


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(rng, n, base=4000):
    return " ".join(f"w{rng.randrange(base)}" for _ in range(n))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = np.random.default_rng(0)
    for _ in range(400):
        a = rng.integers(0, 6, rng.integers(0, 40)).astype(np.int32)
        b = np.array([x for x in a for _ in range(rng.choice([0, 1, 1, 1, 1, 2]))], np.int32)
        most, true = int(rng.integers(0, 14)), distance(a, b)
        got = nd.edit_distance_within(a, b, most)
        assert got == true if true <= most else got > most


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 501 + i) for i in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    wanted = {(x, find(x)) for x in list(root) if find(x) != x}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == wanted
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_dedup_links_a_star(spark):
    """Copies with an own passage each are alike to the original, and not to each other."""
    rng = random.Random(8)
    base, copies = words(rng, 400).split(), []
    for k in range(1000):
        at = rng.randrange(401)
        copies.append(base[:at] + [f"own{k}x{i}" for i in range(rng.randrange(60, 95))] + base[at:])
    docs = [(i, " ".join(t)) for i, t in enumerate([*copies, base])]
    found = rows(nd.near_dedup(spark.createDataFrame(docs, DOCS)))
    assert {r["class_id"] for r in found} == {0} and sum(r["kept"] for r in found) == 1


def edited(rng, text, edits):
    out = list(text)
    for k in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[f"new{k}"], [f"new{k}"], [out[at], f"new{k}"], []] if len(out) > 4 else [[f"new{k}"]])
    return out


def sharing(pairs):
    """Whether the texts of each pair share something of their sketches."""
    sketched = nd.sketches_of(*nd.words_of([" ".join(t) for pair in pairs for t in pair]))
    return [len(np.intersect1d(a, b)) > 0 for a, b in zip(sketched[0::2], sketched[1::2], strict=True)]


def test_near_candidates_at_edit_similarity():
    rng = random.Random(12)
    ids = {}
    number = lambda t: np.array([ids.setdefault(w, len(ids)) for w in t])
    for n in [*range(5, 36), 60, 100, 300]:
        pairs = [(t, edited(rng, t, rng.choice([n // 5, n // 5, n // 10]))) for t in (words(rng, n).split() for _ in range(200))]
        pairs = [(a, b) for a, b in pairs if nd.alike(number(a), number(b))]
        found = sharing(pairs)
        assert len(pairs) > 50 and (all(found) if max(len(t) for p in pairs for t in p) <= 35 else sum(found) >= 0.98 * len(found)), n


def test_near_dedup_at_the_threshold(spark):
    rng = random.Random(13)
    docs = []
    for n in (5, 6, 9, 12, 20, 24, 31, 300, 300, 300) * 4:
        text = words(rng, n).split()
        other = list(text)
        for at in rng.sample(range(n), n // 5):
            other[at] = "changed"
        docs += [(len(docs), " ".join(text)), (len(docs) + 1, " ".join(other))]
    found = {r["doc_id"]: r["class_id"] for r in rows(nd.near_dedup(spark.createDataFrame(docs, DOCS)))}
    assert all(found[i] == i - i % 2 for i in found)


def test_near_dedup(spark):
    rng = random.Random(4)
    docs, families = [], []
    common = words(rng, 40)
    for f in range(12):
        base = words(rng, rng.randrange(60, 300)).split()
        family = []
        for k in range(6):
            text = list(base)
            for _ in range(len(text) // 60 * (k > 0)):
                text[rng.randrange(len(text))] = "changed"
            if k == 5:
                text = text[:3] + ["inserted"] + text[3:]
            docs.append((len(docs), " ".join(text)))
            family.append(docs[-1][0])
        families.append(family)
    single = [(1000 + i, f"{common} {words(rng, 60)}") for i in range(40)]
    docs += single + [(2000, None), (2001, ""), (2002, " \n"), (2003, "One  two"), (2004, "one TWO"), (2005, "one three"), (None, docs[0][1]), (2006, words(rng, 30000)), (2007, "same id here as that"), (2007, "same id here as that")]
    found = rows(nd.near_dedup(spark.createDataFrame(docs, DOCS).withColumn("class_id", F.lit("x"))))
    assert len(found) == len(docs)
    of = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    for family in families:
        assert {of[i] for i in family} == {family[0]}
    assert all(of[i] == i for i, _ in single) and of[2001] == of[2002] == of[2000] == 2000 and of[2004] == 2003 and of[2005] == 2005
    kept = {}
    for r in found:
        kept[r["class_id"]] = kept.get(r["class_id"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["class_id"]
    assert set(kept.values()) == {1}
    assert rows(nd.near_dedup(spark.createDataFrame([], DOCS))) == []


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 10_000):
        data = bytes(i % 256 for i in range(n))
        assert dechunked(chunked(data)) == data
    assert dechunked(b"5;x=1\r\nabcde\r\n0\r\nT: v\r\n\r\n") == b"abcde"
    assert dechunked(b"5\r\nabc") is None and dechunked(b"zz\r\n") is None and payload_of(b"no head") is None


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    long = "é\r\n\r\nWARC/1.1\r\n" * 9000
    pages = [(1, "http://a\r\nx", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", long), (None, "u", "null id"), (7, "u", "dup row text"), (7, "u", "dup row text")]
    found = rows(round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit(1)), least_bytes=least))
    assert len(found) == len(pages)
    by = {}
    for i, _, html in pages:
        by.setdefault(html or "", []).append(i)
    for r in found:
        data = next((h or "") for i, _, h in pages if i == r["page_id"]).encode()
        assert r["payload_bytes"] == len(data) and r["verified"]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["refers_to"] is None) == (r["record_type"] == "response")
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == data
        else:
            assert r["refers_to"] == min(by[data.decode()]) and len(data) >= least
    stored = [h for h, ids in by.items() for _ in (ids if len(h.encode()) < least else [0])]
    assert sum(r["record_type"] == "response" for r in found) == len(stored)
    assert rows(round_trip(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_broken_segments_are_told(spark, tmp_path):
    write_warc(spark.createDataFrame([(1, "u", "x" * 70_000), (2, "u", "y")], "page_id long, url string, html string"), str(tmp_path / "w"), compress=False)
    (tmp_path / "bad").mkdir()
    for n, f in enumerate((tmp_path / "w").glob("part-*")):
        data = f.read_bytes()
        records = list(parse_warc(data))
        kept = [b for b in data.split(b"WARC/1.1\r\n")[1:] if b"WARC-Segment-Number: 3" not in b]
        assert len(records) - len(kept) in (0, 1)
        (tmp_path / "bad" / f"{n}.warc").write_bytes(b"".join(b"WARC/1.1\r\n" + b for b in kept))
    found = {r["page_id"]: r for r in rows(read_warc(spark, str(tmp_path / "bad")))}
    assert found[1]["verified"] is False and found[1]["payload"] is None and found[2]["verified"] is True


def test_quality_held_out(spark, small):
    docs, labels = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{small.replace('0.001', '0.01')}/labels.parquet")
    extra = spark.createDataFrame([(None, None), (-1, "")], DOCS)
    found = score_quality(docs.select("doc_id", "text").unionByName(extra).withColumn("score", F.lit("x")), labels)
    pdf = found.join(labels, "doc_id", "left").toPandas()
    assert len(pdf) == docs.count() + 2 and pdf["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(int(i)).encode()) % 5 == 0) for i, h in zip(pdf["doc_id"].dropna(), pdf.loc[pdf["doc_id"].notna(), "held_out"], strict=True))
    held = pdf[pdf["held_out"] & pdf["quality"].notna()]
    assert ((held["score"] >= 0.3) == (held["quality"] == 1)).mean() > 0.9
    alone = rows(score_quality(extra, labels.where("false")))
    assert all(r["score"] == 0.5 for r in alone) and rows(score_quality(extra.where("false"), labels)) == []


def test_segmentation():
    counts = {"news": 50, "letter": 30, "newsletter": 1, "le": 2}
    assert segment("newsletter", counts, 1000) == ["news", "letter"]
    assert segment("", counts, 1000) == [] and segment("qqqq", counts, 1000) == ["qqqq"]

    def best(label):
        if not label:
            return 0.0
        cost = lambda w: math.log(counts[w] / 1000) if w in counts else math.log(10 / 1000) - len(w) * math.log(10)
        return max(cost(label[:i]) + best(label[i:]) for i in range(1, len(label) + 1))

    counts["internationalisationsnewsletters"] = 5
    assert segment("xinternationalisationsnewsletters", counts, 1000)[-1] == "internationalisationsnewsletters" and segment("q" * 3000, counts, 1000) == ["q" * 3000]
    for label in ("newsle", "lenews", "xnews", "letterle", "qqlenewsqq", "ewletle"):
        split = segment(label, counts, 1000)
        assert "".join(split) == label and sum(math.log(counts[w] / 1000) if w in counts else math.log(0.01) - len(w) * math.log(10) for w in split) == pytest.approx(best(label))


def test_urls(spark):
    urls = ["http://WWW.Example.org/es/1", "https://example.org/en/12?x", "http://a.org/x", "http://b.com/de/", "http://b.com/fr/#f", "http://forg/x", "noscheme/de/", None, "http://example.net", "x://example.net?q/de/", "a://b://c/d", "http://é.com:80/de/x", "http://example.orgs/es/", ""]
    df = spark.createDataFrame([(i, u, "<p>news letter</p>") for i, u in enumerate(urls)] + [(None, urls[0], None), (1, urls[1], "x")], "page_id long, url string, html string").withColumn("host", F.lit(0))
    found = rows(judge_urls(df))
    assert len(found) == len(urls) + 2
    for r in found:
        u = r["url"] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None), u
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")
    assert rows(judge_urls(df.where("false"))) == []


def test_bayes_prefers_what_rules_block(spark):
    pages = [(i, f"http://s{i % 7}.com/de/{i}", "x") for i in range(40)] + [(100 + i, f"http://s{i % 7}.com/fr/{i}", "x") for i in range(40)] + [(200, "http://q.net/de/5", "x"), (201, "http://q.net/fr/5", "x")]
    found = {r["page_id"]: r["verdict"] for r in rows(judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert found[200] == "block" and found[201] == "allow"


def test_language_models_are_distributions():
    model = Model({"a": ["abab abba", "baab"], "b": ["cdcd dccd"]})
    for k in range(2):
        seen = np.exp(model.logp[0][:, k].astype(float)).sum()
        assert 0.5 < seen < 1.0001
    entropy, length = model.cross_entropies(["abba", "dccd", None, "12 !", "ab" * 600_000])
    assert entropy[0].argmin() == 0 and entropy[1].argmin() == 1 and list(length[2:4]) == [0, 0] and length[4] == 1_200_000
    whole, _ = model.cross_entropies(["ab ba " * 20])
    assert whole[0, 0] == pytest.approx(model.cross_entropies(["AB, ba! " * 20])[0][0, 0])


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, None, None), (-1, "", "en"), (-2, "123 !?", None), (-3, "zqxj" * 40, None)], "doc_id long, text string, lang string")
    pdf = identify(docs.unionByName(odd).withColumn("score", F.lit("x"))).toPandas()
    assert len(pdf) == docs.count() + 4
    held = pdf[pdf["held_out"] & (pdf["doc_id"] >= 0)]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and held["rejected"].mean() < 0.01
    none = pdf[pdf["text"].isna() | pdf["doc_id"].isin([-1, -2])]
    assert (none["lang_pred"] == "und").all() and (none["score"] == 0).all() and none["rejected"].all()
    assert pdf[pdf["doc_id"] == -3]["rejected"].all() and set(pdf["lang_pred"]) == {"en", "fr", "de", "es", "und"}
    assert keep_identified(odd.where("false")).count() == 0 and keep_identified(odd).columns == odd.columns


def test_subset_sums():
    rng = np.random.default_rng(1)
    for k in range(300):
        lengths = np.unique(np.append(rng.integers(1, 60, rng.integers(1, 6)) * (1 + k % 3), [6000][: k % 2]).astype(np.int64))
        counts = rng.integers(1, 6, len(lengths))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = int(rng.integers(0, (lengths * counts).sum() + 10))
        take = fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)
    many = np.arange(1, 20_000)
    assert int((fit_counts(many, np.full(len(many), 3), 123_456_789) * many).sum()) == 123_456_789


def test_mixing(spark):
    rng = random.Random(8)
    data = [(i, words(rng, rng.randrange(0, 60)), rng.choice(["b", "a", "é", None, "-"])) for i in range(600)] + [(i, "hot text of six words here", "a") for i in range(600, 900)] + [(None, "x y", "a"), (1, "x y", "a"), (1, None, "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    found = rows(mix_sources(df))
    assert len(found) == len(data) and sorted(map(str, found)) == sorted(map(str, rows(mix_sources(df))))
    size = {}
    for r in found:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(size.values())
    target, open_ = {}, list(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    for s in names:
        mine = [r for r in found if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == size[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 2
    assert rows(mix_sources(df.where("false"))) == []


def test_pipeline(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for _, stage in p.STAGES[:-1]:
        after = stage(spark, kept, small)
        assert after.columns == docs.columns
        kept = spark.createDataFrame(after.toPandas(), docs.schema)
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids)) <= docs.count()
    assert p.run(spark, small).select("doc_id").distinct().count() <= len(ids)
