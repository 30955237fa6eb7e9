"""URL filters: rules first, then host word segmentation and multinomial naive Bayes.

Host names are split into words by a unigram Viterbi search; word counts come from the visible text of all pages. Only
substrings of host labels are looked up in the counts, so each label's search sees its own few words and no vocabulary
is broadcast. Naive Bayes learns from the URLs that a rule decides, and scores the segmented host words and the path's
tokens of the others (digits are one token). Counts are made per distinct host and per distinct path shape, so a host
or shape that a third of all pages share is one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, text_of, without, written
from .exact_dedup import ascii_lower


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def with_host_and_path(pages: DataFrame, url_column: str) -> DataFrame:
    """Adds host and path; both are empty if the URL is null or has no '://'."""
    url = text_of(url_column)
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    rest = F.coalesce(rest, F.lit(""))
    pages = pages.withColumn("__sg_rest", rest).withColumn("__sg_host", F.regexp_extract("__sg_rest", r"^[^/?#]*", 0))
    after = F.substring(F.col("__sg_rest"), F.char_length("__sg_host") + 1, F.char_length("__sg_rest"))
    return pages.withColumns({"host": ascii_lower(F.col("__sg_host")), "path": F.regexp_extract(after, r"^[^?#]*", 0)}).drop("__sg_rest", "__sg_host")


def ruled(rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))) & F.startswith(F.col("path"), F.lit(rule.path))
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def word_counts(texts: DataFrame, text_column: str) -> DataFrame:
    """(word, n) over all texts: runs of letters outside tags, lower-cased."""
    visible = F.lower(F.regexp_replace(text_of(text_column), r"<[^<>]*>", " "))
    words = texts.select(F.explode_outer(F.split(visible, r"[^\p{L}]+")).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of label into words of the highest product of unigram chances. A piece that is no counted word has
    chance 10 / (total * 10^length), so unknown stretches stay whole; ties go to the longer last word."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    lengths = sorted({len(w) for w in counts if w})
    ten, unknown = math.log(10.0), math.log(10.0 / total)
    # the start from which an unknown piece is best is the same for every end: its cost grows evenly with its length
    origin, origin_value = 0, 0.0
    for end in range(1, len(label) + 1):
        found = (best[origin][0] + unknown - (end - origin) * ten, -origin)
        for n in lengths:
            if n > end:
                break
            if k := counts.get(label[end - n : end], 0):
                found = max(found, (best[end - n][0] + math.log(k / total), n - end))
        best.append((found[0], -found[1]))
        if (value := found[0] + end * ten) > origin_value + 1e-9:
            origin, origin_value = end, value
    words, end = [], len(label)
    while end:
        words.append(label[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, tokens): the words of all labels of each distinct host, in order."""
    labels = hosts.select("host", F.posexplode_outer(F.array_remove(F.split("host", r"[^\p{L}\p{N}]+"), "")).alias("__sg_at", "label")).where(F.col("label").isNotNull())
    labels = written(labels, "url-labels")
    distinct = labels.select("label").distinct()
    # only lengths that counted words have are looked up; no more of them than the longest label has letters
    longest = distinct.agg(F.max(F.char_length("label"))).first()[0] or 0
    lengths = sorted(r[0] for r in counts.select(F.char_length("word")).distinct().where(F.col("char_length(word)") <= longest).collect())
    starts, held = F.sequence(F.lit(1), F.char_length("label")), F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    parts = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(held, lambda n: n <= F.char_length("label") - s + 1), lambda n: F.substring(F.col("label"), s, n))))
    pairs = distinct.select("label", F.explode_outer(F.array_distinct(parts)).alias("word"))
    total = max(1, counts.agg(F.sum("n").alias("n")).first()["n"] or 1)
    known = pairs.join(counts, "word", "left").groupBy("label").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("held"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([segment(a, {x["word"]: int(x["n"]) for x in b}, total) for a, b in zip(label, held, strict=True)])

    words = known.select("label", split("label", "held").alias("words"))
    return labels.join(words, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__sg_at", "words"))), lambda x: x["words"])).alias("tokens"))


def _bayes(held: DataFrame) -> DataFrame:
    """(token, gain) from (token, blocked, allowed): the log-odds for block that a token adds, with one added to counts."""
    model = held.groupBy("token").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    model = written(model, "url-tokens")
    sums = model.agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.count(F.lit(1)).alias("v")).first()
    b, a, v = sums["b"] or 0, sums["a"] or 0, sums["v"]
    return model.select("token", (F.log((F.col("blocked") + 1) / float(b + v + 1)) - F.log((F.col("allowed") + 1) / float(a + v + 1))).alias("gain"))


def _scored(keyed: DataFrame, key: str, model: DataFrame, name: str) -> DataFrame:
    """(key, sum of gains) from (key, tokens)."""
    return keyed.select(key, F.explode_outer("tokens").alias("token")).join(model, "token").groupBy(key).agg(F.sum("gain").alias(name))


def judge_urls(pages: DataFrame, url_column: str = "url", text_column: str = "html", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """pages plus host, path, rule, verdict and score, one row for each row of pages, without its text column.

    rule: the longest that fits, or null; its verdict wins. Else block if score, the log-odds of naive Bayes, is above 0.
    A URL without tokens has the log-odds of the decided URLs as a whole; where no URL is decided, or only one way, every
    URL leans that way (allow if none is). Null texts count as empty; an empty table gives no rows. Input columns named
    as an output are replaced.
    """
    need(pages, url_column, text_column)
    outputs = ("host", "path", "rule", "verdict", "score")
    pages = without(pages, *outputs)
    name, verdict = ruled(rules)
    rows = with_host_and_path(pages.drop(text_column) if text_column != url_column else pages, url_column)
    shape = F.regexp_replace(F.lower("path"), r"[0-9]+", "0")
    rows = written(rows.withColumns({"rule": name, "__sg_ruled": verdict, "__sg_shape": shape}), "url-rows")
    counts = written(word_counts(pages, text_column), "url-words")

    classes = [F.count_if(F.col("__sg_ruled") == "block").alias("blocked"), F.count_if(F.col("__sg_ruled") == "allow").alias("allowed")]
    hosts = written(rows.groupBy("host").agg(*classes), "url-hosts")
    shapes = rows.groupBy(F.col("__sg_shape").alias("shape")).agg(*classes)
    shapes = written(shapes.withColumn("tokens", F.transform(F.array_remove(F.split("shape", r"[^\p{L}\p{N}]+"), ""), lambda t: F.concat(F.lit("/"), t))), "url-shapes")
    named = hosts.join(host_words(hosts.select("host"), counts), "host")
    named = written(named, "url-named")
    either = [t.select(F.explode_outer("tokens").alias("token"), "blocked", "allowed").where(F.col("token").isNotNull()) for t in (named, shapes)]
    model = _bayes(either[0].unionByName(either[1]))
    decided = hosts.agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).first()
    blocked, allowed = decided["b"] or 0, decided["a"] or 0
    prior = math.log((blocked + 0.5) / (allowed + 0.5)) if blocked + allowed else -1.0
    one_way = blocked == 0 or allowed == 0

    by_host = _scored(named, "host", model, "__sg_by_host").select(F.reverse("host").alias("__sg_other_host"), "__sg_by_host")
    by_shape = _scored(shapes, "shape", model, "__sg_by_shape").select(F.reverse("shape").alias("__sg_other_shape"), "__sg_by_shape")
    joined = rows.join(by_host, F.reverse("host") == F.col("__sg_other_host"), "left").join(by_shape, F.reverse("__sg_shape") == F.col("__sg_other_shape"), "left")
    score = F.lit(prior) if one_way else F.lit(prior) + F.coalesce("__sg_by_host", F.lit(0.0)) + F.coalesce("__sg_by_shape", F.lit(0.0))
    judged = joined.withColumn("score", score).withColumn("verdict", F.coalesce("__sg_ruled", F.when(F.col("score") > 0, "block").otherwise("allow")))
    return judged.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("__sg_") and c not in outputs], *outputs)
