"""Secret scans over a trigram inverted index, with built-in functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must contain: an AND of
clauses, each an OR of alternatives, each an AND of trigrams. The index holds postings (trigram, text key) for the
trigrams that the rules ask for; postings are intersected and united per rule as its query says. The surviving
(rule, text) pairs go into a fixed-size broadcast filter, so the texts themselves never shuffle: a text is verified by
a rule's expression only where the filter lets that pair pass. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from .common import need, text_of, without, written


@dataclass(frozen=True)
class Rule:
    """kind; pattern; its group whose length must be least characters at least (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: In the order in which spans of equal start are listed. Where every match of X+ that is too short only holds matches
#: that are too short as well, the length stands in the pattern.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)
MOST_STRINGS = 64


def _literals(tree) -> list[set[str] | None]:
    """The sequence's parts: the set of strings that a part may be, or None where that isn't a small finite set."""
    parts: list[set[str] | None] = []
    for op, value in tree:
        if op is sre.LITERAL:
            parts.append({chr(value).lower()})
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, what in value:
                if kind is sre.LITERAL and chars is not None:
                    chars.add(chr(what).lower())
                elif kind is sre.RANGE and chars is not None and what[1] - what[0] < 8:
                    chars |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
                else:
                    chars = None
            parts.append(chars if chars and len(chars) <= 8 else None)
        elif op is sre.SUBPATTERN:
            parts.extend(_literals(value[-1]))
        elif op is sre.BRANCH:
            found: set[str] | None = set()
            for branch in value[1]:
                whole = _product(_literals(branch))
                found = None if found is None or whole is None else found | whole
            parts.append(found)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            whole = _product(_literals(inner))
            if whole is not None and high == 1 and low == 0:
                parts.append(whole | {""})
            elif whole is not None and low >= 1 and len(whole) ** low <= MOST_STRINGS:
                parts.extend([whole] * low)
                if high != low:
                    parts.append(None)
            else:
                parts.append(None)
        elif op is sre.AT:
            continue
        else:
            parts.append(None)
    return parts


def _product(parts: list[set[str] | None]) -> set[str] | None:
    whole = {""}
    for part in parts:
        if part is None or len(whole) * len(part) > MOST_STRINGS:
            return None
        whole = {a + b for a in whole for b in part}
    return whole


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses of alternatives of trigrams, lower-cased; empty if the pattern has no mandatory trigram."""
    clauses: list[list[list[str]]] = []

    def close(strings: set[str]) -> None:
        groups = [sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in sorted(strings)]
        if groups and all(groups):
            clauses.append(groups)

    run = {""}
    for part in [*_literals(parser.parse(pattern)), None]:
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
        else:
            close(run)
            run = part if part is not None else {""}
    close(run)
    return clauses


def trigram_index(texts: DataFrame, trigrams: list[str], text: Column) -> DataFrame:
    """Postings (trigram, __sg_key) of these trigrams in lower-cased texts; equal texts post once."""
    grams = F.array(*[F.lit(t) for t in trigrams])
    # lambdas bind the lower-cased text, so that it is made once; explode_outer, because explode would test its array first
    held = F.get(F.transform(F.array(F.lower(text)), lambda low: F.filter(grams, lambda t: F.contains(low, t))), F.lit(0))
    found = texts.select("__sg_key", held.alias("__sg_held")).distinct()
    return found.select("__sg_key", F.explode_outer("__sg_held").alias("trigram")).where(F.col("trigram").isNotNull())


def _candidates(docs: DataFrame, text: Column, queries: dict[int, list[list[list[str]]]]) -> DataFrame:
    """(__sg_pair): hashes of (text key, rule) whose postings satisfy the rule's query."""
    asked = [(rule, c, a, t, len(group), len(clauses)) for rule, clauses in queries.items() for c, groups in enumerate(clauses) for a, group in enumerate(groups) for t in group]
    # a table made from the rules alone: its size is a constant
    table = docs.sparkSession.createDataFrame(asked, "rule int, clause int, alternative int, trigram string, grams int, clauses int")
    postings = trigram_index(docs, sorted({x[3] for x in asked}), text)
    hits = postings.join(F.broadcast(table), "trigram")
    intersected = hits.groupBy("__sg_key", "rule", "clauses", "clause", "alternative", "grams").agg(F.count(F.lit(1)).alias("n")).where("n = grams")
    united = intersected.groupBy("__sg_key", "rule", "clauses").agg(F.count_distinct("clause").alias("met")).where("met = clauses")
    return united.select(_pair(F.col("__sg_key"), F.col("rule")).alias("__sg_pair"))


def _pair(key: Column, rule: Column) -> Column:
    return F.xxhash64(key, rule.cast("int"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end>> of a rule's matches, leftmost and non-overlapping, in code points.

    The pieces between the matches and the matches themselves alternate, so running lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    pieces, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(matches)), F.char_length).alias("gap"), F.transform(matches, F.char_length).alias("long"), F.transform(held, F.char_length).alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int>>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("order"), (begin + x["long"]).alias("end")))
        return F.struct((begin + x["long"]).alias("at"), F.when(x["held"] >= rule.least, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.aggregate(steps, start, step, lambda state: state["found"])


def scan_secrets(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs plus spans_found array<struct<kind, start, end, base>>, ordered by start, then by rule.

    Places are code points, the end is exclusive. Every row of docs gives one row; null and empty texts have no spans;
    equal texts have equal spans; an empty table gives no rows. An input column named spans_found is replaced.
    """
    need(docs, text_column)
    docs = without(docs, "spans_found")
    text = text_of(text_column)
    rows = docs.withColumn("__sg_key", F.xxhash64(text))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    may = {}
    if queries:
        pairs = written(_candidates(rows, text, queries), "secret-candidates")
        log2_bits = bitfilter.log2_bits_for(pairs.count())
        pages = bitfilter.seen(pairs, "__sg_pair", log2_bits)
        for i in queries:
            may[i] = f"__sg_may{i}"
            rows = bitfilter.with_maybe(rows, _pair(F.col("__sg_key"), F.lit(i)), pages, log2_bits, may[i])
    found = [F.when((F.col(may[i]) if i in may else F.lit(True)) & text.rlike(r.pattern), spans_of(text, r, i)).otherwise(none) for i, r in enumerate(rules)]
    kinds, base = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.base) for r in rules])
    ordered = F.array_sort(F.concat(*found))
    spans = F.transform(ordered, lambda s: F.struct(F.get(kinds, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.get(base, s["order"]).alias("base")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], spans.alias("spans_found"))
