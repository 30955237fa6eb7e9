"""Written and spoken numbers: extraction, Chinese numerals and mathematical notation, as column expressions.

Chinese numerals are read by splitting at the large units: every stretch is the sum of its digit-and-unit pairs and of a
last digit, times the unit that ends it. Only near-miss similarity needs Python.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .text import IDEOGRAPHS, SPACES, _nfkc, nfkc_all, normalize, replace_matches, strip, strip_events, without_spaces

#: Numerals and their digits, units, and the shapes of number tokens.
NUMERALS, DIGITS = "零〇一二两三四五六七八九", "001223456789"
SMALL, LARGE = {"十": 10, "百": 100, "千": 1000}, {"万": 10_000, "亿": 100_000_000}
_PLAIN = r"\p{Nd}+(?:[,.]\p{Nd}+)*"
TOKEN = rf"(?i)(?:{_PLAIN}(?:[万亿]{_PLAIN})+[万亿]?)|(?:{_PLAIN}[万亿])|(?:{_PLAIN}(?:st|nd|rd|th)?%?)|(?:[一二三四五六七八九十百千万亿零〇两点]+)"
PLAIN_FORM = r"(?i)^\p{Nd}+(?:\.\p{Nd}+)?(?:st|nd|rd|th)?%?\z"
SPOKEN_DIGITS = rf"[零〇一二三四五六七八九](?:[{SPACES},，、.。．·\-:：;；!！?？]+[零〇一二三四五六七八九]){{2,}}"
NUMERAL_RUN = "[零〇一二三四五六七八九十百千万亿两]+"
MATH_SYMBOL = r"[0-9×xX*＊+\-=÷/]"


def bound(value: Column, make) -> Column:
    """make(value) with the value computed once, as a lambda's variable, however often make() uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def computed(df: DataFrame) -> DataFrame:
    """df, whose columns Spark computes here, once, and does not put into the expressions that use them: projections are
    not merged across a generator, here of one row. Columns that nobody reads are still left out."""
    return df.select("*", F.explode(F.array(F.lit(0))).alias("__one")).drop("__one")


def _digits(numerals: Column) -> Column:
    return F.translate(numerals, NUMERALS, DIGITS)


def _no_leading_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=.)", "")


def _unit(pair: Column, units: dict[str, int]) -> Column:
    last = F.right(pair, F.lit(1))
    out = F.lit(1)
    for name, size in units.items():
        out = F.when(last == name, F.lit(size)).otherwise(out)
    return out.cast("decimal(38,0)")


def _below_large(stretch: Column) -> Column:
    """Digit-and-unit pairs and a last digit of a stretch without large units; a unit without a digit counts once."""
    pairs = F.regexp_extract_all(stretch, F.lit(f"[{NUMERALS}]?[十百千]"), F.lit(0))

    def digit(pair: Column) -> Column:
        value = _digits(F.regexp_extract(pair, f"^[{NUMERALS}]", 0))
        return bound(value, lambda v: F.when(v.isin("", "0"), F.lit("1")).otherwise(v).cast("decimal(38,0)"))

    zero = F.lit(0).cast("decimal(38,0)")
    summed = F.aggregate(pairs, zero, lambda s, p: (s + digit(p) * _unit(p, SMALL)).cast("decimal(38,0)"))
    last = F.regexp_extract(stretch, f"[{NUMERALS}]$", 0)
    return (summed + F.when(last == "", F.lit("0")).otherwise(_digits(last)).cast("decimal(38,0)")).cast("decimal(38,0)")


def chinese_integer(token: Column) -> Column:
    """The number as a string of digits; null for other tokens, and for 一两, which is no number."""
    stretches = F.regexp_extract_all(token, F.lit("[^万亿]*[万亿]|[^万亿]+"), F.lit(0))

    def value(stretch: Column) -> Column:
        ended, one = stretch.rlike("[万亿]$"), F.lit(1).cast("decimal(38,0)")
        own = bound(F.regexp_replace(stretch, "[万亿]$", ""), _below_large)
        counted = bound(own, lambda n: F.when(ended & (n == 0), one).otherwise(n))
        return counted * F.when(ended, _unit(stretch, LARGE)).otherwise(one)

    total = F.aggregate(stretches, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + value(x)).cast("decimal(38,0)"))
    spelled = token.rlike(f"^[{NUMERALS}]+\\z")
    return F.when(token.isNull() | (token == "一两"), None).when(spelled, _no_leading_zeros(_digits(token))).when(token.rlike(f"^[{NUMERALS}十百千万亿]+\\z"), total.cast("string"))


def chinese_decimal(token: Column) -> Column:
    """Digits around the first 点; the fraction has to be plain numerals, an empty whole part is 0. Else null."""
    at = F.instr(token, "点")
    whole, fraction = F.substring(token, F.lit(1), at - 1), F.substring(token, at + 1, F.char_length(token))
    value = bound(whole, lambda w: F.when(w == "", F.lit("0")).otherwise(chinese_integer(w)))
    return F.when((at > 0) & fraction.rlike(f"^[{NUMERALS}]+\\z"), F.concat(value, F.lit("."), _digits(fraction)))


def mixed_units(token: Column) -> Column:
    """Sum of digits with 万 or 亿, as an integer where it is one. Null for tokens of another shape."""
    shaped = token.rlike(r"\p{Nd}.*[万亿]|[万亿].*\p{Nd}")
    parts = F.regexp_extract_all(token, F.lit(r"\p{Nd}+(?:\.\p{Nd}+)?[万亿]?"), F.lit(0))
    # every unit has to follow digits
    sound = F.size(F.regexp_extract_all(token, F.lit("[万亿]"), F.lit(0))) == F.size(F.filter(parts, lambda p: p.rlike("[万亿]$")))
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.regexp_extract(p, r"^[\p{Nd}.]+", 0).cast("double") * _unit(p, LARGE).cast("double"))
    return F.when(shaped & sound & (F.size(parts) > 0), F.when(total == F.floor(total), total.cast("decimal(38,0)").cast("string")).otherwise(total.cast("string")))


def number_token(token: Column) -> Column:
    """A matched token's normal form; null for a lone 点."""

    def normal(low: Column) -> Column:
        plain = F.when(low.rlike(PLAIN_FORM), low)
        chinese = F.when(low.rlike(f"[{NUMERALS}十百千万亿点]"), F.coalesce(mixed_units(low), chinese_decimal(low), chinese_integer(low)))
        return F.when(low != "点", F.coalesce(plain, chinese, low))

    return bound(F.replace(F.lower(token), F.lit(","), F.lit("")), normal)


def join_spoken_digits(text: Column) -> Column:
    """Three or more numerals that marks or spaces separate are one."""
    return replace_matches(text, SPOKEN_DIGITS, lambda m: F.regexp_replace(m, f"[^{NUMERALS}]", ""))


def extract_numbers(text: Column, nfkc: bool = True, events: bool = True) -> Column:
    """array<string> of the numbers in a raw text, in order."""
    normal = normalize(text, keep_punctuation=True, nfkc=nfkc, events=events)
    joined = bound(normal, lambda n: F.when(n.rlike(SPOKEN_DIGITS), join_spoken_digits(n)).otherwise(n))
    return F.filter(F.transform(F.regexp_extract_all(joined, F.lit(TOKEN), F.lit(0)), number_token), lambda x: x.isNotNull() & (x != ""))


def form_matches(form: Column, normal: Column, numbers: Column) -> Column:
    return F.array_contains(numbers, form) | (~form.rlike(PLAIN_FORM) & F.contains(normal, form))


def substring_similarity(needle: str, haystack: str) -> float:
    """The best ratio of needle and a window of haystack about as long; 1 if it occurs. Spaces should be gone already."""
    if not needle or not haystack:
        return 0.0
    if needle in haystack:
        return 1.0
    windows = {haystack[i : i + n] for n in {max(1, len(needle) - 1), len(needle), len(needle) + 1} if n <= len(haystack) for i in range(len(haystack) - n + 1)}
    best = 0.0
    for window in windows:
        matcher = SequenceMatcher(None, needle, window)
        if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
            best = max(best, matcher.ratio())
    return best


def near_misses(forms: list[str], compact: str, numbers: list[str]) -> float:
    """A target's best similarity to the text or to one of its numbers."""
    scores = [substring_similarity("".join(f.split()), compact) for f in forms]
    return max([0.0, *scores, *(SequenceMatcher(None, f, n).ratio() for f in forms for n in set(numbers))])


@F.pandas_udf(ArrayType(DoubleType()))
def _near_misses(forms: pd.Series, compact: pd.Series, numbers: pd.Series) -> pd.Series:
    listed = lambda a: [] if a is None else list(a)
    return pd.Series([None if f is None else [near_misses(listed(t), c or "", listed(n)) for t in f] for f, c, n in zip(forms, compact, numbers, strict=True)], dtype=object)


def with_near_misses(df: DataFrame, forms: str, compact: str, numbers: str, name: str) -> DataFrame:
    """df plus the near misses of each target's forms, as an array, computed once."""
    return computed(computed(df).withColumn(name, _near_misses(F.col(forms), F.col(compact), F.col(numbers))))


def math_normal(text: Column, nfkc: bool = True, events: bool = True) -> Column:
    """Spoken and written arithmetic in one notation, without spaces or other marks."""
    out = strip_events(text) if events else text
    out = F.lower(_nfkc(out) if nfkc else out)
    out = F.translate(out, "＊*x", "×××")
    out = replace_matches(out, NUMERAL_RUN, lambda m: F.coalesce(chinese_integer(m), m))
    gap = f"[{SPACES}]*"
    for spoken, sign, ahead in (("乘以?", "×", r"\p{Nd}"), ("乘以?", "×", "再"), ("加上?", "+", r"\p{Nd}"), ("减去?", "-", r"\p{Nd}"), ("除以?", "÷", r"\p{Nd}")):
        out = F.regexp_replace(out, rf"(?<={ahead}){gap}{spoken}{gap}(?=\p{{Nd}})", sign)
    return F.regexp_replace(without_spaces(out), rf"[^0-9a-z{IDEOGRAPHS}×+\-=÷/%]", "")


def target_forms(numbers: Column) -> Column:
    """array<struct<display, forms>>: what the case lists, and the forms under which it may occur."""

    def one(value: Column, plain: Column) -> Column:
        normal, found = normalize(plain, nfkc=False, events=False), extract_numbers(plain, nfkc=False, events=False)
        return F.struct(strip(value).alias("display"), F.array_distinct(F.filter(F.concat(F.array(normal), found), lambda f: f != "")).alias("forms"))

    numbers = F.coalesce(numbers, F.array().cast("array<string>"))
    # lambdas hold no Python, so NFKC comes first
    listed = F.zip_with(numbers, nfkc_all(F.transform(numbers, strip_events)), one)
    return F.filter(listed, lambda t: (t["display"] != "") & (F.size(t["forms"]) > 0))
