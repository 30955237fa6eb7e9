"""Token arrays for error rates, n-gram repetition, and multiset scores, as column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .text import ARABIC, IDEOGRAPHS, SENTENCE_MARK, normalize, without_spaces

#: Code points above the first plane.
MOST_SHARED = 0x100000
METRICS = ("cer", "wer", "hybrid_ter")
#: Words join on hyphens and apostrophes, numbers on commas and points.
LATIN = r"[a-zA-Z]+(?:[-'][a-zA-Z]+)*"
NUMBER = r"\p{Nd}+(?:[,.]\p{Nd}+)*(?:st|nd|rd|th)?"
HYBRID = rf"[{IDEOGRAPHS}]|{NUMBER}%?|[{ARABIC}]+|{LATIN}"


def characters(normal: Column) -> Column:
    """Character tokens of a normalised text."""
    packed = without_spaces(normal)
    return F.when(packed == "", F.array().cast("array<string>")).otherwise(F.split(packed, ""))


def character_count(normal: Column) -> Column:
    return F.char_length(without_spaces(normal))


def word_count(normal: Column) -> Column:
    return F.regexp_count(normal, F.lit(f"{LATIN}|{NUMBER}"))


def hybrid_count(normal: Column) -> Column:
    return F.regexp_count(normal, F.lit(f"(?i){HYBRID}"))


def words(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(f"{LATIN}|{NUMBER}"), F.lit(0))


def hybrid(normal: Column) -> Column:
    """Ideographs, numbers, Arabic runs and Latin words, in the order in which a scan from the left meets them."""
    return F.regexp_extract_all(normal, F.lit(f"(?i){HYBRID}"), F.lit(0))


def metric_tokens(metric: Column, text: Column, normalized: bool = False) -> Column:
    normal = text if normalized else normalize(text)
    unknown = F.raise_error(F.concat(F.lit("unknown metric: "), F.coalesce(metric, F.lit("null")))).cast("array<string>")
    return F.when(metric == "cer", characters(normal)).when(metric == "wer", words(normal)).when(metric == "hybrid_ter", hybrid(normal)).otherwise(unknown)


@F.pandas_udf(StructType([StructField("a", StringType()), StructField("b", StringType())]))
def _coded(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Both token arrays as strings of one code point for each token that both have, so that string distance is token
    distance. Tokens that one side has alone are equal to nothing on the other, so one code point a side does for them all."""
    made = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            made.append((None, None))
            continue
        both = set(x) & set(y)
        shared = {t: n for n, t in enumerate(both)}
        if len(shared) > MOST_SHARED:
            raise ValueError(f"more than {MOST_SHARED} distinct tokens in common: beyond what a distance can be computed for")
        made.append(tuple("".join(chr(0x10000 + shared[t]) if t in shared else own for t in side) for side, own in ((x, "a"), (y, "b"))))
    return pd.DataFrame(made, columns=["a", "b"])


def character_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of the character tokens of two normalised texts, without making the tokens."""
    return F.levenshtein(without_spaces(a), without_spaces(b))


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays."""
    coded = _coded(a, b)
    return F.levenshtein(coded["a"], coded["b"])


def error_rate(reference: Column, hypothesis: Column, distance: Column) -> Column:
    """Distance per reference token; an empty reference has 0 if the hypothesis is empty too, else 1."""
    empty = F.when(F.size(hypothesis) == 0, 0.0).otherwise(1.0)
    return F.when(F.size(reference) == 0, empty).otherwise(distance / F.size(reference))


def repetition_rate(tokens: Column, n: int = 4) -> Column:
    """Share of n-grams that repeat an earlier one; 0 for fewer than 2n tokens. The grams are made from n shifted copies of
    the tokens: a slice copies its whole array, so one for each gram would take time by the square of the tokens."""
    made = F.size(tokens) - (n - 1)
    shifted = lambda i: F.slice(tokens, F.lit(i + 1), F.greatest(made, F.lit(0)))
    grams = reduce(lambda done, i: F.zip_with(done, shifted(i), lambda a, b: F.concat_ws("\x00", a, b)), range(1, n), shifted(0))
    return F.when(F.size(tokens) >= 2 * n, (made - F.size(F.array_distinct(grams))) / made).otherwise(0.0)


def sentence_marks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE_MARK), F.lit(0))


def multiset_overlap(a: Column, b: Column) -> Column:
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    return F.aggregate(F.transform(F.array_distinct(a), lambda x: F.least(count(a, x), count(b, x))), F.lit(0), lambda s, x: s + x)


def harmonic(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def multiset_scores(reference: Column, hypothesis: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two item arrays: all 1 if both are empty, all 0 if one is."""
    shared, either = multiset_overlap(reference, hypothesis), (F.size(reference) == 0) | (F.size(hypothesis) == 0)
    both = (F.size(reference) == 0) & (F.size(hypothesis) == 0)
    over = lambda items: F.when(both, 1.0).when(either, 0.0).otherwise(shared / F.greatest(F.size(items), F.lit(1)))
    precision, recall = over(hypothesis), over(reference)
    return precision, recall, harmonic(precision, recall)
