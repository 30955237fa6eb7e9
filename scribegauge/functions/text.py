"""Text normalisation as column expressions; only NFKC and the periodic-repeat cleanup need Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Unicode white space; scripts that are kept besides letters, digits and underscore.
SPACES = r"\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
IDEOGRAPHS = r"\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af"
ARABIC = r"\u0600-\u06ff"
WORD = r"\p{L}\p{N}_"
FURIGANA = r"（[ぁ-んァ-ヶー" + SPACES + r"]+）|\([ぁ-んァ-ヶー" + SPACES + r"]+\)"
SENTENCE_MARK = r"[，。！？；：!?;:]|(?<!\p{Nd})[,.](?!\p{Nd})"
SIMPLE_MARK = r"[，。！？；：,.!?;:]"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(texts: pd.Series) -> pd.Series:
    """NFKC of each text of an array."""
    return texts.map(lambda a: a if a is None else [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in a])


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACES}]+", "")


def strip_events(text: Column) -> Column:
    """Bracketed event tags become a space."""
    return F.regexp_replace(text, r"\[[^\]]+\]", " ")


def plain(text: Column, nfkc: bool = True) -> Column:
    """Events out, and NFKC: what normalize(), extract_numbers() and math_normal() all begin with."""
    return _nfkc(strip_events(text)) if nfkc else strip_events(text)


def normalize(text: Column, keep_punctuation: bool = False, nfkc: bool = True, events: bool = True) -> Column:
    """Events out, NFKC, lower case, marks to spaces (unless kept), single spaces. nfkc: false if texts are known stable;
    events: false if they are out already."""
    out = strip_events(text) if events else text
    out = F.lower(_nfkc(out) if nfkc else out)
    if not keep_punctuation:
        out = F.regexp_replace(out, f"[^{WORD}{SPACES}{IDEOGRAPHS}{ARABIC}.%-]", " ")
    return F.trim(F.regexp_replace(out, f"[{SPACES}]+", " "))


def strip_furigana(text: Column) -> Column:
    return F.regexp_replace(text, FURIGANA, "")


def alias_groups(groups: Column) -> Column:
    """array<array<string>>: values stripped, empties and repeats out, groups of two or more."""
    cleaned = F.transform(groups, lambda g: F.array_distinct(F.filter(F.transform(g, strip), lambda x: x != "")))
    return F.filter(cleaned, lambda g: F.size(g) >= 2)


def fold_aliases(text: Column, groups: Column) -> Column:
    """Each group's values, longest first, become its first value; later steps see what earlier ones made."""
    ranked = lambda g: F.transform(F.array_sort(F.transform(g, lambda x, i: F.struct((-F.char_length(x)).alias("size"), i.alias("at"), x.alias("value")))), lambda s: s["value"])
    return F.aggregate(groups, text, lambda done, g: F.aggregate(ranked(g), done, lambda t, x: F.replace(t, x, F.get(g, F.lit(0)))))


def strip_model_tags(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"<\|[^|]+\|>", " "), f"[{SPACES}]+", " "))


def strip_technical(text: Column) -> Column:
    """URLs and dotted tokens become spaces."""
    urls = F.regexp_replace(text, rf"https?://[^{SPACES}]+", " ")
    return F.regexp_replace(urls, r"(?U)\b[\w-]+(?:\.[\w-]+)+\b", " ")


def has_sentence_marks(text: Column) -> Column:
    return strip_technical(text).rlike(SENTENCE_MARK)


def replace_matches(text: Column, pattern: str, made) -> Column:
    """text with each match of pattern replaced by made(match): what lies between matches alternates with them."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(matches, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def collapse_runs(text: Column, threshold: int = 20) -> Column:
    """A run of one character longer than threshold becomes one."""
    return F.regexp_replace(text, rf"(?s)(.)\1{{{threshold},}}", "$1")


@F.pandas_udf(StringType())
def _collapse_periods(text: pd.Series, threshold: pd.Series, longest: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else collapse_periods(t, int(n), int(m)) for t, n, m in zip(text, threshold, longest, strict=True)], dtype=object)


def collapse_periods(text: str, threshold: int = 20, longest: int = 20) -> str:
    """Stretches that repeat a pattern of 1 to longest characters threshold times or more keep one copy.

    A stretch begins only where at least twice threshold characters are left; the shortest pattern is tried first.
    """
    kept, at = [], 0
    patterns = [re.compile(rf"(.{{{n}}})\1{{{threshold - 1},}}", re.S) for n in range(1, longest + 1)]
    while len(text) - at >= 2 * threshold:
        found = [(m.start(), n, m) for n, p in enumerate(patterns, 1) if (m := p.search(text, at)) and len(text) - m.start() >= 2 * threshold]
        if not found:
            break
        start, size, match = min(found, key=lambda x: x[:2])
        kept.append(text[at : start + size])
        at = match.end()
    return "".join(kept) + text[at:]


def clean_repeats(text: Column, threshold: int = 20, longest: int = 20) -> Column:
    return _collapse_periods(collapse_runs(text, threshold), F.lit(threshold), F.lit(longest))


def timestamp_label(seconds: Column) -> Column:
    """HH:MM:SS,mmm; milliseconds are rounded within their minute and never carry."""
    hours, rest = F.floor(seconds / 3600).cast("int"), seconds % 3600
    return F.format_string("%02d:%02d:%s", hours, F.floor(rest / 60).cast("int"), F.replace(F.format_string("%06.3f", rest % 60), F.lit("."), F.lit(",")))


def tail(text: Column, size: int) -> Column:
    return F.right(text, F.lit(size))


#: The sentences that introduce a prompt's terms, and what separates and ends the terms.
TERM_SENTENCES = {
    "run": "请转写音频。以下是可能出现的专有名词和热词，请优先按这些写法输出：",
    "transcribe": "请完整逐字转写整段音频，不要摘要，不要只输出热词。以下词只用于纠正常见写法；只有音频中实际出现时才按这些写法输出：",
}


def prompt(system_prompt: Column, terms: Column, kind: str = "transcribe") -> Column:
    """System prompt and a sentence of terms, on lines of their own; null if both are empty."""
    named = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), strip), lambda t: t != "")
    sentence = F.when(F.size(named) > 0, F.concat(F.lit(TERM_SENTENCES[kind]), F.array_join(named, "、"), F.lit("。")))
    return F.nullif(F.concat_ws("\n", F.nullif(strip(system_prompt), F.lit("")), sentence), F.lit(""))


def output_text(output: Column) -> Column:
    """The text of a model's JSON output: a plain string, its text field, or its segments' texts joined."""
    parsed = F.try_parse_json(output)
    parts = F.try_variant_get(parsed, "$.segments", "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda s: strip(s["text"])), lambda t: t != ""), " ")
    return strip(F.coalesce(F.try_variant_get(parsed, "$.text", "string"), joined, F.when(F.try_variant_get(parsed, "$", "struct<a:string>").isNull(), output), F.lit("")))


def named_text(output: Column, names: tuple[str, ...] = ("text", "transcription", "result"), blank_counts: bool = True) -> Column:
    """The text of a model's JSON output that names it by one of names, the first that holds a string (not an empty one
    unless blank_counts): a plain string, an object, or a list of them, whose texts are joined by blanks. What isn't JSON,
    or has no such name, stays as it is. Model tags go; lists within lists are taken as they are; null stays null."""

    def string(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def one(v: Column) -> Column:
        held = [string(F.try_variant_get(v, f"$.{n}", "variant")) for n in names]
        return F.coalesce(string(v), *[h if blank_counts else F.nullif(h, F.lit("")) for h in held])

    parsed = F.try_parse_json(output)
    parts = F.transform(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: strip_model_tags(F.coalesce(one(v), F.to_json(v))))
    return strip_model_tags(F.coalesce(one(parsed), F.array_join(F.filter(parts, lambda t: t != ""), " "), output))
