"""Scores of one reference and one prediction, and the record of a case.

Every text is normalised and tokenised once. A case's diagnostic variants (script, furigana, aliases) are scored by the
same expressions within its row, and only where their texts differ from the case's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..functions import tokens as T
from . import cases as C

STRINGS = "array<string>"


def _none(kind: str = STRINGS) -> Column:
    return F.array().cast(kind)


def term_forms(terms: Column) -> Column:
    """array<struct<term, normal>>: each term and its normalised form."""
    terms = F.coalesce(terms, _none())
    # lambdas hold no Python, so NFKC comes first
    return F.zip_with(terms, X.nfkc_all(F.transform(terms, X.strip_events)), lambda t, plain: F.struct(t.alias("term"), X.normalize(plain, nfkc=False, events=False).alias("normal")))


def terms_found(forms: Column, reference_normal: Column, prediction_normal: Column) -> Column:
    """array<struct<term, hit>> of the terms that occur in the reference, repeats kept. Texts are bound, else Spark may
    normalise them again for each term."""

    def found(x: Column) -> Column:
        held = F.filter(x["forms"], lambda f: (f["normal"] != "") & F.contains(x["reference"], f["normal"]))
        return F.transform(held, lambda f: F.struct(f["term"].alias("term"), F.contains(x["prediction"], f["normal"]).alias("hit")))

    return N.bound(F.struct(forms.alias("forms"), reference_normal.alias("reference"), prediction_normal.alias("prediction")), found)


def expected_terms(terms: Column, reference_normal: Column, prediction_normal: Column) -> Column:
    return terms_found(term_forms(terms), reference_normal, prediction_normal)


def term_scores(found: Column, prefix: str) -> dict[str, Column]:
    """Recall of a closed set, which stands for precision and F1 too; 1 if nothing was expected."""
    hits = F.size(F.filter(found, lambda x: x["hit"]))
    recall = F.when(F.size(found) == 0, 1.0).otherwise(hits / F.size(found))
    return {f"{prefix}_recall": recall, f"{prefix}_precision": recall, f"{prefix}_f1": recall, f"{prefix}_matched": hits, f"{prefix}_total": F.size(found)}


def term_lists(found: Column, prefix: str) -> dict[str, Column]:
    names = lambda keep: F.transform(F.filter(found, keep), lambda x: x["term"])
    hit = names(lambda x: x["hit"])
    return {f"{prefix}_expected_terms": F.transform(found, lambda x: x["term"]), f"{prefix}_matched_terms": hit, f"{prefix}_missing_terms": F.filter(names(lambda x: ~x["hit"]), lambda t: ~F.array_contains(hit, t))}


def length_ratio(reference_count: Column, prediction_count: Column) -> Column:
    return F.when(reference_count > 0, prediction_count / reference_count).when(prediction_count > 0, float("inf")).otherwise(1.0)


def length_score(reference_count: Column, prediction_count: Column) -> Column:
    """1 within 0.6 to 1.6 times the reference, falling off to 0 at none and at three times."""
    ratio = length_ratio(reference_count, prediction_count)
    within = F.when(ratio < 0.6, ratio / 0.6).when(ratio <= 1.6, 1.0).otherwise(1.0 - F.least(F.lit(1.0), (ratio - 1.6) / 1.4))
    return F.when(reference_count > 0, within).otherwise(1.0 - F.least(F.lit(1.0), prediction_count / 50))


def hallucination(reference_tokens: Column, prediction_tokens: Column, rates: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """rates: the repetition rates of both, where they are computed already."""
    count, made = F.size(reference_tokens), F.size(prediction_tokens)
    before, after = rates or (T.repetition_rate(reference_tokens), T.repetition_rate(prediction_tokens))
    excess = F.greatest(F.lit(0.0), after - before)
    repeats = 1.0 - F.least(F.lit(1.0), excess * 4)
    length = length_score(count, made)
    return {
        "reference_token_count": count, "prediction_token_count": made, "length_ratio": length_ratio(count, made), "length_score": length,
        "reference_repetition_rate": before, "repetition_rate": after, "excess_repetition_rate": excess, "repetition_score": repeats,
        "hallucination_score": 0.65 * length + 0.35 * repeats,
    }


def quality_flags(ratio: Column, excess: Column, repetition_score: Column, mode: Column) -> dict[str, Column]:
    base = F.array_compact(F.array(F.when(ratio < 0.8, "under_transcription").when(ratio > 1.3, "over_transcription"), F.when((excess > 0.08) | (repetition_score < 0.7), "excess_repetition")))
    failed = C.hotword_mode(mode).isin(*C.CONTEXT_MODES) & (F.size(base) > 0)
    return {"quality_flags": F.when(failed, F.array_append(base, "context_prompt_instability")).otherwise(base), "context_prompt_failure": failed}


def text_score_90(error: Column, keyword_f1: Column, number_f1: Column, hallucination_score: Column, punctuation_f1: Column) -> Column:
    return 50.0 * (1.0 - F.least(F.lit(1.0), error)) + 15.0 * keyword_f1 + 10.0 * number_f1 + 10.0 * hallucination_score + 5.0 * punctuation_f1


def _with(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def measured(pairs: DataFrame, nfkc: bool = True, prefix: str = "") -> DataFrame:
    """pairs (reference, prediction, metric, keywords, numbers, punctuation) plus all score columns of each pair. prefix: of
    the names of the texts and of all that is made of them; a run without one has to come first."""
    own = lambda name: F.col(f"{prefix}{name}")
    add = lambda df, columns: _with(df, {f"{prefix}{n}": c for n, c in columns.items()})
    df = pairs if prefix else _with(pairs, {"__terms": term_forms(F.col("keywords")), "__listed": N.target_forms(F.col("numbers"))})
    df = N.computed(add(df, {"__ref_plain": X.plain(own("reference"), nfkc), "__hyp_plain": X.plain(own("prediction"), nfkc)}))
    df = add(df, {side: X.normalize(own(f"{side}_plain"), nfkc=False, events=False) for side in ("__ref", "__hyp")})
    df = N.computed(add(df, {"__ref_marks": T.sentence_marks(own("reference")), "__hyp_marks": T.sentence_marks(own("prediction"))}))
    df = add(df, {f"{side}_tokens": T.metric_tokens(F.col("metric"), own(side), True) for side in ("__ref", "__hyp")})
    df = N.computed(add(df, {"__keywords": terms_found(F.col("__terms"), own("__ref"), own("__hyp"))}))
    by_characters = F.col("metric") == "cer"
    coded = [F.when(~by_characters, own(c)) for c in ("__ref_tokens", "__hyp_tokens")]
    df = add(df, {"__distance": F.when(by_characters, T.character_distance(own("__ref"), own("__hyp"))).otherwise(T.token_distance(*coded))})
    df = add(df, {f"{side}_repetition": T.repetition_rate(own(f"{side}_tokens")) for side in ("__ref", "__hyp")})
    none = F.col("punctuation").eqNullSafe("none")
    precision, recall, _ = T.multiset_scores(own("__ref_marks"), own("__hyp_marks"))
    df = N.computed(add(df, {"punctuation_precision": F.when(none, 1.0).otherwise(precision), "punctuation_recall": F.when(none, 1.0).otherwise(recall)}))
    df = add(df, {"primary_error_rate": T.error_rate(own("__ref_tokens"), own("__hyp_tokens"), own("__distance"))})
    df = add(df, term_scores(own("__keywords"), "keyword"))
    df = add(df, {"punctuation_evaluation": F.when(none, "ignored_reference_has_no_punctuation").otherwise("scored"), "punctuation_f1": T.harmonic(own("punctuation_precision"), own("punctuation_recall"))})
    df = add(df, hallucination(own("__ref_tokens"), own("__hyp_tokens"), (own("__ref_repetition"), own("__hyp_repetition"))))
    df = _number_scores(df, prefix, *[N.extract_numbers(own(f"{side}_plain"), nfkc=False, events=False) for side in ("__ref", "__hyp")])
    return N.computed(add(df, {"text_score_90": text_score_90(*[own(c) for c in ("primary_error_rate", "keyword_f1", "number_f1", "hallucination_score", "punctuation_f1")])}))


def with_number_scores(df: DataFrame, nfkc: bool = True) -> DataFrame:
    """Adds number scores over the targets that occur in the reference; a target that the prediction misses counts its
    best near miss. Precision, recall and F1 are the mean; 1 without targets."""
    df = _with(df, {"__listed": N.target_forms(F.col("numbers"))})
    return _number_scores(df, "", *[N.extract_numbers(F.col(c), nfkc) for c in ("reference", "prediction")])


def _number_scores(df: DataFrame, prefix: str, reference_numbers: Column, prediction_numbers: Column) -> DataFrame:
    own = lambda name: F.col(f"{prefix}{name}")
    add = lambda df, columns: _with(df, {f"{prefix}{n}": c for n, c in columns.items()})
    df = N.computed(add(df, {"__ref_numbers": F.array_distinct(reference_numbers), "__hyp_numbers": F.array_distinct(prediction_numbers)}))

    def some(targets: Column, side: str, made) -> Column:
        """made(targets, test) with the side's text and numbers computed once, not again for each target."""
        holds = lambda x: lambda t: F.exists(t["forms"], lambda f: N.form_matches(f, x["normal"], x["numbers"]))
        return N.bound(F.struct(targets.alias("targets"), own(side).alias("normal"), own(f"{side}_numbers").alias("numbers")), lambda x: made(x["targets"], holds(x)))

    df = N.computed(add(df, {"__targets": some(F.col("__listed"), "__ref", F.filter)}))
    df = N.computed(add(df, {"__exact": some(own("__targets"), "__hyp", F.transform), "__forms": F.transform(own("__targets"), lambda t: t["forms"])}))
    df = add(df, {"__missed": F.zip_with(own("__forms"), own("__exact"), lambda forms, exact: F.when(exact, _none()).otherwise(forms))})
    df = add(df, {"__compact": F.when(F.exists(own("__missed"), lambda forms: F.size(forms) > 0), X.without_spaces(own("__hyp")))})
    df = N.with_near_misses(df, *[f"{prefix}{c}" for c in ("__missed", "__compact", "__hyp_numbers", "__near")])
    scored = F.zip_with(own("__targets"), F.zip_with(own("__exact"), own("__near"), lambda exact, near: F.when(exact, 1.0).otherwise(near)), lambda t, score: F.struct(t["display"].alias("target"), score.alias("score")))
    df = N.computed(add(df, {"number_target_scores": scored}))
    found = own("number_target_scores")
    mean = F.when(F.size(found) == 0, 1.0).otherwise(F.aggregate(found, F.lit(0.0), lambda s, x: s + x["score"]) / F.size(found))
    shown = lambda keep: F.array_sort(F.array_distinct(F.transform(F.filter(found, keep), lambda x: x["target"])))
    return add(df, {"number_precision": mean, "number_recall": mean, "number_f1": mean, "reference_numbers": shown(lambda x: F.lit(True)), "prediction_numbers": shown(lambda x: x["score"] >= 0.999)})


VARIANT_SCORES = ("primary_error_rate", "text_score_90")


def score_cases(cases: DataFrame, mode: str = "zero_shot", configured: dict[str, float] | None = None, to_simplified=None, nfkc: bool = True) -> DataFrame:
    """The score record of each case. cases: case_id, scenario, language, priority, weight, primary_error_metric, status,
    review_level, punctuation, keywords, numbers, hotwords, alias_groups (array<array<string>>), itn_domain, itn_domains,
    reference, prediction. to_simplified: a function of a text column that converts script, where one is available.
    """
    df = C.with_weights(cases, configured).withColumn("metric", F.col("primary_error_metric"))
    raw = measured(df, nfkc)
    raw = N.computed(_with(raw, {"__hotwords": expected_terms(F.col("hotwords"), F.col("__ref"), F.col("__hyp"))}))
    raw = _with(raw, term_scores(F.col("__hotwords"), "hotword") | term_lists(F.col("__hotwords"), "hotword"))
    raw = _with(raw, {c.replace("hotword", "context_term"): F.col(c) for c in raw.columns if c.startswith("hotword_")})
    raw = _with(raw, {"context_terms_source_field": F.lit("hotwords"), "hotword_mode": C.hotword_mode(F.lit(mode)), "term_prompt_mechanism": C.prompt_mechanism(F.lit(mode))})
    raw = _with(raw, quality_flags(F.col("length_ratio"), F.col("excess_repetition_rate"), F.col("repetition_score"), F.col("hotword_mode")))
    raw = with_math(raw, nfkc)
    raw = _with(raw, {"weighted_text_score_90": F.col("text_score_90") * F.col("effective_weight")})
    return _with_variants(raw, to_simplified, nfkc)


def with_math(df: DataFrame, plain: bool) -> DataFrame:
    """plain: whether df has the texts without events and in NFKC already."""
    applies = C.math_applies(*[F.col(c) for c in ("scenario", "numbers", "keywords", "itn_domain", "itn_domains", "reference")])
    normal = lambda made, text: N.math_normal(F.col(made), nfkc=False, events=False) if plain else N.math_normal(F.col(text))
    df = _with(df, {"__math": applies, "__math_ref": normal("__ref_plain", "reference"), "__math_hyp": normal("__hyp_plain", "prediction")})
    df = N.computed(df)
    size = F.char_length("__math_ref")
    error = F.when(size > 0, F.levenshtein("__math_ref", "__math_hyp") / size).otherwise(F.when(F.col("__math_hyp") == "", 0.0).otherwise(1.0))
    df = _with(df, {"math_formula_itn_evaluation": F.when(F.col("__math"), "scored").otherwise("not_applicable"), "math_normalized_error_rate": F.when(F.col("__math"), error), "math_normalized_reference": F.when(F.col("__math"), F.col("__math_ref")), "math_normalized_prediction": F.when(F.col("__math"), F.col("__math_hyp"))})
    df = N.computed(df)
    df = _with(df, {"math_itn_format_gap": F.when(F.col("__math"), F.greatest(F.lit(0.0), F.col("primary_error_rate") - F.col("math_normalized_error_rate")))})
    score = 10.0 * (1.0 - F.least(F.lit(1.0), F.col("math_itn_format_gap") / 0.2))
    return _with(df, {"math_itn_format_score_10": F.when(F.col("__math"), score)})


def _with_variants(raw: DataFrame, to_simplified, nfkc: bool) -> DataFrame:
    """raw plus the scores of changed texts. They are measured within each row, so that neither repeated nor null case ids
    can mix cases; texts that a change leaves as they are have the case's own scores; texts are null where a variant does
    not apply."""
    groups = X.alias_groups(F.coalesce(F.col("alias_groups"), _none("array<array<string>>")))
    japanese, cantonese = F.col("language").eqNullSafe("ja"), F.col("language").eqNullSafe("yue")
    bare = lambda c: X.strip_furigana(F.col(c))
    made = {
        "furigana": (japanese, bare),
        "alias": (japanese & (F.size("__groups") > 0), lambda c: X.fold_aliases(bare(c), F.col("__groups"))),
        "script": (cantonese, lambda c: to_simplified(F.col(c))),
    }
    out = raw.select(*[F.col(f"`{c}`") for c in raw.columns if not c.startswith("__") or c in ("__terms", "__listed")], groups.alias("__groups"))
    for name, (applies, change) in made.items():
        if name == "script" and to_simplified is None:
            out = _with(out, {f"__{name}_{c}": F.lit(None).cast("double") for c in VARIANT_SCORES})
            continue
        texts = ("reference", "prediction")
        held = applies & F.col("reference").isNotNull() & F.col("prediction").isNotNull()
        out = N.computed(_with(out, {f"__{name}_made_{c}": F.when(held, change(c)) for c in texts}))
        same = F.lit(True)
        for c in texts:
            same = same & F.col(f"__{name}_made_{c}").eqNullSafe(F.col(c))
        out = _with(out, {f"__{name}_same": same, f"__{name}_held": held})
        out = _with(out, {f"__{name}_{c}": F.when(~F.col(f"__{name}_same"), F.col(f"__{name}_made_{c}")) for c in texts})
        out = measured(N.computed(out), nfkc, f"__{name}_")
        out = _with(out, {f"__{name}_{c}": F.when(F.col(f"__{name}_held"), F.when(F.col(f"__{name}_same"), F.col(c)).otherwise(F.col(f"__{name}_{c}"))) for c in VARIANT_SCORES})
    gain = lambda v: F.col(f"__{v}_text_score_90") - F.col("text_score_90")
    weighed = lambda v: F.col(f"__{v}_text_score_90") * F.col("effective_weight")
    available = "opencc_t2s" if to_simplified is not None else "unavailable_opencc_t2s"
    folds = F.when(japanese, F.size("__groups")).otherwise(0)
    out = _with(out, {
        "script_normalization": F.when(cantonese, available).otherwise("not_applicable"),
        "script_normalized_primary_error_rate": F.col("__script_primary_error_rate"), "script_normalized_text_score_90": F.col("__script_text_score_90"),
        "script_normalized_weighted_text_score_90": weighed("script"), "script_normalized_delta_text_score_90": gain("script"),
        "japanese_text_normalization": F.when(~japanese, "not_applicable").when(folds > 0, "furigana_and_orthographic_aliases").otherwise("furigana_only"),
        "japanese_furigana_stripped_primary_error_rate": F.col("__furigana_primary_error_rate"), "japanese_furigana_stripped_text_score_90": F.col("__furigana_text_score_90"),
        "japanese_furigana_stripped_delta_text_score_90": gain("furigana"),
        "japanese_orthographic_alias_primary_error_rate": F.col("__alias_primary_error_rate"), "japanese_orthographic_alias_text_score_90": F.col("__alias_text_score_90"),
        "japanese_orthographic_alias_weighted_text_score_90": weighed("alias"), "japanese_orthographic_alias_delta_text_score_90": gain("alias"),
        "japanese_orthographic_alias_group_count": folds,
    })
    return out.select(*[F.col(c) for c in out.columns if not c.startswith("__") and c not in ("metric",)])
