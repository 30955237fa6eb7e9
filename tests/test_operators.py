import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scribegauge import queries, sources
from scribegauge.functions import tokens as T
from scribegauge.operators import aggregate, audit, cases, runs, scores, segments
from scribegauge.plans import report
from scribegauge.sources import sinks

CASE = "case_id string, scenario string, language string, priority string, weight double, primary_error_metric string, status string, review_level string, punctuation string, keywords array<string>, numbers array<string>, hotwords array<string>, alias_groups array<array<string>>, itn_domain string, itn_domains array<string>, reference string, prediction string"


@pytest.fixture(scope="module")
def some(spark):
    rows = [
        ("c1", "s1", "ja", "p", 2.0, "cer", "ready", "user_confirmed_real_audio", "normal", ["制度"], ["三"], ["制度"], [["春", "ハル"]], None, None, "制度（せいど）は春三つ。", "制度はハル三つ。"),
        ("c2", "student_lecture", "zh", "p", 1.0, "hybrid_ter", "ready", "auto_screened_public_subtitle", "none", [], ["88"], [], None, None, None, "八十八拆成八乘十一 88", "88拆成8×11 87"),
        ("c3", "s1", "yue", "p", 1.0, "cer", "ready", "auto_screened_public_subtitle", None, [], [], None, None, None, None, "漢語", "汉语"),
        ("c4", "s1", "en", "p", 1.0, "wer", "ready", None, None, ["fox"], ["12%"], ["Fox", "dog", "cat"], None, None, None, "the quick fox, 12% of dogs cat", "the quick fox 12% dogs"),
        ("c5", "s1", "en", "p", 1.0, "wer", "deferred", None, None, [], [], None, None, None, None, None, None),
        ("c6", "s1", "en", "p", 1.0, "wer", "ready", "user_confirmed_real_audio", None, [], [], None, None, None, None, "x", None),
    ]
    return spark.createDataFrame(rows, CASE)


def test_records(some):
    found = {r["case_id"]: r for r in scores.score_cases(some.where("prediction is not null"), "with_hotwords", to_simplified=lambda c: F.translate(c, "漢語", "汉语")).collect()}
    one = found["c1"]
    assert one["effective_weight"] == 6.0 and one["japanese_orthographic_alias_primary_error_rate"] == 0.0 and one["japanese_text_normalization"] == "furigana_and_orthographic_aliases"
    assert one["japanese_furigana_stripped_delta_text_score_90"] == pytest.approx(one["japanese_furigana_stripped_text_score_90"] - one["text_score_90"])
    assert found["c2"]["math_formula_itn_evaluation"] == "scored" and found["c2"]["punctuation_f1"] == 1.0 and found["c2"]["number_f1"] == 1.0
    assert found["c3"]["script_normalized_primary_error_rate"] == 0.0 and found["c3"]["primary_error_rate"] == 1.0 and found["c3"]["math_itn_format_score_10"] is None
    four = found["c4"]
    assert four["hotword_missing_terms"] == ["cat"] and four["hotword_recall"] == pytest.approx(2 / 3) and four["context_term_total"] == 3
    assert four["keyword_f1"] == 1.0 and four["term_prompt_mechanism"] == "prompt_context_terms" and four["primary_error_rate"] == pytest.approx(2 / 7)


def test_score_of_components(values):
    got = values([(0.25, 0.5, 1.0, 1.0, 1.0)], "a double, b double, c double, d double, e double", scores.text_score_90(*[F.col(x) for x in "abcde"]))
    assert got == [70.0]


def test_near_miss_counts_in_part(spark):
    df = spark.createDataFrame([("共12345元", "共12346元", ["12345"])], "reference string, prediction string, numbers array<string>").withColumns({"__ref": F.col("reference"), "__hyp": F.col("prediction")})
    row = scores.with_number_scores(df).first()
    assert 0.7 < row["number_f1"] < 0.999 and row["reference_numbers"] == ["12345"] and row["prediction_numbers"] == []


def test_report(some):
    made = report(some.where("reference is not null or case_id = 'c5'"), "benchmark")
    assert {(r["case_id"], r["reason"]) for r in made.skipped.collect()} == {("c4", "outside_scope_benchmark"), ("c5", "outside_scope_benchmark"), ("c6", "prediction_missing")}
    rows = made.records.collect()
    total = sum(r["effective_weight"] for r in rows)
    whole = made.overall.first()
    assert whole["weighted_text_score_90"] == pytest.approx(sum(r["weighted_text_score_90"] for r in rows) / total)
    parts = made.by_scenario.collect()
    assert whole["weighted_text_score_90"] == pytest.approx(sum(p["weighted_text_score_90"] * p["weight"] for p in parts) / sum(p["weight"] for p in parts))
    assert whole["japanese_orthographic_alias_case_count"] == 1 and whole["script_normalized_case_count"] == 0
    assert json.loads(sinks.report_document(made.overall, made.by_scenario).first()["document"])["by_scenario"].keys() == {"s1", "student_lecture"}


def test_empty_input(some):
    row = aggregate.overall(scores.score_cases(some.where("false"))).first()
    assert row["case_count"] == 0 and row["weighted_text_score_90"] is None and row["weighted_hotword_f1"] is None


def test_labels(values):
    assert values([(x,) for x in (29.9, 30.0, 60.0, 180.0, 600.0, 1200.0, 2700.0, 5400.0, 9000.0, 16200.0, None)], "v double", cases.duration_bucket(F.col("v"))) == ["<30s", "30-60s", "60-180s", "3-10m", "10-20m", "20-45m", "45-90m", "90-150m", "3.5-4.5h", ">4.5h", "unknown"]
    assert values([("zh-en",), ("ja",), ("fr",), ("auto",)], "v string", *[cases.language_hint(F.col("v"), s) for s in ("code_or_null", "zh_en_only", "code_or_auto", "name", "locale", "code_or_self")]) == [("zh", "zh", "zh", "auto", "zh-CN", "zh"), ("ja", None, "ja", "日文", "ja-JP", "ja"), (None, None, "auto", "auto", "en-US", "fr"), (None, None, "auto", "auto", "en-US", None)]
    assert values([("auto", 1200.0), ("auto", None), ("single_pass", 9e9)], "r string, d double", cases.route(F.col("r"), F.col("d"))) == ["vad_chunked", "single_pass", "single_pass"]
    with pytest.raises(ValueError):
        cases.in_scope("some", F.col("a"), F.col("b"))


def test_segment_plans():
    assert segments.plan_by_silence(400, []) == [0, 120, 240, 400]
    assert segments.plan_by_silence(400, [102, 131]) == [0, 131, 251, 400]
    assert segments.plan_by_silence(0, []) == [0]
    with pytest.raises(ValueError):
        segments.plan_by_silence(10, [], target=5, least=6)
    rng = np.random.default_rng(0)
    for _ in range(50):
        length = float(rng.uniform(1, 3000))
        bounds = segments.plan_by_silence(length, sorted(rng.uniform(0, length, 40)))
        assert bounds[0] == 0 and bounds[-1] == length and all(a < b for a, b in zip(bounds, bounds[1:], strict=False))
        speech = segments.plan_by_speech(int(length), sorted(rng.integers(0, int(length) + 1, 20).tolist()), 120, 180, 20)
        assert speech[0] == 0 and speech[-1] == int(length) and all(b - a <= 200 for a, b in zip(speech, speech[1:], strict=False))


def test_merge():
    assert segments.merged(["well the quick brown fox", "The quick  brown fox jumps", "", None or ""]) == "well the quick brown fox\njumps"
    assert segments.trimmed("abc", "abc") == "abc"
    assert segments.trimmed("x" * 12, "x" * 12 + " tail") == "tail"


def test_silences(spark):
    lines = ["silence_end: 1", "silence_start: 2.5", "silence_start: 3.0", "silence_end: 4.5 | x", "silence_end: 9"]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "audio_id string, line_no int, line string")
    assert [tuple(r) for r in segments.silences(df).collect()] == [("a", 3.0, 4.5)]


def test_transcribe_records_errors(spark):
    def fails(rows: pd.DataFrame) -> list[str]:
        if rows["case_id"].iloc[0] == "b":
            raise RuntimeError("no")
        return ["text"]

    audio = spark.createDataFrame([("a", "x", 2.0), ("b", "y", 0.0)], "case_id string, audio_path string, duration_sec double")
    found = {r["case_id"]: r for r in runs.transcribe(audio, fails).collect()}
    assert found["a"]["text"] == "text" and found["a"]["rtf"] > 0 and "no" in found["b"]["error"] and found["b"]["rtf"] is None


def test_violations(spark):
    found = [tuple(r) for r in queries.manifest_violations(spark, "").collect()]
    assert (0, "a", "unmarked_punctuation", "warning") in found and len([f for f in found if f[0] == 0]) == 1
    assert {f[2] for f in found if f[0] == 1} == {"case_id_unique", "metric", "weight", "unmarked_punctuation"}
    assert {"required_fields", "reference", "segment_start", "keywords"} <= {f[2] for f in found if f[0] == 2}
    bad = spark.createDataFrame([("other", 1.0), ("odd", 1.0), ("ready_reference", -1.0)], "tier string, multiplier double")
    assert audit.policy_violations(bad).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    case = {"case_id": "a", "language": "ja", "scenario": "s", "primary_error_metric": "cer", "weight": 1, "reference": {"status": "ready", "review_level": "user_confirmed_real_audio", "path": "data/benchmark_references/a.ref.txt"}, "keywords": [], "numbers": [], "orthographic_aliases": [{"canonical": "春", "aliases": ["ハル"]}, ["x", "y"]], "segment": {"start_sec": 0, "end_sec": 5}}
    (tmp_path / "m.json").write_text(json.dumps({"cases": [case, {"case_id": "b", "hotwords": []}]}))
    for folder, name, text in (("refs", "a.ref.txt", " 春\n"), ("preds", "a.txt", "ハル　")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(text)
    whole = sources.read_manifest(spark, str(tmp_path / "m.json"))
    rows = sources.manifest_cases(whole).orderBy("position").collect()
    assert rows[0]["alias_groups"] == [["春", "ハル"], ["x", "y"]] and rows[1]["hotwords"] == [] and rows[0]["hotwords"] is None
    from scribegauge.plans import profile, score_folder

    made = score_folder(spark, str(tmp_path / "m.json"), str(tmp_path / "refs"), str(tmp_path / "preds"))
    assert made.records.first()["japanese_orthographic_alias_primary_error_rate"] == 0.0
    assert profile(sources.manifest_cases(whole).withColumn("duration_sec", F.col("duration_sec"))).count() > 0
    sinks.write_report(str(tmp_path / "out"), made.records, made.overall, made.by_scenario, made.skipped)
    assert spark.read.json(str(tmp_path / "out/cases")).count() == 1
    assert sources.raw_cases(spark, str(tmp_path / "m.json")).count() == 2
    assert sources.folder_bytes(spark, str(tmp_path / "refs")).first()["bytes"] == len(" 春\n".encode())
    sinks.write_tsv(cases.weight_list(sources.manifest_cases(whole)).select("case_id", "effective_weight"), str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).first()["effective_weight"] == "3.00"


def test_wav(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[16384, 0]] * 4000, "<i2").tobytes())
    row = sources.read_wav(spark, str(tmp_path)).first()
    assert row["duration_sec"] == 0.5 and row["samples"][0] == 0.25


def test_stream(spark, tmp_path):
    from scribegauge import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"case_id":"a","text":"hello world","arrived":"2024-01-01T00:00:00Z"}\n')
    known = spark.createDataFrame([("a", "hello there", "wer", [], [], None, "s", 2.0)], "case_id string, reference string, metric string, keywords array<string>, numbers array<string>, punctuation string, scenario string, effective_weight double")
    stream = streaming.arriving(spark, str(tmp_path / "in"))
    query = streaming.score_to(stream, known, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["primary_error_rate"] == 0.5
    running = streaming.running_means(streaming.scored(stream, known)).writeStream.format("memory").queryName("means").outputMode("complete").start()
    running.processAllAvailable()
    assert spark.sql("select * from means").first()["n"] == 1
    running.stop()


def test_entry_without_the_llm_folders(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_variants_of_repeated_and_null_case_ids(spark):
    """Neither repeated nor null ids mix cases; terms and texts are both brought to NFKC."""
    none = F.lit(None)
    rows = [("a", "ja", "漢字（かんじ）です", "漢字です", ["ＡＢＣ"]), ("a", "ja", "x y", "q", None), (None, "ja", "漢字（かんじ）", "漢字", None), ("b", "en", "see ＡＢＣ入門", "ABC入門", ["ＡＢＣ"])]
    df = spark.createDataFrame(rows, "case_id string, language string, reference string, prediction string, keywords array<string>")
    fixed = {"scenario": F.lit("s"), "priority": F.lit("p"), "weight": F.lit(1.0), "primary_error_metric": F.lit("cer"), "status": F.lit("ready"), "punctuation": F.lit("normal")}
    fixed |= {c: none.cast("string") for c in ("review_level", "itn_domain")} | {c: none.cast("array<string>") for c in ("numbers", "hotwords", "itn_domains")}
    found = scores.score_cases(df.withColumns(fixed | {"alias_groups": none.cast("array<array<string>>")})).collect()
    assert [(r["case_id"], r["japanese_furigana_stripped_primary_error_rate"]) for r in found] == [("a", 0.0), ("a", 1.0), (None, 0.0), ("b", None)]
    assert [r["keyword_total"] for r in found] == [0, 0, 0, 1] and found[3]["keyword_f1"] == 1.0


def test_distances_of_many_distinct_tokens(values):
    a, b = [f"t{i}" for i in range(3000)], [f"t{i}" for i in range(0, 3000, 2)] + ["u"]
    assert values([(a, b)], "a array<string>, b array<string>", T.token_distance(F.col("a"), F.col("b"))) == [1500]
    assert values([("a é b", "aéc")], "a string, b string", T.character_distance(F.col("a"), F.col("b"))) == [1]


def test_rollup_tells_levels_from_nulls(spark):
    df = spark.createDataFrame([(None, 1.0, 50.0), ("en", 1.0, 70.0)], "language string, effective_weight double, text_score_90 double")
    assert {(r["level"], r["language"], r["case_count"]) for r in aggregate.rollup(df, "language").collect()} == {(0, None, 1), (0, "en", 1), (1, None, 2)}


def test_manifests_as_a_whole(spark):
    cases, weights = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("a", 0.5), ("b", 0.5)], "scenario string, weight double")
    broken = lambda c, w: {r["rule"] for r in audit.manifest_violations(c, w).collect()}
    assert broken(cases, weights) == set() and broken(cases, weights.where("false")) == set()
    assert broken(cases.where("false"), weights.where("scenario = 'a'")) == {"cases", "scenario_weights"}


def test_run_and_audio_manifests_come_back(spark, tmp_path):
    head = spark.createDataFrame([("r1", "m", 2), ("r2", "n", 0)], "run_id string, model string, case_count long")
    held = spark.createDataFrame([("r1", "b", 2.0, 1.0, None), ("r1", "a", 4.0, 1.0, "x")], "run_id string, case_id string, duration_sec double, infer_sec double, error string")
    sinks.write_run_metrics(head, held, str(tmp_path / "runs"))
    runs_read, cases_read = sources.read_runs(spark, str(tmp_path / "runs"))
    assert sorted((r["model"], r["case_count"]) for r in runs_read.collect()) == [("m", 2), ("n", 0)]
    assert [(r["case_id"], r["duration_sec"], r["error"]) for r in cases_read.collect()] == [("a", 4.0, "x"), ("b", 2.0, None)]
    listed = spark.createDataFrame([("b", "ja", 0.0, 1.0, 3.5, None), ("a", "en", 2.0, None, None, ["w"])], "case_id string, language string, duration_sec double, start_sec double, end_sec double, hotwords array<string>")
    sinks.write_audio_manifest(cases.clips(listed, "/audio/"), str(tmp_path / "audio"), "m.json", "/audio")
    back = sources.read_audio_manifest(spark, str(tmp_path / "audio")).orderBy("position").collect()
    assert [(r["case_id"], r["audio_path"], r["duration_sec"], r["hotwords"]) for r in back] == [("a", "/audio/a.wav", 2.0, ["w"]), ("b", "/audio/b.wav", 2.5, [])]


def test_named_texts(spark):
    from scribegauge.functions.text import named_text

    outputs = ['"plain"', '{"text": "", "result": "r"}', '{"transcription": "t", "text": 3}', '[{"text": "a"}, "", "b", {"result": "c"}]', "not json", '{"other": 1}', None, "[]"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(outputs)], "i int, o string").select("i", named_text(F.col("o")).alias("first"), named_text(F.col("o"), ("text", "result", "transcription"), False).alias("filled")).orderBy("i").collect()
    assert [r["first"] for r in rows] == ["plain", "", "t", "a b c", "not json", '{"other": 1}', None, ""]
    assert [r["filled"] for r in rows] == ["plain", "r", "t", "a b c", "not json", '{"other": 1}', None, ""]


def test_wav_widths_and_rates(spark, tmp_path):
    import wave

    values = [0.0, 0.5, -0.5]
    for width in (1, 2, 3, 4):
        raw = b"".join((int(v * 128) + 128).to_bytes(1, "little") if width == 1 else int(v * 2 ** (8 * width - 1)).to_bytes(width, "little", signed=True) for v in values)
        with wave.open(str(tmp_path / f"w{width}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(16000)
            w.writeframes(raw)
    found = sources.read_wav(spark, str(tmp_path), sample_rate=16000).collect()
    assert len(found) == 4 and all(r["samples"] == values for r in found)
    assert all(r["duration_sec"] == 3 / 16000 for r in sources.wav_durations(spark, str(tmp_path)).collect())
    with pytest.raises(Exception, match="16000 samples a second, not 8000"):
        sources.read_wav(spark, str(tmp_path), sample_rate=8000).collect()


def test_records_compute_each_text_once(spark, small):
    """Expressions that Spark puts into all that uses them make plans that grow by powers: numbers are extracted from a
    reference and a prediction of three kinds, and read from the targets, once each; no column is computed by a huge expression."""
    plan = queries.score_records(spark, small)._jdf.queryExecution().optimizedPlan()
    nodes, sizes, extracted = [plan], [], 0
    while nodes:
        node = nodes.pop()
        made = [node.expressions().apply(i).sql() for i in range(node.expressions().size())]
        sizes += map(len, made)
        extracted += sum(m.count("[一二三四五六七八九十百千万亿零〇两点]+") for m in made)
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert extracted == 7 and max(sizes) < 30_000


def test_repetition_of_many_tokens(values):
    """One slice for each of n copies, not for each gram: 200,000 tokens would take 40 thousand million steps."""
    tokens = [str(i % 50_000) for i in range(200_000)]
    assert values([(tokens,)], "a array<string>", T.repetition_rate(F.col("a"))) == [pytest.approx((199_997 - 50_000) / 199_997)]


def test_texts_that_a_variant_changes_are_scored_anew(spark):
    """A change of one text of a pair, or of none: the variant's scores are those of the changed pair, or the case's own."""
    texts = [("the cat sat (あ)", "the cat sat"), ("the cat", "that cat"), ("a dog", "a dig"), ("", "x"), (None, "x")]
    rows = [(str(i), "s", "ja", "p", 1.0, "cer", "ready", None, "normal", ["cat"], ["12"], ["cat"], [["the", "that"]], None, None, a, b) for i, (a, b) in enumerate(texts)]
    found = {r["case_id"]: r for r in scores.score_cases(spark.createDataFrame(rows, CASE)).collect()}
    rates = lambda name: [found[str(i)][name] and round(found[str(i)][name], 6) for i in range(5)]
    assert rates("japanese_furigana_stripped_primary_error_rate") == [0.0, round(2 / 6, 6), 0.25, 1.0, None]
    assert rates("japanese_orthographic_alias_primary_error_rate") == [0.0, 0.0, 0.25, 1.0, None]
    assert found["2"]["japanese_orthographic_alias_text_score_90"] == found["2"]["text_score_90"] and found["1"]["japanese_orthographic_alias_delta_text_score_90"] > 0
