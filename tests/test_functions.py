import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribegauge.functions import numbers as N
from scribegauge.functions import text as X
from scribegauge.functions import tokens as T
from scribegauge.operators import scores as S

t = None


@pytest.fixture(autouse=True)
def _column(spark):
    global t
    t = F.col("t")


def column(values, texts, expression, schema="t string"):
    return values([(x,) for x in texts], schema, expression)


def test_tokens(values):
    assert column(values, ["Don't stop", "1,000 items", "COVID-19 3rd well-known", ""], T.words(X.normalize(t))) == [["don", "t", "stop"], ["1", "000", "items"], ["covid", "19", "3rd", "well-known"], []]
    assert column(values, ["用GPT-4o跑3rd 12.5%"], T.hybrid(X.normalize(t))) == [["用", "gpt", "4", "o", "跑", "3rd", "12.5%"]]
    assert column(values, ["你好，世界", "v1.5", " "], T.characters(X.normalize(t))) == [list("你好世界"), list("v1.5"), []]


def test_normalize(values):
    texts = ["[noise] Ａbc　 x", "［全角］ok", "a—b_c", None]
    assert column(values, texts, X.normalize(t)) == ["abc x", "全角 ok", "a b_c", None]


def test_numbers(values):
    from scribegauge.queries import NUMBER_VECTORS

    assert column(values, [a for a, _ in NUMBER_VECTORS], N.number_token(t)) == [b for _, b in NUMBER_VECTORS]
    assert column(values, ["2万亿", "三、二、一", "点", "用了３５个", "9" * 30 + "一" * 30], N.extract_numbers(t)) == [["20000", "100000000"], ["321"], [], ["35"], ["9" * 30, "1" * 30]]


def test_math(values):
    assert column(values, ["八十八拆成八乘十一", "88拆成8×11", "三加上四减去一除以二", "再乘以三"], N.math_normal(t)) == ["88拆成8×11", "88拆成8×11", "3+4-1÷2", "再×3"]


def test_text_steps(values):
    assert column(values, ["制度（せいど）", "a(かな b)", "(カナ)"], X.strip_furigana(t)) == ["制度", "a(かな b)", ""]
    assert values([("春とハル", [["Haru", "春", "ハル"]]), ("ab", [["x", "a"], ["y", "xb"]])], "t string, g array<array<string>>", X.fold_aliases(t, F.col("g"))) == ["HaruとHaru", "y"]
    assert column(values, [3661.5, 59.9996], X.timestamp_label(t), "t double") == ["01:01:01,500", "00:00:60,000"]
    assert column(values, ["a" * 21, "a" * 20, "xyz" * 30 + "q" * 10], X.clean_repeats(t)) == ["a", "a" * 20, "xyz" + "q" * 10]
    assert column(values, ["see https://a.b/c,d now", "v1.2.3 x", "ok, go", "3,5"], X.has_sentence_marks(t)) == [False, False, True, False]
    assert column(values, ['{"text":" hi "}', '{"segments":[{"text":"a"},{"text":" b "}]}', "plain"], X.output_text(t)) == ["hi", "a b", "plain"]
    assert values([("p", ["a", " "]), (None, None)], "s string, w array<string>", X.prompt(F.col("s"), F.col("w"), "run")) == ["p\n" + X.TERM_SENTENCES["run"] + "a。", None]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_token_distance_is_an_edit_distance(values):
    rng = random.Random(1)
    rows = [([rng.choice("abcde") * 2 for _ in range(rng.randrange(12))], [rng.choice("abcde") * 2 for _ in range(rng.randrange(12))]) for _ in range(60)]
    found = values(rows, "a array<string>, b array<string>", F.col("a"), F.col("b"), T.token_distance(F.col("a"), F.col("b")))
    assert all(d == distance(a, b) for a, b, d in found)
    rates = values([([], []), ([], ["x"]), (["a", "b"], ["a"])], "a array<string>, b array<string>", T.error_rate(F.col("a"), F.col("b"), T.token_distance(F.col("a"), F.col("b"))))
    assert rates == [0.0, 1.0, 0.5]


def test_repetition_and_hallucination(values):
    rows = [(list("abcdabcd"), list("abcdabcd")), (list("abcdefghij"), list("abcde")), (list("abcdefghij"), list("abcdefghijklmnopqrstuvw")), ([], [str(i) for i in range(25)]), ([], [])]
    made = S.hallucination(F.col("a"), F.col("b"))
    found = values(rows, "a array<string>, b array<string>", *[F.round(made[c], 4) for c in ("repetition_rate", "length_ratio", "length_score", "hallucination_score")])
    assert found == [(0.2, 1.0, 1.0, 1.0), (0.0, 0.5, 0.8333, 0.8917), (0.0, 2.3, 0.5, 0.675), (0.0, float("inf"), 0.5, 0.675), (0.0, 1.0, 1.0, 1.0)]


def test_multiset_scores(values):
    assert values([(["a", "a", "b"], ["a", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>", *T.multiset_scores(F.col("a"), F.col("b"))) == [(0.5, 1 / 3, 0.4), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]
    assert column(values, ["a, b. 3,5 你好。?"], T.sentence_marks(t)) == [[",", ".", "。", "?"]]


@settings(max_examples=50, deadline=None)
@given(st.text("abAB ", max_size=30), st.integers(2, 5))
def test_collapsed_periods_hold_no_long_stretch(text, threshold):
    done = X.collapse_periods(text, threshold, 3)
    assert len(done) <= len(text) and X.collapse_periods("", threshold, 3) == ""


def test_substring_similarity():
    assert N.substring_similarity("abc", "xxabcxx") == 1.0
    assert N.substring_similarity("", "a") == 0.0
    assert N.substring_similarity("abcd", "xabxdx") == pytest.approx(0.75)
