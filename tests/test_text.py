"""Quality rules, tags and cleaning on hand-made edge cases."""

import pytest
from conftest import fails
from pyspark.sql import functions as F

from vectext.functions import text as tx
from vectext.operators import corpus as cp

T = F.col("t")


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def many(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


# ------------------------------------------------------------------ quality rules


def words(n):
    return " ".join(["word"] * n)


def test_score_floor(spark):
    got = many(spark, [None, "abc", "0.95", "0.9499", "1", " 0.96 "], tx.score_ok(T, 0.95))
    assert got == [False, False, True, False, True, True]
    assert many(spark, [None, "0.1"], tx.score_ok(T, None)) == [True, True]
    assert many(spark, [None, "abc", "0.95", "1"], tx.score_text(T)) == [None, None, "0.9500", "1.0000"]


def reason(spark, text, score="1", **rules):
    df = spark.createDataFrame([(text, score)], "text string, score string")
    return cp.with_reject_reason(df, tx.QualityRules(**rules)).first()["reject_reason"]


def test_first_failing_rule(spark):
    fits = (words(240) + " ").ljust(1300, "x")
    assert reason(spark, None) == "not_text"
    assert reason(spark, fits, None) == "low_score"
    assert reason(spark, fits, None, score_min=None) is None
    assert reason(spark, "short") == "length"
    assert reason(spark, fits + " Add To CART") == "bad_pattern"
    assert reason(spark, fits + " zebra", extra_patterns=["ZEB+RA"]) == "bad_pattern"
    assert reason(spark, "1 " * 700) == "few_words"


@pytest.mark.parametrize("size, ok", [(1199, False), (1200, True), (20000, True), (20001, False)])
def test_length_band(spark, size, ok):
    text = (words(239) + " ").ljust(size, "x") if size > 1195 else ""
    assert (reason(spark, text[:size]) is None) == ok


@pytest.mark.parametrize("n, ok", [(219, False), (220, True)])
def test_word_floor(spark, n, ok):
    assert (reason(spark, words(n), min_chars=1) is None) == ok


def test_bad_patterns(spark):
    texts = ["Free  shipping", "FREE SHIPPING", "écart", "a cart.", "skull", "SKU", "cookie policy", "cooKie policy", "email@example.com", "emailxexample.com"]
    assert many(spark, texts, tx.has_bad_pattern(T)) == [False, True, False, True, False, True, True, True, True, False]


def test_bullets(spark):
    lines = "- a\n* b\n• c\n1. x\n2) y\n3.\n z\n  -q\n4.x\n\n5.  \n 6. ok - last"
    assert one(spark, lines, tx.line_count(T)) == 12
    assert one(spark, lines, tx.bullet_count(T)) == 8
    nineteen = "\n".join(["- a"] * 19)
    assert one(spark, nineteen, tx.bullet_share(T)) is None
    assert one(spark, nineteen + "\nplain", tx.bullet_share(T)) == pytest.approx(0.95)
    assert reason(spark, "\n".join(["- " + words(12)] * 9 + [words(12)] * 11)) is None  # exactly 0.45
    assert reason(spark, "\n".join(["- " + words(12)] * 10 + [words(12)] * 10)) == "bullets"


def test_prefix_key(spark):
    a = "x" * 499
    keys = many(spark, [a + "A tail", a + "a other", a + "b tail", "A  B\n C", "a b c"], tx.prefix_key(T))
    assert keys[0] == keys[1] and keys[0] != keys[2]
    assert keys[3] == keys[4]


# ----------------------------------------------------------------- tags, templates


def test_extract(spark):
    texts = [
        "none", "<explanation> open only", "</explanation> a <explanation>", "<explanation>\n a\nb \n</explanation> rest",
        "x <explanation>one</explanation> <explanation>two</explanation>", "<explanation></explanation>", None,
    ]
    assert many(spark, texts, tx.extract_explanation(T)) == [None, None, None, "a\nb", "one", "", None]
    assert many(spark, texts, tx.extract_or_all(T)) == [
        "none", "<explanation> open only", "", "a\nb", "one", "", None,
    ]


def test_wrap_round_trip(spark):
    assert one(spark, "a\n\nb", tx.extract_explanation(tx.wrap_explanation(T))) == "a\n\nb"


def test_template(spark):
    made = tx.fill_template("<t>{explanation}</t> end", T)
    assert one(spark, "a $1 {x}", made) == "<t>a $1 {x}</t> end"
    assert many(spark, ["", "payload"], tx.unwrap_template(made, "<t>{explanation}</t> end")) == ["", "payload"]
    df = spark.createDataFrame([("<t>a</t> other",)], "t string")
    fails(df.select(tx.unwrap_template(T, "<t>{explanation}</t> end")), "does not fit the template")
    fails(df.select(tx.unwrap_template(T, "<u>{explanation}</t> other")), "does not fit the template")
    with pytest.raises(ValueError):
        tx.fill_template("no slot", T)


def test_truncate_note(spark):
    assert many(spark, ["abc", "abcd"], tx.truncate_note(T, 3)) == ["abc", "abc\n\n[... TRUNCATED: 1 more chars ...]"]


# ------------------------------------------------------------------------ cleaning


def tagged(body):
    return f"<analysis>\n{body}\n</analysis>"


CASES = [
    ("no tags", "plain text", None, 0),
    ("unclosed tag", "<analysis>\na\n\nb", None, 0),
    ("empty tag", "<analysis></analysis>", "", 1),
    ("two closing tags", tagged("a\n\nb") + " c</analysis>", "a\n\nb", 2),
    ("plain paragraphs", tagged("first one\n\nsecond one"), "first one\n\nsecond one", 2),
    ("list marks", tagged("- a1\n* b1\n– c1\n— d1\n+ e1\n• f1"), "a1\n\nb1\n\nc1\n\nd1\n\ne1\n\nf1", 6),
    ("numbers", tagged("1. a1\n2) b1\n(3) c1\nIV. d1\n(x) e1\nb) f1"), "a1\n\nb1\n\nc1\n\nd1\n\ne1\n\nf1", 6),
    ("roman in brackets stays", tagged("(iii) a1\nb1"), "(iii) a1\n\nb1", 2),
    ("bold header", tagged("**Header:** text here\n\n**All bold**"), "Header: text here\n\nAll bold", 2),
    ("other line ends inside a line", tagged("**a\u2028b** c\n\n**x\ry** z"), "a\u2028b c\n\nx\ry z", 2),
    ("trailing marks", tagged("*one*\n\n_two_"), "one\n\ntwo", 2),
    ("only marks", tagged("**"), "", 1),
    ("inline header", tagged("First: a. Second: b. Final token: c."), "First: a.\n\nSecond: b.\n\nFinal token: c.", 3),
    ("inline header, other case", tagged("one two SEMANTIC EXPECTATION : three"), "one two\n\nSEMANTIC EXPECTATION : three", 2),
    ("ordinals", tagged("It opens, Second, it goes on, finally, it ends"), "It opens,\n\nSecond, it goes on,\n\nfinally, it ends", 3),
    ("final phrase", tagged("Starts here. The final word is x"), "Starts here.\n\nThe final word is x", 2),
    ("one sentence", tagged("Just one sentence."), "Just one sentence.", 1),
    ("two sentences", tagged("One here. Two there."), "One here.\n\nTwo there.", 2),
    ("three sentences", tagged('One! "Two"? `Three`.'), 'One!\n\n"Two"?\n\n`Three`.', 3),
    ("no cut before small letters", tagged("e.g. this one. and that"), "e.g. this one. and that", 1),
]


@pytest.mark.parametrize("raw, cleaned, features", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_cleaning(spark, raw, cleaned, features):
    assert one(spark, raw, tx.clean_explanation(T)) == cleaned
    assert one(spark, raw, tx.feature_count(tx.clean_explanation(T))) == features


def test_cleaning_of_null(spark):
    assert one(spark, None, tx.clean_explanation(T)) is None


def test_custom_pattern(spark):
    got = one(spark, "<out>a\n\nb</out>", tx.clean_explanation(T, r"<out>\s*(.*?)\s*</out>"))
    assert got == "a\n\nb"
