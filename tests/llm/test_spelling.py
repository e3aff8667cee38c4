"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vectext.llm import spelling


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def plain_words(rows, least_length=6, least_count=5, slip=199):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least_length and n >= least_count}


def plain(words, times=5):
    found = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(found[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def varied(rnd, base, alphabet):
    word = base
    for _ in range(rnd.choice((1, 1, 2, 3))):
        k, c = rnd.randrange(len(word) + 1), rnd.choice(alphabet)
        word = rnd.choice((word[:k] + c + word[k:], word[:k] + word[k + 1:], word[:k] + c + word[k + 1:]))
    return word


@pytest.mark.parametrize("block, pairs", [(1024, 1 << 17), (3, 7)])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghéÿ中\U0001f600"])
def test_near_words_against_all_pairs(spark, block, pairs, alphabet):
    rnd = random.Random(len(alphabet))
    words = {}
    for _ in range(25):
        base = "".join(rnd.choices(alphabet, k=rnd.randint(2, 14)))
        for w in [base, *(varied(rnd, base, alphabet) for _ in range(12))]:
            if len(w) >= 2:
                words[w] = rnd.choice((5, 5, 30, 200, 9000))
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling.near_words(df, block, pairs).collect()}
    for w in words:
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        assert got.get(w, (0, None, None)) == (len(others), best, words.get(best)), w


TEXTS = ["Straße straße STRASSE", "nothing Nothing nothin nothing, nothings", "été Étéétés étéétés ÉTÉÉTÉS", "under_score under-score", "x×multiply÷ divide7divided", "中文letters中文letters", "\U0001f600"]


def test_variants_against_plain(spark):
    rnd = random.Random(8)
    bases = ["".join(rnd.choices("abcdeé", k=rnd.randint(5, 9))) for _ in range(30)]
    rows = []
    for k in range(300):
        words = [rnd.choice(bases[:3]) if rnd.random() < 0.4 else rnd.choice(bases) for _ in range(rnd.randint(0, 60))]
        words = [varied(rnd, w, "abz") if rnd.random() < 0.15 else w for w in words]
        rows.append((k, rnd.choice((" ", "\n", "1")).join(words).title() if k % 3 else " ".join(words)))
    rows += [(1000 + k, t) for k in range(8) for t in TEXTS]
    rows += [(None, "nullid nullid " * 9), (2000, None), (2001, ""), (3, "repeated row " * 3), (3, "repeated row " * 3), (3001, "x" * 5000 + " " + "longest " * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    df = df.withColumn("word", F.lit(1)).withColumn("n", F.lit(1)).withColumn("_share", F.lit(1))
    got = spelling.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(plain_words(rows))
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[1] for r in want)


@pytest.mark.parametrize("size", [1, 4, 100, 1 << 20])
def test_pieces_of_long_texts(size):
    text = "Ab éàÿŸword WORDS×x, " * 30 + "long" * 40
    got = [r for runs in spelling.runs_of(text, size) for r in runs]
    assert got == [r for runs in spelling.runs_of(text) for r in runs]
    assert got[:4] == ["ab", "éàÿ", "word", "words×x"]


def test_long_text_and_full_memory(spark):
    df = spark.createDataFrame([(1, "Longer words here, longer " * 100_000), (2, " ".join(f"{'abcdefgh'[k % 8]}{'xyzuvw'[k % 6]}words" for k in range(480)))], "doc_id bigint, text string")
    got = {r["word"]: r["n"] for r in spelling.count_words(df, memory_words=3).collect()}
    assert got == plain_words([(r["doc_id"], r["text"]) for r in df.collect()])


def test_chain_of_forms(spark):
    """Forms of forms; ties go to the least word; a form needs enough occurrences."""
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "aaaaac": 25, "qqqqqq": 10, "qqqqqr": 49, "zzzzzz": 7}
    rows = [(k, f"{w} " * n) for k, (w, n) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["word"]: r for r in spelling.spelling_variants(df, slip=None).collect()}
    assert [got["aaaaaa"][c] for c in ("form", "root", "n_near", "form_n")] == ["aaaaab", "aabbbb", 2, 25]
    assert got["qqqqqq"]["form"] is None and got["qqqqqq"]["root"] == "qqqqqq" and got["qqqqqq"]["n_near"] == 1
    assert got["zzzzzz"]["n_near"] == 0


def test_no_pairs_leave_a_task(spark):
    """Many words with one beginning: rows out are words, not pairs."""
    words = [f"prefix{a}{b}" for a in "abcdefghijkl" for b in "abcdefghijkl"]
    frame = pd.DataFrame({"length": 8, "chunk": 0, "gram": "pref", "a": 0, "b": 0, "side": [0] * 144 + [1] * 144, "place": 0, "word": words * 2, "n": 5})
    found = spelling.near_in(frame)
    assert len(found) == 144 and found["n_near"].tolist() == [22] * 144


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.spelling_variants(none).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(none, times=1)
