"""Code lengths against a plain context tree, and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectext.llm import language
from vectext.llm.streams import held_out

TRAIN = {
    "xx": ["the cat and the hat", "That cat is fat. The rat sat.", "é the"],
    "yy": ["le chat et le chapeau", "un rat à la maison", "là où le chat dort"],
    "zz": ["1 2 3"],
}


def plain_bits(texts, text):
    """Code length by walking contexts from the longest seen down, byte by byte."""
    counts = {}
    for t in texts:
        data = language.START + t.lower().encode()
        for i in range(language.ORDER, len(data)):
            for depth in range(language.ORDER + 1):
                counts.setdefault(data[i - depth:i], Counter())[data[i]] += 1
    total, data = 0.0, language.START + text.lower().encode()
    for i in range(language.ORDER, len(data)):
        depth = next(d for d in range(language.ORDER, -1, -1) if data[i - d:i] in counts)
        for d in range(depth, -2, -1):
            if d < 0:
                total += 8
                break
            seen = counts[data[i - d:i]]
            n, q = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
    return total


def counts_of(texts_by_lang):
    grams, counts = {}, {}
    for lang, texts in texts_by_lang.items():
        windows = np.concatenate([language.windows(language.text_bytes(t)) for t in texts])
        found, n = np.unique(windows, return_counts=True)
        grams[lang], counts[lang] = found.astype(np.uint32), n
    return language.Counts(grams, counts)


def test_code_lengths(monkeypatch):
    model = language.Model(counts_of(TRAIN))
    rnd = random.Random(1)
    texts = ["", "the cat", "le chat où", "ZZZ 123 ### the", "中文", "a" * 50] + ["".join(rnd.choices("the rat chlou à1#", k=30)) for _ in range(40)]
    want = np.array([[plain_bits(TRAIN[name], text) for name in model.names] for text in texts])
    assert model.bits(texts) == pytest.approx(want, rel=1e-5)
    for text, bits in zip(texts, want):
        assert model.bits([text])[0] == pytest.approx(bits, rel=1e-5)
    monkeypatch.setattr(language, "WINDOW", 7)  # windows do not change a code length
    assert model.bits(texts) == pytest.approx(want, rel=1e-5)


def test_many_languages_of_several_scripts(spark):
    """300 languages, each of its own letters: all are learned, and the model stays small."""
    letters = [chr(c) for start, end in ((0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x4E00, 0x4F00), (0x61, 0x7A)) for c in range(start, end)]
    rnd = random.Random(3)
    rows, asked = [], []
    for k in range(300):
        mine = rnd.sample(letters, 12)
        words = ["".join(rnd.choices(mine, k=rnd.randint(2, 6))) for _ in range(40)]
        rows += [(1000 * k + j, " ".join(rnd.choices(words, k=30)), f"l{k:03d}") for j in range(4)]
        asked.append((k, " ".join(rnd.choices(words, k=20))))
    counts = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(counts.grams) == 300
    trees = language.Model(counts).trees
    held = sum(part.nbytes for tree in trees for depth in tree.depths for part in depth)
    assert held <= 20 * 4 * sum(map(len, counts.grams.values()))
    got = language.predict_language(spark.createDataFrame(asked, "doc_id bigint, text string"), counts)
    right = got.where(F.col("predicted.lang_pred") == F.format_string("l%03d", "doc_id")).count()
    assert right >= 297


def test_a_column_of_the_output_name(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id bigint, text string, predicted int")
    counts = language.Counts({}, {})
    with pytest.raises(ValueError, match="name another"):
        language.predict_language(df, counts)
    assert language.predict_language(df, counts, out="guess").select("predicted", "guess.*").first() == (2, "und", 0.0)


def test_learning_and_predicting(spark):
    rows = [(k, t, lang) for k, (lang, texts) in enumerate(TRAIN.items()) for t in texts]
    rows += [(50, None, "xx"), (51, "words without a label", None), (None, "the dog", "xx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    counts = language.learn(df)
    assert sorted(counts.grams) == ["xx", "yy", "zz"]
    asked = spark.createDataFrame(
        [(1, "the cat sat"), (2, "où est le chat"), (3, None), (4, ""), (5, "123 ### !"), (6, "the " * 100_000), (1, "the cat sat"), (None, "le")],
        "doc_id bigint, text string",
    ).withColumn("lang", F.lit("clash"))
    got = language.predict_language(asked, counts).select("text", "predicted.*").collect()
    assert [r["lang_pred"] for r in got] == ["xx", "yy", "und", "und", "und", "xx", "xx", "yy"]
    assert all(0 <= r["score"] <= 1 for r in got) and got[2]["score"] == got[4]["score"] == 0 and got[0]["score"] > 0.5


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    counts = language.learn(none)
    asked = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    assert language.predict_language(asked, counts).select("predicted.*").collect() == [("und", 0.0)]
    assert language.predict_language(none, counts).count() == 0


def test_sample_is_bounded_and_does_not_depend_on_layout(spark):
    df = spark.range(5000).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("lang"))
    one, two = (sorted(language.sample(d, 30).collect()) for d in (df, df.repartition(9)))
    plan = language.sample(df, 30)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # texts are not shuffled before they are cut down
    assert one == two and Counter(r["lang"] for r in one) == {"rare": 30, "hot": 30}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = language.learn(docs.where(~held_out("doc_id")))
    guessed = language.predict_language(docs.where(held_out("doc_id")), counts)
    right, rows = guessed.agg(F.sum((F.col("predicted.lang_pred") == F.col("lang")).cast("int")), F.count("lang")).first()
    assert right / rows > 0.98
