"""Votes against plain cosines, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectext.llm import quality
from vectext.llm.streams import held_out

FOLDER = "/root/testdata/sf0.01"


def plain_terms(text):
    """Term counts by walking the bytes."""
    kept = []
    for byte in text.encode():
        kind = int(quality.BYTE_CLASS[byte])
        if kept[-2:] != [kind, kind]:
            kept.append(kind)
    counts = np.zeros(quality.TERMS, dtype=int)
    for a, b, c in zip(kept, kept[1:], kept[2:]):
        counts[(a * quality.CLASSES + b) * quality.CLASSES + c] += 1
    words = text.encode().split()
    for k in range(1, len(words)):
        counts[quality.REPEATED] += words[k] == words[k - 1]
        counts[quality.REPEATED + 1] += k > 1 and words[k] == words[k - 1] == words[k - 2]
    return counts


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa bb", "Hello, WORLD!! *** it it it it's é\n\n1 2", "the the the cat cat the", " " * 9])
def test_terms(text):
    assert (quality.term_counts(text) == plain_terms(text)).all()


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    idf = rng.random(quality.TERMS).astype(np.float32)
    projection = rng.standard_normal((quality.TERMS, 6)).astype(np.float32)
    vectors = quality.unit(rng.standard_normal((80, 6)).astype(np.float32))
    labels = (rng.random(80) > 0.4).astype(float)
    votes = quality.Votes(idf, projection, vectors, labels)
    counts = rng.integers(0, 5, (30, quality.TERMS)) * (rng.random((30, quality.TERMS)) < 0.02)
    counts[3] = 0
    for row, got in zip(counts, votes.scores(counts)):
        v = (np.log1p(row) * idf) @ projection.astype(float)
        if not row.any():
            assert got == pytest.approx(labels.mean())
            continue
        cosines = vectors.astype(float) @ (v / np.linalg.norm(v))
        best = np.argsort(-cosines)[:quality.NEIGHBOURS]
        weights = np.clip(cosines[best], 0, 1) ** quality.SHARPNESS
        assert got == pytest.approx((weights * labels[best]).sum() / weights.sum(), abs=1e-3)


def test_ties_at_the_border_go_to_the_first():
    rng = np.random.default_rng(7)
    cosines = np.concatenate([np.full((5, 3000), 0.5), rng.integers(0, 4, (40, 3000)) / 4]).astype(np.float32)
    for k in (1, 25, 3000):
        want = np.sort(np.argsort(-cosines, axis=1, kind="stable")[:, :k], axis=1)
        assert (quality.nearest(cosines, k) == want).all()


def test_latent_axes():
    x = np.random.default_rng(2).standard_normal((60, 40)).astype(np.float32) * np.linspace(3, 0.1, 40, dtype=np.float32)
    axes = quality.latent_axes(x, 5)
    _, _, want = np.linalg.svd(x, full_matrices=False)
    assert np.abs(np.abs(axes.T @ want[:5].T) - np.eye(5)).max() < 0.05


def test_document_frequencies_cover_all_rows(spark):
    texts = [None, "", "a b", "a b c", "A!!"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    found, rows = quality.document_frequencies(df)
    assert rows == 15 and (found == sum((plain_terms(t or "") > 0).astype(int) for t in texts)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("body", F.lit("clash"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    votes = quality.learn(docs, labels.where(~held_out("doc_id")))
    scored = quality.with_quality(docs, votes)
    assert scored.columns == [*docs.columns, "score"]
    tested = scored.join(labels, "doc_id").where(held_out("doc_id"))
    right = ((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int")
    good = F.when(F.col("quality") == 1, right)
    got = tested.agg(F.avg(right).alias("all"), F.avg(good).alias("good")).first()
    assert got["all"] > 0.95 and got["good"] > 0.97
    again = quality.with_quality(docs.repartition(5).where("doc_id < 200"), votes).select("doc_id", F.round("score", 5)).collect()
    first = scored.where("doc_id < 200").select("doc_id", F.round("score", 5)).collect()
    assert sorted(again) == sorted(first)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None), (3, ""), (None, "b"), (1, "a text"), (4, "long " * 100_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    scores = [r["score"] for r in quality.with_quality(docs, quality.learn(docs, labels)).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores) and scores[1] == scores[2]
    none = labels.where(F.lit(False))
    assert {r["score"] for r in quality.with_quality(docs, quality.learn(docs, none)).collect()} == {1.0}
    empty = docs.where(F.lit(False))
    assert quality.with_quality(empty, quality.learn(empty, labels)).count() == 0
