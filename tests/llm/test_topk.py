"""Top-k against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vectext.llm import topk


def brute(rows, k, scale=64):
    """(query, rank, id, score) over rows told apart by their place."""
    parts = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            parts.append((n, i, [math.floor(scale * x) for x in v]))
    out = []
    for n, q, a in parts:
        if q is None or q % 20:
            continue
        scored = [(-limited(sum(x * y for x, y in zip(a, b))), i is None, i or 0) for m, i, b in parts if m != n]
        for rank, (score, unknown, i) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, None if unknown else i, -score))
    return sorted(out, key=repr)


def limited(score):
    return max(-(2**63), min(2**63 - 1, score))


def run(spark, rows, k=5, **how):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("place", F.lit("clash"))
    return sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0, k=k, **how).collect()), key=repr)


@pytest.mark.parametrize("lengths", ["alike", "spread", "few"])
def test_against_all_products(spark, lengths):
    rnd = random.Random(lengths)
    rows = []
    for i in range(420):
        size = {"alike": 1.0, "spread": rnd.expovariate(0.5), "few": rnd.choice((0.1, 1, 5))}[lengths]
        v = [rnd.gauss(0, 1) for _ in range(8)]
        rows.append((i, [size * x / math.sqrt(sum(y * y for y in v)) for x in v]))
    hot = rows[17][1]
    rows += [(i, hot) for i in range(500, 700)]  # one vector on a third of all rows
    assert run(spark, rows, bucket_rows=50, query_rows=7) == brute(rows, 5)


def test_pruning_never_loses_a_candidate():
    import numpy as np

    rng = np.random.default_rng(4)
    pruned = 0
    for cosine in (0.2, 0.5, 0.8, 0.97):
        vectors = np.floor(64 * rng.standard_normal((400, 6)))
        norms = np.sqrt((vectors**2).sum(axis=1))
        order = np.argsort(-norms)
        vectors, norms = vectors[order], norms[order]
        units = vectors / norms[:, None]
        for q in vectors[:60]:
            length = math.sqrt((q**2).sum())
            bound = cosine * length * norms[0]
            kept = set(topk.candidates(q, length, bound, units, norms).tolist())
            assert set(np.flatnonzero(vectors @ q >= bound).tolist()) <= kept
            pruned += 400 - len(kept)
    assert pruned > 60 * 400


def test_edges(spark):
    rows = [
        (0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.25, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]),
        (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (40, [0.0, 0.0]), (6, [3.0]), (7, []), (None, [1.0, 0.5]), (8, [1e12, -1e12]),
        (60, [3e8, 1.0]), (9, [-0.01, 0.01]),
    ]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, rows, k=100, bucket_rows=2, query_rows=1) == brute(rows, 100)


def test_few_rows(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [0.5])]) == [(0, 1, 1, 64 * 32)]
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(df, F.col("id") % 20 == 0).count() == 0
