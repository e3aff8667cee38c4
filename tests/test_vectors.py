"""Vectors, rewards, baselines and reports."""

import math

import numpy as np
import pytest
from conftest import fails
from pyspark.sql import functions as F

from vectext.functions import vectors as vx
from vectext.operators import report as rp, scoring as sc

A, B = F.col("a"), F.col("b")


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>")


@pytest.mark.parametrize("a, b, mse, cos", [([3.0, 0.0], [1.0, 0.0], 0, 1), ([1.0, 0.0], [0.0, 5.0], 2, 0), ([1.0, 0.0], [-2.0, 0.0], 4, -1)])
def test_direction_mse(spark, a, b, mse, cos):
    row = pair(spark, a, b).select(vx.scaled_mse(A, B, math.sqrt(2)), vx.cosine(A, B)).first()
    assert row[0] == pytest.approx(mse, abs=1e-12) and row[1] == pytest.approx(cos)


def test_mse_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=8), rng.normal(size=8)
    scale = math.sqrt(8)
    norm = lambda v: v / max(np.linalg.norm(v), 1e-12) * scale
    df = pair(spark, a.tolist(), b.tolist())
    row = df.select(vx.scaled_mse(A, B, scale), vx.scaled_mse(A, B, None), vx.cosine(A, B)).first()
    assert row[0] == pytest.approx(((norm(a) - norm(b)) ** 2).mean())
    assert row[0] == pytest.approx(2 * (1 - row[2]))
    assert row[1] == pytest.approx(((a - b) ** 2).mean())


def test_normalize(spark):
    df = pair(spark, [3.0, 4.0], [0.0, 0.0])
    row = df.select(vx.normalize(A, 10.0), vx.normalize(B, 10.0), vx.normalize(A, None), vx.norm(A)).first()
    assert row[0] == pytest.approx([6.0, 8.0]) and row[1] == [0.0, 0.0] and row[2] == [3.0, 4.0] and row[3] == 5.0
    twice = df.select(vx.normalize(vx.normalize(A, 10.0), 10.0)).first()[0]
    assert twice == pytest.approx([6.0, 8.0])


def test_resolve_scale(spark):
    assert [vx.resolve_scale(s, 16) for s in (None, "raw", "none", "sqrt_d_model", "150", 2)] == [None, None, None, 4.0, 150.0, 2.0]
    with pytest.raises(ValueError):
        vx.resolve_scale("x", 16)
    df = spark.createDataFrame([(None,), ("raw",), ("none",), ("sqrt_d_model",), ("150",)], "a string")
    got = [r[0] for r in df.select(vx.resolve_scale_column(A, F.lit(16))).collect()]
    assert got == [None, None, None, 4.0, 150.0]
    fails(spark.createDataFrame([("x",)], "a string").select(vx.resolve_scale_column(A, F.lit(16))), "CAST_INVALID_INPUT")


def test_reward(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (None,)], "a double")
    assert [r[0] for r in df.select(vx.reward(A)).collect()] == [0.0, -0.5, -2.0]
    got = [r[0] for r in df.select(vx.reward(A, log_form=True)).collect()]
    assert got == pytest.approx([-math.log(1e-8), -math.log(0.5), -math.log(2)])


def test_guards(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, 2.0],), ([nan, 1.0],), ([inf, 1.0],), ([1.0],), (None,)]
    df = spark.createDataFrame(rows, "activation_vector array<double>")
    assert tuple(sc.vector_guard(df, 2).first()) == (5, 2, 3, False)
    assert tuple(sc.vector_guard(df.limit(1), 2).first()) == (1, 0, 0, True)
    assert sc.require_vectors(df.limit(1), 2).count() == 1
    fails(sc.require_vectors(df, 2), "not 2 finite values")


def test_reshape(spark):
    df = pair(spark, [1.0, 2.0, 3.0, 4.0], [])
    assert df.select(vx.rows_from_flat(A, 2)).first()[0] == [[1.0, 2.0], [3.0, 4.0]]
    fails(df.select(vx.rows_from_flat(A, 3)), "not a multiple")


def test_baselines_match_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 6)) + 0.5
    df = spark.createDataFrame([(r.tolist(),) for r in v], "activation_vector array<double>")
    for scale in (math.sqrt(6), None):
        n = v if scale is None else v / np.linalg.norm(v, axis=1, keepdims=True) * scale
        mu = n.mean(axis=0)
        c = mu if scale is None else mu / np.linalg.norm(mu) * scale
        row = sc.mean_baselines(df, scale).first()
        assert row["rows"] == 50
        assert row["mean_norm_baseline"] == pytest.approx(((n - c) ** 2).mean())
        assert row["raw_variance_baseline"] == pytest.approx(((n - mu) ** 2).mean())


def test_loss_metrics(spark):
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [5.0, 0.0])], "predicted array<double>, activation_vector array<double>")
    row = sc.loss_metrics(df, math.sqrt(2), baseline=4.0).first()
    assert row["rows"] == 2 and row["loss"] == pytest.approx(2) and row["fve"] == pytest.approx(1.5)
    assert row["pred_norm_raw"] == 4 and row["gold_norm_raw"] == 7 and row["mse_scale"] == pytest.approx(2 * math.sqrt(2))
    assert "fve" not in sc.loss_metrics(df, None).columns and sc.loss_metrics(df, None).first()["mse_scale"] == -2


def test_permuted_targets_score_like_the_mean(spark):
    from vectext.operators.layout import permute_column

    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id bigint, v array<double>")
    moved = permute_column(df, "id", "v").withColumnRenamed("v", "w")
    scale = math.sqrt(8)
    mse = lambda x, y: F.avg(vx.scaled_mse(F.col(x), F.col(y), scale))
    row = df.join(moved, "id").select(mse("v", "v"), mse("v", "w")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(2, abs=0.2)


def test_linear_head(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0, 3.0])], "id int, vector array<double>")
    eye = np.eye(3)

    def project(matrix):
        cells = [(o, i, float(w)) for o, row in enumerate(matrix) for i, w in enumerate(row)]
        weights = spark.createDataFrame(cells, "out int, in int, w double")
        return [r["y"] for r in sc.linear_head(df, weights, ["id"]).orderBy("out").collect()]

    assert project(eye) == [1.0, 2.0, 3.0]
    assert project(eye[[2, 0, 1]]) == [3.0, 1.0, 2.0]
    assert project([[1, 1, 1]]) == [6.0]


def test_linear_head_against_plain_product(spark):
    """Ragged vectors, nulls, sparse and repeated weights, small blocks; any layout gives the same."""
    rnd = np.random.default_rng(3)
    rows = [(k, f"key {k}", [float(x) for x in rnd.normal(size=rnd.integers(1, 40))]) for k in range(200)]
    rows += [(900, None, []), (901, "n", None), (902, "c", [1.0, None, 2.0]), (900, None, [1.0]), (900, None, [1.0])]
    df = spark.createDataFrame(rows, "id int, name string, vector array<double>")
    cells = [(int(o) * 7, int(i), float(w)) for o, i, w in zip(rnd.integers(0, 50, 600), rnd.integers(0, 30, 600), rnd.normal(size=600))]
    weights = spark.createDataFrame(cells, "out int, in int, w double")
    dense = np.zeros((350, 30))
    for o, i, w in cells:
        dense[o, i] += w
    outs = sorted({o for o, _, _ in cells})
    want = []
    for key, name, v in rows:
        if v:
            x = np.zeros(30)
            x[:min(30, len(v))] = [c or 0.0 for c in v[:30]]
            want += [(key, name or "", o, round(float(dense[o] @ x), 9) + 0.0) for o in outs]
    for cells_, parts in ((400, 3), (1 << 19, 5)):
        got = sc.linear_head(df.repartition(parts), weights, ["id", "name"], block_cells=cells_)
        assert got.dtypes == [("id", "int"), ("name", "string"), ("out", "int"), ("y", "double")]
        assert sorted((r[0], r[1] or "", r[2], round(r[3], 9) + 0.0) for r in got.collect()) == sorted(want)


def test_linear_head_shuffles_blocks(spark):
    """3,584 wide, as the model's vectors are: what meets is blocks, and rows come out right."""
    width = 3584
    df = spark.range(64).select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == F.col("id"), 2.0).otherwise(0.0)).alias("vector"))
    # Row o has a weight of o + 1 for input o, and 1 for the input after it.
    diagonal = spark.range(width).selectExpr("cast(id as int) out", "cast(id as int) `in`", "id + 1D w")
    beside = spark.range(width - 1).selectExpr("cast(id as int) out", "cast(id + 1 as int) `in`", "1D w")
    got = sc.linear_head(df, diagonal.unionByName(beside), ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan
    met = got.where("y <> 0").collect()
    assert got.count() == 64 * width
    assert {(r["id"], r["out"]): r["y"] for r in met} == {(k, o): 2.0 * (o + 1 if o == k else 1) for k in range(64) for o in (k, k - 1) if o >= 0}


def test_empty_head(spark):
    df = spark.createDataFrame([(1, [1.0])], "id int, vector array<double>")
    none = spark.createDataFrame([], "out int, in int, w double")
    some = spark.createDataFrame([(0, 0, 1.0)], "out int, in int, w double")
    assert sc.linear_head(df, none, ["id"]).count() == 0 and sc.linear_head(df.limit(0), some, ["id"]).count() == 0


def test_moments_of_ragged_vectors(spark):
    rows = [([1.0, 2.0],), ([3.0, None, 5.0],), ([],), (None,), ([-1.0],)]
    df = spark.createDataFrame(rows, "activation_vector array<double>").repartition(3)
    got = sorted(map(tuple, sc.vector_moments(df).select("position", "total", "squares", "n").collect()))
    assert got == [(0, 3.0, 11.0, 3), (1, 2.0, 4.0, 1), (2, 5.0, 25.0, 1)]
    assert sc.vector_moments(df.limit(0)).count() == 0
    plan = sc.vector_moments(spark.range(9).selectExpr("array(id, 2D) activation_vector"))._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_generation_status(spark):
    ok = "<explanation>fine</explanation>"
    rows = [("completed", ok, 3), ("truncated", ok, 3), ("completed", "no tags", 3), ("completed", f"<explanation>{'w ' * 600}</explanation>", 3), ("aborted", ok, 9)]
    df = spark.createDataFrame(rows, "status string, response string, n_logprobs int")
    got = [(r["final_status"], r["length_anomaly"]) for r in sc.generation_status(df, max_new=5).collect()]
    assert got == [("completed", False), ("failed", False), ("failed", False), ("failed", False), ("aborted", True)]
    fails(sc.generation_status(df.withColumn("n_logprobs", F.lit(0))), "without log-probs")


def test_rewards_go_back_by_index(spark):
    samples = spark.range(4).withColumnRenamed("id", "index")
    scored = spark.createDataFrame([(1, -0.5), (3, -0.1)], "index bigint, reward double")
    got = {r["index"]: r["reward"] for r in sc.scatter_rewards(samples, scored).collect()}
    assert got == {0: -2.0, 1: -0.5, 2: -2.0, 3: -0.1}


def test_group_advantage(spark):
    rows = [(0, 1, 1.0), (1, 1, 3.0), (2, 2, 5.0), (3, 3, 2.0), (4, 3, 2.0)]
    df = spark.createDataFrame(rows, "index bigint, g int, reward double")
    got = {r["index"]: r["advantage"] for r in sc.group_advantage(df, "g", "index").collect()}
    assert got[0] == pytest.approx(-1 / (math.sqrt(2) + 1e-6)) and got[1] == -got[0]
    assert got[2] == 0 and got[3] == 0 and got[4] == 0


def test_logprob_mismatch(spark):
    df = spark.createDataFrame([(-1.0, -1.0), (-1.0, -2.0)], "train_lp double, rollout_lp double")
    same, higher = sc.logprob_mismatch(df).collect()
    assert (same["tis"], same["tis_abs"], same["tis_k3"]) == (1.0, 0.0, 0.0)
    assert higher["tis"] == pytest.approx(math.e) and higher["tis_k3"] == pytest.approx(math.e - 2)


def test_score_agreement(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (1.05, 1.0, 2.0)], "a double, b double, n double")
    row = sc.score_agreement(df, "a", "b", "n", 4, 0.1).first()
    assert row["max_deviation"] == pytest.approx(0.05) and row["paths_agree"] and row["head_trained"]
    row = sc.score_agreement(df.withColumn("n", F.lit(0.1)), "a", "b", "n", 4, 0.01).first()
    assert not row["paths_agree"] and not row["head_trained"]


# ----------------------------------------------------------------------- reports


def rewards(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "index bigint, reward double")


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0] * 40 + [1.0, 2.0], list(np.random.default_rng(4).normal(size=101))])
def test_percentiles_match_numpy(spark, values):
    got = {r["percentile"]: r["value"] for r in rp.percentiles(rewards(spark, [float(v) for v in values]), "reward", "index").collect()}
    for p in (10, 25, 50, 75, 90):
        assert got[float(p)] == pytest.approx(np.percentile(values, p))


def bands(spark, values, **kw):
    got = rp.pick_bands(rewards(spark, values), "reward", "index", **kw).orderBy("place").collect()
    return [(r["index"], r["band"]) for r in got]


def test_pick_bands(spark):
    values = [float(v) for v in range(10)]
    assert bands(spark, values, n_top=2, n_mid=2, n_bottom=2) == [(9, "top"), (8, "top"), (5, "middle"), (4, "middle"), (1, "bottom"), (0, "bottom")]
    assert [i for i, _ in bands(spark, [1.0] * 6, n_top=1, n_mid=2, n_bottom=1)] == [0, 2, 3, 5]
    assert bands(spark, [1.0, 2.0, 3.0]) == [(2, "top"), (1, "top"), (0, "top")]


def test_report_rows(spark):
    df = rewards(spark, [1.0, 2.0]).withColumns({
        "detokenized_text_truncated": F.lit("abcdef"), "response": F.lit("<explanation> e </explanation>"), "doc_id": F.lit("x Ultra-FineWeb:1"),
    })
    row = rp.report_rows(df, "reward", "index", 4, n_top=1, n_mid=0, n_bottom=0).collect()
    assert len(row) == 1 and row[0]["index"] == 1 and row[0]["place"] == 0
    assert row[0]["source_text"] == "abcd\n\n[... TRUNCATED: 2 more chars ...]"
    assert "vector_norm" not in row[0].asDict() and row[0]["explanation"] == "e" and row[0]["source_label"] == "UFW"


def test_source_mix(spark):
    rows = [("WildChat:1", 1), ("WildChat:2", 1), ("Ultra-FineWeb:1", 2), ("z", 3)]
    df = spark.createDataFrame(rows, "doc_id string, g int")
    got = {r["source_label"]: (r["samples"], r["groups"]) for r in rp.source_mix(df, "g").collect()}
    assert got == {"WildChat": (2, 1), "UFW": (1, 1), "other": (1, 1)}


def test_norm_outliers(spark):
    df = spark.createDataFrame([(i, 100.0 if i else 14000.0, i * 5) for i in range(9)], "index bigint, n double, pos int")
    got = rp.norm_outliers(df, "n", "pos", factor=5.0).orderBy("index").collect()
    assert [r["too_early"] for r in got] == [True, True] + [False] * 7
    assert [r["too_long"] for r in got] == [True] + [False] * 8
