"""Tokens, sampling, markers and masks."""

import pyarrow as pa
import pytest
from conftest import fails
from pyspark.sql import functions as F

from vectext.functions import tokens as tk
from vectext.operators import sampling as sp


def docs(spark, sizes):
    rows = [(i, " ".join(f"t{j}" for j in range(n))) for i, n in enumerate(sizes)]
    return sp.with_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"))


def sampled(df, **kw):
    out = {}
    for r in sp.sample_positions(df, "doc_id", **kw).collect():
        out.setdefault(r["doc_id"], []).append(r["position"])
    return {d: sorted(p) for d, p in out.items()}


def test_sampling_sizes(spark):
    got = sampled(docs(spark, [50, 51, 53, 60, 400]), k=5)
    assert 0 not in got and got[1] == [50] and got[2] == [50, 51, 52]
    assert len(got[3]) == 5 and len(got[4]) == 5
    for positions, size in ((got[3], 60), (got[4], 400)):
        assert len(set(positions)) == 5 and all(50 <= p < size for p in positions)


def test_sampling_ignores_layout(spark):
    df = docs(spark, range(40, 240))
    once = sampled(df.coalesce(1), k=5)
    again = sampled(df.repartition(8, F.rand()), k=5)
    part = sampled(df.where("doc_id >= 100"), k=5)
    assert once == again
    assert part == {d: p for d, p in once.items() if d >= 100}
    assert once != sampled(df, k=5, seed=43)


def test_sampling_is_even(spark):
    counts = [0] * 10
    for positions in sampled(docs(spark, [60] * 2000), k=3).values():
        for p in positions:
            counts[p - 50] += 1
    assert sum(counts) == 6000 and all(480 < c < 720 for c in counts)


def test_specials_are_skipped(spark):
    df = docs(spark, [60])
    got = sampled(df, k=20, specials=[f"t{j}" for j in range(50, 58)])
    assert got[0] == [58, 59]


def test_audit(spark):
    row = sp.sampling_audit(docs(spark, [10, 50, 51, 53, 400]), "doc_id", 5).first()
    assert tuple(row) == (5, 2, 2, 9)


def test_base_rows(spark):
    rows = sp.base_rows(docs(spark, [51]), 20, "doc_id", "c:train:", k=5).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row["n_raw_tokens"] == 51 and row["activation_layer"] == 20 and row["doc_id"] == "c:train:0"
    assert row["detokenized_text_truncated"].split() == [f"t{j}" for j in range(51)]


def test_prefix_leaves_specials_out(spark):
    rows = sp.base_rows(docs(spark, [51]), 20, "doc_id", k=5, specials=["t0", "t7"]).collect()
    assert rows[0]["n_raw_tokens"] == 51
    assert rows[0]["detokenized_text_truncated"].split() == [f"t{j}" for j in range(51) if j not in (0, 7)]


def test_vectors_go_to_sites_in_order(spark):
    sites = spark.createDataFrame([(1, 5), (0, 9), (0, 2)], "row bigint, position bigint")
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "n bigint, vector array<double>")
    got = sp.vectors_in_order(sites, vectors, ["row", "position"], ["n"]).collect()
    assert sorted((r["row"], r["position"], r["vector"][0]) for r in got) == [(0, 2, 0.0), (0, 9, 1.0), (1, 5, 2.0)]
    with pytest.raises(ValueError, match="3 marker sites for 2 vectors"):
        sp.vectors_in_order(sites, vectors.limit(2), ["row", "position"], ["n"])


def test_splice(spark):
    embedded = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0]), (1, 1, [3.0])], "row bigint, position int, embedding array<double>")
    sites = spark.createDataFrame([(0, 1, [9.0])], "row bigint, position int, vector array<double>")
    got = sp.splice_vectors(embedded, sites, ["row"]).collect()
    assert sorted((r["row"], r["position"], r["embedding"][0]) for r in got) == [(0, 0, 1.0), (0, 1, 9.0), (1, 1, 3.0)]


def test_pad_guard(spark):
    df = docs(spark, [3])
    assert sp.require_no_pad(df, "<pad>").count() == 1
    fails(sp.require_no_pad(df, "t1"), "pad token")


def sites(spark, toks):
    df = spark.createDataFrame([(toks,)], "t array<string>")
    return df.select(tk.marker_sites(F.col("t"), "M", "L", "R").alias("s")).first()["s"]


def test_marker_sites(spark):
    assert sites(spark, ["a", "b"]) == [] and sites(spark, []) == []
    assert sites(spark, ["L", "M", "R"]) == [1]
    assert sites(spark, ["L", "M", "R", "x", "L", "M", "R"]) == [1, 5]
    assert sites(spark, ["M", "R", "L", "M"]) == []
    assert sites(spark, ["L", "M", "x", "y", "M", "R"]) == []


def test_marker_neighbors(spark):
    def run(toks):
        df = spark.createDataFrame([(toks,)], "t array<string>")
        return df.select(tk.marker_neighbors(F.col("t"), "M").alias("n"))

    assert tuple(run(["a", "M", "b"]).first()["n"]) == ("a", "b")
    for bad in (["M", "a"], ["a", "M"], ["a", "b"], ["a", "M", "b", "M", "c"]):
        fails(run(bad), "marker must occur once")


def test_suffix(spark):
    assert tk.stable_suffix("a {explanation} b c d") == ["c", "d"]
    for bad in ("no slot", "a {explanation} b"):
        with pytest.raises(ValueError):
            tk.stable_suffix(bad)
    df = spark.createDataFrame([(["x", "c", "d"],), (["c", "d"],), (["d"],), (["c", "d", "e"],)], "t array<string>")
    assert [r[0] for r in df.select(tk.ends_with(F.col("t"), ["c", "d"])).collect()] == [True, True, False, False]


def test_loss_mask(spark):
    df = spark.createDataFrame(
        [([("user", "a b"), ("assistant", "c"), ("user", "d"), ("assistant", "e f")],)],
        "m array<struct<role:string,content:string>>",
    ).select(tk.loss_mask(F.col("m")).alias("mask"))
    row = df.select("mask", tk.response_length(F.col("mask")).alias("n")).first()
    assert row["mask"] == [0, 0, 1, 0, 1, 1] and row["n"] == 4


def test_last_real_index(spark):
    df = spark.createDataFrame([([1, 1, 0],), ([0, 1, 1],), ([0, 0],)], "m array<int>")
    assert [r[0] for r in df.select(tk.last_real_index(F.col("m"))).collect()] == [1, 2, None]


def test_pick_marker(spark):
    df = spark.createDataFrame([("a ㈀ b",), ("㈁㈃",)], "text string")
    assert tuple(sp.pick_marker(df).first()) == (0x3202, "㈂")
    assert tuple(sp.pick_marker(df.limit(0)).first()) == (0x3200, "㈀")
    fails(sp.pick_marker(df, first=0x3200, last=0x3201), "every character of the range")


def test_tokenizer_plug_in(spark):
    import pandas as pd

    @F.pandas_udf("array<string>")
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(list)

    df = spark.createDataFrame([("abc",)], "text string")
    assert sp.with_tokens(df, tokenizer=letters("text")).first()["tokens"] == ["a", "b", "c"]


def test_python_tokenizer_works_in_slices(spark, monkeypatch):
    """All rows come back in place, with few texts' tokens at once whatever the size of a batch."""
    monkeypatch.setattr(sp, "SLICE_BYTES", 64)
    texts = [(i, None if i % 7 == 3 else "ab c " * (i % 5) + "é" * (40 * (i % 11 == 0))) for i in range(100)]
    df = spark.createDataFrame(texts, "i int, text string").coalesce(1)
    got = sp.with_tokens(df, tokenizer=sp.python_tokenizer(str.split)("text")).orderBy("i").collect()
    assert [r["tokens"] for r in got] == [None if t is None else t.split() for _, t in texts]
    assert sp.with_tokens(df.limit(0), tokenizer=sp.python_tokenizer(str.split)("text")).count() == 0
    # The slices themselves, as a worker makes them.
    run = sp.python_tokenizer(str.split).func
    out = list(run(iter([pa.array(["x y"] * 100), pa.array([], pa.string()), pa.array(["z" * 1000, None])])))
    assert [t for part in out for t in part.to_pylist()] == [["x", "y"]] * 100 + [["z" * 1000], None]
    assert max(map(len, out)) <= 64 // 3 + 1


def test_extractor_plug_in(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "detokenized_text_truncated string")
    out = sp.extract_vectors(df, lambda texts, layer: [[len(t), layer] for t in texts], 7, 2)
    got = sorted((r[0], r["activation_vector"]) for r in out.collect())
    assert got == [("ab", [2.0, 7.0]), ("c", [1.0, 7.0])]
    fails(sp.extract_vectors(df, lambda texts, layer: [[0.0]] * len(texts), 7, 2), "stated width")
    fails(sp.extract_vectors(df, lambda texts, layer: [], 7, 2), "stated width")
