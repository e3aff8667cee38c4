"""Mixtures: weights, budgets and walks against a plain walk in Python."""

import math

import pytest
from pyspark.sql import functions as F

from vectext.llm import mixing

TOKENS = {"a": 1000, "b": 100, "c": 10, None: 50}


def test_limits_of_the_exponent():
    assert mixing.tempered(TOKENS, 1.0)["a"] == pytest.approx(1000 / 1160)
    assert set(mixing.tempered(TOKENS, 0.0).values()) == {0.25}
    mix = mixing.solve(TOKENS, budget=1160, target_entropy=0.8)
    assert mixing.entropy(mix.weights) == pytest.approx(0.8 * math.log(4), abs=1e-6)
    assert mixing.solve(TOKENS, budget=500, target_entropy=0.0).exponent == 1.0
    assert mixing.solve(TOKENS, budget=500, target_entropy=1.0).exponent == pytest.approx(0, abs=1e-5)


def test_repetition_limit():
    mix = mixing.solve(TOKENS, max_passes=3.0)
    reads = {s: mix.weights[s] * mix.budget / n for s, n in TOKENS.items()}
    assert max(reads.values()) == pytest.approx(3.0) and min(reads.values()) == pytest.approx(1.0)
    fixed = mixing.solve(TOKENS, budget=1160, max_passes=2.0)
    assert max(fixed.weights[s] * 1160 / n for s, n in TOKENS.items()) == pytest.approx(2.0)
    assert 0 < fixed.exponent < 1
    with pytest.raises(ValueError):
        mixing.solve(TOKENS, budget=1160 * 5, max_passes=2.0)
    with pytest.raises(ValueError):
        mixing.solve(TOKENS)
    assert mixing.solve({"one": 10}, target_entropy=1.0).weights == {"one": 1.0}


def documents(spark):
    rows = [(k, "w " * (k % 13), "big" if k % 3 else f"s{k % 2}", "x") for k in range(600)]
    rows += [(1000, None, "s0", "x"), (1001, "", None, "x"), (None, "no id", "s0", "x"), (7, "w " * 7, "big", "x"), (7, "w " * 7, "big", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, pass string")


@pytest.mark.parametrize("slice_rows", [50_000, 17])
@pytest.mark.parametrize("how", [{"max_passes": 2.0}, {"target_entropy": 0.9, "budget": 2000}])
def test_walks(spark, monkeypatch, slice_rows, how):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    df = documents(spark)
    places, mix = mixing.mix_sources(df, block_tokens=500, **how)
    got = places.collect()
    rows = df.collect()
    size = {s: sum(len((r["text"] or "").split()) + 1 for r in rows if r["source"] == s) for s in {r["source"] for r in rows}}
    assert mix.tokens == size
    for source, n in size.items():
        allowed = mix.allowed(source)
        mine = [r for r in got if r["source"] == source]
        spent = sum(r["tokens"] for r in mine)
        longest = max(len((r["text"] or "").split()) + 1 for r in rows if r["source"] == source)
        # Whole documents up to the budget: the last may reach over it.
        assert allowed <= spent < allowed + longest
        full = (allowed - 1) // n
        for p in range(full):
            assert sorted(repr(r["doc_id"]) for r in mine if r["pass"] == p) == sorted(repr(r["doc_id"]) for r in rows if r["source"] == source)
        share = mix.weights[source] * 500
        by_block = {}
        for r in mine:
            by_block[r["block"]] = by_block.get(r["block"], 0) + r["tokens"]
        if spent:
            assert all(abs(t - share) <= 2 * longest for b, t in by_block.items() if b < max(by_block))
    for b in {r["block"] for r in got}:
        assert sorted(r["place"] for r in got if r["block"] == b) == list(range(sum(r["block"] == b for r in got)))


def test_slices_do_not_change_the_walk(spark, monkeypatch):
    df = documents(spark)
    whole = sorted(map(repr, mixing.mix_sources(df, max_passes=2.0)[0].collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 11)
    assert sorted(map(repr, mixing.mix_sources(df.repartition(5), max_passes=2.0)[0].collect())) == whole


def test_mixed_rows(spark):
    df = documents(spark)
    places, mix = mixing.mix_sources(df, max_passes=2.0)
    mixed = mixing.mixed_rows(df, places)
    assert mixed.columns == df.columns
    counts = {repr(r["doc_id"]): r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    reads = {repr(r["doc_id"]): r["count"] for r in places.groupBy("doc_id").count().collect()}
    assert counts == reads
    assert set(counts) == {repr(r["doc_id"]) for r in df.collect()}  # each document once at least


def test_repeated_rows_share_their_reads(spark):
    rows = [(1, "a b", "s", k) for k in range(5)] + [(2, "c", "s", 9), (None, None, "s", 8), (None, None, "s", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _rank int").repartition(3)
    places = spark.createDataFrame([(1,)] * 13 + [(2,)] * 2 + [(None,)], "doc_id bigint").withColumn(
        "text_hash", F.xxhash64(F.when(F.col("doc_id") == 1, "a b").when(F.col("doc_id") == 2, "c").otherwise(""))
    )
    got = mixing.mixed_rows(df, places).groupBy("doc_id", "_rank").count().collect()
    assert sorted(r["count"] for r in got if r["doc_id"] == 1) == [2, 2, 3, 3, 3]
    assert [r["count"] for r in got if r["doc_id"] == 2] == [2]
    assert [r["count"] for r in got if r["doc_id"] is None] == [1]


def test_many_passes_over_a_small_source(spark, monkeypatch):
    """No array holds all passes of a document, and none is lost."""
    df = spark.createDataFrame([(1, "a b c", "s"), (2, "d", "s"), (3, "w " * 50, "t")], "doc_id bigint, text string, source string")
    want = sorted(map(repr, mixing.mix_sources(df, target_entropy=0.69, budget=3000)[0].collect()))
    assert len(want) > 200
    monkeypatch.setattr(mixing, "TIMES", 7)
    places, _ = mixing.mix_sources(df, target_entropy=0.69, budget=3000)
    assert sorted(map(repr, places.collect())) == want
    assert mixing.mixed_rows(df, places).count() == len(want)
    monkeypatch.undo()
    spread = mixing.repeated(df, F.lit(20_000_000_000).cast("bigint"), "k", 20_000_000_000)
    assert "Exchange" in spread._jdf.queryExecution().executedPlan().toString()


def test_more_sources_than_the_driver_takes(spark):
    """One source a host: 120,000 of them, of which some are large."""
    size = (1 + F.col("id") % 7 + F.when(F.col("id") < 3, 5000).otherwise(0)).cast("int")
    df = spark.range(120_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("host"), "id").alias("source"), F.repeat(F.lit("w "), size).alias("text")
    )
    places, mix = mixing.mix_sources(df, max_passes=2.0)
    assert places.select("source").distinct().count() == 120_000
    assert places.groupBy("source").count().agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("how", [
    {"max_passes": 2.0}, {"max_passes": 2.0, "budget": 1160}, {"target_entropy": 0.8}, {"target_entropy": 0.8, "budget": 500}, {"target_entropy": 1.0},
])
def test_aggregates_give_the_same_weights(spark, how):
    local = mixing.solve(TOKENS, **how)
    table = spark.createDataFrame(list(TOKENS.items()), "source string, tokens bigint")
    weighed, mix = mixing.solve_table(table, **how)
    assert mix.exponent == pytest.approx(local.exponent, abs=1e-6) and mix.budget == pytest.approx(local.budget, rel=1e-6)
    assert mix.tokens == TOKENS and mix.weights == pytest.approx(local.weights, rel=1e-6)
    assert {r["source"]: r["allowed"] for r in weighed.collect()} == {s: mix.allowed(s) for s in TOKENS}


def test_walks_without_a_broadcast(spark):
    """A table of sources too large to be sent to all tasks is joined by a shuffle."""
    df = documents(spark)
    want = sorted(map(repr, mixing.mix_sources(df, max_passes=2.0)[0].collect()))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, mixing.mix_sources(df, max_passes=2.0)[0].collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_empty_table(spark):
    none = documents(spark).where(F.lit(False))
    places, mix = mixing.mix_sources(none, max_passes=2.0)
    assert places.count() == 0 and mix.weights == {}
    assert mixing.mixed_rows(none, places).count() == 0
