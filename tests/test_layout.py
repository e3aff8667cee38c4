"""Row numbers, splits, shuffles, batches, groups and shards."""

import re

import pytest
from pyspark.sql import functions as F

from vectext.operators import corpus as cp, index as ix, layout as ly, lookups as lk, splits as sl
from vectext.sources import tables as tb


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ------------------------------------------------------------------------- index


@pytest.mark.parametrize("parts", [1, 7])
def test_global_index(spark, parts):
    df = spark.range(500).select("id", F.pmod(F.xxhash64("id"), F.lit(9)).alias("v")).repartition(parts)
    want = sorted((r["v"], r["id"]) for r in df.collect())
    got = ix.global_index(df, "v", "id").orderBy("row_index").collect()
    assert [(r["v"], r["id"]) for r in got] == want
    assert [r["row_index"] for r in got] == list(range(500))


def test_hash_rank_is_a_bijection(spark):
    df = spark.range(3000)
    once = dict(pairs(ix.hash_rank(df, 1, "id"), "id", "rank"))
    again = dict(pairs(ix.hash_rank(df.repartition(5, F.rand()), 1, "id"), "id", "rank"))
    assert once == again and sorted(once.values()) == list(range(3000))
    assert once != dict(pairs(ix.hash_rank(df, 2, "id"), "id", "rank"))


def test_group_rank_of_one_hot_group(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("g"))
    got = ix.group_rank(df, "id", ["g"])
    hot = [r["rank"] for r in got.where("g = -1").orderBy("id").collect()]
    assert hot == list(range(len(hot))) and len(hot) == 666


def test_group_rank_of_sparse_ids(spark):
    """Ids far apart, a null group, and no group at all."""
    df = spark.range(1000).select((F.col("id") * 1_000_003).alias("id"), F.when(F.col("id") % 2 == 0, "a").alias("g"))
    got = ix.group_rank(df, "id", ["g"])
    for group in (F.col("g").isNull(), F.col("g") == "a"):
        assert [r["rank"] for r in got.where(group).orderBy("id").collect()] == list(range(500))
    assert [r["rank"] for r in ix.group_rank(df, "id").orderBy("id").collect()] == list(range(1000))


def test_ranks_never_gather_rows_in_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 97).alias("id"), F.lit("one").alias("g"))
    for made in (ix.group_rank(df, "id", ["g"]), ix.group_rank(df, "id"), ly.epoch_order(df, "id", 0, 5000, None)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        lone = re.findall(r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", plan)
        assert all("sum(_rows" in w for w in lone)


def test_hash_digits():
    assert [ix.hash_digits(n) for n in (0, 1, 65536, 65537 * 16, 65536 * 16**3)] == [1, 1, 1, 2, 3]


def test_permutation_of_repeated_keys(spark):
    rows = [("a", i, float(i)) for i in range(300)] + [(None, 300 + i, 300.0 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    got = ly.permute_column(df, "k", "v").collect()
    assert sorted(r["id"] for r in got) == list(range(400))
    assert sorted(r["v"] for r in got) == [float(i) for i in range(400)]
    assert sum(r["id"] != r["v"] for r in got) > 350


def test_head_rows(spark):
    assert [r[0] for r in ly.head_rows(spark.range(50), 3, F.col("id").desc()).collect()] == [49, 48, 47]


def test_first_clean_reads_few_files(spark, tmp_path):
    texts = [(f"text {i // 2}",) for i in range(400)]
    spark.createDataFrame(texts, "text string").repartitionByRange(20, F.col("text")).write.parquet(f"{tmp_path}/in")
    df = tb.read_corpus(spark, f"{tmp_path}/in")
    read = []

    def clean(part):
        read.append(part.select("source_file").distinct().count())
        return cp.dedup_prefix(part, ["source_file", "source_row"])

    got = cp.first_clean(df, 15, clean)
    whole = cp.first_n(cp.dedup_prefix(df, ["source_file", "source_row"]), 15)
    assert pairs(got, "source_file", "source_row") == pairs(whole, "source_file", "source_row") and got.count() == 15
    assert read and max(read) < 10
    assert cp.first_clean(df, 200, clean).count() == 200
    with pytest.raises(ValueError, match="only 200 of 201"):
        cp.first_clean(df, 201, clean)


def test_slice_reads_few_files(spark, tmp_path):
    spark.range(0, 1000, 1, 10).select(F.col("id").cast("string").alias("text")).write.parquet(f"{tmp_path}/in")
    df = tb.read_corpus(spark, f"{tmp_path}/in")
    got = ix.scan_slice(df, 250, 100)
    order = [r["text"] for r in df.orderBy("source_file", "source_row").collect()]
    assert [r["text"] for r in got.orderBy("row_index").collect()] == order[250:350]
    assert got.select("source_file").distinct().count() == 2
    assert ix.scan_slice(df, 0, 0).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ShuffledHashJoin" not in plan and "SortMergeJoin" not in plan
    with pytest.raises(ValueError, match="40 found"):
        ix.scan_slice(df, 960, 100)


def test_slice_ranks_only_blocks_that_hold_it(spark, tmp_path, monkeypatch):
    """Where rows are missing, no more than the slice's blocks are shuffled to be ranked."""
    monkeypatch.setattr(ix, "BLOCK_ROWS", 10)
    spark.range(0, 100, 1, 1).select(F.col("id").cast("string").alias("text")).write.parquet(f"{tmp_path}/in")
    df = tb.read_corpus(spark, f"{tmp_path}/in").where("cast(text as int) % 3 > 0")
    got = ix.scan_slice(df, 30, 3)
    kept = [str(i) for i in range(100) if i % 3]
    assert [r["text"] for r in got.orderBy("row_index").collect()] == kept[30:33]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Window [row_number") < plan.index("Join ")  # the join lies below


def test_running_sum_of_a_group(spark):
    df = spark.range(200).select("id", (F.col("id") % 5).alias("v"), F.lit(1).alias("g"))
    got = dict(pairs(ix.group_running_sum(df, "v", "id", ["g"]), "id", "running"))
    total = 0
    for i in range(200):
        total += i % 5
        assert got[i] == total


def test_scan_index(spark):
    rows = [(f, i) for f, n in (("a", 3), ("b", 2), ("c", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "source_file string, source_row bigint")
    got = [r["row_index"] for r in ix.scan_index(df).orderBy("source_file", "source_row").collect()]
    assert got == list(range(9))


@pytest.mark.parametrize("n", [1, 4, 9, 10, 12])
def test_first_n(spark, n):
    rows = [(f, i * 70000) for f, k in (("a", 4), ("b", 5), ("c", 3)) for i in range(k)]
    df = spark.createDataFrame(rows, "source_file string, source_row bigint").repartition(4)
    assert pairs(cp.first_n(df, n), "source_file", "source_row") == rows[:n]


def test_first_n_shortfall(spark):
    df = spark.createDataFrame([("a", 1)], "source_file string, source_row bigint")
    with pytest.raises(ValueError, match="only 1 of 2"):
        cp.first_n(df, 2)
    assert cp.first_n(df, 2, strict=False).count() == 1


def test_dedup_first_wins(spark):
    rows = [(3, "Same  TEXT"), (1, "same text"), (2, "same text"), (5, "x" * 500 + "a"), (4, "x" * 500 + "b"), (6, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert [r[0] for r in pairs(cp.dedup_prefix(df, ["doc_id"]), "doc_id")] == [1, 4, 6]
    assert [r[0] for r in pairs(cp.dedup_prefix(df, ["doc_id"], chars=None), "doc_id")] == [1, 4, 5, 6]


# ----------------------------------------------------------------------- lookups


def test_lookup_join_with_hot_key(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 10).alias("k"))
    table = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = rows.join(table, "k", "left").fillna(-1)
    got = lk.lookup_join(rows, table, "k", ["id"], "left").fillna(-1)
    assert pairs(got, "id", "k", "v") == pairs(want, "id", "k", "v")
    shared = lk.lookup_join(rows, table, "k", ["id"], "inner")
    assert pairs(shared, "id", "v") == pairs(rows.join(table, "k"), "id", "v")


def test_lookup_join_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id bigint, k string")
    table = spark.createDataFrame([("a", 5)], "k string, v int")
    got = {r["id"]: r["v"] for r in lk.lookup_join(rows, table, "k", ["id"], "left").collect()}
    assert got == {1: None, 2: 5}


def test_group_stats_join(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    got = lk.group_stats_join(rows, "g", ["id"], [F.avg("x").alias("m")]).collect()
    assert len(got) == 300
    assert {(r["g"], r["m"]) for r in got} == {(0, 148.5), (1, 149.5), (2, 150.5)}


# ------------------------------------------------------------------------ splits


def documents(spark, n, rows=3):
    return spark.range(n * rows).select((F.col("id") % n).cast("string").alias("doc_id"))


@pytest.mark.parametrize("n, want", [(0, {}), (1, {"rl": 1}), (3, {"rl": 3}), (10, {"av_sft": 3, "ar_sft": 3, "rl": 4}), (97, {"av_sft": 29, "ar_sft": 29, "rl": 39})])
def test_split_sizes(spark, n, want):
    got = {r["split"]: (r["documents"], r["rows"]) for r in sl.split_counts(sl.split_documents(documents(spark, n))).collect()}
    assert got == {k: (v, 3 * v) for k, v in want.items()}


def test_split_all_to_one(spark):
    split = sl.split_documents(documents(spark, 9), fractions={"av_sft": 0, "ar_sft": 0, "rl": 1})
    assert split.select("split").distinct().collect()[0][0] == "rl"
    split = sl.split_documents(documents(spark, 9), fractions={"av_sft": 1, "ar_sft": 0, "rl": 0})
    assert [tuple(r) for r in split.select("split").distinct().collect()] == [("av_sft",)]


def test_split_ignores_layout_and_never_leaks(spark):
    df = documents(spark, 200)
    once = sl.split_documents(df)
    again = sl.split_documents(df.repartition(5, F.rand()))
    assert set(pairs(once, "doc_id", "split")) == set(pairs(again, "doc_id", "split"))
    assert sl.split_leak(once).count() == 0


def test_split_fraction_errors(spark):
    for bad in ({"a": 0.5, "b": 0.4}, {"a": -0.5, "b": 1.5}):
        with pytest.raises(ValueError):
            sl.split_documents(documents(spark, 3), fractions=bad)


def test_split_does_not_move_rows(spark):
    plan = sl.split_documents(documents(spark, 50))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


# ------------------------------------------------------------------------ layout


def test_permute_column(spark):
    df = spark.range(400).select("id", F.array(F.col("id").cast("double")).alias("v"), (F.col("id") + 1).alias("keep"))
    once = ly.permute_column(df, "id", "v", 42, "d")
    got = pairs(once, "id", "keep", "v")
    assert [g[0] for g in got] == list(range(400)) and all(g[1] == g[0] + 1 for g in got)
    assert sorted(g[2][0] for g in got) == list(range(400))
    assert sum(g[2][0] == g[0] for g in got) < 20
    assert got == pairs(ly.permute_column(df.repartition(3), "id", "v", 42, "d"), "id", "keep", "v")


def test_shuffle_rows(spark):
    df = spark.range(300)
    order = [r["id"] for r in ly.shuffle_rows(df, "id", 1, "a").collect()]
    assert sorted(order) == list(range(300)) and order != list(range(300))
    assert order == [r["id"] for r in ly.shuffle_rows(df.repartition(4), "id", 1, "a").collect()]
    assert order == [r["id"] for r in ly.shuffle_rows(df, "id", 1, "a", partitions=3).collect()]
    assert order != [r["id"] for r in ly.shuffle_rows(df, "id", 1, "b").collect()]


def test_epoch_batches(spark):
    got = ly.epoch_batches(spark.range(10), "id", 10, 4, range(2)).orderBy("draw").collect()
    assert [r["draw"] for r in got] == list(range(20))
    assert [r["batch"] for r in got] == [i // 4 for i in range(20)]
    first, second = [r["id"] for r in got[:10]], [r["id"] for r in got[10:]]
    assert sorted(first) == sorted(second) == list(range(10)) and first != second
    plain = ly.epoch_batches(spark.range(10), "id", 10, 4, range(2), seed=None).orderBy("draw").collect()
    assert [r["id"] for r in plain] == list(range(10)) * 2


def test_draw_state():
    state = ly.DrawState(10)
    assert state.draw(4) == (0, 4) and state.draw(6) == (4, 10) and (state.epoch, state.offset) == (0, 10)
    assert state.draw(3) == (10, 13) and (state.epoch, state.offset) == (1, 3)
    state.push_back(2)
    assert state.draw(1) == (11, 12)
    state.push_back(50)
    assert state.position == 10
    assert ly.DrawState(4).draw(11) == (0, 11)
    whole = ly.DrawState(10, offset=4)
    assert whole.draw(16) == (4, 20) and (whole.epoch, whole.offset) == (1, 10)
    whole.push_back(3)
    assert whole.position == 17


def test_fan_out(spark):
    got = pairs(ly.fan_out(spark.range(3), 2, "id"), "id", "group_index", "index")
    assert got == [(0, 0, 0), (0, 0, 1), (1, 1, 2), (1, 1, 3), (2, 2, 4), (2, 2, 5)]


def test_equalize_groups(spark):
    sizes = [171, 170, 170]
    rows = [(g, i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i bigint")
    got = ly.equalize_groups(df, "g", "i", 8)
    assert pairs(got.groupBy("g").count(), "g", "count") == [(0, 168), (1, 168), (2, 168)]
    assert got.agg(F.max("i")).first()[0] == 167
    with pytest.raises(ValueError):
        ly.equalize_groups(df.where("g > 0 or i < 3"), "g", "i", 8)


def test_round_robin(spark):
    got = pairs(ly.round_robin(spark.range(6), "id", 2), "id", "target")
    assert got == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 1)]
    placed = ly.repartition_round_robin(spark.range(60), "id", 4).withColumn("p", F.spark_partition_id())
    assert pairs(placed.select("target", "p").distinct(), "target", "p") == [(i, i) for i in range(4)]


def test_shard_plan(spark):
    got = pairs(ly.shard_plan(spark, 100, 10, 4), "shard", "start", "length")
    assert got == [(0, 100, 2), (1, 102, 2), (2, 104, 2), (3, 106, 4)]
    at = spark.range(100, 110).select(ly.shard_of(F.col("id"), 100, 10, 4).alias("s"))
    assert [r["s"] for r in at.collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3]


HELPERS = ["_hash", "_block", "_inside", "_before", "_key", "_share", "_copy"]


@pytest.mark.parametrize("run", [
    lambda df: ly.shuffle_rows(df, "id"), lambda df: ix.hash_rank(df, 1, "id"), lambda df: ly.fan_out(df, 1, "id"),
    lambda df: cp.dedup_prefix(df, ["id"]), lambda df: lk.lookup_join(df, df.select(F.col("id"), F.lit(1).alias("more")), "id", ["id"]),
], ids=["shuffle_rows", "hash_rank", "fan_out", "dedup_prefix", "lookup_join"])
def test_helpers_leave_columns_of_their_names(spark, run):
    df = spark.range(20).withColumn("text", F.col("id").cast("string"))
    for name in HELPERS:
        df = df.withColumn(name, F.concat(F.lit(name), F.col("id")))
    got = run(df)
    assert set(df.columns) <= set(got.columns)
    assert sorted(map(tuple, got.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
