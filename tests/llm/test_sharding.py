"""Shards: a bijection, balanced, reproducible and computable."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectext.llm import sharding


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 17, 100, 4096, 4097, 100_003])
@pytest.mark.parametrize("seed", [0, 7])
def test_permutation(rows, seed):
    numbers = np.arange(rows)
    there = sharding.permuted(numbers, rows, seed)
    assert sorted(there.tolist()) == list(range(rows))
    assert (sharding.permuted(there, rows, seed, backwards=True) == numbers).all()
    if rows > 1000:
        assert abs(np.corrcoef(numbers, there)[0, 1]) < 0.05
        assert (there != sharding.permuted(numbers, rows, seed + 1)).mean() > 0.9


def test_places_are_computable():
    for row in range(50):
        shard, slot = sharding.place_of(row, 50, 16, 3)
        assert sharding.row_of(shard, slot, 50, 16, 3) == row


ROWS = [(k * 7 % 101, f"text {k}" * (k % 5)) for k in range(95)] + [(None, "x"), (None, None), (3, "twin"), (3, "twin"), (500, "é")]


def test_shards(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard_rows(df, shards=16, seed=1).collect()
    again = sharding.shard_rows(df.repartition(7), shards=16, seed=1).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["shard"], r["slot"]) == sharding.place_of(r["row_number"], len(ROWS), 16, 1)
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {len(ROWS) // 16, len(ROWS) // 16 + 1}
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_empty_table_and_files(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.shard_rows(none).count() == 0
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    places = sharding.shard_rows(df, shards=4)
    sharding.write_shards(df, places, "doc_id", f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
