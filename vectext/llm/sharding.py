"""Reproducible shuffles into shards, with computable places.

Rows get global numbers 0..n-1 in the order of their ids; a Feistel network
over the smallest even number of bits that covers n, walked until it lands
below n, permutes the numbers. Place p goes to shard ``p % shards`` at slot
``p // shards``, so shards differ by one row at most, slots have no gaps, and
the place of any row, or the row of any place, is computed from (n, seed)
alone.

Null ids come first; rows with equal ids are ordered by size and checksum of
the text, and rows equal in all of these are interchangeable. An empty table
gives an empty result. Other columns are left out of the numbering.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from vectext.llm.streams import crc32_of, text_of
from vectext.operators.index import global_index

ROUNDS = 6


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_bits(rows: int) -> int:
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, bits: int, seed: int, backwards: bool = False) -> np.ndarray:
    """One pass of the network over numbers of 2 * ``bits`` bits."""
    low = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & low
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64) for r in range(ROUNDS)]
    for key in reversed(keys) if backwards else keys:
        if backwards:
            left, right = right ^ (mixed(left ^ key) & low), left
        else:
            left, right = right, left ^ (mixed(right ^ key) & low)
    return (left << np.uint64(bits)) | right


def permuted(numbers: np.ndarray, rows: int, seed: int, backwards: bool = False) -> np.ndarray:
    """The permutation of 0..rows-1: passes repeat for what lands outside, until all are inside."""
    out = np.asarray(numbers).astype(np.uint64)
    bits, size = half_bits(rows), np.uint64(rows)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = feistel(out[todo], bits, seed, backwards)
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def place_of(row_number: int, rows: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    place = int(permuted(np.array([row_number]), rows, seed)[0])
    return place % shards, place // shards


def row_of(shard: int, slot: int, rows: int, shards: int, seed: int) -> int:
    """The row number that sits at a shard's slot."""
    return int(permuted(np.array([slot * shards + shard]), rows, seed, backwards=True)[0])


def with_place(df: DataFrame, row: str, rows: int, shards: int, seed: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows that carry their global number."""

    @pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), rows, seed))

    placed = df.withColumn("_place", place(F.col(row)))
    return placed.select(
        *df.columns,
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(shards)).cast("bigint").alias("slot"),
    )


def shard_rows(df: DataFrame, id: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 0) -> DataFrame:
    """``id, size, text_crc32, row_number, shard, slot`` of every row; texts are read once and not moved."""
    body = text_of(text)
    narrow = df.select(
        F.col(id).alias("_id"),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        crc32_of(body).alias("text_crc32"),
    )
    numbered = global_index(narrow, F.col("_id"), F.col("size"), F.col("text_crc32"), out="row_number")
    rows = numbered.agg(F.max("row_number")).first()[0]
    placed = with_place(numbered, "row_number", 1 if rows is None else rows + 1, shards, seed)
    return placed.withColumnRenamed("_id", id)


def write_shards(df: DataFrame, places: DataFrame, id: str, path: str) -> None:
    """Writes ``df`` below ``path`` as one folder per shard, sorted by slot. Ids must be unique."""
    joined = df.join(places.select(id, "shard", "slot"), id)
    spread = joined.repartition("shard", F.floor(F.col("slot") / F.lit(100_000)))
    spread.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
