"""Near duplicates by SimHash, with candidates from the pigeonring principle.

A fingerprint has 64 bits, cut into ``d + 1`` segments on a ring for a limit of
``d`` differing bits. By the pigeonring principle some segment starts chains
that stay in proportion: the segment itself differs in no bit, it and the next
one in at most 1, the next three in at most 2, and so on around the ring. So
two linked fingerprints share, for some start, the whole first segment and one
half of the second, which has at most one bit to differ in; these 24 bits (at
d = 3) are the key by which candidates meet. Of those, pairs whose chain breaks
its budget are dropped before the full Hamming distance is taken.

Equal fingerprints are one node. A key shared by more than ``BLOCK`` nodes is
cut into chunks whose pairs of chunks go to different tasks; a task passes on a
spanning forest of the links it finds, never all pairs. Links become groups by
the alternating star contraction, each step a written table.

Null and empty texts have no words and get fingerprint zero, linked like any
other. Null ids take part; a group's id is its smallest id, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from vectext.llm.components import connected, join_roots
from vectext.llm.streams import free_name, group_starts, text_of, whole_groups
from vectext.session import cut_lineage

BITS = 64
BLOCK = 1024
HASH_SEED = 42
COUNT_ROWS = 1 << 16


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; fewer words hash as they are, none give nothing."""
    # bytes.lower and bytes.split act on A-Z and on ASCII white space alone.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], HASH_SEED) for a, b in zip(starts[:last].tolist(), stops.tolist())),
        dtype=np.uint64, count=last,
    )


def fold(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    set_bits = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), COUNT_ROWS):
        part = np.ascontiguousarray(hashes[i:i + COUNT_ROWS].astype("<u8")).view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    majority = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprint(text: Column | str, width: int = 3) -> Column:
    """The SimHash of a text column as a bigint."""

    @pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fold(shingle_hashes(t, width)) for t in texts], dtype="int64")

    return simhash(text_of(text))


def hex_digits(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of ``distance + 1`` segments that cover the 64 bits."""
    cuts = [BITS * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def bits_of(number: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(number, shift).bitwiseAND(F.lit((1 << width) - 1))


def ring_keys(number: Column, distance: int) -> Column:
    """Keys of the chains of two: a start segment and either half of the segment after it."""
    ring = segments(distance)
    keys = []
    for i, (shift, width) in enumerate(ring):
        shift2, width2 = ring[(i + 1) % len(ring)]
        low = width2 // 2
        for half, (s, w) in enumerate(((shift2, low), (shift2 + low, width2 - low))):
            keys.append(F.struct(
                F.lit(2 * i + half).alias("start"),
                bits_of(number, shift, width).alias("whole"),
                bits_of(number, s, w).alias("half"),
            ))
    return F.array(*keys)


def chain_holds(x: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Which differences stay within every budget of the chain from their start segment."""
    ring = segments(distance)
    holds = np.ones(len(x), dtype=bool)
    masks = np.array([((1 << w) - 1) << s for s, w in ring], dtype=np.uint64)
    spent = np.zeros(len(x), dtype=np.int64)
    for step in range(len(ring)):
        spent += np.bitwise_count(x & masks[(start + step) % len(ring)])
        # The budget of a chain of n segments is n / (d + 1) of d bits, rounded down.
        holds &= spent <= (step + 1) * distance // len(ring)
    return holds


def block_links(frame: pd.DataFrame, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each key group of ``frame``, as two index arrays."""
    prints = frame["fingerprint"].to_numpy().astype(np.int64).view(np.uint64)
    first = frame["start"].to_numpy().astype(np.int64) // 2
    chunk = frame["chunk"].to_numpy()
    within = frame["a"].to_numpy() == frame["b"].to_numpy()
    starts = group_starts(frame, GROUP)
    end = np.repeat(np.append(starts[1:], len(frame)), np.diff(np.append(starts, len(frame))))
    root = np.arange(len(frame))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    left = np.arange(len(frame))
    lag = 0
    while True:
        lag += 1
        left = left[left + lag < end[left]]
        if not len(left):
            break
        right = left + lag
        # Already joined rows need no second link; chunks of one block are met in its own task.
        new = (root[left] != root[right]) & (within[left] | (chunk[left] != chunk[right]))
        i, j = left[new], right[new]
        x = prints[i] ^ prints[j]
        candidates = chain_holds(x, first[i], distance)
        i, j, x = i[candidates], j[candidates], x[candidates]
        linked = np.bitwise_count(x) <= distance
        if linked.any():
            out.append(join_roots(root, i[linked], j[linked]))
    if not out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


GROUP = ["start", "whole", "half", "a", "b"]


def links(prints: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``u < v`` that connect all fingerprints within ``distance`` bits of each other.

    ``prints`` has one row per distinct ``fingerprint``. Each connected set of
    the full link graph is connected by the links returned.
    """
    if distance == 0:
        return prints.select(F.col("fingerprint").alias("u"), F.col("fingerprint").alias("v")).limit(0)
    if not 0 < distance < BITS // 2:
        raise ValueError("the distance is 0 to 31 bits")
    keyed = prints.select("fingerprint", F.explode(ring_keys(F.col("fingerprint"), distance)).alias("k"))
    keyed = keyed.select("fingerprint", "k.*")
    key = ["start", "whole", "half"]
    counts = keyed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counts, key)
    chunks = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select(
        *key, F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "fingerprint"
    )
    sorted_rows = met.repartition(*GROUP).sortWithinPartitions(*GROUP, "fingerprint")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, GROUP):
            i, j = block_links(frame, distance)
            prints_ = frame["fingerprint"].to_numpy()
            u, v = np.minimum(prints_[i], prints_[j]), np.maximum(prints_[i], prints_[j])
            yield pd.DataFrame({"u": u, "v": v}).drop_duplicates()

    return sorted_rows.mapInPandas(find, "u bigint, v bigint").distinct()


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3
) -> DataFrame:
    """``id, fingerprint, component_id, node, text_hash`` of every row.

    ``component_id`` is the smallest id of all rows reachable over links, the
    row itself included; ``node`` is the same group named by a fingerprint.
    """
    body = text_of(text)
    rows = df.select(F.col(id).alias("id"), body.alias("text"))
    rows = cut_lineage(rows.select("id", fingerprint("text", width).alias("fingerprint"), F.xxhash64("text").alias("text_hash")))
    prints = cut_lineage(rows.groupBy("fingerprint").agg(F.min("id").alias("least")))
    groups = connected(links(prints, distance))
    linked = prints.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.select("fingerprint", "root").join(least, "root")
    named = prints.join(linked, "fingerprint", "left").select(
        "fingerprint",
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "fingerprint").alias("node"),
    )
    return rows.join(named, "fingerprint").select(
        F.col("id").alias(id), hex_digits(F.col("fingerprint")).alias("fingerprint"),
        "component_id", hex_digits(F.col("node")).alias("node"), "text_hash",
    )


def drop_near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3
) -> DataFrame:
    """One row per group: that of the smallest id, and of the smallest text hash among equal or null ids.

    Rows repeated in id and text are one choice and stay together; run the
    exact dedup first.
    """
    groups = near_duplicates(df, id, text, width, distance)
    order = F.struct(F.col(id).isNull().alias("unknown"), F.col(id).alias("id"), F.col("text_hash").alias("hash"))
    stays_id, stays_hash = free_name(df, "_stays_id"), free_name(df, "_stays_hash")
    stays = groups.groupBy("node").agg(F.min(order).alias("row")).select(
        F.col("row.id").alias(stays_id), F.col("row.hash").alias(stays_hash)
    )
    same = F.col(id).eqNullSafe(F.col(stays_id)) & (F.xxhash64(text_of(text)) == F.col(stays_hash))
    return df.join(stays, same, "left_semi")
