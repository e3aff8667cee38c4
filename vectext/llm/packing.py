"""Best-fit packing of token pieces into sequences, by merging residual bins up a tree.

Each task packs its share of the pieces best-fit, longest first, and lets go of
bins that are nearly full. The others travel on as items, whole bins with their
pieces, to a quarter as many tasks, which pack them best-fit again; and so on
until one task's share is left. Bins beside which not even the least of the
others fits are set aside after each round, so rounds get narrow, no task holds
more than its share, and the tree ends where no two bins go together.

A document is its ids with an end id. Only longer ones than a sequence are cut,
into pieces of the full length, the first piece taking what is left over.

Null texts count as empty and are one end id. Null ids and rows repeated in id
are documents of their own. Pieces have a key of their own (``piece_key``), so
equal rows never meet in a join. No other input column is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectext.llm.streams import text_of
from vectext.llm.tokenizing import ID_TYPE, encoder
from vectext.session import cut_lineage

#: Rows of pieces in a task's share, and how many shares meet in the next round.
SHARE_ROWS = 200_000
FAN_IN = 4
#: Texts whose pieces a task gives back together.
TEXTS = 256
#: A bin with no more free tokens than this part of it is let go at once.
NEARLY_FULL = 1 / 128


def token_pieces(
    df: DataFrame, path: str, kind: str, end_id: int, length: int, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, piece, start, length, ids`` of every document, ids as little-endian unsigned 32-bit bytes."""
    rows = df.select(F.col(id).alias("id"), text_of(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    end = np.array([end_id], dtype=ID_TYPE).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path, kind).encode_all
        for batch in batches:
            # Few texts at a time are Python strings; the others stay in the batch.
            encoded = encode_all(body.as_py() for body in batch["text"])
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                out = []
                for row, ids in enumerate(islice(encoded, part.num_rows)):
                    ids += end
                    n = len(ids) // 4
                    ends = range((n - 1) % length + 1, n + 1, length)
                    out += [
                        (row, k, max(0, stop - length), stop - max(0, stop - length), ids[4 * max(0, stop - length):4 * stop])
                        for k, stop in enumerate(ends)
                    ]
                rows_, *columns = zip(*out)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(rows_)), *[pa.array(c, kind_) for c, kind_ in zip(columns, kinds)]],
                    ["id", "piece", "start", "length", "ids"],
                )
            # A worker waits for later stages' tasks: it gives back what Arrow would keep of its batches.
            batch = part = encoded = None
            pa.default_memory_pool().release_unused()

    pieces = rows.mapInArrow(cut, f"id {id_type}, piece int, start bigint, length bigint, ids binary")
    return pieces.withColumnRenamed("id", id)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first, each into the bin it fills best.

    Open bins are kept by free space, and a bit per amount of free space that
    some bin has; the best bin's free space is the lowest bit at or above the size.
    """
    bins = np.empty(len(sizes), dtype=np.int64)
    offsets = np.empty(len(sizes), dtype=np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = some >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            place = by_free[free].pop()
            if not by_free[free]:
                some &= ~(1 << free)
        else:
            free, place = capacity, opened
            opened += 1
        bins[i], offsets[i] = place, capacity - free
        if free > size:
            by_free[free - size].append(place)
            some |= 1 << (free - size)
    return bins, offsets


def packed_share(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins of a share packed as items: their rows with the new bin and offset."""
    codes, _ = pd.factorize(frame["bin"])
    lengths = frame["length"].to_numpy()
    sizes = np.bincount(codes, weights=lengths).astype(np.int64)
    bins, offsets = best_fit(sizes, capacity)
    first = np.full(len(sizes), -1, dtype=np.int64)
    keys = frame["bin"].to_numpy()
    # A merged bin goes by the least key of its items, so keys stay unique over all tasks.
    first[codes] = keys
    named = pd.Series(first).groupby(bins).min().to_numpy()
    used = np.bincount(bins, weights=sizes).astype(np.int64)
    out = frame.copy()
    out["bin"] = named[bins[codes]]
    out["offset"] = frame["offset"].to_numpy() + offsets[codes]
    out["used"] = used[bins[codes]]
    return out


def pack(lengths: DataFrame, capacity: int, share_rows: int = SHARE_ROWS) -> DataFrame:
    """``piece_key, length, sequence_id, offset`` of pieces given as (piece_key, length).

    Keys are unique, lengths 1 to ``capacity``.
    """
    items = lengths.select(
        F.col("piece_key").alias("bin"), "piece_key", "length", F.lit(0).cast("bigint").alias("offset")
    )
    schema = "bin bigint, piece_key bigint, length bigint, offset bigint, used bigint"

    def fit(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return packed_share(frame.drop(columns="share"), capacity)[["bin", "piece_key", "length", "offset", "used"]]

    rows = items.count()
    shares = max(1, math.ceil(rows / share_rows))
    done: list[DataFrame] = []
    near = capacity - max(1, int(capacity * NEARLY_FULL))
    round_ = 0
    while rows:
        # A bin's rows have its key, hence one share; the round number deals them anew each time.
        share = F.pmod(F.xxhash64("bin", F.lit(round_)), F.lit(shares)).cast("int")
        fitted = cut_lineage(items.withColumn("share", share).groupBy("share").applyInPandas(fit, schema))
        least = fitted.where(F.col("used") < near).agg(F.min("used")).first()[0] or capacity
        # Bins that nothing left fits beside are sequences.
        full = (F.col("used") >= near) | (F.col("used") > capacity - least)
        done.append(fitted.where(full))
        items = fitted.where(~full).drop("used")
        state = items.agg(F.count("*").alias("rows"), F.count_distinct("bin").alias("bins")).first()
        rows, bins = state["rows"], state["bins"]
        if shares == 1 or bins < 2:
            break
        # In each round the least bin goes to another one of its share, so shares hold two bins at least.
        round_, shares = round_ + 1, max(1, min(max(math.ceil(shares / FAN_IN), math.ceil(rows / share_rows)), bins // 2))
    for part in done:
        items = items.select("bin", "piece_key", "length", "offset").unionByName(part.drop("used"))
    return items.select("piece_key", "length", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(
    df: DataFrame, path: str, kind: str = "bytes", end_id: int = 2, capacity: int = 1024,
    id: str = "doc_id", text: str = "text", share_rows: int = SHARE_ROWS,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document.

    Ids stay with the tokenising task: what is written and packed is their
    checksum and length. :func:`sequences` puts the ids themselves in place.
    """
    pieces = token_pieces(df, path, kind, end_id, capacity, id, text).select(
        F.col(id).alias("id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    pieces = cut_lineage(pieces.withColumn("piece_key", F.monotonically_increasing_id()))
    placed = pack(pieces.select("piece_key", "length"), capacity, share_rows).drop("length")
    return pieces.join(placed, "piece_key").drop("piece_key").withColumnRenamed("id", id)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from pieces with (piece_key, ids) and their places."""
    parts = pieces.select("piece_key", "ids").join(placed.select("piece_key", "sequence_id", "offset"), "piece_key")
    ordered = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return ordered.select("sequence_id", joined.alias("ids"))
