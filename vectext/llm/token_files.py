"""Token ids on disk as bit or byte planes.

Format. ``<path>`` is a table of Parquet files, written and read by Spark so
that any store it reaches will do, of one row per block of ``BLOCK_IDS`` ids
(the last block of a part may be shorter):

* ``part, block``: the place of the block; parts follow each other in id order,
  and a part's blocks are numbered from 0;
* ``before``: ids of the part's earlier blocks;
* ``n_ids, kind, planes``: the ids, as unsigned 32-bit numbers, transposed so
  that plane k holds bit k (``bit``, eight ids a byte, low bit first) or byte k
  (``byte``) of every id, each plane compressed with zstandard on its own;
  planes above the highest used one are left out, being all zero;
* ``spans``: the block's index, one (doc, id, first, at, length, whole) per
  document that has ids in the block: its number in the part, its id, where its
  ids in this block begin in the document and in the block, how many they are,
  and whether that is all of the document.

A block decodes by itself, so reading is a scan without a shuffle; only
documents cut by a block border are put together across rows.

Order is by id, nulls first; equal ids by checksum of the text, and rows equal
in both are interchangeable. Null texts are empty: one end id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vectext.llm.streams import crc32_of, text_of
from vectext.llm.tokenizing import ID_TYPE, encoder

BLOCK_IDS = 1 << 16
LEVEL = 3


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> list[bytes]:
    """Compressed planes of a block of ids, lowest first."""
    bytes_ = np.ascontiguousarray(ids.astype(ID_TYPE)).view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(bytes_, axis=1, bitorder="little").T, axis=1, bitorder="little")
    elif kind == "byte":
        planes = bytes_.T
    else:
        raise ValueError(f"planes are of bits or bytes, not {kind}")
    used = np.flatnonzero(planes.any(axis=1)) if len(ids) else []
    top = int(used[-1]) + 1 if len(used) else 0
    compressor = zstandard.ZstdCompressor(level=level)
    return [compressor.compress(np.ascontiguousarray(p).tobytes()) for p in planes[:top]]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "byte") -> np.ndarray:
    """The ids of a block."""
    count, width = (32, (n_ids + 7) // 8) if kind == "bit" else (4, n_ids)
    grid = np.zeros((count, width), dtype=np.uint8)
    decompressor = zstandard.ZstdDecompressor()
    for k, plane in enumerate(planes):
        grid[k] = np.frombuffer(decompressor.decompress(plane), dtype=np.uint8)
    if kind == "bit":
        grid = np.packbits(np.unpackbits(grid, axis=1, bitorder="little", count=n_ids).T, axis=1, bitorder="little")
        return np.ascontiguousarray(grid).reshape(-1).view(ID_TYPE)
    return np.ascontiguousarray(grid.T).reshape(-1).view(ID_TYPE)


SPAN = "doc:bigint,id:{id},first:bigint,at:int,length:int,whole:boolean"
BLOCK = "part int, block int, before bigint, n_ids int, kind string, planes array<binary>, spans array<struct<{span}>>"


def write_token_files(
    df: DataFrame, out: str, path: str, kind: str = "words", end_id: int = 1, id: str = "doc_id", text: str = "text",
    planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL,
) -> None:
    """Writes every document's ids, its end id included, below ``out`` in id order."""
    rows = df.select(F.col(id).alias("id"), text_of(text).alias("text"))
    ordered = rows.repartitionByRange("id", crc32_of(F.col("text"))).sortWithinPartitions("id", crc32_of(F.col("text")))
    id_type = rows.schema["id"].dataType.simpleString()
    end = np.array([end_id], dtype=ID_TYPE).tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, docs = TaskContext.get().partitionId(), 0, 0
        encode_all = encoder(path, kind).encode_all
        held, spans, space = [], [], block_ids
        schema: pa.Schema | None = None

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=ID_TYPE)
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "before": block * block_ids, "n_ids": len(ids), "kind": planes,
                "planes": to_planes(ids, planes, level), "spans": spans,
            }], schema=schema)

        for batch in batches:
            if schema is None:
                schema = block_schema(batch.schema.field("id").type)
            encoded = encode_all(body.as_py() for body in batch["text"])
            for doc_id, ids in zip((key.as_py() for key in batch["id"]), encoded):
                ids += end
                total, first = len(ids) // 4, 0
                while first < total:
                    take = min(space, total - first)
                    spans.append({
                        "doc": docs, "id": doc_id, "first": first, "at": block_ids - space,
                        "length": take, "whole": take == total,
                    })
                    held.append(ids[4 * first:4 * (first + take)])
                    first, space = first + take, space - take
                    if not space:
                        yield row()
                        held, spans, space, block = [], [], block_ids, block + 1
                docs += 1
        if held:
            yield row()

    schema = BLOCK.format(span=SPAN.format(id=id_type))
    ordered.mapInArrow(blocks, schema).write.option("compression", "none").parquet(out)


def block_schema(id_type: pa.DataType) -> pa.Schema:
    span = pa.struct([
        ("doc", pa.int64()), ("id", id_type), ("first", pa.int64()), ("at", pa.int32()), ("length", pa.int32()), ("whole", pa.bool_()),
    ])
    return pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()),
        ("planes", pa.list_(pa.binary())), ("spans", pa.list_(span)),
    ])


def read_spans(spark: SparkSession, out: str) -> DataFrame:
    """``part, doc, id, first, begin, length, whole, ids`` of every span; ``begin`` counts ids from the part's start."""
    blocks = spark.read.parquet(out)
    id_type = blocks.schema["spans"].dataType.elementType["id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = from_planes(row["planes"], row["n_ids"], row["kind"]).tobytes()
                spans = row["spans"]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(spans), pa.int32()),
                    pa.array([s["doc"] for s in spans], pa.int64()),
                    pa.array([s["id"] for s in spans], batch.schema.field("spans").type.value_type.field("id").type),
                    pa.array([s["first"] for s in spans], pa.int64()),
                    pa.array([row["before"] + s["at"] for s in spans], pa.int64()),
                    pa.array([s["length"] for s in spans], pa.int32()),
                    pa.array([s["whole"] for s in spans], pa.bool_()),
                    pa.array([ids[4 * s["at"]:4 * (s["at"] + s["length"])] for s in spans], pa.binary()),
                ], names=["part", "doc", "id", "first", "begin", "length", "whole", "ids"])

    columns = f"part int, doc bigint, id {id_type}, first bigint, begin bigint, length int, whole boolean, ids binary"
    return blocks.mapInArrow(decode, columns)


def read_documents(spark: SparkSession, out: str, id: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids`` of every document, decoded from the files.

    ``start`` counts all ids of documents before it in the order of the files.
    """
    spans = read_spans(spark, out)
    whole = spans.where("whole").select("part", "id", F.col("begin"), F.col("length").cast("bigint").alias("n_tokens"), "ids")
    cut = spans.where("not whole").groupBy("part", "doc").agg(
        F.first("id").alias("id"), F.min("begin").alias("begin"), F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("first", "ids"))).alias("pieces"),
    )
    joined = F.aggregate("pieces", F.lit(b""), lambda done, piece: F.concat(done, piece["ids"]))
    cut = cut.select("part", "id", "begin", "n_tokens", joined.alias("ids"))
    # One row per part, of which there are as many as writing tasks.
    parts = spark.read.parquet(out).groupBy("part").agg(F.sum("n_ids").alias("_rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("ahead"))
    return whole.unionByName(cut).join(F.broadcast(parts), "part").select(
        F.col("id").alias(id), (F.col("ahead") + F.col("begin")).cast("bigint").alias("start"), "n_tokens", "ids"
    )
