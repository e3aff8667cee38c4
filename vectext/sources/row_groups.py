"""An index of row groups, made from parquet footers, and slices planned from it.

``build_index`` reads the footers of a corpus in tasks and keeps one row per row
group: file, group, rows, and how many rows lie before and up to its end in scan
order. ``read_rows`` finds a slice in that table by its two bounds and reads
nothing but the row groups that hold it, one group a task. No row is counted, and
neither files nor groups are listed at the driver.

Files are opened by ``open_uri``, which knows the stores that Arrow knows; pass
another function of a path for others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vectext.functions.keys import path_base, path_slice
from vectext.operators.index import block_offsets

#: Tasks of one read; beyond it a task reads several groups, one after the other.
READ_TASKS = 100_000
BATCH_ROWS = 4096
LINEAGE = ("source_file", "source_row", "row_index")
FOOTERS = "source_file string, file_bytes bigint, group int, rows bigint"

Opener = Callable[[str], pa.NativeFile]


def open_uri(path: str) -> pa.NativeFile:
    """A file by its URI, or by a path of this machine."""
    store, inside = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def read_footers(files: DataFrame, open_file: Opener = open_uri) -> DataFrame:
    """One row per row group of the files named in ``source_file``; files without groups give none."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["source_file"].to_pylist():
                with open_file(path) as source:
                    size, meta = source.size(), pq.read_metadata(source)
                rows = [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(rows), pa.string()), pa.array([size] * len(rows), pa.int64()),
                        pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.int64()),
                    ],
                    ["source_file", "file_bytes", "group", "rows"],
                )

    return files.select("source_file").mapInArrow(footers, FOOTERS)


def build_index(
    spark: SparkSession, paths: Sequence[str] | str, out: str, open_file: Opener = open_uri, mode: str = "errorifexists"
) -> DataFrame:
    """Writes the index of all parquet files below ``paths`` to ``out`` and returns it.

    Scan order is by file path, then by place in the file. Offsets are added up
    over files and over the groups of a file, never over all groups at once.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    files = listed.load([paths] if isinstance(paths, str) else list(paths)).select(F.col("_metadata.file_path").alias("source_file"))
    groups = read_footers(files.repartition("source_file"), open_file).where("rows > 0")
    staged = f"{out.rstrip('/')}.footers"
    groups.write.mode("overwrite").parquet(staged)
    groups = spark.read.schema(FOOTERS).parquet(staged)
    totals = groups.groupBy("source_file").agg(F.sum("rows").alias("rows"), F.count("*").alias("groups"))
    starts = block_offsets(totals, [], "source_file", "rows").withColumnRenamed("_before", "start")
    places = block_offsets(totals, [], "source_file", "groups").withColumnRenamed("_before", "place")
    inside = block_offsets(groups, ["source_file"], "group", "rows").withColumnRenamed("_before", "first")
    made = groups.join(inside, ["source_file", "group"]).join(starts, "source_file").join(places, "source_file").select(
        "source_file", "file_bytes", "group", "rows", "first",
        (F.col("start") + F.col("first")).alias("before"),
        (F.col("start") + F.col("first") + F.col("rows")).alias("after"),
        (F.col("place") + F.col("group")).cast("bigint").alias("place"),
    )
    # In order, so that the bounds of a slice prune the index as well.
    made.repartitionByRange("before").sortWithinPartitions("before").write.mode(mode).parquet(out)
    return spark.read.parquet(out)


def total_rows(index: DataFrame) -> int:
    return index.agg(F.coalesce(F.max("after"), F.lit(0))).first()[0]


def read_rows(
    index: DataFrame, schema: StructType, start: int, length: int, open_file: Opener = open_uri, strict: bool = True
) -> DataFrame:
    """Rows ``[start, start + length)`` in scan order: the columns of ``schema``, then ``source_file``, ``source_row``, ``row_index``.

    Too few rows are an error when ``strict``. A column that a file does not
    have is null. A file whose size is another than the index says is an error:
    build the index again.
    """
    clashing = [c for c in schema.names if c in LINEAGE]
    if clashing:
        raise ValueError(f"columns {clashing} have names of the lineage")
    end, have = start + length, total_rows(index)
    if strict and have < end:
        raise ValueError(f"rows [{start}, {end}) requested, {max(0, have - start)} found")
    held = index.where((F.col("before") < end) & (F.col("after") > start) & F.lit(length > 0))
    tasks = min(max(held.count(), 1), READ_TASKS)
    # Neighbours in the index go to different tasks.
    spread = held.repartitionById(tasks, F.pmod("place", F.lit(tasks)).cast("int"))
    out = StructType(list(schema.fields)).add("source_file", "string").add("source_row", "long").add("row_index", "long")
    kinds, names = to_arrow_schema(out), list(schema.names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.to_pylist():
                yield from group_rows(group, names, kinds, start, end, open_file)

    return spread.mapInArrow(rows, out)


def group_rows(
    group: dict, names: Sequence[str], kinds: pa.Schema, start: int, end: int, open_file: Opener
) -> Iterator[pa.RecordBatch]:
    """The rows of one row group that lie in ``[start, end)``."""
    path, before = group["source_file"], group["before"]
    with open_file(path) as source:
        if source.size() != group["file_bytes"]:
            raise ValueError(f"{path} has changed since it was indexed")
        file = pq.ParquetFile(source)
        known = [c for c in names if c in file.schema_arrow.names]
        for part in file.iter_batches(BATCH_ROWS, row_groups=[group["group"]], columns=known):
            low, high = max(start - before, 0), min(end - before, part.num_rows)
            if low < high:
                cut = part.slice(low, high - low)
                n, first = cut.num_rows, before + low
                values = [cut[c].cast(kinds.field(c).type) if c in known else pa.nulls(n, kinds.field(c).type) for c in names]
                index = pa.array(range(first, first + n), pa.int64())
                inside = pa.array(range(first - group["before"] + group["first"], first - group["before"] + group["first"] + n), pa.int64())
                yield pa.RecordBatch.from_arrays([*values, pa.array([path] * n, pa.string()), inside, index], schema=kinds)
            before += part.num_rows
            if before >= end:
                return


def read_path(spark: SparkSession, path: str, index: DataFrame, columns: Sequence[str], open_file: Opener = open_uri) -> DataFrame:
    """Rows of ``path@[a:b]``, either bound optional, planned from the index of ``path``."""
    base, (first, last) = path_base(F.lit(path)), path_slice(F.lit(path))
    asked = spark.range(1).select(base.alias("base"), first.alias("first"), last.alias("last")).first()
    have = total_rows(index)
    start = asked["first"] or 0
    end = have if asked["last"] is None else min(asked["last"], have)
    schema = spark.read.parquet(asked["base"]).select(*columns).schema
    return read_rows(index, schema, start, max(end - start, 0), open_file, strict=False)
