"""Row numbers over whole tables, without moving a table to one task.

A window without a partition key sends every row to one task. The functions
here split the order into bounded blocks, number rows inside the blocks in
parallel and add each block's offset, so that only one row per block is ever
seen by a single task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vectext.functions.keys import free_name, keyed_hash
from vectext.session import cut_lineage

BLOCK_ROWS = 65536


def block_offsets(counts: DataFrame, group: Sequence[str], block: str, value: str) -> DataFrame:
    """Running total of ``value`` before each block. ``counts`` has one row per block."""
    order = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *group, block, F.coalesce(F.sum(value).over(order), F.lit(0).cast("bigint")).alias("_before")
    )


def hash_digits(rows: int) -> int:
    """Leading hex digits that cut ``rows`` hashes into blocks of ``BLOCK_ROWS`` or fewer on average."""
    return max(1, math.ceil(math.log(max(rows, 1) / BLOCK_ROWS, 16)))


def hash_rank(
    df: DataFrame, seed: int | str, key: Column | str, out: str = "rank", rows: int | None = None
) -> DataFrame:
    """Rank 0..n-1 of every row in the order of a keyed hash of its unique key.

    The leading hex digits name the block, so blocks have even size whatever
    the keys are; how many digits follows from the number of rows, counted if
    not given. For keys that repeat, order by hash and a row number with
    :func:`global_index`.
    """
    digits = hash_digits(df.count() if rows is None else rows)
    hash_name, block, place, before = (free_name(df, c) for c in ("_hash", "_block", "_inside", "_before"))
    hashed = df.withColumn(hash_name, keyed_hash(seed, key)).withColumn(block, F.substring(hash_name, 1, digits))
    counts = hashed.groupBy(block).agg(F.count("*").alias("_rows"))
    offsets = block_offsets(counts, [], block, "_rows").withColumnRenamed("_before", before)
    inside = F.row_number().over(Window.partitionBy(block).orderBy(hash_name))
    return (
        hashed.withColumn(place, inside)
        .join(offsets, block)
        .withColumn(out, (F.col(before) + F.col(place) - 1).cast("bigint"))
        .drop(hash_name, block, place, before)
    )


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in any total order, written in sorted ranges, with range ``_part`` and place ``_inside``.

    Range bounds come from sampling, so the sorted rows are written to the
    shared folder before anything is counted: all that follows must see the
    same ranges. Pass narrow rows and join wide ones back.
    """
    return written_in_place(df.repartitionByRange(*order).sortWithinPartitions(*order))


def written_in_place(df: DataFrame) -> DataFrame:
    """Rows as they lie, written once, with their partition ``_part`` and place ``_inside`` it."""
    placed = cut_lineage(df.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).withColumn("_inside", inside).drop("_place")


def numbered(placed: DataFrame, out: str = "row_index") -> DataFrame:
    """Row number 0..n-1 of rows with ``_part`` and ``_inside``. There is one offset per part."""
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = block_offsets(counts, [], "_part", "_rows")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_inside", "_before")
    )


def global_index(df: DataFrame, *order: Column | str, out: str = "row_index") -> DataFrame:
    """Row number 0..n-1 in any total order: one range shuffle and a sort inside each range."""
    return numbered(in_order(df, *order), out)


def same_group(group: Sequence[str], prefix: str) -> Column:
    """Equality with the renamed group columns of another side; null is a group."""
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{prefix}{g}"))
    return same


def group_rank(df: DataFrame, order: str, group: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Rank 0..n-1 inside each group by a column that is unique in its group, dense or sparse.

    Rows are numbered over all groups, and a group's first number is taken off,
    so a group of any size is spread over as many ranges as it needs.
    """
    index = global_index(df, *group, order, out="_index")
    if not group:
        return index.withColumnRenamed("_index", out)
    firsts = index.groupBy(*group).agg(F.min("_index").alias("_first"))
    firsts = firsts.select(*[F.col(g).alias(f"_of_{g}") for g in group], "_first")
    ranked = index.join(firsts, same_group(group, "_of_"))
    return ranked.withColumn(out, F.col("_index") - F.col("_first")).select(*df.columns, out)


def group_running_sum(
    df: DataFrame, value: str, order: str, group: Sequence[str] = (), out: str = "running"
) -> DataFrame:
    """Running total up to and including each row of its group.

    A group that lies on several ranges is summed range by range; only one
    total per group and range is added up along the order.
    """
    placed = in_order(df, *group, order)
    totals = placed.groupBy(*group, "_part").agg(F.sum(value).cast("bigint").alias("_rows"))
    offsets = block_offsets(totals, group, "_part", "_rows")
    offsets = offsets.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part").alias("_of__part"), "_before")
    frame = Window.partitionBy(*group, "_part").orderBy("_inside").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_sum", F.sum(value).over(frame))
        .join(offsets, same_group([*group, "_part"], "_of_"))
        .withColumn(out, (F.col("_before") + F.col("_sum")).cast("bigint"))
        .select(*df.columns, out)
    )


def scan_index(df: DataFrame, file: str = "source_file", row: str = "source_row", out: str = "row_index") -> DataFrame:
    """Row number in file order, for unfiltered rows that carry file and row.

    A file's offset is the number of rows in earlier files: one row per file,
    joined as its size allows.
    """
    counts = df.groupBy(file).agg(F.count("*").alias("_rows"))
    offsets = block_offsets(counts, [], file, "_rows")
    return df.join(offsets, file).withColumn(out, F.col("_before") + F.col(row)).drop("_before")


def scan_blocks(df: DataFrame, file: str = "source_file", row: str = "source_row") -> DataFrame:
    """``file, _block, _rows, _before, _whole`` of every run of ``BLOCK_ROWS`` rows of a file.

    Counts whatever rows ``df`` has left, so filtered scans are numbered by what
    they keep; ``_whole`` says that no row is missing before the block's last.
    """
    block = F.floor(F.col(row) / BLOCK_ROWS).cast("bigint").alias("_block")
    counts = df.groupBy(file, block).agg(F.count("*").alias("_rows"), F.max(row).alias("_last"))
    files = counts.groupBy(file).agg(F.sum("_rows").alias("_rows"))
    starts = block_offsets(files, [], file, "_rows").withColumnRenamed("_before", "_start")
    inside = block_offsets(counts, [file], "_block", "_rows")
    return counts.join(inside, [file, "_block"]).join(starts, file).select(
        file, "_block", "_rows", (F.col("_start") + F.col("_before")).alias("_before"),
        (F.col("_last") - F.col("_block") * BLOCK_ROWS + 1 == F.col("_rows")).alias("_whole"),
    )


def scan_slice(
    df: DataFrame, start: int, length: int, file: str = "source_file", row: str = "source_row", out: str = "row_index"
) -> DataFrame:
    """Rows with scan numbers ``[start, start + length)``, filtered or not; too few are an error.

    Counting reads no column but those of the filter. The blocks that hold the
    slice, a list no longer than the slice asks for, name the files to read;
    the scan skips all others. Rows of whole blocks have their number from the
    file; only where rows are missing are they ranked inside their block.
    """
    end = start + length
    blocks = scan_blocks(df.select(file, row), file, row)
    found = blocks.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    if found < end:
        raise ValueError(f"rows [{start}, {end}) requested, {max(0, found - start)} found")
    held = blocks.where((F.col("_before") < end) & (F.col("_before") + F.col("_rows") > start)).collect()
    spark = df.sparkSession
    files = sorted({r[file] for r in held})
    offsets = spark.createDataFrame(
        [(r[file], r["_block"], r["_before"]) for r in held], f"`{file}` string, _block bigint, _before bigint"
    )
    part = df.where(F.col(file).isin(files)) if files else df.where(F.lit(False))
    part = part.withColumn("_block", F.floor(F.col(row) / BLOCK_ROWS).cast("bigint"))
    # Joined first, so that only rows of blocks that hold the slice are ever shuffled.
    part = part.join(F.broadcast(offsets), [file, "_block"])
    if all(r["_whole"] for r in held):
        inside = F.col(row) - F.col("_block") * BLOCK_ROWS
    else:
        inside = F.row_number().over(Window.partitionBy(file, "_block").orderBy(row)) - 1
    ranked = part.withColumn(out, (F.col("_before") + inside).cast("bigint"))
    return ranked.where(F.col(out).between(start, end - 1)).select(*df.columns, out)


def chunk_id(index: Column | str, chunk_rows: int) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.floor(index / F.lit(chunk_rows)).cast("bigint")
