"""Parquet scans with lineage, row slices, sinks and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectext import fixed_values as fx
from vectext.operators.index import scan_slice


#: Splits that an error names.
NAMED_SPLITS = 20


def read_corpus(
    spark: SparkSession,
    paths: Sequence[str] | str,
    text: str = "text",
    score: str | None = None,
    merge_schema: bool = False,
) -> DataFrame:
    """Text (and score, where the files have it) with source file and row.

    ``paths`` may hold globs. Only these columns are read. Set ``merge_schema``
    where only some files have a score; it reads every file's footer.
    """
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    df = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    if text not in df.columns:
        raise ValueError(f"text column {text!r} not found; available: {', '.join(df.columns)}")
    columns = [F.col(text)]
    if score is not None and score in df.columns:
        columns.append(F.col(score).cast("string").alias(score))
    return df.select(*columns, *lineage())


def lineage() -> tuple[Column, Column]:
    """Source file and row number in that file, as the parquet reader knows them."""
    return (
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.row_index").alias("source_row"),
    )


def ingest_slice(
    spark: SparkSession, path: str, split: str, start: int, length: int, text: str = "text", split_column: str = "split"
) -> DataFrame:
    """Rows ``[start, start + length)`` of one split of an outside dataset.

    Rows are numbered among those of the split, in scan order, so files may mix
    splits. A split or text column that is not there is an error.
    """
    df = require_columns(spark.read.parquet(path), [text, split_column])
    rows = df.where(F.col(split_column) == split).select(text, *lineage())
    if rows.isEmpty():
        known = [str(r[0]) for r in df.select(split_column).distinct().limit(NAMED_SPLITS).collect()]
        raise ValueError(f"split {split!r} not found; available, among others: {', '.join(sorted(known))}")
    return scan_slice(rows, start, length).select(text, "row_index")


def read_slice(df: DataFrame, start: int, length: int, index: str = "row_index") -> DataFrame:
    """Rows ``[start, start + length)`` of an indexed table; a short table is an error."""
    part = df.where(F.col(index).between(start, start + length - 1))
    found = part.count()
    if found != length:
        raise ValueError(f"rows [{start}, {start + length}) requested, {found} found")
    return part


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail where a table that must hold rows holds none."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {', '.join(df.columns)}")
    return df


def write_table(df: DataFrame, path: str, rows_per_file: int = fx.ROWS_PER_FILE, mode: str = "errorifexists") -> None:
    """Parquet with bounded files; Spark's committer publishes all files or none."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", rows_per_file: int = fx.ROWS_PER_FILE) -> None:
    """One folder per split in one pass, without a shuffle."""
    df.write.partitionBy(split).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_rejects(df: DataFrame, path: str) -> None:
    """Rejected rows as JSON lines."""
    df.write.option("ignoreNullFields", "false").json(path)


def union_shards(*shards: DataFrame) -> DataFrame:
    merged = shards[0]
    for shard in shards[1:]:
        merged = merged.unionByName(shard)
    return merged
