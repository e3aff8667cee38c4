"""Resumable jobs over arriving parquet files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vectext import fixed_values as fx
from vectext.functions import text as tx
from vectext.functions.keys import text_key
from vectext.operators.lookups import first_per_key
from vectext.streaming.state import first_rows


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path, not a pattern, is that of a single file, as the session's file systems know it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(found) and system.getFileStatus(found).isFile()


def read_files(spark: SparkSession, folder: str, schema, name: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder, or a single file, as a stream; ``name`` limits it to matching files."""
    if is_file(spark, folder):
        # The source takes a plain path for a folder of partitions; a pattern may be one file's.
        folder = f"{folder[:-1]}[{folder[-1]}]"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name is not None:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder)


def resume_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; a later run takes up where this one ended.

    The checkpoint records finished files and the file sink publishes each
    batch once, so finished work is never redone.
    """
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order: Sequence[str],
    text: str = "text",
    chars: int | None = fx.PREFIX_CHARS,
    time: str | None = None,
    delay_seconds: int = 86_400,
) -> StreamingQuery:
    """Keep the first row in ``order`` per opening text over all batches, all columns.

    The least order of every opening is kept in the state store, so a batch
    reads nothing of what earlier ones have written. A row that comes before one
    already kept is added, and :func:`deduped` then picks it: the result depends
    on the rows alone, not on arrival, and equals the batch operator's. With a
    ``time`` column see :func:`first_rows` for what is late and what is forgotten.
    """
    keyed = stream.withColumn("prefix", text_key(tx.prefix_key(F.col(text), chars)))
    return resume_into(first_rows(keyed, F.col("prefix"), order, time, delay_seconds), path, checkpoint)


def deduped(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame:
    """The rows that :func:`dedup_batches` has kept so far, one per opening text."""
    rows = spark.read.parquet(path).drop("batch")
    return first_per_key(rows, ["prefix"], order).select(*rows.columns)


def each_batch(
    stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """``run(rows, number)`` for every batch; an error fails the batch and the query.

    A batch closes at the source's size limit, or after ``every`` where given.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def batch_path(path: str, number: int) -> str:
    """Folder of one batch: a repeated batch replaces itself and no other."""
    return f"{path.rstrip('/')}/batch={number}"


def score_batches(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Score arriving rows batch by batch into one folder per batch."""

    def run(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(batch_path(path, number))

    return each_batch(stream, run, checkpoint, every)


def explain_batches(
    stream: DataFrame,
    explain: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    path: str,
    rejects_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Explained rows and reject log of every batch of files.

    A run that dies goes on with the batch it was at: finished batches never
    call the provider again.
    """

    def run(batch: DataFrame, number: int) -> None:
        explained, rejected = explain(batch)
        rejected.write.mode("overwrite").option("ignoreNullFields", "false").json(batch_path(rejects_path, number))
        explained.write.mode("overwrite").parquet(batch_path(path, number))

    return each_batch(stream, run, checkpoint)
