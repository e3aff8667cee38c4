"""Row order and placement: shuffles, permutations, batches, groups, shards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectext.functions.keys import free_name, hash_number, keyed_hash
from vectext.operators.index import global_index, group_rank, hash_rank
from vectext.session import cut_lineage


def shuffle_rows(
    df: DataFrame, key: Column | str, seed: int = 42, dataset: str = "", partitions: int | None = None
) -> DataFrame:
    """All rows in the order of a hash of (seed, dataset, unique key).

    Hashes are even, so the leading digits give the partition directly: one
    shuffle into equal parts and a sort inside them, without the extra pass
    over the table that sampling range bounds would take.
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = free_name(df, "_hash")
    hashed = df.withColumn(name, keyed_hash(f"{seed}|{dataset}", key))
    part = F.floor(hash_number(F.col(name), 7) * partitions / 16**7).cast("int")
    return hashed.repartitionById(partitions, part).sortWithinPartitions(name).drop(name)


def permute_column(df: DataFrame, key: str, column: str, seed: int = 42, dataset: str = "") -> DataFrame:
    """The same rows with one column permuted across them.

    The row of rank r in one hash order gets the value of the row of rank r in
    another. Rows get a written number first, which tells rows of one key
    apart; ranks are computed on keys and numbers alone. The wide column moves
    once to meet its new number and once to meet its new row.
    """
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))

    def ranks(role: str, name: str) -> DataFrame:
        order = f"{seed}|{dataset}|{role}"
        hashed = rows.select(F.col("_row").alias(name), keyed_hash(order, key).alias("_hash"), keyed_hash(order, "_row").alias("_tie"))
        return global_index(hashed, "_hash", "_tie", out="rank").select("rank", name)

    pairs = ranks("row", "_row").join(ranks("activ", "_from"), "rank").drop("rank")
    values = rows.select(F.col("_row").alias("_from"), F.col(column).alias("_value"))
    moved = pairs.join(values, "_from").drop("_from")
    kept = rows.drop(column).join(moved, "_row").withColumnRenamed("_value", column)
    return kept.select(*df.columns)


def attach_by_rank(df: DataFrame, other: DataFrame, rank: str, how: str = "inner") -> DataFrame:
    """Rows of two indexed tables side by side, row i with row i."""
    return df.join(other, rank, how)


# -------------------------------------------------------------- epochs, batches


@dataclass
class DrawState:
    """How far draws have got: the epoch and the rows drawn in it."""

    size: int
    epoch: int = 0
    offset: int = 0

    @property
    def position(self) -> int:
        return self.epoch * self.size + self.offset

    def draw(self, n: int) -> tuple[int, int]:
        """Range of draw positions for the next ``n`` rows; wraps to new epochs."""
        start = self.position
        end = start + n
        if n > 0:
            self.epoch = (end - 1) // self.size
            self.offset = end - self.epoch * self.size
        return start, end

    def push_back(self, n: int) -> None:
        """Give back the last ``n`` rows, at most to the start of the epoch."""
        self.offset = max(0, self.offset - n)


def epoch_order(df: DataFrame, key: str, epoch: int, rows: int, seed: int | None = 42) -> DataFrame:
    """Rows with their draw position in one epoch, permuted by (seed + epoch).

    Without a seed every epoch keeps the order of ``key``, a row index.
    """
    if seed is None:
        ranked = group_rank(df, key, out="_rank")
    else:
        ranked = hash_rank(df, seed + epoch, key, out="_rank", rows=rows)
    return ranked.withColumn("epoch", F.lit(epoch).cast("bigint")).withColumn(
        "draw", F.col("_rank") + F.lit(epoch * rows)
    ).drop("_rank")


def epoch_batches(
    df: DataFrame, key: str, rows: int, batch: int, epochs: Sequence[int], seed: int | None = 42
) -> DataFrame:
    """Fixed-size batches that run on from one epoch into the next."""
    orders = [epoch_order(df, key, e, rows, seed) for e in epochs]
    drawn = orders[0]
    for order in orders[1:]:
        drawn = drawn.unionByName(order)
    return drawn.withColumn("batch", F.floor(F.col("draw") / batch).cast("bigint"))


def fan_out(df: DataFrame, samples: int, order: str) -> DataFrame:
    """Every prompt ``samples`` times, with group and running sample numbers."""
    copy = free_name(df, "_copy")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint")))
    return (
        df.withColumn(copy, copies)
        .withColumn("group_index", F.col(order))
        .withColumn("index", F.col(order) * samples + F.col(copy))
        .drop(copy)
    )


# ------------------------------------------------------------- groups and shards


def equal_size(df: DataFrame, group: str, micro_batch: int | None = None) -> int:
    """Rows every group keeps: the smallest group, whole micro-batches only."""
    least = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    keep = least if micro_batch is None else least // micro_batch * micro_batch
    if keep == 0:
        raise ValueError("a group has too few rows for one micro-batch")
    return keep


def equalize_groups(df: DataFrame, group: str, order: str, micro_batch: int | None = None) -> DataFrame:
    """The first rows of every group, the same number in each.

    Rows are ranked on (group, order) alone; each group's last kept ``order``
    is then a filter on the rows, which stay where they are.
    """
    keep = equal_size(df, group, micro_batch)
    ranked = group_rank(df.select(group, order), order, [group], "_rank")
    last = ranked.where(F.col("_rank") == keep - 1).select(F.col(group).alias("_of"), F.col(order).alias("_last"))
    kept = df.join(last, F.col(group).eqNullSafe(F.col("_of")))
    return kept.where(F.col(order) <= F.col("_last")).select(*df.columns)


def round_robin(df: DataFrame, part: str, targets: int) -> DataFrame:
    """Target r takes the source parts r, r + targets, r + 2 * targets, ..."""
    return df.withColumn("target", F.pmod(F.col(part), F.lit(targets)).cast("bigint"))


def repartition_round_robin(df: DataFrame, part: str, targets: int) -> DataFrame:
    """As :func:`round_robin`, with partition r holding exactly target r."""
    return round_robin(df, part, targets).repartitionById(targets, F.col("target").cast("int"))


def shard_plan(spark: SparkSession, start: int, length: int, shards: int) -> DataFrame:
    """Even contiguous ranges; the last shard takes the remainder."""
    each = length // shards
    first = F.lit(start) + F.col("id") * each
    rest = F.lit(start + length) - first
    size = F.when(F.col("id") == shards - 1, rest).otherwise(F.lit(each))
    return spark.range(shards).select(
        F.col("id").alias("shard"), first.cast("bigint").alias("start"), size.cast("bigint").alias("length")
    )


def shard_of(index: Column, start: int, length: int, shards: int) -> Column:
    """Shard an index falls in under :func:`shard_plan`."""
    each = length // shards
    if each == 0:
        return F.lit(shards - 1).cast("bigint")
    return F.least(F.floor((index - start) / each), F.lit(shards - 1)).cast("bigint")


def head_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in an order: the best of each partition meet, not all rows."""
    return df.orderBy(*order).limit(n)
