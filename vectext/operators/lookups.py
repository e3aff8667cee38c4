"""Lookups of one row per key, safe against keys that hold much of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vectext.functions.keys import free_name


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the least ``order`` per key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*")


def lookup_join(rows: DataFrame, table: DataFrame, key: str, spread: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join to a ``table`` with at most one row per key.

    Each row has one partner at most, so a frequent key only makes a large
    partition of ``rows``, which adaptive execution splits at any size, the
    table's side being repeated for the pieces. Null keys have no partner; they
    are spread over all tasks by a hash of the ``spread`` columns.
    """
    share = free_name(rows, free_name(table, "_share"))
    alone = F.when(F.col(key).isNull(), F.xxhash64(*spread)).otherwise(F.lit(0).cast("bigint"))
    return (
        rows.withColumn(share, alone)
        .join(table.withColumn(share, F.lit(0).cast("bigint")), [key, share], how)
        .drop(share)
    )


def group_stats_join(rows: DataFrame, group: str, spread: Sequence[str], stats: Sequence[Column]) -> DataFrame:
    """Rows with aggregates of their group, without gathering a group in one task."""
    return lookup_join(rows, rows.groupBy(group).agg(*stats), group, spread, "inner")
