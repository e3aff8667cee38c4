"""Checks and merges over manifests of table shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from vectext.functions.keys import dataset_id

AGREEING = ["base_model", "layer_index", "d_model", "norm", "corpus", "positions_per_doc"]


def shard_contiguity(shards: DataFrame) -> DataFrame:
    """Shards in order of their start, each with the gap (or overlap) that follows.

    One row per shard, so the single ordered window stays small.
    """
    following = F.lead("start").over(Window.orderBy("start"))
    gap = following - (F.col("start") + F.col("length"))
    return shards.withColumn("gap", gap).withColumn(
        "verdict", F.when(gap > 0, "gap").when(gap < 0, "overlap").otherwise("ok")
    )


def merge_manifests(shards: DataFrame, fields: Sequence[str] = tuple(AGREEING)) -> DataFrame:
    """The manifest of the union, with what would forbid the merge."""
    end = F.max(F.col("start") + F.col("length"))
    differing = F.filter(
        F.array(*[F.when(F.count_distinct(f) > 1, F.lit(f)) for f in fields]), lambda f: f.isNotNull()
    )
    merged = shards.agg(
        F.count("*").alias("shards"),
        F.min("start").alias("start"),
        F.sum("length").cast("bigint").alias("length"),
        end.alias("end"),
        F.sum("row_count").cast("bigint").alias("row_count"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("start", "dataset_id"))), lambda s: s["dataset_id"]), ","
        ).alias("parents"),
        F.array_join(differing, ",").alias("differing_fields"),
        F.first("base_model").alias("base_model"),
        F.first("layer_index").alias("layer_index"),
        F.first("corpus").alias("corpus"),
    )
    new_id = dataset_id(F.col("base_model"), F.col("layer_index"), F.col("corpus"), F.col("start"), F.col("length"))
    return (
        merged.withColumn("contiguous", F.col("end") - F.col("start") == F.col("length"))
        .withColumn("dataset_id", new_id)
        .drop("end", "base_model", "layer_index", "corpus")
    )


def merge_shards(tables: Sequence[DataFrame], shards: DataFrame) -> DataFrame:
    """Union of shard tables after their manifests agree, touch and add up."""
    faults = shard_contiguity(shards).where("verdict <> 'ok'").count()
    merged = merge_manifests(shards).first()
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    rows = union.count()
    if faults or not merged["contiguous"]:
        raise ValueError("shards are not contiguous")
    if merged["differing_fields"]:
        raise ValueError(f"shards differ in {merged['differing_fields']}")
    if rows != merged["row_count"]:
        raise ValueError(f"{rows} rows in the shards, {merged['row_count']} in their manifests")
    return union
