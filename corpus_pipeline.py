"""A corpus run from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectext.llm import exact_dedup, mixing, packing, quality, queries, simhash
from vectext.llm.streams import free_name
from vectext.session import CUTS, drop_cuts, new_shared_path, use_own_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(run: Stage) -> Stage:
    """A stage that also runs on a one-machine session without a shared folder."""

    @wraps(run)
    def prepared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        use_own_folder(spark)
        return run(spark, docs, sf_dir)

    return prepared


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the others go."""
    votes = queries.quality_votes(spark, docs, sf_dir)
    score = free_name(docs, "_score")
    return quality.with_quality(docs, votes, out=score).where(F.col(score) >= queries.ACCEPT).drop(score)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of fingerprints linked at 3 or fewer differing bits the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; small sources again, within the repetition limit."""
    places, _ = mixing.mix_sources(docs, max_passes=queries.MAX_PASSES)
    return mixing.mixed_rows(docs, places)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "bytes", end_id=2, capacity=1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality_votes", keep_quality),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("temperature_mix", mix),
    ("best_fit_packing", pack),
]

#: SimHash, neighbour votes and tokens have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    use_own_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, run_stage in STAGES:
        path, cuts = new_shared_path(spark, f"stage-{name}"), len(CUTS)
        result = run_stage(spark, docs, sf_dir)
        result.write.parquet(path)
        drop_cuts(spark, cuts)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
