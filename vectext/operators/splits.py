"""Document-level splits: exact sizes, no document in two splits."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from vectext import fixed_values as fx
from vectext.functions.keys import keyed_hash
from vectext.operators.index import hash_digits
from vectext.session import cut_lineage


def check_fractions(fractions: Mapping[str, float]) -> None:
    if any(f < 0 for f in fractions.values()):
        raise ValueError(f"fractions must not be negative: {dict(fractions)}")
    if abs(sum(fractions.values()) - 1.0) >= 1e-6:
        raise ValueError(f"fractions must sum to 1: {dict(fractions)}")


@dataclass(frozen=True)
class SplitRule:
    """Split of a document by where its keyed hash falls between cut hashes."""

    seed: int
    names: tuple[str, ...]
    cuts: tuple[str | None, ...]

    def column(self, key: Column | str) -> Column:
        digest = keyed_hash(self.seed, key)
        split = F.lit(self.names[-1])
        for name, cut in reversed(list(zip(self.names, self.cuts))):
            below = F.lit(True) if cut is None else digest < F.lit(cut)
            split = F.when(below, name).otherwise(split)
        return split


def split_rule(
    df: DataFrame, key: str, fractions: Mapping[str, float] = fx.SPLIT_FRACTIONS, seed: int = 42
) -> SplitRule:
    """Cut hashes that give every split exactly ``int(n * fraction)`` documents.

    Only keys are read and shuffled. The driver sees one count per hash block
    and one hash per cut; routing rows afterwards is a plain column expression,
    so the wide table is neither shuffled nor joined.
    """
    check_fractions(fractions)
    names = tuple(fractions)
    # Written once: the input runs for this table alone, whatever is counted below.
    docs = cut_lineage(df.select(F.col(key)).distinct().withColumn("_hash", keyed_hash(seed, key)))
    docs = docs.withColumn("_block", F.substring("_hash", 1, hash_digits(docs.count())))
    counts = {r["_block"]: r["n"] for r in docs.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())

    ranks, upto = [], 0
    for name in names[:-1]:
        upto += int(total * fractions[name])
        ranks.append(upto)

    wanted = {}
    for rank in ranks:
        before = 0
        for block in sorted(counts):
            if before <= rank < before + counts[block]:
                wanted[rank] = (block, rank - before + 1)
                break
            before += counts[block]
    found = {}
    if wanted:
        blocks = sorted({block for block, _ in wanted.values()})
        place = F.row_number().over(Window.partitionBy("_block").orderBy("_hash"))
        cut = F.lit(False)
        for block, row in set(wanted.values()):
            cut = cut | ((F.col("_block") == block) & (F.col("_row") == row))
        rows = docs.where(F.col("_block").isin(blocks)).withColumn("_row", place).where(cut).collect()
        found = {(r["_block"], r["_row"]): r["_hash"] for r in rows}
    return SplitRule(seed, names, tuple(found.get(wanted.get(rank)) for rank in ranks))


def split_documents(
    df: DataFrame, key: str = "doc_id", fractions: Mapping[str, float] = fx.SPLIT_FRACTIONS, seed: int = 42
) -> DataFrame:
    """Every row with the split of its document."""
    return df.withColumn("split", split_rule(df, key, fractions, seed).column(key))


def split_counts(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.groupBy("split").agg(F.countDistinct(key).alias("documents"), F.count("*").alias("rows"))


def split_leak(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents found in more than one split."""
    return df.groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")
