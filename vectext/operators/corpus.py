"""Corpus filter: quality rules, first-wins dedup, first N survivors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from vectext import fixed_values as fx
from vectext.functions import text as tx
from vectext.functions.keys import free_name, text_key
from vectext.operators.index import BLOCK_ROWS, scan_blocks
from vectext.operators.lookups import first_per_key
from vectext.session import cut_lineage


def with_reject_reason(
    df: DataFrame, rules: tx.QualityRules = tx.QualityRules(), text: str = "text", score: str = "score"
) -> DataFrame:
    """Rows with the first rule they fail, null where they pass.

    The reason comes out of a generator, one row per row, so that a filter on
    it runs where it is written and not a second time inside the scan.
    """
    if score not in df.columns:
        df = df.withColumn(score, F.lit(None).cast("string"))
    reason = tx.reject_reason(F.col(text), F.col(score), rules)
    return df.select("*", F.explode(F.array(reason)).alias("reject_reason"))


def passing(
    df: DataFrame, rules: tx.QualityRules = tx.QualityRules(), text: str = "text", score: str = "score"
) -> DataFrame:
    return with_reject_reason(df, rules, text, score).where("reject_reason is null").drop("reject_reason")


def dedup_prefix(
    df: DataFrame, order: Sequence[str], text: str = "text", chars: int | None = fx.PREFIX_CHARS
) -> DataFrame:
    """First row in ``order`` per opening of ``chars`` characters, or per whole text if None.

    The default is a quick rule: texts that differ only behind their opening
    count as one.

    Copies are combined on the map side, so a text that makes up a third of the
    corpus reaches its reducer as one row per map task.
    """
    key = free_name(df, "_key")
    keyed = df.withColumn(key, text_key(tx.prefix_key(F.col(text), chars)))
    return first_per_key(keyed, [key], order).select(*df.columns)


def first_n(
    df: DataFrame, n: int, file: str = "source_file", row: str = "source_row", strict: bool = True
) -> DataFrame:
    """The first ``n`` rows in scan order; fewer rows are an error when ``strict``.

    The rows are written once. Only (file, row) pairs are counted, per block of
    a file; the block the cut falls in is the only one that is sorted, and the
    result is a plain filter on file and row.
    """
    return first_written(cut_lineage(df), n, file, row, strict)


def first_written(df: DataFrame, n: int, file: str, row: str, strict: bool) -> DataFrame:
    """As :func:`first_n`, for rows that are written already."""
    blocks = scan_blocks(df.select(file, row), file, row)
    before = F.col("_before")
    edge = blocks.where((before < n) & (before + F.col("_rows") >= n)).first()
    if edge is None:
        have = df.count()
        if strict and have < n:
            raise ValueError(f"only {have} of {n} rows passed")
        return df if n else df.limit(0)
    inside = (F.col(file) == edge[file]) & (F.floor(F.col(row) / BLOCK_ROWS) == edge["_block"])
    last = df.where(inside).select(row).orderBy(row).limit(n - edge["_before"]).agg(F.max(row)).first()[0]
    return df.where((F.col(file) < edge[file]) | ((F.col(file) == edge[file]) & (F.col(row) <= last)))


def first_clean(
    df: DataFrame,
    n: int,
    clean: Callable[[DataFrame], DataFrame],
    file: str = "source_file",
    row: str = "source_row",
    strict: bool = True,
) -> DataFrame:
    """The first ``n`` rows in scan order that ``clean`` keeps, cleaning only as many rows as that takes.

    ``clean`` must decide on a row from it and rows before it alone, as rules
    and first-wins dedup do: then the rows kept of the first rows do not depend
    on the others. Rows are taken in scan order, four times as many each time,
    until enough are kept; files behind them are not read, and what was kept is
    written, not made again.
    """
    counts = df.select(file).groupBy(file).agg(F.count("*").alias("_rows")).orderBy(file).collect()  # one row per file
    total = sum(r["_rows"] for r in counts)
    return first_of(lambda rows: df.where(among_first(counts, rows, file, row)), total, n, clean, file, row, strict)


def first_of(
    take: Callable[[int], DataFrame], total: int, n: int, clean: Callable[[DataFrame], DataFrame],
    file: str = "source_file", row: str = "source_row", strict: bool = True,
) -> DataFrame:
    """As :func:`first_clean`, of a source of ``total`` rows of which ``take`` gives the first ones."""
    want = 2 * n
    while want < total:
        kept = cut_lineage(clean(take(want)))
        if kept.count() >= n:
            return first_written(kept, n, file, row, strict)
        want *= 4
    return first_n(clean(take(total)), n, file, row, strict)


def among_first(counts: Sequence[Row], rows: int, file: str, row: str) -> Column:
    """Whether a row is in the first files that hold ``rows`` rows, or in their share of the last of these."""
    whole = []
    for r in counts:
        if rows < r["_rows"]:
            return F.col(file).isin(whole) | ((F.col(file) == r[file]) & (F.col(row) < rows))
        whole.append(r[file])
        rows -= r["_rows"]
    return F.col(file).isin(whole)


def clean_corpus(
    df: DataFrame,
    order: Sequence[str],
    rules: tx.QualityRules = tx.QualityRules(),
    text: str = "text",
    score: str = "score",
    chars: int | None = fx.PREFIX_CHARS,
) -> DataFrame:
    """Rows that pass every rule, one per opening text, score as fixed decimals."""
    kept = dedup_prefix(passing(df, rules, text, score), order, text, chars)
    return kept.withColumn(score, tx.score_text(F.col(score))) if score in df.columns else kept
