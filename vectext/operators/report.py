"""Summaries and report rows over scored rollouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vectext import fixed_values as fx
from vectext.functions import text as tx, vectors as vx
from vectext.functions.keys import has_forbidden, source_label
from vectext.operators.index import global_index


def reward_summary(df: DataFrame, reward: str = "reward") -> DataFrame:
    return df.agg(
        F.count("*").alias("samples"),
        F.avg(reward).alias("mean"),
        F.stddev_pop(reward).alias("std"),
        F.min(reward).alias("least"),
        F.max(reward).alias("greatest"),
    )


def percentiles(
    df: DataFrame, value: str, index: str, percents: Sequence[float] = tuple(fx.REPORT_PERCENTILES)
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row each.

    Values are numbered in order over range partitions and only the two
    neighbours of each percentile are picked; the built-in exact percentile
    would gather all distinct values in one task.
    """
    ordered = global_index(df.select(value, index).where(F.col(value).isNotNull()), value, index, out="_rank")
    n = ordered.count()
    if n == 0:
        raise ValueError("no values")
    places = [(float(p), p / 100 * (n - 1)) for p in percents]
    wanted = df.sparkSession.createDataFrame(
        [(p, int(at), at - int(at), side) for p, at in places for side in (0, 1)],
        "percentile double, _low bigint, _share double, _side int",
    ).withColumn("_rank", F.least(F.col("_low") + F.col("_side"), F.lit(n - 1)))
    low = F.max(F.when(F.col("_side") == 0, F.col(value)))
    high = F.max(F.when(F.col("_side") == 1, F.col(value)))
    return (
        ordered.join(F.broadcast(wanted), "_rank")
        .groupBy("percentile")
        .agg((low + (high - low) * F.max("_share")).alias("value"))
    )


def source_mix(df: DataFrame, group: str, label: Column | None = None) -> DataFrame:
    """Samples and groups per source label, with the mean group size."""
    label = source_label(F.col("doc_id")) if label is None else label
    return (
        df.groupBy(label.alias("source_label"))
        .agg(F.count("*").alias("samples"), F.countDistinct(group).alias("groups"))
        .withColumn("mean_group_size", F.col("samples") / F.col("groups"))
    )


def pick_bands(
    df: DataFrame,
    reward: str,
    index: str,
    n_top: int = fx.REPORT_TOP,
    n_mid: int = fx.REPORT_MID,
    n_bottom: int = fx.REPORT_BOTTOM,
) -> DataFrame:
    """Best, middle and worst samples; one that fits two bands keeps the first.

    Samples are numbered from best to worst over range partitions (ties by
    index), so the bands are plain conditions on that number.
    """
    ranked = global_index(df.select(index, reward), F.col(reward).desc(), F.col(index), out="place")
    n = ranked.count()
    middle = max(0, n // 2 - n_mid // 2)
    band = (
        F.when(F.col("place") < n_top, "top")
        .when((F.col("place") >= middle) & (F.col("place") < middle + n_mid), "middle")
        .when(F.col("place") >= n - n_bottom, "bottom")
    )
    return ranked.withColumn("band", band).where("band is not null")


def report_rows(df: DataFrame, reward: str, index: str, max_chars: int = fx.REPORT_MAX_CHARS, **bands: int) -> DataFrame:
    """Picked samples with shortened source text and explanation body."""
    picked = pick_bands(df, reward, index, **bands)
    shown = df.withColumn("source_text", tx.truncate_note(F.col("detokenized_text_truncated"), max_chars))
    shown = shown.withColumn("explanation", tx.extract_or_all(F.col("response")))
    shown = shown.withColumn("source_label", source_label(F.col("doc_id")))
    if "activation_vector" in df.columns:
        shown = shown.withColumn("vector_norm", vx.norm(F.col("activation_vector")))
    # The picked rows are few by definition (top + middle + bottom).
    return shown.join(F.broadcast(picked.select(index, "band", "place")), index)


def cjk_share(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    hit = F.col(text).rlike("[\\u3200-\\u9fff]").cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(hit).alias("cjk_share"))


def completion_quality(cleaned: DataFrame, setting: str, seconds: Column | None = None) -> DataFrame:
    """Usable, empty and all responses per setting, with the rate per second."""
    out = cleaned.groupBy(setting).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("feature_count") >= fx.MIN_FEATURES).alias("ok"),
        F.count_if(F.col("raw_response").isNull()).alias("none"),
        *([] if seconds is None else [F.max(seconds).alias("seconds")]),
    )
    out = out.withColumn("all_ok", F.col("ok") == F.col("rows"))
    return out if seconds is None else out.withColumn("calls_per_s", F.col("rows") / F.col("seconds"))


def reject_counts(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("reason").agg(F.count("*").alias("rows")).where("reason is not null")


def forbidden_scan(df: DataFrame, hit: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(hit).alias("hits"))


def require_none_forbidden(
    df: DataFrame, text: str, patterns: Sequence[str] = tuple(fx.PRIVATE_PATTERNS)
) -> DataFrame:
    """The rows, or an error at the first text that holds a forbidden pattern."""
    fault = F.raise_error(F.concat(F.lit("forbidden pattern in: "), F.substring(text, 1, 80))).cast("string")
    return df.withColumn(text, F.when(has_forbidden(F.col(text), patterns), fault).otherwise(F.col(text)))


def norm_outliers(
    df: DataFrame, norm: str, position: str, percent: float = 50, factor: float = 10.0, min_position: int = 10, index: str = "index"
) -> DataFrame:
    """Rows flagged as early in their text or far above the usual vector length."""
    usual = percentiles(df, norm, index, [percent]).first()["value"]
    return df.withColumn("too_early", F.col(position) < min_position).withColumn(
        "too_long", F.col(norm) > F.lit(factor * usual)
    )
