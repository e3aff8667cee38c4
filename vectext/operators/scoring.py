"""Rollout status, rewards, advantages and vector metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vectext import fixed_values as fx
from vectext.functions import text as tx, tokens as tk, vectors as vx
from vectext.operators.lookups import group_stats_join
from vectext.session import cut_lineage

#: Cells of a dense block, 4 MB of doubles.
BLOCK_CELLS = 1 << 19


# ----------------------------------------------------------------- generations


def generation_status(
    df: DataFrame,
    max_tokens: int = fx.MAX_CRITIC_TOKENS,
    max_new: int | None = None,
    template: str = fx.CRITIC_TEMPLATE,
) -> DataFrame:
    """Final status of a generation and whether its length is suspect.

    Only completed generations whose tags parse and whose critic prompt fits
    count; a truncated one fails even with tags. More log-probs than the token
    cap is flagged and kept, none at all is an error.
    """

    def judged(explanation: Column) -> Column:
        length = tk.token_count(tx.fill_template(template, explanation))
        failed = explanation.isNull() | (F.col("status") == "truncated") | (length > max_tokens)
        status = F.when(failed, "failed").otherwise(F.col("status"))
        return F.struct(explanation.alias("explanation"), status.alias("final_status"))

    # A generator parses each response once; see clean_responses.
    parsed = F.array(tx.extract_explanation(F.col("response")))
    out = df.select("*", F.inline(F.transform(parsed, judged)))
    if "n_logprobs" not in df.columns:
        return out
    fault = F.raise_error(F.lit("a generation came without log-probs")).cast("string")
    out = out.withColumn("final_status", F.when(F.col("n_logprobs") > 0, F.col("final_status")).otherwise(fault))
    over = F.lit(False) if max_new is None else F.col("n_logprobs") > max_new
    return out.withColumn("length_anomaly", over)


def reward_rows(
    df: DataFrame, scale: float | None, pred: str = "predicted", gold: str = "activation_vector", log_form: bool = False
) -> DataFrame:
    """Error and reward of completed rows; the fixed penalty for all others."""
    mse = F.when(F.col("final_status") == "completed", vx.scaled_mse(F.col(pred), F.col(gold), scale))
    return df.withColumn("mse", mse).withColumn("reward", vx.reward(F.col("mse"), log_form))


def scatter_rewards(samples: DataFrame, scored: DataFrame, index: str = "index", default: float = fx.FAILED_REWARD) -> DataFrame:
    """Rewards back on all samples by index; samples without a score get the default."""
    joined = samples.join(scored.select(index, "reward"), index, "left")
    return joined.withColumn("reward", F.coalesce("reward", F.lit(float(default))))


def group_advantage(df: DataFrame, group: str, index: str, eps: float = 1e-6) -> DataFrame:
    """Reward against its group's mean, in units of the group's deviation."""
    stats = [F.avg("reward").alias("_mean"), F.coalesce(F.stddev_samp("reward"), F.lit(0.0)).alias("_std")]
    joined = group_stats_join(df, group, [index], stats)
    gain = (F.col("reward") - F.col("_mean")) / (F.col("_std") + F.lit(eps))
    return joined.withColumn("advantage", gain).drop("_mean", "_std")


# --------------------------------------------------------------------- vectors


def vector_guard(df: DataFrame, width: int, vector: str = "activation_vector") -> DataFrame:
    """Counts of rows that are unfit as vectors, and whether all cells add up."""
    size = F.coalesce(F.size(vector), F.lit(0))
    finite = F.coalesce(vx.is_finite(F.col(vector)), F.lit(False))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(~vx.has_width(F.col(vector), width)).alias("wrong_width"),
        F.count_if(~finite).alias("not_finite"),
        (F.sum(size).cast("bigint") == F.count("*") * width).alias("cells_add_up"),
    )


def require_vectors(df: DataFrame, width: int, vector: str = "activation_vector") -> DataFrame:
    """The rows, or an error at the first vector of wrong width or with NaN or infinity."""
    fit = vx.has_width(F.col(vector), width) & vx.is_finite(F.col(vector))
    fault = F.raise_error(F.lit(f"a vector is not {width} finite values")).cast(df.schema[vector].dataType)
    return df.withColumn(vector, F.when(fit, F.col(vector)).otherwise(fault))


def vector_moments(df: DataFrame, scale: float | None = None, vector: str = "activation_vector") -> DataFrame:
    """Sum, sum of squares and rows per vector position, in one pass.

    A task adds whole batches of vectors up in dense buffers and passes on one
    row per position, whatever the number of vectors; vectors may differ in
    length, null cells count for nothing. The scale is a number per row.
    """
    scaled = df.select(F.col(vector).cast("array<double>").alias("v"), vx.scale_factor(F.col(vector), scale).cast("double").alias("f"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 0))
        for batch in batches:
            vectors = batch.column("v")
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cells = vectors.flatten()
            known = cells.is_valid().to_numpy(zero_copy_only=False)
            factor = batch.column("f").to_numpy(zero_copy_only=False)
            x = (cells.to_numpy(zero_copy_only=False) * np.repeat(factor, sizes))[known]
            place = (np.arange(len(cells)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[known]
            width = int(place.max()) + 1 if len(place) else 0
            if width > sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, width - sums.shape[1])))
            for k, weights in enumerate((x, x * x, None)):
                sums[k, :width] += np.bincount(place, weights, minlength=width)
        kept = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([
            pa.array(kept.astype(np.int32)), *[pa.array(s[kept]) for s in sums[:2]], pa.array(sums[2, kept].astype(np.int64)),
        ], names=["position", "total", "squares", "n"])

    partial = scaled.mapInArrow(add_up, "position int, total double, squares double, n bigint")
    return partial.groupBy("position").agg(*[F.sum(c).alias(c) for c in ("total", "squares", "n")])


def mean_vector(df: DataFrame, vector: str = "activation_vector") -> DataFrame:
    """Element-wise mean, one row per position."""
    return vector_moments(df, None, vector).select("position", (F.col("total") / F.col("n")).alias("mean"))


def mean_baselines(df: DataFrame, scale: float | None, vector: str = "activation_vector") -> DataFrame:
    """Errors of always predicting the mean: against the mean set to ``scale``
    and against the mean itself.

    Both follow from the moments of the scaled vectors, so the table is read
    once, every row of it, and the mean is never sent back to the rows.
    """
    moments = vector_moments(df, scale, vector)
    mean = F.col("total") / F.col("n")
    sums = moments.agg(
        F.count("*").alias("d"),
        F.sum(F.col("squares") / F.col("n")).alias("m2"),
        F.sum(mean * mean).alias("mu2"),
        F.max("n").alias("rows"),
    )
    if scale is None:
        factor = F.lit(1.0)
    else:
        factor = F.lit(scale) / F.greatest(F.sqrt("mu2"), F.lit(fx.NORM_FLOOR))
    cross = factor * F.col("mu2")
    return sums.select(
        "rows",
        ((F.col("m2") - 2 * cross + factor * cross) / F.col("d")).alias("mean_norm_baseline"),
        ((F.col("m2") - F.col("mu2")) / F.col("d")).alias("raw_variance_baseline"),
    )


def explained_variance(mse: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, 1.0 - mse / baseline)


def loss_metrics(
    df: DataFrame,
    scale: float | None,
    pred: str = "predicted",
    gold: str = "activation_vector",
    baseline: float | None = None,
) -> DataFrame:
    """Sums a trainer logs: loss per row, lengths of predicted and gold vectors.

    With a ``baseline`` error also the explained variance, times the rows.
    """
    sums = df.agg(
        F.count("*").alias("rows"),
        F.sum(vx.scaled_mse(F.col(pred), F.col(gold), scale)).alias("loss"),
        F.sum(vx.norm(F.col(pred))).alias("pred_norm_raw"),
        F.sum(vx.norm(F.col(gold))).alias("gold_norm_raw"),
        (F.count("*") * F.lit(-1.0 if scale is None else float(scale))).alias("mse_scale"),
    )
    if baseline is None or baseline <= 0:
        return sums
    share = explained_variance(F.col("loss") / F.col("rows"), F.lit(baseline))
    return sums.withColumn("fve", share * F.col("rows"))


def logprob_mismatch(df: DataFrame, train: str = "train_lp", rollout: str = "rollout_lp") -> DataFrame:
    """Per-token ratio, its distance from 1 and the k3 divergence estimate."""
    gap = F.col(train) - F.col(rollout)
    ratio = F.exp(gap)
    return (
        df.withColumn("tis", ratio).withColumn("tis_abs", F.abs(ratio - 1)).withColumn("tis_k3", (ratio - 1) - gap)
    )


def score_agreement(df: DataFrame, left: str, right: str, pred_norm: str, width: int, tolerance: float) -> DataFrame:
    """Do two scoring paths agree, and do predictions have a trained head's size?"""
    dev = F.max(F.abs(F.col(left) / F.col(right) - 1))
    size = F.avg(pred_norm) / F.lit(math.sqrt(width))
    return df.agg(
        F.count("*").alias("rows"),
        dev.alias("max_deviation"),
        size.alias("prediction_scale"),
        (dev < tolerance).alias("paths_agree"),
        (size >= fx.UNTRAINED_HEAD_SCALE).alias("head_trained"),
    )


def linear_head(
    df: DataFrame, matrix: DataFrame, key: Sequence[str], vector: str = "vector", out: str = "y", block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """``key, out, y``: every vector times a matrix given as rows (out, in, w), of any size.

    Vectors are stacked into blocks of rows and the matrix into panels of
    outputs, ``block_cells`` cells at most (or one vector); each block meets each
    panel once, in one dense product, so what is shuffled is blocks. The panels
    are repeated over as many parts as cost no more than the vectors do, and
    blocks are dealt over the parts. A missing weight or cell is 0, repeated
    weights add up, cells behind the last ``in`` have no weight; null and empty
    vectors give no rows. Sums are those of a dense product, so their last
    digits depend on the order in which it adds.
    """
    spark = df.sparkSession
    rows = cut_lineage(df.select(F.struct(*key).alias("key"), F.col(vector).cast("array<double>").alias("x")).where(F.size("x") > 0))
    weights = matrix.select(F.col("out").cast("bigint"), F.col("in").cast("bigint"), F.col("w").cast("double"))
    weights = cut_lineage(weights.where("out is not null and `in` >= 0 and w is not null"))
    outs, width = weights.agg(F.count_distinct("out"), F.coalesce(F.max("in") + 1, F.lit(0))).first()
    each = max(1, block_cells // max(1, width))
    panels = math.ceil(outs / each)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / max(1, outs))))
    cells = weights.withColumn("panel", F.pmod(F.xxhash64("out"), F.lit(max(1, panels))).cast("int"))
    dense = cells.groupBy("panel").agg(F.collect_list(F.struct("out", "in", "w")).alias("cells"))
    dense = dense.mapInArrow(dense_panels(width), "outs array<bigint>, w binary")
    dense = dense.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key_type = rows.schema["key"].dataType.simpleString()
    blocks = rows.mapInArrow(stack_rows(width, each), f"block bigint, keys array<{key_type}>, x binary")
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    products = blocks.join(dense, "part").select("keys", "x", "outs", "w").mapInArrow(
        block_product(width), f"keys array<{key_type}>, outs array<bigint>, ys array<array<double>>"
    )
    each_row = products.select("outs", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("ys").alias("ys"))))
    each_cell = each_row.select("key.*", F.inline(F.arrays_zip(F.col("outs").alias("out"), F.col("ys").alias(out))))
    return each_cell.withColumn("out", F.col("out").cast(matrix.schema["out"].dataType)).select(*key, "out", out)


def dense_panels(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells of a panel as a dense matrix, a row an input and a column an output."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in batch.column("cells"):
                out, inner, w = (cells.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                outs, column = np.unique(out, return_inverse=True)
                panel = np.zeros((width, len(outs)))
                np.add.at(panel, (inner, column), w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([outs], pa.list_(pa.int64())), pa.array([panel.tobytes()], pa.binary())], names=["outs", "w"]
                )

    return dense


def stack_rows(width: int, each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors in dense blocks of at most ``each`` rows, cut or filled up with 0 to ``width``."""

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                cells, ends = part.column("x").flatten(), part.column("x").value_lengths().to_numpy().cumsum()
                sizes = np.diff(ends, prepend=0)
                place = np.arange(len(cells)) - np.repeat(ends - sizes, sizes)
                row, values = np.repeat(np.arange(len(sizes)), sizes), cells.fill_null(0.0).to_numpy(zero_copy_only=False)
                x = np.zeros((len(sizes), width))
                inside = place < width
                x[row[inside], place[inside]] = values[inside]
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column("key")]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), keys, pa.array([x.tobytes()], pa.binary())], names=["block", "keys", "x"]
                )
                block += 1

    return stack


def block_product(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Products of blocks and panels that have met, a list of outputs per row of the block."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                met = batch.slice(k, 1)
                outs = met.column("outs")[0].values
                x = np.frombuffer(met.column("x")[0].as_buffer(), dtype=np.float64).reshape(-1, width)
                w = np.frombuffer(met.column("w")[0].as_buffer(), dtype=np.float64).reshape(width, len(outs))
                y = x @ w
                rows = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(y) + 1) * len(outs), pa.int32()), pa.array(y.reshape(-1))
                )
                ys = pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([met.column("keys"), met.column("outs"), ys], names=["keys", "outs", "ys"])

    return multiply
