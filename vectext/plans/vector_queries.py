"""Queries over vectors, rewards and reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vectext import fixed_values as fx
from vectext.functions import text as tx, vectors as vx
from vectext.functions.keys import keyed_hash, source_label
from vectext.operators import report as rp, scoring as sc
from vectext.plans import inputs as ins
from vectext.plans.registry import query
from vectext.session import cut_lineage
from vectext.sources import tables as tb

SQRT_D = math.sqrt(ins.WIDTH)


# ---------------------------------------------------------------------- vectors


@query(
    "normalize_vectors",
    """WITH cells AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE * label AS x FROM embeddings),
    n AS (SELECT vec_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM cells GROUP BY vec_id)
    SELECT vec_id, round(sqrt(sum((8 * x / n) ** 2)), 6) AS norm, round(sum(i * 8 * x / n), 5) AS weighted FROM cells JOIN n USING (vec_id) GROUP BY vec_id""",
)
def normalize_vectors(spark, folder):
    # Scaled by the label first, so that label 0 gives zero vectors.
    scaled = F.transform("activation_vector", lambda x: x.cast("double") * F.col("label"))
    rows = ins.vectors(spark, folder).select("vec_id", scaled.alias("v"))
    rows = rows.select("vec_id", vx.normalize(F.col("v"), SQRT_D).alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(vx.norm(F.col("v")), 6).alias("norm"), F.round(weighted, 5).alias("weighted"))


@query(
    "vector_guard",
    """SELECT count(*) AS rows, count(*) FILTER (label = 3 OR label = 4) AS wrong_width, count(*) FILTER (label = 5 OR label = 4) AS not_finite,
    false AS cells_add_up FROM embeddings""",
)
def vector_guard(spark, folder):
    v, label = F.col("activation_vector"), F.col("label")
    broken = (
        F.when(label == 3, F.slice(v, 1, 32))
        .when(label == 4, F.lit(None))
        .when(label == 5, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice(v, 2, 63)))
        .otherwise(v)
    )
    return sc.vector_guard(ins.vectors(spark, folder).withColumn("activation_vector", broken), ins.WIDTH)


@query(
    "reshape_vectors",
    """SELECT vec_id, r AS row, round(list_sum(embedding[r * 16 + 1:r * 16 + 16]::DOUBLE[]), 6) AS total, true AS same FROM embeddings, range(4) t(r)""",
)
def reshape_vectors(spark, folder):
    rows = ins.vectors(spark, folder).select("vec_id", "activation_vector", vx.rows_from_flat(
        F.transform("activation_vector", lambda x: x.cast("double")), 16).alias("rows"))
    same = vx.flat_from_rows(F.col("rows")) == F.transform("activation_vector", lambda x: x.cast("double"))
    cells = rows.select("vec_id", same.alias("same"), F.posexplode("rows").alias("row", "cells"))
    total = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x)
    return cells.select("vec_id", F.col("row").cast("bigint").alias("row"), F.round(total, 6).alias("total"), "same")


@query(
    "resolve_scale",
    """WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'raw' WHEN 'error' THEN 'none' WHEN 'signup' THEN 'sqrt_d_model'
      WHEN 'purchase' THEN CAST(value AS VARCHAR) END AS raw, user_id AS width FROM events)
    SELECT event_id, raw, round(CASE WHEN raw IS NULL OR raw IN ('raw', 'none') THEN NULL WHEN raw = 'sqrt_d_model' THEN sqrt(width) ELSE CAST(raw AS DOUBLE) END, 6) AS scale FROM s""",
)
def resolve_scale(spark, folder):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", "raw").when(kind == "error", "none").when(kind == "signup", "sqrt_d_model")
        .when(kind == "purchase", F.col("value").cast("string"))
    )
    settings = ins.table(spark, folder, "events").select("event_id", raw.alias("raw"), "user_id")
    scale = vx.resolve_scale_column(F.col("raw"), F.col("user_id"))
    return settings.select("event_id", "raw", F.round(scale, 6).alias("scale"))


@query(
    "direction_mse",
    f"WITH {ins.CENTROID} SELECT vec_id, round(mse, 6) AS mse, round(pg / sqrt(gg * pp), 6) AS cosine FROM scored",
)
def direction_mse(spark, folder):
    pred, gold = F.col("predicted"), F.col("activation_vector")
    return ins.with_centroid(spark, folder).select(
        "vec_id", F.round(vx.scaled_mse(pred, gold, SQRT_D), 6).alias("mse"), F.round(vx.cosine(pred, gold), 6).alias("cosine")
    )


@query(
    "reward_scores",
    f"""WITH {ins.CENTROID} SELECT vec_id, CASE WHEN label = 9 THEN -2.0::DOUBLE ELSE round(-mse, 6) END AS reward,
    CASE WHEN label = 9 THEN round(-ln(2.0::DOUBLE), 6) ELSE round(-ln(greatest(mse, 1e-8)), 6) END AS log_reward FROM scored""",
)
def reward_scores(spark, folder):
    status = F.when(F.col("label") == 9, "failed").otherwise("completed")
    rows = ins.with_centroid(spark, folder).withColumn("final_status", status)
    plain = sc.reward_rows(rows, SQRT_D)
    return plain.select(
        "vec_id", F.round("reward", 6).alias("reward"), F.round(vx.reward(F.col("mse"), log_form=True), 6).alias("log_reward")
    )


@query(
    "reward_scatter",
    f"WITH {ins.CENTROID} SELECT e.vec_id AS index, coalesce(round(-s.mse, 6), -2.0::DOUBLE) AS reward FROM embeddings e LEFT JOIN (SELECT * FROM scored WHERE substr(sha256('scored|' || vec_id), 1, 1) < 'b') s USING (vec_id)",
)
def reward_scatter(spark, folder):
    samples = ins.vectors(spark, folder).select(F.col("vec_id").alias("index"))
    parsed = ins.with_centroid(spark, folder).where(F.substring(keyed_hash("scored", "vec_id"), 1, 1) < F.lit("b")).withColumn("final_status", F.lit("completed"))
    scored = sc.reward_rows(parsed, SQRT_D).select(F.col("vec_id").alias("index"), "reward")
    return sc.scatter_rewards(samples, scored).withColumn("reward", F.round("reward", 6))


@query(
    "mean_vector",
    "SELECT CAST(i - 1 AS INTEGER) AS position, round(avg(x), 8) AS mean FROM (SELECT unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i",
)
def mean_vector(spark, folder):
    return sc.mean_vector(ins.vectors(spark, folder)).withColumn("mean", F.round("mean", 8))


BASELINES = """cells AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
lens AS (SELECT vec_id, sqrt(sum(x * x)) AS len FROM cells GROUP BY vec_id),
scaled AS (SELECT vec_id, label, i, 8 * x / len AS x FROM cells JOIN lens USING (vec_id)),
mu AS (SELECT i, avg(x) AS m FROM scaled GROUP BY i),
mulen AS (SELECT sqrt(sum(m * m)) AS len FROM mu),
base AS (SELECT count(DISTINCT vec_id) AS rows, avg((x - 8 * m / len) ** 2) AS mean_norm_baseline, avg((x - m) ** 2) AS raw_variance_baseline
  FROM scaled JOIN mu USING (i), mulen)"""


@query(
    "fve_baselines",
    f"WITH {BASELINES} SELECT rows, round(mean_norm_baseline, 6) AS mean_norm_baseline, round(raw_variance_baseline, 6) AS raw_variance_baseline FROM base",
)
def fve_baselines(spark, folder):
    base = sc.mean_baselines(ins.vectors(spark, folder), SQRT_D)
    return base.select(
        "rows", F.round("mean_norm_baseline", 6).alias("mean_norm_baseline"),
        F.round("raw_variance_baseline", 6).alias("raw_variance_baseline"),
    )


@query(
    "fve_by_label",
    f"""WITH {BASELINES}, {ins.CENTROID.replace('cells AS (', 'unused_cells AS (', 1)}
    SELECT label, count(*) AS rows, round(avg(mse), 6) AS mse, round(1 - avg(mse) / (SELECT raw_variance_baseline FROM base), 6) AS fve FROM scored GROUP BY label""",
)
def fve_by_label(spark, folder):
    rows = ins.with_centroid(spark, folder)
    mse = vx.scaled_mse(F.col("predicted"), F.col("activation_vector"), SQRT_D)
    by_label = rows.groupBy("label").agg(F.count("*").alias("rows"), F.avg(mse).alias("mse"))
    baseline = sc.mean_baselines(ins.vectors(spark, folder), SQRT_D).select("raw_variance_baseline")
    fve = sc.explained_variance(F.col("mse"), baseline.scalar())
    return by_label.select("label", "rows", F.round("mse", 6).alias("mse"), F.round(fve, 6).alias("fve"))


@query(
    "loss_metrics",
    f"""WITH {ins.CENTROID} SELECT count(*) AS rows, round(sum(mse), 5) AS loss, round(sum(sqrt(pp)), 5) AS pred_norm_raw,
    round(sum(sqrt(gg)), 5) AS gold_norm_raw, count(*) * 8.0::DOUBLE AS mse_scale FROM scored""",
)
def loss_metrics(spark, folder):
    metrics = sc.loss_metrics(ins.with_centroid(spark, folder), SQRT_D)
    return metrics.select("rows", *[F.round(c, 5).alias(c) for c in ("loss", "pred_norm_raw", "gold_norm_raw")], "mse_scale")


@query(
    "linear_head",
    """WITH cells AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    w AS (SELECT label AS out, i, avg(x) AS w FROM cells GROUP BY ALL),
    y AS (SELECT vec_id, out, sum(w * x) AS y FROM cells JOIN w USING (i) GROUP BY ALL)
    SELECT vec_id, out, round(y, 6) AS y FROM y""",
)
def linear_head(spark, folder):
    rows = ins.vectors(spark, folder)
    # One row of weights per label: its mean vector.
    cells = rows.select("label", F.posexplode("activation_vector").alias("in", "x"))
    matrix = cells.groupBy(F.col("label").alias("out"), "in").agg(F.avg(F.col("x").cast("double")).alias("w"))
    return sc.linear_head(rows, matrix, ["vec_id"], "activation_vector").withColumn("y", F.round("y", 6))


@query(
    "score_agreement",
    # The same scores by two paths; shifted, one path is off on a share of the rows; raw, predictions keep their own size.
    f"""WITH {ins.CENTROID}, cases AS (
      SELECT c AS case_name, mse AS l, CASE WHEN c = 'shifted' AND vec_id % 5 = 0 THEN mse * 1.25 ELSE mse END AS r,
        CASE WHEN c = 'raw' THEN sqrt(pp) ELSE 8.0 END AS size
      FROM scored, (VALUES ('same'), ('shifted'), ('raw')) t(c)),
    s AS (SELECT case_name, count(*) AS rows, max(abs(l / r - 1)) AS dev, avg(size) / 8 AS scale FROM cases GROUP BY case_name)
    SELECT case_name, rows, round(dev, 6) AS max_deviation, round(scale, 6) AS prediction_scale,
      dev < {fx.SCORE_AGREEMENT_TOLERANCE} AS paths_agree, scale >= {fx.UNTRAINED_HEAD_SCALE} AS head_trained FROM s""",
)
def score_agreement(spark, folder):
    rows = ins.with_centroid(spark, folder)
    pred, gold = F.col("predicted"), F.col("activation_vector")
    scaled = rows.select(
        "vec_id", vx.scaled_mse(pred, gold, SQRT_D).alias("reward_mse"), vx.norm(pred).alias("raw_norm"),
        vx.normalize(pred, SQRT_D).alias("p"), vx.normalize(gold, SQRT_D).alias("g"),
    )
    squares = F.aggregate(F.zip_with("p", "g", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    both = cut_lineage(scaled.select(
        "vec_id", "reward_mse", "raw_norm", (squares / F.size("g")).alias("train_mse"), vx.norm(F.col("p")).alias("pred_norm")
    ))
    shift = F.when(F.pmod("vec_id", F.lit(5)) == 0, 1.25).otherwise(1.0)
    cases = {
        "same": both, "shifted": both.withColumn("train_mse", F.col("train_mse") * shift),
        "raw": both.withColumn("pred_norm", F.col("raw_norm")),
    }
    agreed = [
        sc.score_agreement(df, "reward_mse", "train_mse", "pred_norm", ins.WIDTH, fx.SCORE_AGREEMENT_TOLERANCE)
        .withColumn("case_name", F.lit(name))
        for name, df in cases.items()
    ]
    return tb.union_shards(*agreed).withColumn("max_deviation", F.round("max_deviation", 6)).withColumn(
        "prediction_scale", F.round("prediction_scale", 6)
    )


@query(
    "norm_outliers",
    """WITH p AS (SELECT quantile_cont(value, 0.5) AS usual FROM events)
    SELECT event_id, user_id < 10 AS too_early, value > 4 * usual AS too_long FROM events, p""",
)
def norm_outliers(spark, folder):
    rows = ins.table(spark, folder, "events").select("event_id", "value", "user_id")
    flagged = rp.norm_outliers(rows, "value", "user_id", factor=4.0, index="event_id")
    return flagged.select("event_id", "too_early", "too_long")


# --------------------------------------------------------------------- rollouts


@query(
    "reward_summary",
    f"""WITH {ins.ROLLOUTS} SELECT count(*) AS samples, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS std,
    min(reward) AS least, max(reward) AS greatest FROM rollouts""",
)
def reward_summary(spark, folder):
    summary = rp.reward_summary(ins.rollouts(spark, folder))
    return summary.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(
    "reward_percentiles",
    f"""WITH {ins.ROLLOUTS} SELECT p::DOUBLE AS percentile, round(v, 6) AS value FROM (SELECT unnest([10, 25, 50, 75, 90]) AS p,
    unnest(quantile_cont(reward, [0.1, 0.25, 0.5, 0.75, 0.9])) AS v FROM rollouts)""",
)
def reward_percentiles(spark, folder):
    found = rp.percentiles(ins.rollouts(spark, folder), "reward", "index")
    return found.withColumn("value", F.round("value", 6))


@query(
    "source_mix",
    f"""WITH {ins.ROLLOUTS}, l AS (SELECT *, CASE WHEN contains(doc_id, 'WildChat') THEN 'WildChat' WHEN contains(doc_id, 'Ultra-FineWeb') THEN 'UFW' ELSE 'other' END AS source_label FROM rollouts)
    SELECT source_label, count(*) AS samples, count(DISTINCT group_index) AS groups, round(count(*) / count(DISTINCT group_index), 6) AS mean_group_size FROM l GROUP BY source_label""",
)
def source_mix(spark, folder):
    mix = rp.source_mix(ins.rollouts(spark, folder), "group_index")
    return mix.withColumn("mean_group_size", F.round("mean_group_size", 6))


@query(
    "group_advantage",
    f"""WITH {ins.ROLLOUTS}, g AS (SELECT group_index, avg(reward) AS m, stddev_samp(reward) AS s FROM rollouts GROUP BY group_index)
    SELECT index, group_index, round((reward - m) / (coalesce(s, 0) + 1e-6), 6) AS advantage FROM rollouts JOIN g USING (group_index)""",
)
def group_advantage(spark, folder):
    rows = ins.rollouts(spark, folder).select("index", "group_index", "reward")
    gains = sc.group_advantage(rows, "group_index", "index")
    return gains.select("index", "group_index", F.round("advantage", 6).alias("advantage"))


LOGPROBS = "lp AS (SELECT event_id, user_id, -value / 64 AS train_lp, -value / 65 AS rollout_lp FROM events)"


@query(
    "logprob_mismatch",
    f"""WITH {LOGPROBS}, m AS (SELECT user_id, exp(train_lp - rollout_lp) AS r, train_lp - rollout_lp AS d FROM lp)
    SELECT user_id, count(*) AS tokens, round(avg(r), 6) AS tis, round(avg(abs(r - 1)), 6) AS tis_abs, round(avg(r - 1 - d), 6) AS tis_k3 FROM m GROUP BY user_id""",
)
def logprob_mismatch(spark, folder):
    rows = ins.table(spark, folder, "events").select(
        "user_id", (-F.col("value") / 64).alias("train_lp"), (-F.col("value") / 65).alias("rollout_lp")
    )
    means = [F.round(F.avg(c), 6).alias(c) for c in ("tis", "tis_abs", "tis_k3")]
    return sc.logprob_mismatch(rows).groupBy("user_id").agg(F.count("*").alias("tokens"), *means)


@query(
    "pick_top_mid_bottom",
    f"""WITH {ins.ROLLOUTS}, r AS (SELECT index, reward, row_number() OVER (ORDER BY reward DESC, index) - 1 AS place, count(*) OVER () AS n FROM rollouts),
    b AS (SELECT *, CASE WHEN place < 6 THEN 'top' WHEN place >= n // 2 - 4 AND place < n // 2 + 4 THEN 'middle' WHEN place >= n - 6 THEN 'bottom' END AS band FROM r)
    SELECT index, reward, place, band FROM b WHERE band IS NOT NULL""",
)
def pick_top_mid_bottom(spark, folder):
    return rp.pick_bands(ins.rollouts(spark, folder), "reward", "index")


@query(
    "report_rows",
    f"""WITH {ins.GENERATIONS},
    r AS (SELECT doc_id, text, response, explanation, -((n_chars % 997) / 100.0::DOUBLE) AS reward FROM documents JOIN parsed ON index = doc_id),
    k AS (SELECT *, row_number() OVER (ORDER BY reward DESC, doc_id) - 1 AS place, count(*) OVER () AS n FROM r),
    b AS (SELECT *, CASE WHEN place < 6 THEN 'top' WHEN place >= n // 2 - 4 AND place < n // 2 + 4 THEN 'middle' WHEN place >= n - 6 THEN 'bottom' END AS band FROM k)
    SELECT doc_id AS index, place, band, reward, 'other' AS source_label,
      CASE WHEN length(text) > 1800 THEN left(text, 1800) || chr(10) || chr(10) || '[... TRUNCATED: ' || (length(text) - 1800) || ' more chars ...]' ELSE text END AS source_text,
      md5(coalesce(explanation, regexp_replace(response, '^\\s+|\\s+$', '', 'g'))) AS explanation_md5
    FROM b WHERE band IS NOT NULL""",
)
def report_rows(spark, folder):
    texts = ins.table(spark, folder, "documents").select(
        F.col("doc_id").alias("index"), F.col("text").alias("detokenized_text_truncated"),
        (-(F.pmod("n_chars", F.lit(997)) / 100.0)).alias("reward"),
    )
    rows = texts.join(ins.generations(spark, folder).select("index", "response", F.col("source").alias("doc_id")), "index")
    found = rp.report_rows(rows, "reward", "index")
    return found.select(
        "index", "place", "band", "reward", "source_label", "source_text", F.md5("explanation").alias("explanation_md5")
    )


@query(
    "source_labels",
    f"""WITH {ins.ROLLOUTS} SELECT index, CASE WHEN contains(doc_id, 'WildChat') THEN 'WildChat' WHEN contains(doc_id, 'Ultra-FineWeb') THEN 'UFW' ELSE 'other' END AS source_label FROM rollouts""",
)
def source_labels(spark, folder):
    return ins.rollouts(spark, folder).select("index", source_label(F.col("doc_id")).alias("source_label"))


@query(
    "truncate_note",
    """SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN left(text, 300) || chr(10) || chr(10) || '[... TRUNCATED: ' || (length(text) - 300) || ' more chars ...]' ELSE text END) AS shown_md5 FROM documents""",
)
def truncate_note(spark, folder):
    docs = ins.table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(tx.truncate_note(F.col("text"), 300)).alias("shown_md5"))
