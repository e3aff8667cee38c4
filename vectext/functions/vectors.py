"""Vector expressions, in double precision."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from vectext import fixed_values as fx
from vectext.functions.lets import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def square_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(square_sum(v))


def resolve_scale(raw: float | str | None, width: int) -> float | None:
    """A scale setting as a number, or None where vectors stay as they are."""
    if raw is None or raw in fx.SCALE_RAW:
        return None
    return math.sqrt(width) if raw == fx.SCALE_SQRT_WIDTH else float(raw)


def resolve_scale_column(raw: Column, width: Column) -> Column:
    """As :func:`resolve_scale` for a column of settings; bad text is an error."""
    return (
        F.when(raw.isNull() | raw.isin(fx.SCALE_RAW), F.lit(None).cast("double"))
        .when(raw == fx.SCALE_SQRT_WIDTH, F.sqrt(width.cast("double")))
        .otherwise(raw.cast("double"))
    )


def factor_for(length: Column, scale: float | None) -> Column:
    """What to multiply a vector of this length by so that its length is ``scale``."""
    return F.lit(1.0) if scale is None else F.lit(float(scale)) / F.greatest(length, F.lit(fx.NORM_FLOOR))


def scale_factor(v: Column, scale: float | None) -> Column:
    return factor_for(norm(v), scale)


def normalize(v: Column, scale: float | None) -> Column:
    if scale is None:
        return v
    return let(scale_factor(v, scale), lambda f: F.transform(v, lambda x: x.cast("double") * f))


def products(a: Column, b: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(a.a, b.b, a.b)``, each product computed once per row."""
    sums = F.struct(square_sum(a).alias("aa"), square_sum(b).alias("bb"), dot(a, b).alias("ab"))
    return let(sums, lambda s: body(s["aa"], s["bb"], s["ab"]))


def cosine(a: Column, b: Column) -> Column:
    floor = F.lit(fx.NORM_FLOOR)
    return products(a, b, lambda aa, bb, ab: ab / (F.greatest(F.sqrt(aa), floor) * F.greatest(F.sqrt(bb), floor)))


def scaled_mse(pred: Column, gold: Column, scale: float | None) -> Column:
    """Mean squared difference of two vectors after both are set to ``scale``.

    Expanded into three scalar products, so no scaled copy of a vector is made.
    """

    def total(pp: Column, gg: Column, pg: Column) -> Column:
        fp, fg = factor_for(F.sqrt(pp), scale), factor_for(F.sqrt(gg), scale)
        return F.greatest(fp * fp * pp + fg * fg * gg - 2 * fp * fg * pg, F.lit(0.0))

    return products(pred, gold, total) / F.size(gold)


def reward(mse: Column, log_form: bool = False) -> Column:
    """Reward of a scored row; null ``mse`` means the response had failed."""
    if log_form:
        scored, failed = -F.log(F.greatest(mse, F.lit(fx.MSE_FLOOR))), -math.log(2.0)
    else:
        scored, failed = -mse, fx.FAILED_REWARD
    return F.when(mse.isNotNull(), scored).otherwise(F.lit(failed))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def has_width(v: Column, width: int) -> Column:
    return F.coalesce(F.size(v) == width, F.lit(False))


def rows_from_flat(flat: Column, width: int) -> Column:
    """Cut a flat list into rows of ``width`` values; a remainder is an error."""

    def cut(values: Column) -> Column:
        n = F.size(values)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(width)))
        rows = F.transform(starts, lambda i: F.slice(values, i, F.lit(width)))
        return F.when(F.pmod(n, F.lit(width)) == 0, rows).otherwise(
            F.raise_error(F.lit(f"length is not a multiple of {width}")).cast("array<array<double>>")
        )

    return let(flat, cut)


def flat_from_rows(rows: Column) -> Column:
    return F.flatten(rows)
