"""Bind a value once inside a nested expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda is evaluated again for every element;
    bound as a lambda variable it is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
