"""Small helpers for row streams inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def text_of(column: Column | str) -> Column:
    """Text with null as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def crc32_of(column: Column) -> Column:
    """Unsigned CRC-32 of a binary column, or of a text in UTF-8."""
    return F.crc32(column.cast("binary"))


def held_out(doc_id: Column | str) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(crc32_of(column.cast("string")), F.lit(4)) == 2, F.lit(False))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str], least: int = 8192) -> Iterator[pd.DataFrame]:
    """Frames that end at a group's end, from a stream sorted by ``keys``.

    Small batches are gathered up to ``least`` rows, so that many tiny groups
    are served by one call; what is held is at most that and one group.
    """
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < least:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        starts = group_starts(frame, keys)
        cut = int(starts[-1])
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
            frame = frame.iloc[cut:].reset_index(drop=True)
        held, rows = [frame], len(frame)
    if rows:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def group_starts(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Positions at which a new group begins."""
    new = np.ones(len(frame), dtype=bool)
    if len(frame) > 1:
        new[1:] = False
        for key in keys:
            values = frame[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
