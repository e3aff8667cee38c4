"""Stateful stream operators on Spark's state store: first row per key, batches by size or time.

State lives with its key in the store (RocksDB) and is checkpointed with the
query, so no batch reads what earlier batches have written, and a query that is
started again goes on from where its checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from vectext.functions.keys import free_name

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store that processors with timers and several states need."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def rank_of(values: Sequence) -> tuple:
    """Values in Spark's order of structs: nulls first."""
    return tuple((v is not None, v) for v in values)


def values_of(struct) -> tuple:
    """The fields of a struct, which comes as a map or as a row."""
    return tuple(struct.values()) if isinstance(struct, dict) else tuple(struct)


def keep_first(delay_ms: int | None) -> Callable:
    """Per key the least order seen so far; passes on a row that comes before it.

    With a delay, rows of a key whose times are further apart are not repeats of
    each other, and a key is forgotten once the watermark is that far past it.
    The state travels to the task with its key's rows, so a key costs no call.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        arrived = sorted(
            ((rank_of(values_of(order)), values_of(order), int(at), row)
             for frame in frames for order, at, row in zip(frame["order"], frame["at"], frame["row"])),
            key=lambda r: (r[2], r[0]),
        )
        found = state.get if state.exists else None
        known = None if found is None else (rank_of(found[:-1]), tuple(found[:-1]), found[-1])
        start, passed = known, []
        for rank, order, at, row in arrived:
            near = known is not None and (delay_ms is None or abs(at - known[2]) <= delay_ms)
            if near and rank >= known[0]:
                continue
            known = rank, order, at
            passed.append(row)
        if known == start:
            if delay_ms is not None:
                state.setTimeoutTimestamp(max(known[2] + delay_ms, state.getCurrentWatermarkMs() + 1))
            return
        state.update((*known[1], known[2]))
        if delay_ms is not None:
            state.setTimeoutTimestamp(max(known[2] + delay_ms, state.getCurrentWatermarkMs() + 1))
        # Without a delay only the last one stands; each comes before the one passed on earlier.
        yield pd.DataFrame({"row": passed if delay_ms is not None else passed[-1:]})

    return run


def first_rows(
    stream: DataFrame, key: Column, order: Sequence[str], time: str | None = None, delay_seconds: int = 86_400
) -> DataFrame:
    """A row when it is the first of its key in ``order``, so far; all columns.

    A later row that comes before the one passed on is passed on as well, so the
    least row of a key is the last one passed on, whatever the order of arrival.
    With a ``time`` column, rows of a key more than ``delay_seconds`` apart are
    no repeats; rows that come later than that behind the latest time of earlier
    batches are late and dropped, and keys that old are forgotten.
    """
    delay = None if time is None else delay_seconds * 1000
    watched = stream if time is None else stream.withWatermark(time, f"{delay_seconds} seconds")
    at = F.lit(0).cast("bigint") if time is None else F.unix_millis(time)
    packed = watched.select(
        key.alias("key"), F.struct(*order).alias("order"), at.alias("at"), F.struct(*stream.columns).alias("row"),
        *([] if time is None else [F.col(time).alias("event_time")]),
    )
    ordered = packed.schema["order"].dataType
    first = packed.groupBy("key").applyInPandasWithState(
        keep_first(delay), outputStructType=StructType([packed.schema["row"]]),
        stateStructType=StructType([*ordered.fields, StructField("at_", LongType())]), outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout,
    )
    return first.select("row.*")


class Collect(StatefulProcessor):
    """Holds rows of a lane until there are ``size`` or ``wait_ms`` have gone by since the first, then scores them."""

    def __init__(self, schema: StructType, score: Callable[[pd.DataFrame], pd.DataFrame], out: StructType, size: int, wait_ms: int) -> None:
        self.schema, self.score, self.out, self.size, self.wait_ms = schema, score, out, size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.count = handle.getValueState("count", "batches bigint, rows bigint")

    def rows(self) -> list[tuple]:
        return list(self.held.get()) if self.held.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches, waiting = self.count.get() if self.count.exists() else (0, 0)
        fresh = [tuple(None if _missing(v) else v for v in row) for frame in rows for row in frame[self.schema.names].itertuples(index=False)]
        if waiting + len(fresh) < self.size:
            if not waiting and fresh:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            self.held.appendList(fresh)
            self.count.update((batches, waiting + len(fresh)))
            return
        held = self.rows() + fresh
        while len(held) >= self.size:
            yield self.batch(key, batches, held[:self.size])
            batches, held = batches + 1, held[self.size:]
        self.forget_timers()
        self.held.clear()
        if held:
            self.held.put(held)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        self.count.update((batches, len(held)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.rows()
        if not held:
            return
        batches, _ = self.count.get()
        self.held.clear()
        self.count.update((batches + 1, 0))
        yield self.batch(key, batches, held)

    def forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def batch(self, key, number: int, rows: list[tuple]) -> pd.DataFrame:
        """A scored batch; where the scorer fails, all its rows are marked with the error."""
        frame = pd.DataFrame(rows, columns=self.schema.names)
        try:
            scored, error = self.score(frame.copy()), None
            if len(scored) != len(frame):
                raise ValueError(f"the scorer returned {len(scored)} rows for {len(frame)}")
        except Exception as fault:  # A scorer's fault is a result here, for every row of the batch.
            scored, error = frame, f"{type(fault).__name__}: {fault}"
        out = pd.DataFrame({name: scored[name] if name in scored else None for name in self.out.names})
        return out.assign(lane=key[0], batch=number, error=error)

    def close(self) -> None:
        pass


def _missing(value) -> bool:
    return value is None or value is pd.NaT or (isinstance(value, float) and value != value)


def score_collected(
    stream: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], out: str, size: int, wait_seconds: float, lanes: int = 1
) -> DataFrame:
    """Rows scored in batches of exactly ``size``, or fewer once ``wait_seconds`` have gone by since a batch's first row.

    Rows are dealt over ``lanes`` by a hash of the row, each of which collects on
    its own. ``score`` takes a batch and returns it with the columns of the
    schema ``out``; ``lane, batch, error`` come with them. A scorer that fails
    marks every row of its batch with its error, scores null, and the query
    goes on. Rows that wait when a query stops are in its checkpoint. Run it with
    a trigger by time: timers need batches without data as well, so a query that
    is to end with what is there (``availableNow``) would not end.
    """
    use_state_store(stream.sparkSession)
    types = StructType.fromDDL(out)
    whole = StructType.fromDDL(f"{out}, lane int, batch bigint, error string")
    lane = free_name(stream, "_lane")
    dealt = stream.withColumn(lane, F.pmod(F.xxhash64(*stream.columns), F.lit(lanes)).cast("int"))
    return dealt.groupBy(lane).transformWithStateInPandas(
        statefulProcessor=Collect(stream.schema, score, types, size, int(wait_seconds * 1000)),
        outputStructType=whole, outputMode="Append", timeMode="ProcessingTime",
    )
