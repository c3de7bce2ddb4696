"""Stateful operators over keyed streams: rows are put in the order of their times, then drive a small state machine.

Rows may arrive out of order by up to the watermark's delay. Each key buffers them in the state and lets them go once
the watermark has passed their time, so the result does not depend on batches or on the order of files. Timers wake keys
without new rows. Keys share buckets, whose state is read and written once a batch. State is in RocksDB; it grows with
the keys that are alive and the rows of one delay.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import pickle
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICRO = dt.timedelta(microseconds=1)


@contextlib.contextmanager
def rocks_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB; the session's own choice comes back afterwards."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, own) if own else spark.conf.unset(PROVIDER)


#: Keys are dealt out to so many buckets, and each is one entry of the state: a batch costs a few calls of the state store
#: a bucket, not a few a row. A task holds the keys and waiting rows of one bucket. Fixed for the life of a checkpoint.
BUCKETS = 1024


class InOrder(StatefulProcessor):
    """Feeds ``step`` with the rows of each key of a bucket by (time, tie). Times are microseconds since the epoch.

    ``step(key, state, at, mark)`` takes one row; ``wake(key, state, upto)`` does what is due before the time ``upto``, and
    returns also the next time at which something is due (or None). Both give the key's new state (None: it has none) and
    rows. The state is kept under ``name`` as a list of the keys' columns and ``fields``.
    """

    name: str
    fields: str

    def __init__(self, keys: Sequence[str], types: str):
        self.keys, self.types = list(keys), types

    def made(self, key: tuple, **values) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), **values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the waiting rows of all keys as one pickled dict, and the time of the bucket's timer
        self.waiting = handle.getValueState("waiting", "rows binary, timer long")
        self.known = handle.getListState(self.name, f"{self.types}, {self.fields}")

    def step(self, key: tuple, state: tuple | None, at: int, mark: int) -> tuple[tuple | None, list[Row]]:
        raise NotImplementedError

    def wake(self, key: tuple, state: tuple | None, upto: int) -> tuple[tuple | None, list[Row], int | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh: dict[tuple, list[tuple]] = {}
        for r in rows:
            fresh.setdefault(tuple(r[c] for c in self.keys), []).append((r["__at"], r["__tie"], r["__mark"]))
        yield from self.release(fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.release({}, timerValues)

    def release(self, fresh: dict[tuple, list[tuple]], timers) -> Iterator[Row]:
        mark, n = max(timers.getCurrentWatermarkInMs(), 0) * 1000, len(self.keys)
        packed, timer = self.waiting.get() or (None, None)
        held = pickle.loads(packed) if packed is not None else {}
        for key, rows in fresh.items():
            held.setdefault(key, []).extend(rows)
        before = {tuple(r[:n]): tuple(r[n:]) for r in self.known.get()} if self.known.exists() else {}
        after, rest, times = {}, {}, []
        for key in {**before, **held}:
            state, rows = before.get(key), held.get(key, ())
            for at, _, kind in sorted(r for r in rows if r[0] < mark):
                state, out, _ = self.wake(key, state, at)
                yield from out
                state, out = self.step(key, state, at, kind)
                yield from out
            state, out, due = self.wake(key, state, mark)
            yield from out
            if state is not None:
                after[key] = state
            if due is not None:
                times.append(due)
            if late := [r for r in rows if r[0] >= mark]:
                rest[key] = late
                times.append(min(late)[0])
        if after != before:
            self.known.put([(*key, *state) for key, state in after.items()]) if after else self.known.clear()
        soon = min(times) // 1000 + 1 if times else None
        if soon != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if soon is not None:
                self.handle.registerTimer(soon)
        if soon is None:
            self.waiting.clear()
        elif fresh or soon != timer or len(rest) != len(held):
            self.waiting.update((pickle.dumps(rest), soon))

    def close(self) -> None:
        pass


def ordered(events: DataFrame, keys: Sequence[str], time: str, tie: str, mark: Column, delay: str, processor: InOrder, schema: str, initial: DataFrame | None = None) -> DataFrame:
    bucketed = lambda df: df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    rows = events.withWatermark(time, delay).select(*keys, time, F.unix_micros(F.col(time)).alias("__at"), F.col(tie).cast("long").alias("__tie"), mark.cast("int").alias("__mark"))
    known = bucketed(initial).groupBy("__bucket") if initial is not None else None
    return bucketed(rows).groupBy("__bucket").transformWithState(processor, schema, "append", "EventTime", initialState=known)


def types_of(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


class Incidents(InOrder):
    """Opens an incident at the second failed check in a row, escalates it after a time, resolves it at the next good one."""

    # failed checks in a row, when the incident was opened (0: not), whether it has escalated
    name, fields = "incident", "failed long, opened long, escalated boolean"

    def __init__(self, keys: Sequence[str], types: str, escalate_micros: int):
        super().__init__(keys, types)
        self.limit = escalate_micros

    def row(self, key: tuple, event: str, opened: int, at: int, checks: int) -> Row:
        return self.made(key, event=event, opened=opened, at=at, checks=checks)

    def step(self, key, state, at, mark):
        failed, opened, escalated = state or (0, 0, False)
        if not mark:
            return None, [self.row(key, "resolved", opened, at, failed)] if opened else []
        failed += 1
        if failed == 2:
            return (failed, at, escalated), [self.row(key, "opened", at, at, failed)]
        return (failed, opened, escalated), []

    def wake(self, key, state, upto):
        if state is None:
            return None, [], None
        failed, opened, escalated = state
        due = opened + self.limit
        if not opened or escalated:
            return state, [], None
        if due >= upto:
            return state, [], due
        return (failed, opened, True), [self.row(key, "escalated", opened, due, failed)], None


def incident_events(checks: DataFrame, by: Sequence[str], time: str, tie: str, failed: Column, delay: str, escalate_after: dt.timedelta) -> DataFrame:
    """Stream of (by, event, opened, at, checks): incidents opened, escalated and resolved, times in microseconds."""
    types = types_of(checks, by)
    return ordered(checks, by, time, tie, failed, delay, Incidents(by, types, escalate_after // MICRO), f"{types}, event string, opened long, at long, checks long")


def incident_events_batch(checks: DataFrame, by: Sequence[str], time: str, tie: str, failed: Column, upto: Column, escalate_after: dt.timedelta) -> DataFrame:
    """Batch twin of ``incident_events`` over the rows before ``upto`` (microseconds), by windows."""
    order = Window.partitionBy(*by).orderBy("__at", tie)
    rows = checks.select(*by, tie, F.unix_micros(F.col(time)).alias("__at"), failed.cast("int").alias("__f")).where(F.col("__at") < upto)
    good = F.when(F.col("__f") == 0, F.col("__at"))
    rows = rows.withColumn("__run", F.count(good).over(order)).withColumn("resolved", F.first(good, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    runs = rows.where("__f = 1").withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__run").orderBy("__at", tie)))
    opened = runs.where("__n = 2").select(*by, "__run", F.col("__at").alias("opened"), "resolved")
    limit = F.col("opened") + escalate_after // MICRO
    sizes = runs.join(opened.select(*by, "__run", "opened"), [*by, "__run"]).groupBy(*by, "__run").agg(F.count("*").alias("all"), F.count_if(F.col("__at") <= limit).alias("soon"))
    both = opened.join(sizes, [*by, "__run"])
    return both.select(*by, F.explode(F.array_compact(F.array(
        F.struct(F.lit("opened").alias("event"), "opened", F.col("opened").alias("at"), F.lit(2).cast("long").alias("checks")),
        F.when((limit < upto) & (F.col("resolved").isNull() | (limit < F.col("resolved"))), F.struct(F.lit("escalated").alias("event"), "opened", limit.alias("at"), F.col("soon").alias("checks"))),
        F.when(F.col("resolved").isNotNull(), F.struct(F.lit("resolved").alias("event"), "opened", F.col("resolved").alias("at"), F.col("all").alias("checks"))),
    ))).alias("e")).select(*by, "e.*")


class Memory(InOrder):
    """First and last sighting and mentions of a key; a key silent for longer than the horizon leaves the state."""

    name, fields = "memory", "first_seen long, last_seen long, mentions long"

    def __init__(self, keys: Sequence[str], types: str, horizon_micros: int):
        super().__init__(keys, types)
        self.horizon = horizon_micros

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.appendValue((*(initialState[c] for c in self.keys), initialState["first_seen"], initialState["last_seen"], initialState["mentions"]))
        self.handle.registerTimer((initialState["last_seen"] + self.horizon) // 1000 + 1)

    def step(self, key, state, at, mark):
        first, _, mentions = state or (at, at, 0)
        return (first, at, mentions + 1), []

    def wake(self, key, state, upto):
        if state is None:
            return None, [], None
        first, last, mentions = state
        if last + self.horizon >= upto:
            return state, [], last + self.horizon
        return None, [self.made(key, first_seen=first, last_seen=last, mentions=mentions)], None


def remember_within(events: DataFrame, keys: Sequence[str], time: str, tie: str, delay: str, horizon: dt.timedelta, snapshot: DataFrame | None = None) -> DataFrame:
    """Stream of the memories (keys, first_seen, last_seen, mentions; microseconds) that end: their keys were silent for
    ``horizon``. Those alive are in the state (``alive``). ``snapshot``, of the same columns, is what was known before."""
    types = types_of(events, keys)
    return ordered(events, keys, time, tie, F.lit(1), delay, Memory(keys, types, horizon // MICRO), f"{types}, {Memory.fields}", snapshot)


def alive(spark: SparkSession, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """The memories in the state of a stream, read through the state data source: the next run's snapshot."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "memory").load()
    return state.select(*(F.col(f"list_element.{c}") for c in (*keys, "first_seen", "last_seen", "mentions")))
