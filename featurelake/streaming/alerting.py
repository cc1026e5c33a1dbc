"""Alert rules on streams: a condition that holds for a while takes a rule from inactive over pending to firing.

One key per rule (and further keys, as a host) carries the state between micro-batches. Evaluations come one per step of
event time, in any order within the watermark's delay: those the watermark has not passed wait in the state, the others are
taken in order of time. An event-time timer finds steps that never came: a missing step ends the run, as in the batch
operator ``sustained``, even when no further evaluation ever arrives.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from featurelake.functions.histogram import LATENCY_BOUNDS, cumulative_counts, quantile_from_counts
from featurelake.functions.scalars import safe_ratio
from featurelake.operators.traffic import ERROR_RATIO_LIMIT, P95_LIMIT_SECONDS, rolling

# Minutes that each rule's condition has to hold.
HOLD_MINUTES = {"high_error_rate": 10, "high_latency_p95": 10, "model_not_loaded": 5}
INACTIVE, PENDING, FIRING, RESOLVED = "inactive", "pending", "firing", "resolved"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def advance(run: tuple | None, evaluations: Sequence[tuple[int, bool]], hold: int, step: int, until: int) -> tuple[tuple | None, list[tuple]]:
    """State after the evaluations (milliseconds, held) and the rows (at, since, held, state) they give.

    ``run`` is (last evaluation, first step of the unbroken run, firing) or None. A step missing before the next
    evaluation, or before ``until`` at the end, breaks the run; if it was pending or firing that is a row of its own without
    a value.
    """
    rows: list[tuple] = []

    def missing(before: int) -> None:
        nonlocal run
        if run is not None and before > run[0] + step:
            rows.append((run[0] + step, run[1], None, RESOLVED if run[2] else INACTIVE))
            run = None

    for at, held in evaluations:
        missing(at)
        if held:
            since = at if run is None else run[1]
            firing = at - since >= hold * step
            run = (at, since, firing)
            rows.append((at, since, True, FIRING if firing else PENDING))
        else:
            rows.append((at, None, False, RESOLVED if run is not None and run[2] else INACTIVE))
            run = None
    missing(until + 1)
    return run, rows


class AlertRule(StatefulProcessor):
    """State of one rule: its run, and evaluations that the watermark has not passed yet."""

    def __init__(self, keys: Sequence[str], hold: int | Mapping[str, int], step: int) -> None:
        self.keys, self.hold, self.step = list(keys), hold, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last long, since long, firing boolean")
        self.waiting = handle.getListState("waiting", "at long, held boolean")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), bool(held)) for frame in rows for at, held in zip(frame["at_ms"], frame["holds"])]
        yield self.moved(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.moved(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def moved(self, key: tuple, new: list[tuple[int, bool]], watermark: int) -> pd.DataFrame:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        known = dict(sorted([*held, *new]))  # repeated evaluations of a step count once; one that held wins
        ready = [(at, value) for at, value in known.items() if at <= watermark]
        later = [(at, value) for at, value in known.items() if at > watermark]
        hold = self.hold if isinstance(self.hold, int) else self.hold[key[0]]
        before = self.run.get() if self.run.exists() else None
        run, rows = advance(None if before is None else tuple(before), ready, hold, self.step, watermark)
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
        if later:
            self.waiting.put(later)
        elif held:
            self.waiting.clear()
        # The next thing that can happen without input: a waiting evaluation is passed, or the run's next step is overdue.
        due = [later[0][0]] if later else []
        due += [run[0] + self.step] if run is not None else []
        set_for = self.timer.get()[0] if self.timer.exists() else None
        at = max(min(due), watermark + 1) if due else None
        if set_for is not None and set_for != at:
            self.handle.deleteTimer(set_for)
        if at is None:
            self.timer.clear()
        elif at != set_for:
            self.handle.registerTimer(at)
            self.timer.update((at,))
        # Plain objects: each column then becomes one Arrow array, whatever string type pandas prefers.
        told = {c: [r[i] for r in rows] for i, c in enumerate(("at_ms", "since_ms", "held", "state"))}
        return pd.DataFrame({**{k: [v] * len(rows) for k, v in zip(self.keys, key)}, **told}, dtype=object)


def alert_states(evaluations: DataFrame, at: str, condition: Column, hold_steps: int | Mapping[str, int], step_seconds: int = 60,
                 keys: Sequence[str] = ("rule",), event_time: str | None = None) -> DataFrame:
    """One row per evaluation and per broken run: keys, ``at``, held, state, since, firing.

    ``evaluations`` is a stream with one row for each key and step of ``at``; ``hold_steps`` may differ by the first key.
    ``event_time`` names the column with the
    watermark if that is another one, as the end of a window is to its ``window_time``. Start the query with ``start_alerts``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in evaluations.schema}
    # No name begins with an underscore: the rows reach Python as named tuples.
    narrow = evaluations.select(*keys, F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"),
                                F.coalesce(condition, F.lit(False)).alias("holds"), F.col(event_time or at).alias("event_time"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", at_ms long, since_ms long, held boolean, state string"
    rows = narrow.groupBy(*keys).transformWithStateInPandas(
        AlertRule(keys, hold_steps, step_seconds * 1000), schema, "append", "eventTime")
    return rows.select(*keys, F.timestamp_millis("at_ms").alias(at), "held", "state", F.timestamp_millis("since_ms").alias("since"),
                       (F.col("state") == FIRING).alias("firing"))


def start_alerts(states: DataFrame, sink: str, state: str, **trigger) -> StreamingQuery:
    """Start an exactly-once file sink. Timers need the RocksDB state store, which is chosen for this query alone."""
    spark = states.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return (states.writeStream.outputMode("append").format("parquet").option("path", sink)
                .option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start())
    finally:
        spark.conf.set(_PROVIDER, before)


def window_evaluations(requests: DataFrame, gauges: DataFrame, ts: str = "ts", gauge: str = "gauge", error_limit: float = ERROR_RATIO_LIMIT,
                       p95_limit: float = P95_LIMIT_SECONDS, floor: float | None = 1.0, length: str = "5 minutes", slide: str = "1 minute",
                       seconds: int = 300) -> DataFrame:
    """The three rules' conditions for every window of two streams: rule, window_end, at (with the watermark), bad."""
    per_second = F.col("n") / seconds
    ratio = (F.col("errors") / seconds) / (F.greatest(per_second, F.lit(floor)) if floor else per_second)
    errors = rolling(requests, ts, length, slide, {"n": F.count(F.lit(1)), "errors": F.count_if(F.col("status").between(500, 599))}, event_time="at")
    buckets = {f"le_{i}": c for i, c in enumerate(cumulative_counts(F.col("duration"), LATENCY_BOUNDS))}
    slow = rolling(requests, ts, length, slide, buckets, event_time="at")
    health = rolling(gauges, ts, length, slide, {"n": F.count(gauge), "total": F.sum(F.col(gauge).cast("bigint"))}, event_time="at")
    conditions = {"high_error_rate": (errors, ratio > error_limit), "high_latency_p95": (slow, quantile_from_counts(0.95, LATENCY_BOUNDS) > p95_limit),
                  "model_not_loaded": (health, safe_ratio(F.col("total"), F.col("n")) < 1)}
    out = None
    for rule, (windows, bad) in conditions.items():
        part = windows.select(F.lit(rule).alias("rule"), "window_end", "at", F.coalesce(bad, F.lit(False)).alias("bad"))
        out = part if out is None else out.unionByName(part)
    return out
