"""Structured Streaming forms of the block and stop rules for live records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridgeflow.operators.track import MAX_STEP_S


def live_blocks(records: DataFrame, *, delay: str = "1 minute") -> DataFrame:
    """Blocks of live records: sessions split by a step above ten seconds.

    ``records``: ``activity_ref``, ``ts``, anything else. Records exactly ten seconds
    apart stay together; emitted once the watermark passes."""
    gap = f"{MAX_STEP_S:g} seconds"
    return (
        records.withWatermark("ts", delay)
        .groupBy("activity_ref", F.session_window("ts", gap).alias("_w"))
        .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("records"))
        .drop("_w")
    )


_OUT = "activity_ref string, start_s double, end_s double, state string"
_PENDING = "ts_ms long, time_s double, immobile boolean"
_RUN = "start double, last double, last_ms long, still boolean"
#: State store that stateful operators with timers need (``spark.sql.streaming.stateStore.providerClass``).
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StopRuns(StatefulProcessor):
    """Runs of immobile records of one activity, settled as the watermark passes them.

    Records wait in the state until no earlier one can come any more, so a batch may hold them
    in any order and spread over batches. What is settled is one open run (four values). Its
    timer is set to the first waiting record, or, if none waits, to the instant after which a
    further record would stand behind a hole: there the run is closed and the state removed."""

    def __init__(self, min_stop_s: float):
        self.min_stop_s = min_stop_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.run = handle.getValueState("run", _RUN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple[int, float, bool]] = []
        for batch in rows:
            # Rounded up: a record is settled once the watermark, in whole milliseconds, is past it.
            instants = -(-pd.to_datetime(batch["ts"]).astype("int64") // _per_ms(batch["ts"]))
            new += [(int(m), float(t), bool(i)) for m, t, i in zip(instants, batch["time_s"], batch["immobile"], strict=True)]
        self.pending.appendList(new)
        self.handle.registerTimer(min(m for m, _, _ in new))
        yield pd.DataFrame([], columns=["activity_ref", "start_s", "end_s", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        start, last, last_ms, still = self.run.get() if self.run.exists() else (None, None, None, False)
        found: list[tuple[str, float, float, str]] = []

        def close(end: float) -> None:
            if end - start >= self.min_stop_s:
                found.append((key[0], start, end, "stopped"))

        due = [r for r in waiting if r[0] <= now]
        for instant, t, immobile in due:
            if still and t - last > MAX_STEP_S:
                close(last)
                still = False
            if still and not immobile:
                close(t)
            elif immobile and not still:
                start = t
            still, last, last_ms = immobile, t, instant
        left = waiting[len(due) :]
        ends = None if last_ms is None else last_ms + int(1000 * MAX_STEP_S) + 1
        if left or (ends is not None and now < ends):
            if due:
                self.pending.put(left) if left else self.pending.clear()
                self.run.update((start, last, last_ms, still))
            self.handle.registerTimer(left[0][0] if left else ends)
        else:
            if still:
                close(last)
            self.pending.clear()
            self.run.clear()
        yield pd.DataFrame(found, columns=["activity_ref", "start_s", "end_s", "state"])

    def close(self) -> None:
        pass


def _per_ms(instants: pd.Series) -> int:
    """Units of a series of instants in one millisecond."""
    unit = getattr(instants.dt, "unit", "ns")
    return {"s": 0.001, "ms": 1, "us": 1_000, "ns": 1_000_000}[unit]


def live_stops(records: DataFrame, min_stop_s: float, *, delay: str = "1 minute") -> DataFrame:
    """Confirmed stops of live records, at least ``min_stop_s`` long, each emitted once.

    ``records``: ``activity_ref``, ``ts`` (event time), ``time_s``, ``immobile``. Records may
    come in any order within ``delay``; later ones are dropped, as what they belong to may be
    out already. A run ends at the first mobile record, or at its last record before a hole;
    an activity that sends nothing more is closed by a timer and leaves no state behind. The
    session's state store must be ``STATE_STORE``."""
    return (
        records.withWatermark("ts", delay)
        .groupBy("activity_ref")
        .transformWithStateInPandas(StopRuns(min_stop_s), _OUT, "Append", "EventTime")
    )


def known_at(blocks: DataFrame, instant, *, strict: bool = False) -> DataFrame:
    """Facts visible at an instant: a plain filter on their own instant."""
    own = F.col("proper_instant")
    return blocks.filter(own < instant if strict else own <= instant)
