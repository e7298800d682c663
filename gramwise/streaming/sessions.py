"""Sessions, debounced scans and the end of a scan-all: over recorded events, and as streams with timers and state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gramwise.functions import fixed
from gramwise.functions.text import trim
from gramwise.streaming.buckets import BUCKETS, in_buckets, packed, session_id
from gramwise.streaming.collect import ROCKS


def package_sessions(events: DataFrame) -> DataFrame:
    """Adds session_no: it grows whenever the foreign package changes, and not at the first. Own and blank ones don't count."""
    order = W.partitionBy("session_id").orderBy("ts", "event_id")
    foreign = events.where(~F.col("own") & (F.length(trim(F.coalesce("package", F.lit("")))) > 0))
    changed = (F.lag("package").over(order) != F.col("package")).cast("int")
    return foreign.withColumn("session_no", F.sum(F.coalesce(changed, F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))


def debounced(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """(session_id, first_ts, last_ts, n_events): each scan follows the last event before a pause longer than gap."""
    return events.groupBy("session_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events")).drop("session_window")


def stop_of_scan_all(sizes: DataFrame, steps: int = fixed.STEPS, stale: int = fixed.STALE) -> DataFrame:
    """(session_id, step, collected, stale_rounds): where scanning ends, from (session_id, step, collected, acted).

    The first row of a session is the size before scanning began. It ends at so many steps, at so many rounds without a new
    size, or where nothing could be scrolled (acted is false; without the column, or null, something was).
    """
    if "acted" not in sizes.columns:
        sizes = sizes.withColumn("acted", F.lit(True))
    order = W.partitionBy("session_id").orderBy("step")
    changed = F.coalesce(F.col("collected") != F.lag("collected").over(order), F.lit(True)).cast("int")
    marked = sizes.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("session_id", "run").orderBy("step")
    counted = marked.withColumn("stale_rounds", F.sum(1 - F.col("changed")).over(run.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    ended = counted.where((F.col("step") >= steps) | (F.col("stale_rounds") >= stale) | ~F.coalesce("acted", F.lit(True)))
    first = ended.groupBy("session_id").agg(F.min(F.struct("step", "collected", "stale_rounds")).alias("at"))
    return first.select("session_id", "at.*")


#: Rows that the watermark hasn't passed, and what is open of a session: the first and last of so many events, and whether all is
#: being scanned.
WAITING = np.dtype([("session_id", "i8"), ("us", "i8"), ("seq", "i8"), ("kind", "i1")])
OPEN = np.dtype([("session_id", "i8"), ("first", "i8"), ("last", "i8"), ("n", "i8"), ("scanning", "?")])
#: Kinds by their number, in the order in which rows of one time and seq count.
EVENT, START, STOP = 1, 2, 3


class Debounce(StatefulProcessor):
    """The passive scans of a bucket's sessions: each runs when no event of its session has come for longer than gap.

    An event cancels what is due and sets its own time; while all is being scanned events are ignored, and what was due before
    still runs; the end of a scan-all calls it off. Rows wait in state until the watermark has passed them, so they count in
    the order of their time however they came. A bucket's timer is that of its first session. What comes so late that the bucket
    has been taken past it is lost.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, {}
        self.due = handle.getValueState("due", "timer long, past long, opened binary, waiting binary")

    def _advance(self, key, now_ms: int, new: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        timer, past, opened, waiting = self.due.get() or (0, None, b"", b"")
        new = np.concatenate([np.zeros(0, WAITING), *new])
        rows = np.concatenate([np.frombuffer(waiting, WAITING), new if past is None else new[new["us"] > past * 1000]])
        passed = rows["us"] < now_ms * 1000
        rest, rows = rows[~passed], rows[passed]
        rows = rows[np.lexsort((rows["kind"], rows["seq"], rows["us"]))]
        sessions = {session: x for session, *x in np.frombuffer(opened, OPEN).tolist()}
        out = []
        for session, us, _, kind in rows.tolist():
            first, last, n, scanning = sessions.get(session, (0, 0, 0, False))
            if n and us - last > self.gap:
                out.append((session, first, last, n))
                n = 0
            if kind == EVENT and not scanning:
                first, last, n = us if not n else first, us, n + 1
            elif kind == START:
                scanning = True
            elif kind == STOP:
                scanning, n = False, 0
            sessions[session] = first, last, n, scanning
        still = []
        for session, (first, last, n, scanning) in sessions.items():
            if n and now_ms * 1000 > last + self.gap:
                out.append((session, first, last, n))
                n = 0
            if n or scanning:
                still.append((session, first, last, n, scanning))
        still = np.array(still, OPEN)
        # The timer is at the first time at which something may be over; then the watermark has passed it.
        times = np.concatenate([rest["us"], still["last"][still["n"] > 0]])
        at = (int(times.min()) + self.gap) // 1000 + 1 if len(times) else 0
        if at != timer:
            if timer > now_ms:
                self.handle.deleteTimer(timer)
            if at:
                self.handle.registerTimer(at)
        self.due.update((at, now_ms, still.tobytes(), rest.tobytes()))
        self.done[key[0]] = now_ms
        if out:
            yield pd.DataFrame(out, columns=["session_id", "first_us", "last_us", "n_events"], dtype="int64")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [np.frombuffer(x, WAITING) for part in rows for x in part["rows"]]
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        # Rows that came in this batch have taken the bucket as far already.
        if self.done.get(key[0]) != now_ms:
            yield from self._advance(key, now_ms, [])

    def close(self) -> None:
        pass


def passive_scans(rows: DataFrame, gap_us: int = 500_000, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(session_id, first_us, last_us, n_events) of each passive scan, as a stream in append mode, from a stream of (session_id, seq,
    ts, kind): event, start or stop (of a scan-all). Rows that come later than `late` after others are lost, as Spark's are, where
    their bucket has been taken past them; rows without a time count for nothing. A task holds the rows of one batch of a bucket
    of sessions, and those of the last that wait."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = F.when(F.col("kind") == "event", EVENT).when(F.col("kind") == "start", START).when(F.col("kind") == "stop", STOP).otherwise(0)
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(0))
    timed = in_buckets(rows.where("ts is not null"), buckets).select("bucket", "session_id", F.unix_micros("ts").alias("us"), seq.alias("seq"), kind.alias("kind"))
    timed = packed(timed, WAITING).select("bucket", "rows", F.timestamp_micros("us").alias("ts")).withWatermark("ts", late)
    scans = timed.groupBy("bucket").transformWithStateInPandas(Debounce(gap_us), "session_id long, first_us long, last_us long, n_events long", "append", "EventTime")
    return scans.select(session_id(), "first_us", "last_us", "n_events")


class ScanAll(StatefulProcessor):
    """The end of a session's scan-all, at the step where it falls."""

    def __init__(self, steps: int, stale: int):
        self.steps, self.stale = steps, stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "collected long, stale long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, stale, ended = self.state.get() or (None, 0, False)
        out = []
        if not ended:
            for step, collected, acted in sorted(x for part in rows for x in zip(part["step"].tolist(), part["collected"].tolist(), part["acted"].tolist(), strict=True)):
                stale, now = stale + 1 if collected == now else 0, collected
                if step >= self.steps or stale >= self.stale or acted is False:
                    out.append((key[0], step, collected, stale))
                    ended = True
                    break
            self.state.update((now, stale, ended))
        yield pd.DataFrame(out, columns=["session_id", "step", "collected", "stale_rounds"]).astype("int64")

    def close(self) -> None:
        pass


def scan_all_stops(sizes: DataFrame, steps: int = fixed.STEPS, stale: int = fixed.STALE) -> DataFrame:
    """What `stop_of_scan_all` gives, as a stream in append mode: a session's rows must come in the order of steps; those of one
    batch may come in any."""
    sizes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    acted = F.coalesce("acted", F.lit(True)) if "acted" in sizes.columns else F.lit(True)
    rows = sizes.select("session_id", F.col("step").cast("long"), F.col("collected").cast("long"), acted.alias("acted"))
    found = rows.groupBy("session_id").transformWithStateInPandas(ScanAll(steps, stale), "session_id long, step long, collected long, stale_rounds long", "append", "None")
    return found.select("session_id", *[F.col(c).cast("int") for c in ("step", "collected", "stale_rounds")])
