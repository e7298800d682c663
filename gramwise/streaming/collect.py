"""The items that a session has collected, kept by Structured Streaming, item by item.

A session's state is a few numbers (its last foreign package, whether all is being scanned, whether a passive scan is due, the
mode, how many items have each metric), a map of items by key, a map of keys by the number of their insertion, and the
scan that is open. A batch reads and writes only the keys that it brings or that leave. Scans may be split over batches: an
open one stays in state until its end is seen, and only then is it added.

What comes out are changes, appended: items put or dropped, collections cleared, and once a batch the state of each session in
it, with the mode that the counts give. `collections` makes of them what each session has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gramwise.functions import analyze, fixed
from gramwise.functions.text import trim, units
from gramwise.operators.dedupe import Collection, fold, item_key
from gramwise.operators.rank import MODES, automatic_mode, display_rows, rank, shown, with_metrics
from gramwise.shared import materialise
from gramwise.sources.screen import drop_noise
from gramwise.sources.texts import analysed
from gramwise.streaming.buckets import BUCKETS, in_buckets, packed, session_id

ITEM = "name string, raw_text string, price double, currency string, quantity struct<kind:string,amount_base:double,display:string,confidence:double,diameter_in:double>, calories double, portion struct<points:double,confidence:double,basis:string>, promotion struct<type:string,label:string,received_multiplier:double,min_paid_units:int,effective_price:double>, confidence double"
FIELDS = ("name", "raw_text", "price", "currency", "quantity", "calories", "portion", "promotion", "confidence")
CHANGES = "session_id long, step long, op string, item_key string, pos long, seq long, item string, mode string, smart string, size long"
#: Scans of a screen tree by themselves, of a scan-all, by hand; and of recognised lines, whose sums and fees stay.
SCANS, OCR = ("passive", "all", "hand"), "ocr"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Places on a screen, the last of which is its end.
PLACES = 1_000_000
SCALARS = ("package string, scanning boolean, due boolean, mode string, kind string, scan_id long, counted boolean, opened long, first long, next long, step long, " + ", ".join(f"n{i} long" for i in range(len(MODES))))
HELD = "place long, confidence double, length int, metrics int, seq long, item string"


class Kept:
    """A map in state: each key that a batch names is read once, and those that change are written at its end."""

    def __init__(self, state):
        self.state, self.now, self.changed, self.cleared = state, {}, set(), False

    def get(self, key):
        if key not in self.now:
            self.now[key] = None if self.cleared else self.state.getValue((key,))
        return self.now[key]

    def put(self, key, value: tuple | None) -> None:
        """None takes the key away."""
        self.now[key] = value
        self.changed.add(key)

    def clear(self) -> None:
        self.now, self.changed, self.cleared = {}, set(), True

    def all(self) -> dict:
        if not self.cleared:
            for (key,), value in self.state.iterator():
                self.now.setdefault(key, value)
        return {k: v for k, v in self.now.items() if v is not None}

    def write(self) -> None:
        if self.cleared and self.state.exists():
            self.state.clear()
        for key in self.changed:
            if self.now[key] is not None:
                self.state.updateValue((key,), self.now[key])
            elif not self.cleared:
                self.state.removeKey((key,))


def _better(new: tuple, old: tuple | None) -> bool:
    return old is None or new[1] > old[1] or new[2] > old[2]


class Session:
    """What each kind of row does to a session's state."""

    def __init__(self, items, order, opened, scalars: tuple | None = None, cap: int = fixed.KEPT):
        self.items, self.order, self.open, self.cap = Kept(items), Kept(order), Kept(opened), cap
        self.package, self.scanning, self.due, self.mode, self.kind, self.scan_id, self.counted, self.opened, self.first, self.next, self.step, *self.counts = scalars or (None, False, False, "SMART", None, None, False, 0, 0, 0, 0, *[0] * len(MODES))
        self.changes: list[tuple] = []

    def scalars(self) -> tuple:
        return (self.package, self.scanning, self.due, self.mode, self.kind, self.scan_id, self.counted, self.opened, self.first, self.next, self.step, *self.counts)

    def take(self, row) -> None:
        """An item counts if its scan does: one by hand or of recognised lines always, one of a scan-all while that goes on, a
        passive one while it doesn't, or if it was due when that began."""
        if row.kind in SCANS or row.kind == OCR:
            if self.kind != row.kind or self.scan_id != row.scan_id:
                self.end_scan()
                self.open.clear()
                self.kind, self.scan_id = row.kind, int(row.scan_id)
                self.counted = row.kind in ("hand", OCR) or (self.scanning if row.kind == "all" else self.due or not self.scanning)
                self.due = self.due and row.kind != "passive"
            if self.counted:
                old = self.open.get(row.item_key)
                new = (self.opened if old is None else old[0], float(row.confidence), int(row.text_length), int(row.metrics), int(row.seq), row.item)
                if _better(new, old):
                    self.open.put(row.item_key, new)
                    self.opened += old is None
            return
        self.end_scan()
        if row.kind in ("event", "touch"):
            # The caller calls events of the app's own package and blank ones touches: they change nothing but that a scan is due.
            if row.kind == "event":
                if self.package not in (None, row.named):
                    self.clear()
                self.package = row.named
            self.due = self.due or not self.scanning
        elif row.kind == "clear":
            self.clear()
        elif row.kind == "start":
            self.scanning = True
        elif row.kind == "stop":
            self.scanning = self.due = False  # what was due is called off
        elif row.kind == "mode":
            self.mode = row.named

    def end_scan(self) -> None:
        """What the open scan leaves is added in its order, and the oldest keys go."""
        if self.kind is not None:
            for key, new in sorted(self.open.all().items(), key=lambda x: x[1][0]):
                old = self.items.get(key)
                if _better(new, old):
                    self._put(key, new, old)
            while self.next - self.first > self.cap:
                (key,) = self.order.get(self.first)
                self._count(self.items.get(key), -1)
                self.items.put(key, None)
                self.order.put(self.first, None)
                self.first += 1
                self._change("drop", key)
            self.open.clear()
            self.kind, self.scan_id, self.opened = None, None, 0

    def clear(self) -> None:
        self.items.clear()
        self.order.clear()
        self.first, self.counts = self.next, [0] * len(MODES)
        self._change("clear")

    def _put(self, key: str, new: tuple, old: tuple | None) -> None:
        if old is None:
            self.order.put(self.next, (key,))
            at, self.next = self.next, self.next + 1
        else:
            at = old[0]
            self._count(old, -1)
        value = (at, *new[1:])
        self._count(value, 1)
        self.items.put(key, value)
        self._change("put", key, at, value[4], value[5])

    def _count(self, value: tuple, by: int) -> None:
        self.counts = [n + by * (value[3] >> i & 1) for i, n in enumerate(self.counts)]

    def _change(self, op: str, key=None, at=None, seq=None, item=None) -> None:
        self.step += 1
        self.changes.append((self.step, op, key, at, seq, item, None, None, None))

    def ended(self) -> list[tuple]:
        """The changes of a batch, the state last."""
        self.step += 1
        last = (self.step, "state", None, None, None, None, self.mode, automatic_mode(self.counts), self.next - self.first)
        for kept in (self.items, self.order, self.open):
            kept.write()
        return [*self.changes, last]


class Collecting(StatefulProcessor):
    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scalars = handle.getValueState("scalars", SCALARS)
        self.maps = [handle.getMapState(n, k, v) for n, k, v in (("items", "item_key string", HELD), ("order", "pos long", "item_key string"), ("open", "item_key string", HELD))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = Session(*self.maps, self.scalars.get(), self.cap)
        batch = sorted((row for part in rows for row in part.itertuples(index=False)), key=lambda r: r.seq)
        for row in batch:
            session.take(row)
        out = session.ended()
        self.scalars.update(session.scalars())
        # Whole numbers with nulls among them must not become floats on the way: places in time are beyond those.
        fields = [c.split() for c in CHANGES.split(", ")]
        columns = zip(*((key[0], *x) for x in out), strict=True)
        yield pd.DataFrame({name: pd.array(x, "Int64" if kind == "long" else "object") for (name, kind), x in zip(fields, columns, strict=True)})

    def close(self) -> None:
        pass


def metrics_had(items: DataFrame) -> Column:
    """A bit for each metric, in the order of MODES, that items with metrics have."""
    bits = [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, (c, *_) in enumerate(MODES.values())]
    return sum(bits[1:], bits[0]).cast("int")


def prepared(rows: DataFrame, own_package: str) -> DataFrame:
    """Analysed items and control rows from (session_id, seq, kind, named, scan_id, raw_text), in one pass: what gives the rows
    may be stateful itself. Control rows are parsed as a price, of which nothing is kept."""
    is_item = F.col("kind").isin(*SCANS, OCR)
    foreign = (F.length(trim(F.coalesce("named", F.lit("")))) > 0) & (F.col("named") != own_package)
    kind = F.when((F.col("kind") == "event") & ~foreign, "touch").otherwise(F.col("kind"))
    items = with_metrics(drop_noise(analyze(rows.withColumns({"kind": kind, "raw_text": F.when(is_item, F.col("raw_text")).otherwise("$1")})), F.col("kind").isin(*SCANS)))
    own = {"item_key": item_key(), "confidence": F.col("confidence"), "text_length": units(F.col("raw_text")), "metrics": metrics_had(items), "item": F.to_json(F.struct(*FIELDS))}
    return items.select("session_id", "seq", "kind", "named", "scan_id", *[F.when(is_item, c).alias(name) for name, c in own.items()])


def collect_stream(rows: DataFrame, own_package: str = "", cap: int = fixed.KEPT) -> DataFrame:
    """The changes (CHANGES) of each session's collection, from a stream of (session_id, seq, kind, named, scan_id, raw_text).

    kind: items are of a scan, passive, all (of a scan-all), hand or ocr. Control rows are event (named: the package on
    screen), clear, start or stop (of a scan-all), mode (named: the mode) and done (the scan ended). A row of another scan
    or a control row ends a scan too. Rows of a batch count in the order of seq; a task holds a session's rows of one
    batch, which the source's limits bound. State is kept in RocksDB, which this sets for the session's queries.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return prepared(rows, own_package).groupBy("session_id").transformWithStateInPandas(Collecting(cap), CHANGES, "append", "None")


def seen(scans: DataFrame, screens: DataFrame, on: list[str]) -> DataFrame:
    """Rows for collect_stream of a stream of passive scans (session_id, last_us and the columns `on`) and a table of what is to be
    seen (`on`, place, raw_text): each scan has the rows of screens that it joins, in the order of place, and its end.

    The end of a scan is a row of screens too (`with_ends`), so that the stream isn't read twice.
    """
    rows = scans.join(screens, on)
    seq = F.floor(F.col("last_us") / 1000) * PLACES + F.col("place")
    return rows.select("session_id", seq.alias("seq"), F.when(F.col("place") == PLACES - 1, "done").otherwise("passive").alias("kind"), F.lit("").alias("named"), F.col("last_us").alias("scan_id"), "raw_text")


def with_ends(screens: DataFrame, on: list[str]) -> DataFrame:
    ends = screens.select(*on).distinct().withColumns({"place": F.lit(PLACES - 1), "raw_text": F.lit(None).cast("string")})
    return screens.select(*on, "place", "raw_text").unionByName(ends)


#: Items of screens that a task looks up at most; with more, scans are joined to their rows.
LOOKED_UP = 200_000
LOOK = "session_id long, step long, smart string, place array<int>, screen array<int>, item array<int>, n array<int>, us array<long>"
#: Items that a session holds one after the other as a scan brought them: n items of a screen, from one on backwards in number.
RUNS = np.dtype([("session_id", "i8"), ("screen", "i4"), ("item", "i4"), ("n", "i4"), ("us", "i8")])
#: Scans on their way to their sessions.
SEEN = np.dtype([("session_id", "i8"), ("us", "i8"), ("screen", "i4")])
#: Runs that a task remembers at most of what scans have left.
REMEMBERED = 200_000


def screen_items(screens: DataFrame, on: list[str], cap: int) -> DataFrame:
    """(screen, `on`, item, item_key, confidence, text_length, metrics, place) of (`on`, place, raw_text): each screen is parsed and
    folded once, as every scan of it would be, and its last 2 * cap items are numbered backwards.

    No others matter to a session that keeps cap keys: of so many, cap at least are new to it, and these alone stay.
    """
    rows = drop_noise(analysed(screens.select(*on, F.col("place").alias("at"), "raw_text")))
    items = fold(with_metrics(rows), on, ["at"])
    last = items.select(*on, "item_key", "confidence", units(F.col("raw_text")).alias("text_length"), metrics_had(items).alias("metrics"), F.col("at").alias("_at"), "place")
    last = last.join(last.groupBy(*on).agg(F.max("place").alias("_last")), on).withColumn("item", F.col("_last") - F.col("place")).where(F.col("item") < 2 * cap)
    known = last.select(*on).distinct().select(*on, F.row_number().over(W.orderBy(*on)).alias("screen"))
    return materialise(last.drop("_last", "place").withColumnRenamed("_at", "place").join(F.broadcast(known), on), "screens")


class Looking(StatefulProcessor):
    """The collections of a bucket's sessions of what known screens show. What a session holds are runs of a screen's items, each
    with the time of its scan. What a scan makes of runs doesn't depend on times, so it is remembered: sessions hold the same
    again and again."""

    def __init__(self, screens: dict[int, list[tuple]], cap: int):
        self.screens, self.cap = screens, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = {(screen, item[4]): item for screen, items in self.screens.items() for item in items}
        self.moves, self.modes, self.remembered = {}, {}, 0
        self.held = handle.getValueState("held", "step long, runs binary")

    def _move(self, runs: tuple, screen: int) -> tuple[tuple, tuple]:
        """The runs (screen, item, n) that a scan of the screen leaves, and which of those before each was part of; -1: the scan's."""
        now = Collection(self.cap)
        for at, (shown, first, n) in enumerate(runs):
            for item in range(first, first - n, -1):
                name, sure, length, *_ = self.items[shown, item]
                now.put(name, sure, length, (at, shown, item))
        for name, sure, length, _, item in self.screens[screen]:
            now.put(name, sure, length, (-1, screen, item))
        now.end_scan()
        left = []
        for at, shown, item in (x[2] for x in now.items.values()):
            if left and left[-1][0] == at and left[-1][2] - left[-1][3] == item:
                left[-1][3] += 1
            else:
                left.append([at, shown, item, 1])
        return tuple((shown, item, n) for _, shown, item, n in left), tuple(at for at, *_ in left)

    def _moved(self, runs: tuple, screen: int) -> tuple[tuple, tuple]:
        move = self.moves.get((runs, screen))
        if move is None:
            if self.remembered > REMEMBERED:
                self.moves, self.modes, self.remembered = {}, {}, 0
            move = self.moves[runs, screen] = self._move(runs, screen)
            self.remembered += len(runs) + len(move[0])
        return move

    def _smart(self, runs: tuple) -> str:
        if runs not in self.modes:
            had = [self.items[shown, item][3] for shown, first, n in runs for item in range(first, first - n, -1)]
            self.modes[runs] = automatic_mode([sum(m >> i & 1 for m in had) for i in range(len(MODES))])
        return self.modes[runs]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, held = self.held.get() or (0, b"")
        now = {}
        for session, every in groupby(np.frombuffer(held, RUNS).tolist(), itemgetter(0)):
            every = list(every)
            now[session] = tuple(x[1:4] for x in every), [x[4] for x in every]
        changed = {}
        scans = np.concatenate([np.frombuffer(x, SEEN) for part in rows for x in part["rows"]])
        for session, us, screen in scans[np.lexsort((scans["screen"], scans["us"]))].tolist():
            runs, times = now.get(session, ((), ()))
            runs, came = self._moved(runs, screen)
            now[session] = changed[session] = runs, [us if at < 0 else times[at] for at in came]
        every = [(session, *run, us) for session, (runs, times) in now.items() for run, us in zip(runs, times, strict=True)]
        self.held.update((step + 1, np.array(every, RUNS).tobytes()))
        out = []
        for session, (runs, times) in changed.items():
            screen, item, n = zip(*runs, strict=True)
            out.append((session, step + 1, self._smart(runs), list(accumulate(n[:-1], initial=0)), screen, item, n, times))
        yield pd.DataFrame(out, columns=["session_id", "step", "smart", "place", "screen", "item", "n", "us"])

    def close(self) -> None:
        pass


def look_stream(scans: DataFrame, items: DataFrame, on: list[str], cap: int = fixed.KEPT, buckets: int = BUCKETS) -> DataFrame:
    """What each session holds after each batch that scans for it (LOOK), from a stream of passive scans (session_id, last_us and the
    columns `on`) and `screen_items`. Scans go to their sessions as they are; what they see is with the tasks, so it must be
    LOOKED_UP at most. A task holds the scans of one batch of a bucket of sessions, and what these keep."""
    scans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    screens: dict[int, list[tuple]] = {}
    for r in items.select("screen", "item", "item_key", "confidence", "text_length", "metrics").orderBy("screen", F.desc("item")).collect():
        screens.setdefault(r["screen"], []).append((r["item_key"], r["confidence"], r["text_length"], r["metrics"], r["item"]))
    numbers = F.broadcast(items.select(*on, "screen").distinct())
    known = in_buckets(scans.join(numbers, on), buckets).withColumnRenamed("last_us", "us")
    return packed(known, SEEN).select("bucket", "rows").groupBy("bucket").transformWithStateInPandas(Looking(screens, cap), LOOK, "append", "None")


def looked(states: DataFrame, items: DataFrame) -> DataFrame:
    """(session_id, place, seq, item_key, smart) of what `look_stream` wrote: what each session has after all of it."""
    last = states.groupBy("session_id").agg(F.max_by(F.struct("smart", F.arrays_zip("place", "screen", "item", "n", "us").alias("runs")), "step").alias("s"))
    runs = last.select(session_id(), "s.smart", F.explode("s.runs").alias("r"))
    held = runs.select("session_id", "smart", "r.*", F.explode(F.sequence(F.lit(0), F.col("r.n") - 1)).alias("k")).withColumns({"place": F.col("place") + F.col("k"), "item": F.col("item") - F.col("k")})
    return held.join(F.broadcast(items.select("screen", "item", "item_key", F.col("place").alias("_at"))), ["screen", "item"]).select("session_id", "place", (F.floor(F.col("us") / 1000) * PLACES + F.col("_at")).alias("seq"), "item_key", "smart")


def collections(changes: DataFrame) -> DataFrame:
    """(session_id, place, seq, item_key, mode, smart, item) of changes: what each session has after all of them, in the order of
    insertion; a session without items gives a row with a null place."""
    state = changes.where("op = 'state'").groupBy("session_id").agg(F.max(F.struct("step", "mode", "smart")).alias("s")).select("session_id", "s.mode", "s.smart")
    cleared = changes.where("op = 'clear'").groupBy("session_id").agg(F.max("step").alias("_cleared"))
    last = changes.where("op in ('put', 'drop')").groupBy("session_id", "item_key").agg(F.max(F.struct("step", "op", "pos", "seq", "item")).alias("x"))
    held = last.join(cleared, "session_id", "left").where((F.col("x.op") == "put") & (F.col("x.step") > F.coalesce("_cleared", F.lit(0)))).select("session_id", "item_key", "x.pos", "x.seq", "x.item")
    # A session holds no more than the cap.
    held = held.withColumn("place", (F.row_number().over(W.partitionBy("session_id").orderBy("pos")) - 1).cast("int"))
    return state.join(held, "session_id", "left").select("session_id", "place", "seq", "item_key", "mode", "smart", "item")


def display(collection: DataFrame) -> DataFrame:
    """What is shown of `collections`: the ranked rows of each session by its mode, or that there are none. The automatic mode is
    what the stream's counts gave."""
    mode = F.when(F.col("mode") == "SMART", F.col("smart")).otherwise(F.col("mode"))
    items = collection.where("place is not null").select("session_id", "place", "seq", mode.alias("mode"), F.from_json("item", ITEM).alias("i")).select("session_id", "place", "seq", "mode", "i.*")
    return shown(display_rows(rank(items, None)), collection)
