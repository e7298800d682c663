"""The streaming collection against the batch fold and against plain rules, and sessions, pauses and ends of scans against
hand-made rows, in batches of any cut."""

import random
from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramwise.functions import analyze, fixed
from gramwise.operators import collected, smart_mode, with_metrics
from gramwise.operators.dedupe import Collection
from gramwise.plans.queries import PAUSE, _streamed, _timed
from gramwise.sources import files_of, in_batches, scan_all_events
from gramwise.streaming import Session, collect, collect_stream, collections, debounced, display, look_stream, looked, package_sessions, passive_scans, scan_all_stops, screen_items, seen, stop_of_scan_all, tasks_of, with_ends
from gramwise.streaming.buckets import TASK_BUCKETS
from gramwise.streaming.collect import SEEN, Looking
from gramwise.streaming.sessions import WAITING, Debounce

SCHEMA = "session_id long, seq long, kind string, named string, scan_id long, raw_text string"


def changes(spark, tmp_path, *parts):
    """What the stream has written after parts came one by one; each starts the query again from its checkpoint."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        query = collect_stream(stream, "own").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def streamed(spark, tmp_path, *parts):
    """The collections and what is shown of them."""
    found = collections(changes(spark, tmp_path, *parts))
    return found.collect(), display(found).collect()


def test_stream_equals_batch(spark, tmp_path):
    texts = ["Gala apples\n1 kg\n$4", "Pears\n2 lb\n$3", "Gala apples\n1 kg\n$4 again", "Pears\n2 lb\n$3", "Tea 300 g $6", "no price"]
    rows = [(s, scan * 100 + i, "passive", "", scan, t + " ." * (scan - 1)) for scan in (1, 2) for i, t in enumerate(texts) for s in (1, 2)]
    rows += [(s, 299, "done", "", 2, None) for s in (1, 2)]
    # The second scan is split between the last two batches.
    found, _ = streamed(spark, tmp_path, rows[:5], rows[5:15], rows[15:])
    batch = collected(analyze(spark.createDataFrame(rows, SCHEMA))).collect()
    pick = lambda r: (r["session_id"], r["place"], r["item_key"], r["seq"])
    assert sorted(map(pick, found)) == sorted(map(pick, batch))
    assert [r["seq"] for r in sorted(batch, key=lambda r: r["place"]) if r["session_id"] == 1] == [202, 201, 204]


def test_an_open_scan_waits(spark, tmp_path):
    rows = [(1, i, "hand", "", 1, f"Tea {300 + i} g $6") for i in range(4)]
    found, shown_rows = streamed(spark, tmp_path, rows[:2], rows[2:])
    assert [r["seq"] for r in found] == [None] and [r["title"] for r in shown_rows] == [fixed.NOTHING_YET]
    found, _ = streamed(spark, tmp_path, [(1, 9, "done", "", 1, None)])
    assert sorted(r["seq"] for r in found) == [0, 1, 2, 3]


def test_scans_that_depend_on_their_batch_cut_do_not(spark, tmp_path):
    """State (.9, 10), then a scan of (.8, 20) and (.85, 5): the scan keeps its first, which is longer, however it is cut."""
    first = (1, 1, "hand", "", 1, "Tea 300 g $6 50 cal")
    scan = [(1, 2, "hand", "", 2, "Tea 300 g $6 " + "." * 30), (1, 3, "hand", "", 2, "Tea 300 g $6 ."), (1, 4, "done", "", 2, None)]
    want, _ = streamed(spark, tmp_path / "whole", [first, *scan])
    for cut in (2,):
        got, _ = streamed(spark, tmp_path / f"c{cut}", [first, *scan][:cut], [first, *scan][cut:])
        assert sorted((r["seq"], r["place"]) for r in got) == sorted((r["seq"], r["place"]) for r in want)


def test_control_rows(spark, tmp_path):
    tea = lambda seq, kind, scan, price: (1, seq, kind, "", scan, f"Tea 300 g ${price}")
    event = lambda seq, named, session=1: (session, seq, "event", named, None, None)
    done = lambda seq: (1, seq, "done", "", None, None)
    first = [event(1, "a"), tea(2, "passive", 1, 1), event(3, "own"), event(4, " "), event(5, "a"), tea(6, "passive", 2, 2), tea(7, "all", 3, 3), event(1, "a", 2)]
    second = [(1, 8, "start", "", None, None), tea(9, "passive", 4, 4), tea(10, "all", 5, 5), event(11, "b"), tea(12, "all", 6, 6), (1, 13, "mode", "VOLUME", None, None)]
    third = [(1, 14, "stop", "", None, None), tea(15, "all", 7, 7), tea(16, "passive", 8, 8), done(17)]
    found, rows = streamed(spark, tmp_path, first)
    assert sorted(r["seq"] for r in found if r["session_id"] == 1) == [2, 6]
    assert [r["title"] for r in rows if r["session_id"] == 2] == [fixed.NOTHING_YET]
    found, _ = streamed(spark, tmp_path, second)
    assert [r["seq"] for r in found if r["session_id"] == 1] == [12]
    found, rows = streamed(spark, tmp_path, third)
    assert sorted((r["seq"], r["mode"]) for r in found if r["session_id"] == 1) == [(12, "VOLUME"), (16, "VOLUME")]
    assert [r["metric_text"] for r in rows if r["session_id"] == 1] == ["price only"] * 2
    assert [r["seq"] for r in streamed(spark, tmp_path, [(1, 18, "clear", "", None, None)])[0] if r["session_id"] == 1] == [None]


def test_scans_that_count_while_all_is_scanned(spark, tmp_path):
    """By hand and of recognised lines always; passive ones only if due when it began; only recognised lines keep sums."""
    row = lambda seq, kind, text="": (1, seq, kind, "a" if kind == "event" else "", seq, text or f"Tea {seq} g $6")
    rows = [row(1, "event"), row(2, "start"), row(3, "passive"), row(4, "passive"), row(5, "hand"), row(6, "ocr"), row(7, "all"), row(8, "event"), row(9, "passive"), row(10, "stop"), row(11, "all"),
            row(12, "hand", "Subtotal $9"), row(13, "ocr", "Subtotal $9"), row(14, "done")]
    found, _ = streamed(spark, tmp_path, rows[:3], rows[3:9], rows[9:])
    assert sorted(r["seq"] for r in found) == [3, 5, 6, 7, 13]


class Map(dict):
    """A map in state."""

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self.touched.add(key)
        self[key] = value

    def exists(self):
        return bool(self)

    def removeKey(self, key):
        self.touched.add(key)
        self.pop(key, None)

    def iterator(self):
        return iter(self.items())

    touched: set = set()


def test_state_of_random_scans():
    """Cut into batches anyhow, the changes give what a plain collection has; the oldest go after each scan, some to come back;
    a batch writes the keys that it brings, and no others but those that leave."""
    rng = random.Random(7)
    for _ in range(60):
        rows, seq = [], 0
        for scan in range(rng.randint(1, 12)):
            for _ in range(rng.randint(1, 9)):
                seq += 1
                rows.append(SimpleNamespace(kind="hand", named="", scan_id=scan, seq=seq, item_key=rng.choice("abcdefgh"), confidence=rng.choice([0.7, 0.8, 0.9]), text_length=rng.randint(1, 5), metrics=rng.randrange(64), item=str(seq)))
        rows.append(SimpleNamespace(kind="done", named="", scan_id=None, seq=seq + 1))
        plain, scan_items, now = Collection(4), Collection(99), None
        for r in rows:
            if r.kind == "done" or r.scan_id != now:
                for k, x in scan_items.items.items():
                    plain.put(k, *x)
                plain.end_scan()
                scan_items, now = Collection(99), r.scan_id
            if r.kind == "hand":
                scan_items.put(r.item_key, r.confidence, r.text_length, r)
        maps, scalars, out = (Map(), Map(), Map()), None, []
        while rows:
            cut = rng.randint(1, 8)
            brought, rows = rows[:cut], rows[cut:]
            maps[0].touched = set()
            session = Session(*maps, scalars, cap=4)
            for r in brought:
                session.take(r)
            out += session.ended()
            scalars = session.scalars()
        held = {}
        for _, op, key, pos, s, *_ in out:
            if op == "put":
                held[key] = (pos, s)
            elif op == "drop":
                del held[key]
        assert sorted(held, key=held.get) == list(plain.items)
        assert {k: s for k, (_, s) in held.items()} == {k: x[2].seq for k, x in plain.items.items()}
        assert session.counts == [sum(x[2].metrics >> i & 1 for x in plain.items.values()) for i in range(6)]
        assert len(maps[1]) == len(held) and not maps[2]


def test_the_mode_of_the_counts(spark, tmp_path):
    texts = ["Gala apples\n1 kg\n$4", "Milk 1 l $3", "Oil 2 l $9", "Salad 300 cal $5", "Soup 200 cal $4", "Pie 12 inch pizza $9", "Thing $3"]
    rows = [(s, i, "hand", "", 1, t) for s in range(1, 8) for i, t in enumerate(texts[: s])] + [(s, 99, "done", "", 1, None) for s in range(1, 8)]
    found, _ = streamed(spark, tmp_path, rows)
    want = {r["session_id"]: r["mode"] for r in smart_mode(with_metrics(collected(analyze(spark.createDataFrame(rows, SCHEMA))))).collect()}
    assert {r["session_id"]: r["smart"] for r in found} == want


def test_oldest_insertions_go_after_each_scan():
    held = Collection(cap=3)
    for keys in ("abcd", "a", "bx"):
        for k in keys:
            held.put(k, 0.5, 1, k)
        held.end_scan()
    assert list(held.items) == ["a", "b", "x"]


def written(stream, tmp_path):
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("cuts", [[2, 4], [1, 2, 3, 4, 5]])
def test_debounce_stream_gaps(spark, tmp_path, cuts):
    """Pauses of 500 ms go on, longer ones end; an event of the second session keeps time going."""
    start, at, rows = datetime(2024, 1, 1), 0, []
    for i, gap in enumerate((0, 100, 499, 500, 501)):
        at += gap
        rows.append((1, i, start + timedelta(milliseconds=at), "event"))
    rows.append((2, 9, start + timedelta(seconds=60), "event"))
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, kind string")
    batch = sum((F.col("seq") >= c).cast("int") for c in cuts)
    found = written(passive_scans(in_batches(df, batch, len(cuts) + 1, files=1), 500_000), tmp_path)
    assert sorted((r["session_id"], r["n_events"]) for r in found.collect()) == [(1, 1), (1, 4)]


def test_debounce_while_all_is_scanned(spark, tmp_path):
    """What was due before a scan-all runs, events during it make nothing due, and its end calls off what still is."""
    start = datetime(2024, 1, 1)
    said = [(0, "event"), (300, "start"), (400, "event"), (2000, "stop"), (3000, "event"), (3100, "start"), (3200, "stop"), (9000, "event"), (60_000, "event")]
    rows = [(1, i, start + timedelta(milliseconds=at), kind) for i, (at, kind) in enumerate(said)]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, kind string")
    found = written(passive_scans(in_batches(df, F.floor(F.col("seq") / 3), 3, files=1), 500_000), tmp_path)
    first = df.agg(F.min(F.unix_micros("ts"))).first()[0]
    assert sorted((r["first_us"] - first, r["last_us"] - first, r["n_events"]) for r in found.collect()) == [(0, 0, 1), (9_000_000, 9_000_000, 1)]


def test_scan_all_stream(spark, tmp_path):
    sizes = [(1, i + 1, n, True) for i, n in enumerate([3, 5, 5, 5, 5, 5, 5, 5])] + [(2, i, 3 + i, i < 2) for i in range(4)] + [(3, i, i, None) for i in range(1, 120)]
    df = spark.createDataFrame(sizes, "session_id long, step int, collected int, acted boolean")
    found = written(scan_all_stops(in_batches(df, F.least(F.floor(F.col("step") / 3), F.lit(9)), 10, files=1)), tmp_path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stop_of_scan_all(df).collect())) == [(1, 7, 5, 5), (2, 2, 5, 0), (3, 90, 90, 0)]


def test_debounce_gaps(spark):
    start, at, rows = datetime(2024, 1, 1), 0, []
    for i, gap in enumerate((0, 100, 499, 500, 501)):
        at += gap
        rows.append((1, i, start + timedelta(milliseconds=at)))
    found = debounced(spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp")).orderBy("first_ts").collect()
    assert [r["n_events"] for r in found] == [4, 1]


def test_package_sessions(spark):
    packages = ["a", "a", "own", "b", "", "b", "a"]
    rows = [(1, i, datetime(2024, 1, 1, 0, i), p, p == "own") for i, p in enumerate(packages)]
    found = package_sessions(spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, package string, own boolean"))
    assert [r["session_no"] for r in found.orderBy("event_id").collect()] == [0, 0, 1, 1, 2]


def test_scan_all_stops(spark):
    sizes = [3, 5, 5, 5, 5, 5, 5, 5]
    df = spark.createDataFrame([(1, i + 1, n) for i, n in enumerate(sizes)], "session_id long, step int, collected int")
    assert tuple(stop_of_scan_all(df).first()) == (1, 7, 5, 5)
    acted = spark.createDataFrame([(1, i, 3 + i, i < 2) for i in range(4)], "session_id long, step int, collected int, acted boolean")
    assert stop_of_scan_all(acted).first()["step"] == 2
    long = spark.range(1, 120).select(F.lit(1).cast("long").alias("session_id"), F.col("id").cast("int").alias("step"), F.col("id").cast("int").alias("collected"))
    assert stop_of_scan_all(long).first()["step"] == 90


def test_known_screens_are_looked_up(spark, tmp_path):
    """Scans of screens with more than twice what is kept leave what their rows one by one leave, and no text is parsed for
    each scan."""
    texts = [(g, k, f"Tea {k // 2 * (g + 1)} g $6" + " ." * (k % 2)) for g, n in ((0, 40), (1, 9), (2, 14)) for k in range(n)]
    what = spark.createDataFrame(texts, "grp long, place int, raw_text string")
    rng = random.Random(5)
    scans = spark.createDataFrame([(s, i * 1_000_000, rng.randrange(3)) for s in range(4) for i in range(7)], "session_id long, last_us long, grp long")
    batch = (F.col("last_us") >= 3_000_000).cast("int")
    items = screen_items(what, ["grp"], 5)
    assert items.groupBy("grp").count().agg(F.max("count")).first()[0] == 10
    got = looked(written(look_stream(in_batches(scans, batch, 2, files=1), items, ["grp"], 5), tmp_path / "look"), items)
    rows = seen(in_batches(scans, batch, 2, files=1), with_ends(what, ["grp"]), ["grp"])
    want = collections(written(collect_stream(rows, cap=5), tmp_path / "rows"))
    pick = lambda df: sorted(map(tuple, df.select("session_id", "place", "seq", "item_key", "smart").collect()))
    assert pick(got) == pick(want) and len(pick(got)) == 20


class Handle:
    """One value in state and timers, with the calls that are made to them."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def packs(rows, kinds):
    """Rows as a bucket's call gets them."""
    return pd.DataFrame({"rows": [np.array(part, kinds).tobytes() for part in (rows[:50], rows[50:]) if part]})


def plain_scans(rows, gap):
    """(first, last, n) of one session's rows (us, seq, kind), all of them being past."""
    out, first, last, n, scanning = [], 0, 0, 0, False
    for us, _, kind in [*sorted(rows), (10**18, 0, "end")]:
        if n and us - last > gap:
            out.append((first, last, n))
            n = 0
        if kind == "event" and not scanning:
            first, last, n = us if not n else first, us, n + 1
        elif kind in ("start", "stop"):
            scanning, n = kind == "start", n if kind == "start" else 0
    return out


def test_a_bucket_of_sessions_is_one_call_to_state():
    """However many sessions a batch has, the debounce reads and writes one value and sets one timer; each session has the scans of
    its own rows, whichever batch brings them and whenever the bucket is called."""
    rng, gap = random.Random(3), 3_000
    number = {"event": 1, "start": 2, "stop": 3, "other": 0}
    rows = [(s, rng.randrange(200_000) // 7 * 7, seq, rng.choice(["event"] * 6 + ["start", "stop", "other"])) for seq in range(6_000) for s in (rng.randrange(400),)]
    handle = Handle()
    debounce = Debounce(gap)
    debounce.init(handle)
    found, ends = [], [0, 40_000, 90_000, 140_000, 200_000, 10**9, 10**9]
    for low, high in zip(ends, ends[1:], strict=False):
        brought = packs([(s, us, seq, number[kind]) for s, us, seq, kind in rows if low <= us < high], WAITING)
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda low=low: low // 1000)
        handle.calls = 0
        found += debounce.handleInputRows((0,), iter([brought[:1], brought[1:]]), clock)
        assert handle.calls <= 4 and len(handle.timers - set(range(low // 1000 + 1))) <= 1
        assert not list(debounce.handleExpiredTimer((0,), clock, None))
    got = sorted(tuple(r) for part in found for r in part.itertuples(index=False))
    want = sorted((s, *scan) for s in range(400) for scan in plain_scans([x[1:] for x in rows if x[0] == s], gap))
    assert got == want and len(got) > 400
    assert handle.value[2] and not handle.value[3]


def test_what_a_scan_leaves_is_remembered():
    """A bucket's sessions are read and written at once; each holds what a plain collection holds, as runs; what a screen makes of
    the same runs is worked out once, and what is remembered is bounded."""
    rng = random.Random(4)
    screens = {k: [(rng.choice("abcdefghijklmnop") if k > 1 else f"{k}-{i}", rng.choice([0.7, 0.8, 0.9]), rng.randint(1, 3), rng.randrange(64), i) for i in reversed(range(n))] for k, n in enumerate((12, 14, 3, 6, 9))}
    screens = {k: list({x[0]: x for x in items}.values()) for k, items in screens.items()}
    scans = [(s, i * 10 + rng.randrange(9), rng.choice([0, 1] if s < 200 else list(screens))) for s in range(300) for i in range(12)]
    want = {}
    for s, us, screen in scans:
        now = want.setdefault(s, Collection(5))
        for name, sure, length, _, item in screens[screen]:
            now.put(name, sure, length, (screen, item, us))
        now.end_scan()
    for most in (collect.REMEMBERED, 50):
        collect.REMEMBERED, before = most, collect.REMEMBERED
        try:
            handle, looking, got = Handle(), Looking(screens, 5), {}
            looking.init(handle)
            for low in (0, 40, 80):
                brought = [x for x in scans if low <= x[1] < low + 40]
                brought = packs(rng.sample(brought, len(brought)), SEEN)
                handle.calls = 0
                for r in pd.concat(looking.handleInputRows((0,), iter([brought[:1], brought[1:]]), None)).itertuples(index=False):
                    assert list(r.place) == [sum(r.n[:i]) for i in range(len(r.n))]
                    got[r.session_id] = [(screen, item - i, us) for screen, item, n, us in zip(r.screen, r.item, r.n, r.us, strict=True) for i in range(n)]
                assert handle.calls == 2
                assert looking.remembered <= most + 12
            assert got == {s: [x[2] for x in now.items.values()] for s, now in want.items()}
            assert most == 50 or len([1 for (_, screen) in looking.moves if screen < 2]) < 600
        finally:
            collect.REMEMBERED = before


def test_sessions_of_a_bucket_in_a_stream(spark, tmp_path):
    """A stream of many sessions, one without an id, has as many values in state as buckets."""
    start, rng = datetime(2024, 1, 1), random.Random(6)
    rows = [(s or None, i, start + timedelta(milliseconds=rng.randrange(20_000) + 20_000 * (i // 4)), "event") for s in range(90) for i in range(12)]
    rows += [(10**18, 99, start + timedelta(days=k), "stop") for k in (1, 2)]
    df = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, kind string")
    batch = F.when(F.col("seq") == 99, F.dayofmonth("ts") + 1).otherwise(F.floor(F.col("seq") / 4)).cast("int")
    stream = passive_scans(in_batches(df, batch, 5, files=1), 500_000, buckets=3)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 3
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    want = debounced(df.where("seq < 99").withColumn("event_id", F.col("seq"))).select("session_id", F.unix_micros("first_ts"), F.unix_micros("last_ts"), "n_events")
    pick = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert pick(got) == pick(want) and any(r["session_id"] is None for r in got.collect())


def test_a_stream_of_buckets_has_tasks_for_cores(spark):
    """Shuffles may have many partitions; a stream whose state is in a few buckets has as many as there are cores, and the setting
    stays as it was. Files of a batch are as many as there are cores, too, where its rows fill them."""
    rows = scan_all_events(spark, "/root/testdata/sf0.01")
    assert files_of(rows, F.floor(F.dayofmonth("ts") / 16), 3, parsed=False) == 3
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "40")
    try:
        assert tasks_of(4, spark) == 4 and tasks_of(TASK_BUCKETS * 9 + 1, spark) == 10 and tasks_of(TASK_BUCKETS * 99, spark) == 40
        out = _streamed(_timed(rows, PAUSE, 16), 16)
        assert spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, before)
    folder = Path(out.inputFiles()[0].removeprefix("file:")).parent.parent
    assert len([x for x in (folder / "checkpoint/state/0").iterdir() if x.name.isdigit()]) == 4
