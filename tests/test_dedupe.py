"""Folds in runs against folds one by one, and numbers within groups against row_number."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from gramwise.operators import collected, fold, numbered
from gramwise.operators.dedupe import Collection, after, compose, record

ITEM = ["'x' as name", "1.0D as price", "struct(cast(null as string) as kind, cast(null as double) as amount_base) as quantity"]


def rows_of(rng, n, groups=2, keys=4, scans=3):
    """(session, scan, seq, key, confidence, text); the promotion stands for the key."""
    return [(rng.randrange(groups), rng.randrange(scans), i, rng.choice("abcdefgh"[:keys]), rng.choice([0.67, 0.7, 0.8464, 0.95]), "x" * rng.randint(1, 30)) for i in rng.sample(range(10 * n), n)]


def items(spark, rows):
    df = spark.createDataFrame(rows, "session_id long, scan_id long, seq long, k string, confidence double, raw_text string").repartition(5)
    return df.selectExpr("*", *ITEM, "struct(k as type) as promotion")


def folded(rows, group):
    """{group: [(key, seq)] in the order of first sight}"""
    out = {}
    for r in sorted(rows, key=lambda r: r[2]):
        out.setdefault(group(r), Collection(10**9)).put(r[3], r[4], len(r[5]), r[2])
    return {g: [(k, x[2]) for k, x in c.items.items()] for g, c in out.items()}


@pytest.mark.parametrize(("run", "fan"), [(256, 64), (2, 2), (3, 2), (1, 5)])
def test_fold_in_runs(spark, run, fan):
    rng = random.Random(run * 10 + fan)
    rows = rows_of(rng, 300)
    got = {}
    for r in fold(items(spark, rows), ["session_id"], ["seq"], run, fan).orderBy("session_id", "place").collect():
        got.setdefault(r["session_id"], []).append((r["k"], r["seq"]))
    assert got == folded(rows, lambda r: r[0])


def test_a_hot_key(spark):
    """A key with nearly all rows, ever longer texts among them."""
    rng = random.Random(2)
    rows = [(1, 1, i, "a" if i % 50 else "b", rng.choice([0.7, 0.9]), "x" * (1 + i // 7 + rng.randrange(9))) for i in range(3000)]
    got = fold(items(spark, rows), ["session_id"], ["seq"], 64, 4).orderBy("place").collect()
    assert [(r["k"], r["seq"]) for r in got] == folded(rows, lambda r: r[0])[1]


@pytest.mark.parametrize(("cap", "run"), [(500, 256), (3, 2)])
def test_collected(spark, cap, run):
    rng = random.Random(cap)
    rows = rows_of(rng, 300, groups=3, keys=8, scans=6)
    got = {}
    for r in collected(items(spark, rows), cap, run, 2).orderBy("session_id", "place").collect():
        got.setdefault(r["session_id"], []).append((r["k"], r["seq"]))
    want = {}
    for session in {r[0] for r in rows}:
        held = Collection(cap)
        for scan in range(6):
            part = [r for r in rows if r[:2] == (session, scan)]
            by_seq = {r[2]: r for r in part}
            for k, seq in folded(part, lambda r: r[0]).get(session, []):
                held.put(k, by_seq[seq][4], len(by_seq[seq][5]), seq)
            held.end_scan()
        want[session] = [(k, x[2]) for k, x in held.items.items()]
    assert got == want


def test_summaries_compose(spark):
    """A run does to what came before what its summary says, however it was put together."""
    rng = random.Random(3)
    cases = [[(rng.choice([0.7, 0.8, 0.9]), rng.randint(1, 6), i) for i in range(rng.randint(2, 9))] for _ in range(80)]
    rows = [(n, case[0], [list(x) for x in case[1:]], rng.randint(0, len(case) - 2)) for n, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, before struct<c:double,n:int,i:int>, run array<struct<c:double,n:int,i:int>>, cut int")
    one = lambda l: F.aggregate(F.slice(l, 2, F.greatest(F.size(l) - 1, F.lit(0))), record(F.get(l, F.lit(0))), lambda s, x: compose(s, record(x)))
    left, right = F.slice("run", F.lit(1), F.col("cut")), F.slice("run", F.col("cut") + 1, F.size("run"))
    both = F.when(F.col("cut") == 0, one(right)).otherwise(compose(one(left), one(right)))
    found = df.where("size(run) > 0").select("id", after(one(F.col("run")), F.col("before"))["i"].alias("whole"), after(both, F.col("before"))["i"].alias("cut_")).collect()
    for r in found:
        now = cases[r["id"]][0]
        for x in cases[r["id"]][1:]:
            now = x if x[0] > now[0] or x[1] > now[1] else now
        assert r["whole"] == r["cut_"] == now[2]


def test_numbers(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 4 * 0).otherwise(F.when(F.col("id") % 7 > 0, F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 5003).alias("o")).repartition(6)
    want = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("o")).cast("long"))
    assert sorted(map(str, numbered(df, ["g"], [F.col("o")]).collect())) == sorted(map(str, want.collect()))


def test_folds_send_nothing_that_grows_through_the_driver(spark):
    """Written tables are small beside their rows: joins of rows by their numbers are shuffled whatever the files' size."""
    rows = items(spark, rows_of(random.Random(5), 300))
    for df in (fold(rows, ["session_id"], ["seq"]), collected(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "_row" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)
