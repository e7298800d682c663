"""Dedupe as an ordered fold by key, and the cap on what is kept.

A later item of a key replaces the one held if it is surer or its text longer. That is neither associative nor a maximum, but
what a run of items does is a function of the item held before it: the first of the run that is surer or longer takes its
place, and from there on the run goes its own way. Only items surer or longer than all before them in the run can be that
first one, so a run is summed up by these records and what each ends as. Summaries compose, and so a key's rows are folded in
runs, in parallel, however many it has. All of it is Spark's own expressions over a few narrow columns; the texts are
joined to what survives.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.functions import fixed
from gramwise.functions.text import canonical_name, fixed_point, let, units
from gramwise.operators.numbering import numbered
from gramwise.shared import apart, materialise, small

LARGEST_INT = 2147483647
#: Rows of a key that are folded at once, and summaries that are composed at once.
RUN, FAN = 256, 64


def item_key() -> Column:
    """Name, price, kind and whole amount of the quantity, and promotion: what makes two items one."""
    amount = F.when(F.col("quantity.amount_base").isNotNull(), F.least(F.col("quantity.amount_base"), F.lit(float(LARGEST_INT))).cast("int")).otherwise(0)
    return F.concat_ws("|", canonical_name(F.col("name")), fixed_point(F.col("price"), 2), F.coalesce(F.col("quantity.kind"), F.lit("null")), amount.cast("string"), F.col("promotion.type"))


def _beats(new: Column, old: Column) -> Column:
    return (new["c"] > old["c"]) | (new["n"] > old["n"])


def record(item: Column) -> Column:
    """The summary of a run of one item (a struct with c, its confidence, and n, its length): array of (c, n, out)."""
    return F.array(F.struct(item["c"].alias("c"), item["n"].alias("n"), item.alias("out")))


def after(summary: Column, item: Column) -> Column:
    """What a run makes of the item held before it."""
    first = F.get(F.filter(summary, lambda r: _beats(r, item)), F.lit(0))
    return F.coalesce(first["out"], item)


def compose(one: Column, two: Column) -> Column:
    """The summary of two runs, one after the other. The first record is the first item: its out is what the run itself
    leaves."""

    def joined(tops: Column) -> Column:
        onward = F.transform(one, lambda r: F.struct(r["c"].alias("c"), r["n"].alias("n"), after(two, r["out"]).alias("out")))
        return F.concat(onward, F.filter(two, lambda r: (r["c"] > tops["c"]) | (r["n"] > tops["n"])))

    tops = F.struct(F.array_max(F.transform(one, lambda r: r["c"])).alias("c"), F.array_max(F.transform(one, lambda r: r["n"])).alias("n"))
    return let(tops, joined)


def _composed(parts: Column) -> Column:
    """The summary of summaries in order; there is one at least."""
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), compose)


def survivors(rows: DataFrame, keys: list[str], order: list[str], run: int = RUN, fan: int = FAN) -> DataFrame:
    """(keys, first, c, n, _row) from (keys, order, c, n, _row): what an ordered fold leaves of each key, and the order of the
    key's first row. Keys with more than `run` rows are folded in runs, which are dealt by ranges and composed as a tree."""
    item = F.struct(F.struct(*order).alias("at"), "c", "n", "_row")

    def listed(df: DataFrame, *by) -> DataFrame:
        return df.groupBy(*keys, *by).agg(F.array_sort(F.collect_list(item)).alias("l"))

    def ended(df: DataFrame, first: Column, last: Column) -> DataFrame:
        return df.select(*keys, first.alias("first"), last.alias("_last")).select(*keys, "first", "_last.c", "_last.n", "_last._row")

    many = materialise(rows.groupBy(*keys).count().where(F.col("count") > run).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "hot")
    head = F.get("l", F.lit(0))
    fold_list = F.aggregate(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), head, lambda a, x: F.when(_beats(x, a), x).otherwise(a))
    if not many.take(1):
        return ended(listed(rows), head["at"], fold_list)
    many = small(many)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    few = ended(listed(rows.join(many, same, "left_anti")), head["at"], fold_list)
    hot = numbered(rows.join(many, same, "left_semi"), keys, [F.col(c) for c in order], "_n")
    runs = listed(hot, F.expr(f"(_n - 1) div {run}").alias("_run"))
    sums = materialise(runs.select(*keys, "_run", _composed(F.transform("l", record)).alias("s")), "runs")
    last = sums.agg(F.max("_run")).first()[0]
    while last:
        groups = sums.groupBy(*keys, F.expr(f"_run div {fan}").alias("_up")).agg(F.array_sort(F.collect_list(F.struct("_run", "s"))).alias("l"))
        sums = materialise(groups.select(*keys, F.col("_up").alias("_run"), _composed(F.transform("l", lambda x: x["s"])).alias("s")), "runs")
        last //= fan
    whole = F.get("s", F.lit(0))
    # The first record is the first item of all.
    firsts = hot.where("_n = 1").select(*keys, F.struct(*order).alias("first"))
    merged = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], whole["out"].alias("_last")).hint("merge").join(firsts.hint("merge"), same)
    return few.unionByName(merged.select(*keys, "first", "_last.c", "_last.n", "_last._row"))


def _keyed(items: DataFrame) -> DataFrame:
    """Items with item_key (their own, if they come with it) and _row, a number of the row, written once: parsing isn't done again."""
    key = F.col("item_key") if "item_key" in items.columns else item_key()
    return materialise(items.select(*_plain(items), key.alias("item_key"), F.monotonically_increasing_id().alias("_row")), "items")


def _plain(items: DataFrame) -> list[str]:
    return [c for c in items.columns if c != "item_key"]


def _narrow(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*names, "item_key", F.col("confidence").alias("c"), units(F.col("raw_text")).alias("n"), "_row")


def fold(items: DataFrame, group: list[str], order: list[str], run: int = RUN, fan: int = FAN) -> DataFrame:
    """One row of each group and item key, with item_key and place (0, 1.. in the group): the item that survives a fold in
    order, at the place of the first. Neither a group nor a key has to fit a task."""
    rows = _keyed(items)
    left = survivors(_narrow(rows, *group, *order), [*group, "item_key"], order, run, fan)
    left = numbered(left.select(*group, "first", "_row"), group, [F.col("first")], "_n")
    return apart(rows, left.select("_row", (F.col("_n") - 1).cast("int").alias("place")), "_row").select(*_plain(items), "item_key", "place")


class Collection:
    """A session's items by key in the order of first sight: (confidence, length, what stands for the item).

    The survivors of a scan are added one by one, then the oldest keys go if there are more than `cap`.
    """

    def __init__(self, cap: int = fixed.KEPT):
        self.cap, self.items = cap, {}

    def put(self, key: str, confidence: float, length: int, item) -> None:
        old = self.items.get(key)
        if old is None or confidence > old[0] or length > old[1]:
            self.items[key] = (confidence, length, item)

    def end_scan(self) -> None:
        for key in list(islice(self.items, max(0, len(self.items) - self.cap))):
            del self.items[key]


def collected(items: DataFrame, cap: int = fixed.KEPT, run: int = RUN, fan: int = FAN) -> DataFrame:
    """What a session has after all its scans, with item_key and place: each scan is folded, then added, and the last `cap` keys
    stay after each.

    Scans are folded in parallel. What goes depends on all that went before, so only what scans leave is then read in the
    order of a session, as a stream of five narrow columns: a task holds `cap` keys of a session.
    """
    rows = _keyed(items)
    left = survivors(_narrow(rows, "session_id", "scan_id", "seq"), ["session_id", "scan_id", "item_key"], ["seq"], run, fan)
    steps = left.select("session_id", "scan_id", "first", "item_key", "c", "n", "_row").repartition("session_id").sortWithinPartitions("session_id", "scan_id", "first")

    def read(batches):
        now, scan, held = None, None, None
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("session_id", "scan_id", "item_key", "c", "n", "_row")]
            for session, at, key, c, n, row in zip(*columns, strict=True):
                if held is None or session != now:
                    if held:
                        held.end_scan()
                        out += enumerate(x[2] for x in held.items.values())
                    now, scan, held = session, at, Collection(cap)
                elif at != scan:
                    held.end_scan()
                    scan = at
                held.put(key, c, n, row)
            yield _placed(out)
        if held:
            held.end_scan()
            yield _placed(list(enumerate(x[2] for x in held.items.values())))

    return apart(rows, steps.mapInArrow(read, "_row bigint, place int"), "_row").select(*_plain(items), "item_key", "place")


def _placed(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for _, r in out], pa.int64()), pa.array([p for p, _ in out], pa.int32())], ["_row", "place"])


def keep_last(items: DataFrame, cap: int) -> DataFrame:
    """The last `cap` of each session's collected items."""
    last = items.groupBy("session_id").agg(F.max("place").alias("_last"))
    return items.join(last, "session_id").where(F.col("place") > F.col("_last") - cap).drop("_last")
