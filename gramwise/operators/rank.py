"""Unit-value metrics, the automatic mode, ranking and rows for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gramwise.functions import fixed
from gramwise.functions.text import fixed_point, money
from gramwise.operators.numbering import numbered

#: Modes in the order that settles ties, with the metric's column, whether less is better, digits and ending of the label.
MODES = {
    "MASS": ("price_per_kg", True, None, "/kg"),
    "VOLUME": ("price_per_l", True, None, "/L"),
    "CALORIE": ("calories_per_dollar", False, 1, " cal/$"),
    "PIZZA": ("pizza_area_per_dollar", False, 1, " in²/$"),
    "UNIT": ("price_per_unit", True, None, "/unit"),
    "PORTION": ("portion_points_per_dollar", False, 2, " est. portion/$"),
}

def with_metrics(items: DataFrame) -> DataFrame:
    amount, price, times = F.col("quantity.amount_base"), F.col("price"), F.col("promotion.received_multiplier")

    def of(kind: str, value: Column) -> Column:
        return F.when((F.col("quantity.kind") == kind) & (amount > 0), value)

    return items.withColumns({
        "price_per_kg": of("MASS_G", price / ((amount * times) / 1000.0)),
        "price_per_l": of("VOLUME_ML", price / ((amount * times) / 1000.0)),
        "calories_per_dollar": F.when(F.col("calories") > 0, F.col("calories") * times / price),
        "pizza_area_per_dollar": of("PIZZA_AREA_SQIN", amount * times / price),
        "price_per_unit": of("COUNT", price / (amount * times)),
        "portion_points_per_dollar": F.when(F.col("portion.points") > 0, F.col("portion.points") * times / price),
    })


def smart_mode(items: DataFrame) -> DataFrame:
    """(session_id, mode): the metric that most items have, of those that two or more have; without such, of all."""
    counts = items.groupBy("session_id").agg(*[F.count(c).alias(m) for m, (c, *_) in MODES.items()])
    each = F.array(*[F.struct(F.col(m).alias("n"), F.lit(-i).alias("order"), F.lit(m).alias("mode")) for i, m in enumerate(MODES)])
    best = F.coalesce(F.array_max(F.filter(each, lambda x: x["n"] >= 2)), F.array_max(each))
    return counts.select("session_id", best["mode"].alias("mode"))


def automatic_mode(counts: list[int]) -> str:
    """The same from the counts of one session, in the order of MODES."""
    best = max(((n, -i) for i, n in enumerate(counts) if n >= 2), default=None) or max((n, -i) for i, n in enumerate(counts))
    return list(MODES)[-best[1]]


def rank(items: DataFrame, mode: str | None = "SMART", spread: bool = False) -> DataFrame:
    """Adds mode (with None, each row names its own in that column), metric, metric_label and rank 1..n by session: items with
    the metric first, the best first; the others by price; ties in the order in which the items came.

    A session is ranked by one task: what is collected is at most `fixed.KEPT` items, what one scan saw not many more. With
    spread, sessions of any size are ranked by ranges of their order, over all tasks.
    """
    items = with_metrics(items)
    if mode == "SMART":
        items = items.join(smart_mode(items), "session_id")
    elif mode:
        items = items.withColumn("mode", F.lit(mode))
    metric, key, label = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(fixed.PRICE_ONLY)
    for name, (column, less, digits, ending) in MODES.items():
        own, value = F.col("mode") == name, F.col(column)
        said = money(value, F.col("currency")) if digits is None else fixed_point(value, digits)
        metric = F.when(own, value).otherwise(metric)
        key = F.when(own, value if less else -value).otherwise(key)
        label = F.when(own & value.isNotNull(), F.concat(said, F.lit(ending))).otherwise(label)
    ranked = items.withColumns({"metric": metric, "metric_label": label, "_key": key})
    order = [F.col("_key").asc_nulls_last(), F.when(F.col("metric").isNull(), F.col("price")).asc(), F.col("place").asc()]
    if spread:
        return numbered(ranked, ["session_id"], order, "rank").drop("_key").withColumn("rank", F.col("rank").cast("int"))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("session_id").orderBy(*order))).drop("_key")


def display_rows(ranked: DataFrame, top: int = fixed.SHOWN) -> DataFrame:
    """The rows that are shown: title, metric with promotion, details, and whether the row stands out as best."""
    dot = F.lit(" · ")
    promo = F.when(F.col("promotion.type") != "none", F.concat(dot, F.col("promotion.label"))).otherwise("")
    parts = F.array_compact(F.array(money(F.col("price"), F.col("currency")), F.col("quantity.display"), F.concat(F.col("calories").cast("int").cast("string"), F.lit(" cal")), F.concat((F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))))
    return ranked.where(F.col("rank") <= top).select("session_id", "rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("name")).alias("title"), F.concat("metric_label", promo).alias("metric_text"), F.array_join(parts, " · ").alias("meta"), ((F.col("rank") == 1) & (F.col("metric_label") != fixed.PRICE_ONLY)).alias("best"))


def badge(items: DataFrame) -> DataFrame:
    return items.groupBy("session_id").agg(F.least(F.count("*"), F.lit(fixed.BADGE_MOST)).alias("badge"))


def shown(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """display_rows, and for each of the sessions (session_id) without any a row of rank 0 that says so."""
    empty = sessions.select("session_id").distinct().join(rows.select("session_id").distinct(), "session_id", "left_anti")
    none = empty.select("session_id", F.lit(0).alias("rank"), F.lit(fixed.NOTHING_YET).alias("title"), F.lit("").alias("metric_text"), F.lit("").alias("meta"), F.lit(False).alias("best"))
    return rows.unionByName(none)
