"""Numbers within groups, without a task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gramwise.shared import materialise, small


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """Adds name: 1, 2.. within each group, in the order given; null keys make a group as others do.

    row_number() brings a group into one task. Here the rows are dealt by ranges of (group, order) instead, so that a group
    with a third of all rows lies in many partitions, and are written once with their place. A group's number of rows in
    each partition then tells what stands before its rows there: as many rows as groups and partitions. The last join is
    by group and partition, so no key of it has more than a partition's rows.
    """
    keys = [F.col(f"`{g}`").asc_nulls_first() for g in group]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*[f"`{g}`" for g in group], "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*[f"`{g}`" for g in group]).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_first", before.alias("_before"))
    runs = small(materialise(runs, "runs"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(runs, same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))
