"""Mixing sources to target weights with DataFrame functions only.

Every document gets a hash. Sizes are summed by source and leading bits of the hash; the bucket in which a source's
budget runs out is the only one refined, by the next bits, down to a single hash. What lies below is taken: nothing
is sorted, and a histogram has at most 2**BITS rows a source, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gramwise.llm.common import BROADCAST_ROWS, materialise, own_columns

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a hash, and of one level of the histogram.
HASH_BITS, BITS = 60, 15


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh `weights` in turn. Together they get `share` of all sizes by weight; a
    target stops at `cap` times its source's size and the rest is shared again. In order of size per weight the stopped
    ones come first, so two running sums give what repeated sharing ends at. The table has a row for each source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double").alias("weight"), (cap * F.col("source_size")).alias("most"), (share * F.sum("source_size").over(W.partitionBy())).alias("budget"))
    up = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing))
    marked = weighed.withColumn("stops", F.col("most") * rest <= (F.col("budget") - before) * F.col("weight"))
    whole = W.partitionBy()
    left = F.col("budget") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(whole)
    share_of = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(whole)
    return marked.select("source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(left * F.col("weight") / share_of).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row.

    Each document is taken the whole number of times that its source's target allows, and once more if its hash is
    below the source's threshold. The hash is of id and text, so reruns agree; rows equal in both are taken alike.
    The sum comes within half of one document (or of rows that share a hash) of the target. A null text has size 0,
    a null source is a source of its own, the last; an empty table gives no rows.
    """
    rows = materialise(_hashed(docs, id_col, source_col, text_col), "mix")
    return _mix(rows, weights, share, cap).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    The thresholds are few and the hash is worked out again from the row, so texts are not shuffled.
    """
    rows = materialise(_hashed(docs, id_col, source_col, text_col), "mix")
    bounds, per_source = _bounds(rows, weights, share, cap)
    # The row travels as one column, so that no name of ours can be one of its own.
    own = docs.select(F.struct(*own_columns(docs)).alias("row"), F.col(f"`{source_col}`").alias("source"), _columns(id_col, source_col, text_col)["hash"].alias("hash"))
    found = per_source(own, bounds.drop("source_size", "target"))
    return found.select("row", F.explode(F.array_repeat(F.lit(1), _copies(F.col("hash")).cast("int")))).select("row.*")


def _columns(id_col: str, source_col: str, text_col: str) -> dict[str, Column]:
    text, number = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`").cast("string")
    hashed = F.conv(F.substring(F.md5(F.concat_ws("\x1f", number, F.col(f"`{text_col}`")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    return {"id": F.col(f"`{id_col}`"), "source": F.col(f"`{source_col}`"), "size": F.regexp_count(text, F.lit(WORD)).cast("long"), "hash": hashed}


def _hashed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*[c.alias(n) for n, c in _columns(id_col, source_col, text_col).items()])


def _mix(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    bounds, per_source = _bounds(rows, weights, share, cap)
    return per_source(rows, bounds).withColumn("copies", _copies(F.col("hash")))


def _copies(hashed: Column) -> Column:
    more = F.coalesce((hashed < F.col("_edge")) | ((hashed == F.col("_edge")) & F.col("_edge_in")), F.lit(False))
    return F.col("_whole") + F.when((F.col("_rest") > 0) & more, 1).otherwise(0)


def _bounds(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float):
    """A row of targets and thresholds for each source, and the join that brings it to rows."""
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    few = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # tables below have a row for each source

    def per_source(df: DataFrame, bounds: DataFrame, source: str = "source") -> DataFrame:
        bounds = bounds.withColumnRenamed("source", "_of")
        return df.join(F.broadcast(bounds) if few else bounds, df[source].eqNullSafe(bounds["_of"]), "left").drop("_of")

    goal = targets(sizes, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(F.lit(0)).cast("long")
    goal = materialise(goal.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "targets")
    bounds = goal.select("source", F.lit(0).cast("long").alias("edge"), F.col("rest").alias("left"))
    for level in range(1, HASH_BITS // BITS + 1):
        bounds = _refine(rows, bounds, level, per_source)
    final = bounds.select("source", F.col("edge").alias("_edge"), (2 * F.col("left") > F.col("sum")).alias("_edge_in"))
    out = per_source(goal, final).select("source", "source_size", "target", F.col("whole").alias("_whole"), F.col("rest").alias("_rest"), "_edge", "_edge_in")
    out = materialise(out, "bounds")
    return out, per_source


def _refine(rows: DataFrame, bounds: DataFrame, level: int, per_source) -> DataFrame:
    """One level down: (source, edge, left, sum), edge being the bucket in which `left` runs out, as a number of level * BITS bits."""
    shift = HASH_BITS - level * BITS
    inside = per_source(rows.where("size > 0"), bounds.select("source", "edge", "left")).where(F.shiftright("hash", shift + BITS) == F.col("edge"))
    histogram = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("sum"), F.first("left").alias("left"))
    run = W.partitionBy("source").orderBy("bucket")
    running = histogram.withColumn("to", F.sum("sum").over(run))
    crossing = running.where(F.col("to") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "sum", (F.col("left") - F.col("to") + F.col("sum")).alias("left"))).alias("at"))
    return crossing.select("source", F.col("at.bucket").alias("edge"), F.col("at.left").alias("left"), F.col("at.sum").alias("sum"))
