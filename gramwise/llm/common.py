"""What the training-data operators share: the shared folder, stable row ids, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gramwise.shared import materialise, release  # noqa: F401  the operators take them from here

#: Rows that a small side may have to be sent to every executor; past it, a shuffle join is used.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting: df should be materialised and narrow. Larger sides stay shuffle joins."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that docs doesn't have, whatever the case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, dots in their names or not."""
    return [F.col(f"`{c}`") for c in docs.columns]


def id_kind(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def with_row_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, text): rid is a unique number, ordered as id, null ids first and equal ids by a digest of the text.

    Whole numbers that are unique and not null are used as they are, which a narrow aggregation checks. Otherwise the rows
    are sorted, numbered and written once, so that every later read sees the same numbers.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if id_kind(docs, id_col) in ("tinyint", "smallint", "int", "bigint") and not rows.groupBy("id").count().where("count > 1 or id is null").take(1):
        return rows.select(F.col("id").cast("long").alias("rid"), "id", "text")
    ordered = rows.orderBy(F.col("id").asc_nulls_first(), F.sha2(F.col("text").cast("binary"), 256))
    return materialise(ordered.select(F.monotonically_increasing_id().alias("rid"), "id", "text"), "rows")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Freed memory goes back to the system: workers stay for later stages, and theirs counts there."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't GNU's
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cut a batch into runs of rows whose column holds about `most` bytes; one long text makes a run of its own.

    Between runs Arrow gives back what it has freed: workers stay for later stages, and their memory counts there.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            pa.default_memory_pool().release_unused()
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
        pa.default_memory_pool().release_unused()
