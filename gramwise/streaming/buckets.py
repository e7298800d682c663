"""Sessions by the bucket: a call to a stateful operator, and each call that this makes to its state, takes milliseconds, so it is
made for some hundreds of sessions at once. A bucket's state is one value, in which what its sessions hold is packed. Its rows come
packed, too: row by row they take longer on their way than what is done with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Buckets of a stream unless it says otherwise; a stream that goes on from its checkpoint must have as many as before.
BUCKETS = 64
#: Rows that a bucket has over all of a stream whose number of rows is known.
BUCKET_ROWS = 16_384
#: Buckets of a task: state is opened and written anew by each task of each batch, which costs far more than the rows of a few.
TASK_BUCKETS = 256
#: Rows that a task deals over buckets at once.
PACKED_ROWS = 100_000
#: Stands for a session without an id, as whole numbers with nulls among them would become floats.
NO_SESSION = -(2**63)


def buckets_of(rows: DataFrame) -> int:
    """As many buckets as hold the rows, and some for each core at least."""
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BUCKET_ROWS))


def tasks_of(buckets: int, spark: SparkSession) -> int:
    """Tasks that share the buckets: one for each core, more for many buckets, but no more than shuffles have."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-buckets // TASK_BUCKETS)))


def in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds bucket, by session_id, which becomes a number in any case."""
    return rows.withColumns({"bucket": F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"), "session_id": F.coalesce(F.col("session_id").cast("long"), F.lit(NO_SESSION))})


def packed(rows: DataFrame, kinds: np.dtype) -> DataFrame:
    """(bucket, us, rows) of rows with bucket and the columns of kinds, of which us is one: what a task has of a bucket among so many
    rows is one value, and us its last time. Nothing is shuffled, and no column may be null."""

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        bucket = table.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        bucket, every = bucket[order], np.empty(len(order), kinds)
        for name in kinds.names:
            every[name] = table.column(name).to_numpy()[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        last = np.maximum.reduceat(every["us"], starts)
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(last), pa.array([x.tobytes() for x in np.split(every, starts[1:])], pa.binary())], ["bucket", "us", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACKED_ROWS:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    return rows.select("bucket", *kinds.names).mapInArrow(run, "bucket int, us long, rows binary")


def session_id() -> Column:
    """What it was before."""
    return F.nullif(F.col("session_id"), F.lit(NO_SESSION)).alias("session_id")
