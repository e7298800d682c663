"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders to remove when the driver ends.
_FOLDERS: set[str] = set()
#: Rows that a small side may have to be sent to every executor.
BROADCAST_ROWS = 200_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where tables that were written stand.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, as in tests, a local session gets a folder of its own; on a cluster it must
    be set, as executors don't see the driver's folders."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if sc.getCheckpointDir() is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def remove(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # what is left behind costs room only
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one; it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/gramwise-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(remove, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here, and a lost executor loses nothing.

    What was shuffled for it is of no use once it is written, so Spark is asked to remove that at the end of the query.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing will read again."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            remove(df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), path)


def apart(one: DataFrame, two: DataFrame, *keys: str) -> DataFrame:
    """A join of sides that both grow with the input. What comes out of Python or of a table counts by what went in or by its
    file, which is small beside its rows: left to itself Spark sends such a side through the driver."""
    return one.hint("merge").join(two.hint("merge"), list(keys))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting: df should be materialised and narrow. Larger sides are shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
