"""Session helpers: shared scratch space and materialised intermediates.

Everything an operator has to cut lineage for goes to the folder that the
cluster names in ``spark.checkpoint.dir``, which all executors share, so a lost
executor never takes an intermediate with it. A folder of our own is used only
where that setting is absent and the session is local, as in tests.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediates."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="ledeforge-")
    return _LOCAL[app]


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path, by the session's configuration."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Rows of an Arrow batch while an intermediate is written: texts can be long, and a worker holds a batch several times.
BATCH_ROWS = 2_000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, tag: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it reread.

    The files go when the application ends, or earlier through ``release``.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/ledeforge/{tag}-{uuid.uuid4().hex}"
    before = int(spark.conf.get(_ARROW_ROWS))
    spark.conf.set(_ARROW_ROWS, min(before, batch_rows) if before > 0 else batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledeforge_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the files of materialised frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_ledeforge_path", None)
        if path:
            fs, p = hadoop_path(df.sparkSession, path)
            fs.delete(p, True)


def input_partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows up to which a small side, of a few numbers a row, is broadcast.
BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``rows`` rows, which are counted; beyond, joins shuffle. Give it a materialised frame."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def settle(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more.

    They go with the garbage of the driver, which may otherwise not be collected
    for the length of an iterative operator.
    """
    gc.collect()
    spark._jvm.System.gc()
