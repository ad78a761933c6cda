"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths that were made and not deleted, oldest first.
_made: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="wavelattice-"))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = None
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet and read again: computed once, without lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so once the driver has collected its garbage."""
    for pause in (0, 0.3):  # what the first pass finds only lets go of the rest
        time.sleep(pause)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table._stored_at)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _made.pop(name, None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes on leaving what operators stored meanwhile, but the tables put into the list it gives.

    A result that is not written yet reads such tables, so write it inside.
    """
    before, keep = set(_made), []
    try:
        yield keep
    finally:
        for path in [p for p in _made if p not in before and p not in {t._stored_at for t in keep}]:
            _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def split_skew(spark: SparkSession):
    """While tables are written: adaptive execution splits a skewed join even if what follows needs one more shuffle."""
    name = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows that Spark hands to Python at once; with its default of 10,000 whole documents a batch takes tens of MB, several times over.
ARROW_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """For jobs over whole documents: smaller Arrow batches, unless the session has a smaller bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
