"""Tables in the folder that driver and executors share, which end the lineage of what comes before them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir.

    Where none is set, a local session gets a temporary folder of its own; on a cluster that would be a folder of one
    machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='vanefold-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/vanefold-{uuid.uuid4().hex}"


#: Deletes the shuffle files of a query when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each open `scratch`, the paths it deletes.
_open: list[list[str]] = []


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and a lost executor takes nothing with it."""
    path = shared_folder(spark)
    if _open:
        _open[-1].append(path)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is `written` inside is deleted at the end, but for what goes through the function that this gives."""
    mine: list[str] = []
    _open.append(mine)

    def out(df: DataFrame) -> DataFrame:
        kept = written(df, spark)
        path = mine.pop()
        if len(_open) > 1:
            _open[-2].append(path)
        return kept

    try:
        yield out
    finally:
        _open.pop()
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
