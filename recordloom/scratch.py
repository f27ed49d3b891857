"""Tables in the shared folder (spark.checkpoint.dir), which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []
_own = threading.local()  # paths: what this thread has written inside of ``settled``


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only where it is unset and all
    runs on one machine, as in tests, a folder of this machine takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="recordloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders by the (last) columns ``by``, and read
    it back.

    This ends the lineage as checkpoint() does, but computes the input once, and
    the columns stay prunable. The files survive lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/recordloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    _scratch.append(path)
    if getattr(_own, "paths", None) is not None:
        _own.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, after ``cut`` unless it comes from there. The tables that ``make`` wrote on
    its way go."""
    outer, _own.paths = getattr(_own, "paths", None), []
    try:
        out = make()
        out = out if vars(out).get("_scratch") in _own.paths else cut(out, label)
        for path in _own.paths:
            if path != out._scratch and path in _scratch:
                _scratch.remove(path)
                _delete(out.sparkSession, path)
        if outer is not None:
            outer.append(out._scratch)
    finally:
        _own.paths = outer
    return out


def spread(df: DataFrame, each: int = 4) -> DataFrame:
    """``df`` dealt evenly over ``each`` tasks a core. A table of short rows is one small file, and work
    on its rows that is long for their size would be one task's."""
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` gave. Nothing may be built on them any more but what
    has been written."""
    for df in tables:
        path = vars(df).get("_scratch")
        if path in _scratch:
            _scratch.remove(path)
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this driver. Call it only once the results
    that were built on them have been written."""
    while _scratch:
        _delete(spark, _scratch.pop())


def mark() -> int:
    """A mark for ``release_since``."""
    return len(_scratch)


def release_since(spark: SparkSession, at: int, keep: DataFrame) -> None:
    """Delete the scratch tables written since ``mark`` gave ``at``, but for ``keep``."""
    for path in _scratch[at:]:
        if path != vars(keep).get("_scratch"):
            _scratch.remove(path)
            _delete(spark, path)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``release`` deletes with the tables."""
    path = f"{scratch_root(spark)}/recordloom/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path
