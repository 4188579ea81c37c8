"""Places that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables written since a block that removes them began; None outside such a block.
_OPEN: ContextVar[list[str] | None] = ContextVar("written", default=None)
#: Tables that go with the application.
_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and Spark runs on one machine (tests, local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage is cut, executors may be lost.

    The table is removed at the end of the block (``tidy``) that it was written in, else with the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    opened = _OPEN.get()
    if opened is not None:
        opened.append(path)
    else:
        _LEFT.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Removes what is written within; nothing that is lazy and reads it may leave the block."""
    token = _OPEN.set([])
    try:
        yield
    finally:
        for path in _OPEN.get() or []:
            remove(spark, path)
        _OPEN.reset(token)


def tidied(method: Callable) -> Callable:
    """A method of an object with ``spark`` that leaves no tables behind."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        with tidy(self.spark):
            return method(self, *args, **kwargs)

    return run


@atexit.register
def _leave() -> None:
    for spark, path in _LEFT:
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            remove(spark, path)
