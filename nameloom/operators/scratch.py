"""Lineage cuts: tables written to the folder all executors share.

An iterative operator writes its state as a parquet table and reads it back. The
table outlives any executor, keeps columnar statistics (the planner sees its
real size) and is deleted once the next state stands.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_number = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on a local master a temporary folder of our own, elsewhere an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="nameloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", _own[app])
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/nameloom/{spark.sparkContext.applicationId}/{next(_number):04d}-{label}-{uuid.uuid4().hex[:8]}"


_local = threading.local()


def _scopes() -> list[list[Table]]:
    """The open scopes of this thread, the innermost last."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


class Table:
    """A written table: `df` reads it, `stats` holds what was counted while it was written, `drop()` deletes its files, `keep()` leaves it to the scope around the current one."""

    def __init__(self, spark: SparkSession, path: str, schema, stats: dict[str, int] | None = None) -> None:
        self.spark, self.path, self.stats = spark, path, stats or {}
        self.df = spark.read.schema(schema).parquet(path)
        self.dropped = False

    def drop(self) -> None:
        if not self.dropped:
            delete(self.spark, self.path)
        self.dropped = True

    def keep(self) -> Table:
        for s in _scopes()[-1:]:
            s[:] = [t for t in s if t is not self]
        for s in _scopes()[-2:-1]:
            s.append(self)
        return self


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """On leaving, deletes the tables written inside that were not kept; no frame that reads them may be used after."""
    _scopes().append([])
    try:
        yield
    finally:
        for t in _scopes().pop():
            t.drop()


def write(df: DataFrame, label: str, partition_by: list[str] | None = None, **counts: Column) -> Table:
    """Writes df into the shared folder and returns the table. stats has `rows`, and for each condition in `counts` the rows that meet it; they are counted on the way."""
    spark = df.sparkSession
    path = new_path(spark, label)
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    writer = observed.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = Table(spark, path, df.schema, dict(seen.get))
    for s in _scopes()[-1:]:
        s.append(table)
    return table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over more tasks than cores, by a hash of `keys`: for rows of few bytes that are long work, which one task would read as one small file. Given as a number, as parts are merged by size otherwise."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
