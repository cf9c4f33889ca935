"""Shared scratch tables and table reading for the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that the session names in spark.checkpoint.dir. Where that is
    unset, a local session (as in tests) gets a temporary folder; a cluster's
    executors could not read such a folder, so there that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="flowloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one long that are broadcast: about 16 MB, 60 MB as a hash table.
BROADCAST_ROWS = 1 << 21


def of_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` is in ids, a written table of distinct longs in its column `on`.

    A table of at most BROADCAST_ROWS is broadcast, so that wide rows need no shuffle; a larger one is joined.
    """
    ids = ids.select(on)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, "left_semi")


#: Rows of one table that a partition holds in a hash table: some 20 MB.
HASHED_ROWS = 1 << 18


def with_keys(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """rows joined with keys, a written table with one row for each value of its columns `on`.

    Where the keys of a partition are few they go into a hash table, so that the many rows need no sort; else both are sorted.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(keys.hint("shuffle_hash") if keys.count() <= parts * HASHED_ROWS else keys, on)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def driver_gives_back(context: SparkContext) -> str | None:
    """The driver's Python and its JVM give free memory outside the heap back to the system; what the JVM says of it, None where it can't.

    Compiling the plans of many steps leaves a few hundred MB free in the JVM's native memory, which it keeps else.
    """
    _give_back()
    jvm, of = context._jvm, context._jvm.java.lang.Class.forName

    def array(kind, *values):
        out = context._gateway.new_array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    try:
        # by the interface's method: the class behind it is closed to reflection
        kinds = [of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call = array(jvm.java.lang.Object, name, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))
        return str(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call))
    except Py4JError:  # another JVM, or not Linux
        return None


def gives_back(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """work for mapInPandas; at a task's end its worker gives the memory that is free by then back to the system.

    A worker serves the tasks of many steps, and what numpy and Arrow have freed would stay with it all the while.
    """

    @functools.wraps(work)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def gives_back_each(work: Callable[..., pd.Series]) -> Callable[..., pd.Series]:
    """work for pandas_udf; after each batch its worker gives free memory back, as with gives_back."""

    @functools.wraps(work)
    def run(*columns: pd.Series) -> pd.Series:
        try:
            return work(*columns)
        finally:
            _give_back()

    return run


def fields(structs: str, *names: str) -> list[Column]:
    """The fields of a column of arrays of structs, each as an array of its own.

    A worker gets them as numpy arrays; the structs would be a Python object each, some ten times as large.
    """
    return [F.col(f"{structs}.{name}").alias(name) for name in names]


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs no more than the step it was in."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/flowloom-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def path(self) -> str:
        return f"{self.root}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame) -> DataFrame:
        """Write df as a table and read it back."""
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Delete saved tables that nothing reads any more, and let Spark free the shuffle files and the driver the memory of finished steps.

        Spark frees them when the driver collects its garbage, which a driver with little to do may not for hours.
        """
        for df in saved:
            self._delete(df._scratch_path)
        self.spark.sparkContext._jvm.System.gc()
        driver_gives_back(self.spark.sparkContext)

    def clear(self) -> None:
        """Delete all saved tables; nothing may read them any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            return
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
