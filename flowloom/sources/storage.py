"""Files as things: copy, move, delete, touch, test, change encoding; through Hadoop's file systems, so any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.errors import ConfigurationError
from flowloom.sources.files import read_raw


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = True, move: bool = False) -> None:
    """A file or folder copied or moved, also between stores."""
    a, at = _at(spark, source)
    b, to = _at(spark, target)
    if not a.exists(at):
        raise ConfigurationError(f"no file {source}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, at, b, to, move, overwrite, spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str, must_exist: bool = False) -> bool:
    """True if there was something to delete."""
    fs, at = _at(spark, path)
    if must_exist and not fs.exists(at):
        raise ConfigurationError(f"no file {path}")
    return fs.delete(at, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file where there is none."""
    fs, at = _at(spark, path)
    fs.createNewFile(at)


def change_encoding(spark: SparkSession, source: str, target: str, encoding: str) -> None:
    """Text files in a character set written as UTF-8 parts."""
    read_raw(spark, source, True, encoding, "value").write.option("lineSep", "\n").mode("overwrite").text(target)


def merged(df: DataFrame, path: str) -> None:
    """One text file from a column of lines, in their order of partitions; for results that one task can write."""
    df.coalesce(1).write.mode("overwrite").text(path)
