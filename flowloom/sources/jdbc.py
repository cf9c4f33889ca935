"""Database tables and statements over JDBC."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Connection:
    """A database: its JDBC URL, user and driver class; the driver's JAR is the session's to bring."""

    url: str
    user: str = ""
    password: str = field(default="", repr=False)
    driver: str | None = None

    def options(self) -> dict[str, str]:
        made = {"url": self.url, "user": self.user, "password": self.password}
        return made | ({"driver": self.driver} if self.driver else {})


def read_query(spark: SparkSession, connection: Connection, query: str, fetch_size: int = 1000, timeout: int = 0, trim_all: bool = False, trim: list[str] = (), no_nulls: bool = False, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """The rows of a query; partition (column, lower, upper, count): read by that many tasks."""
    reader = spark.read.format("jdbc").options(**connection.options()).option("fetchsize", fetch_size).option("queryTimeout", timeout)
    if partition:
        column, lower, upper, count = partition
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", count)
    else:
        reader = reader.option("query", query)
    rows = reader.load()
    made = {}
    for f in rows.schema:
        if f.dataType.simpleString() == "string" and (trim_all or f.name in trim or no_nulls):
            c = F.trim(F.col(f"`{f.name}`")) if trim_all or f.name in trim else F.col(f"`{f.name}`")
            made[f.name] = F.coalesce(c, F.lit("")) if no_nulls else c
    return rows.withColumns(made) if made else rows


def write_table(df: DataFrame, connection: Connection, table: str, action: str = "append", batch_size: int = 10_000) -> None:
    """Rows into a table; action: append, create (drop and create), truncate, or create_if_missing."""
    writer = df.write.format("jdbc").options(**connection.options()).option("dbtable", table).option("batchsize", batch_size)
    mode = {"append": "append", "create_if_missing": "append", "create": "overwrite", "truncate": "overwrite"}[action]
    writer.option("truncate", str(action == "truncate").lower()).mode(mode).save()


def upsert_statement(table: str, columns: list[str], keys: list[str], staging: str) -> str:
    """The MERGE that brings a staging table, written with write_table, into table by its keys."""
    for name in [table, staging, *columns]:
        if not name.replace("_", "").replace(".", "").replace("$", "").isalnum():
            raise ValueError(f"not an identifier: {name!r}")
    rest = [c for c in columns if c not in keys]
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{c} = s.{c}' for c in rest)}" if rest else ""
    return f"MERGE INTO {table} t USING {staging} s ON ({on}){update} WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join(f's.{c}' for c in columns)})"
