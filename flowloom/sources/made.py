"""Rows that come from settings: fixed rows and generated ones."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed_rows(spark: SparkSession, schema: str, row: dict[str, Any] | None = None, count: int = 1, table: list[tuple] | None = None, content: str | None = None, field_separator: str = ";", row_separator: str = "\n") -> DataFrame:
    """One template row `count` times, an inline table, or inline delimited text, cast to schema."""
    if table is not None:
        return spark.createDataFrame(table, schema)
    names = [(p.split()[0].strip("`"), p.split(None, 1)[1]) for p in (x.strip() for x in schema.split(","))]
    if content is not None:
        rows = [tuple((line.split(field_separator) + [None] * len(names))[: len(names)]) for line in content.split(row_separator) if line]
        text = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n, _ in names))
        return text.select(*[F.col(f"`{n}`").try_cast(t).alias(n) for n, t in names])
    return spark.range(count).select(*[F.lit((row or {}).get(n)).cast(t).alias(n) for n, t in names])


def generate_rows(spark: SparkSession, count: int, columns: dict[str, str]) -> DataFrame:
    """`count` rows of SQL expressions, in which `id` is the row's number from 0."""
    return spark.range(count).select(*[F.expr(e).alias(c) for c, e in columns.items()])
