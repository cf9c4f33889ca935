"""Normalising, unpivoting, pivoting, splitting rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _literal(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def normalize(df: DataFrame, column: str, separator: str = ",", trim: bool = False, deduplicate: bool = False, discard_trailing_empty: bool = False) -> DataFrame:
    """One row for each item of a separated text; a null is one empty item, a cell without items after discarding gives no row."""
    items = F.split(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")), _literal(separator), -1)
    if discard_trailing_empty:
        last = F.array_max(F.transform(items, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
        items = F.slice(items, F.lit(1), last)
    items = F.transform(items, lambda x: F.trim(x)) if trim else items
    items = F.array_distinct(items) if deduplicate else items
    return df.withColumn("__item", F.explode(items)).withColumn(column, F.col("__item")).drop("__item")


def unpivot(df: DataFrame, row_keys: list[str], key: str = "pivot_key", value: str = "pivot_value", include_empty: bool = True) -> DataFrame:
    """A row (keys, key, value as text) for each other column; include_empty: nulls and empty texts too."""
    rest = [c for c in df.columns if c not in row_keys]
    text = df.select(*[F.col(f"`{c}`") for c in row_keys], *[F.col(f"`{c}`").cast("string").alias(c) for c in rest])
    out = text.unpivot([F.col(f"`{c}`") for c in row_keys], [F.col(f"`{c}`") for c in rest], key, value)
    return out if include_empty else out.where(F.coalesce(F.col(value), F.lit("")) != "")


def pivot(df: DataFrame, group_by: list[str], pivot_column: str, value_column: str, function: str = "sum", order_by: list[str] | None = None) -> DataFrame:
    """group_by and one text column for each value of pivot_column, in order of first appearance by order_by; missing cells are "".

    function: sum, count, min, max, first or last. Whole numbers are written without point.
    """
    order = F.struct(*[F.col(f"`{c}`") for c in order_by or [pivot_column]])
    values = [r[0] for r in df.dropna(subset=[pivot_column]).groupBy(pivot_column).agg(F.min(order).alias("__o")).orderBy("__o").collect()]
    v = F.col(f"`{value_column}`")
    made: Column = {"sum": F.sum(v), "count": F.count(v), "min": F.min(v), "max": F.max(v), "first": F.min_by(v, F.when(v.isNotNull(), order)), "last": F.max_by(v, F.when(v.isNotNull(), order))}[function]
    out = df.groupBy(*group_by).pivot(pivot_column, values).agg(made)
    types = dict(out.dtypes)

    def shown(name: str) -> Column:
        c = F.col(f"`{name}`")
        text = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")) if types[name] in ("double", "float") or types[name].startswith("decimal") else c.cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return out.select(*group_by, *[shown(str(x)) for x in values])


def split_row(df: DataFrame, mappings: list[dict[str, str]]) -> DataFrame:
    """One output row for each mapping (column: `flow.column` or a column name, a quoted or numeric literal, or else plain text)."""
    columns = list(dict.fromkeys(c for m in mappings for c in m))

    def cell(text: str | None) -> Column:
        if text is None:
            return F.lit(None).cast("string")
        name = text.rpartition(".")[2]
        if name in df.columns:
            return F.col(f"`{name}`").cast("string")
        quoted = re.fullmatch(r"(['\"])(.*)\1", text, re.S)
        return F.lit(quoted[2] if quoted else text)

    rows = [F.struct(*[cell(m.get(c)).alias(c) for c in columns]) for m in mappings]
    return df.select(F.explode(F.array(*rows)).alias("__row")).select("__row.*")
