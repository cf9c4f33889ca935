"""Aggregation, duplicates, denormalising."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.rows import Flows
from flowloom.shared import spare


def _ordered_list(value: Column, order: list[str], distinct: bool = False) -> Column:
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*[F.col(f"`{c}`") for c in order], value.alias("__v")))))
    out = F.transform(rows, lambda r: r["__v"])
    return F.array_distinct(out) if distinct else out


def aggregation(function: str, column: str, order: list[str], ignore_null: bool = True, delimiter: str = ",", scale: int | None = 18) -> Column:
    """One of the fifteen functions over a group.

    sum is 0 where no value is; text that is no number counts as no value where numbers are needed; scale: digits of the decimals that sum and avg are
    exact in, None for doubles. first, last and lists go by `order`.
    """
    c = F.col(f"`{column}`")
    number = c.try_cast(f"decimal({20 + scale},{scale})") if scale is not None else c.try_cast("double")
    text, o = c.cast("string"), F.struct(*[F.col(f"`{x}`") for x in order])
    listed = text if ignore_null else F.coalesce(text, F.lit("null"))
    made = {
        "count": lambda: F.count(c), "count_distinct": lambda: F.count_distinct(c),
        "sum": lambda: F.coalesce(F.sum(number), F.lit(0)), "avg": lambda: F.avg(number), "min": lambda: F.min(c), "max": lambda: F.max(c),
        "std": lambda: F.stddev_samp(c.try_cast("double")), "population_std_dev": lambda: F.stddev_pop(c.try_cast("double")), "variance": lambda: F.var_samp(c.try_cast("double")),
        "median": lambda: F.median(c.try_cast("double")),
        "first": lambda: F.min_by(c, F.when(c.isNotNull(), o)), "last": lambda: F.max_by(c, F.when(c.isNotNull(), o)),
        "list": lambda: F.array_join(_ordered_list(listed, order), delimiter),
        "list_object": lambda: F.concat(F.lit("["), F.array_join(_ordered_list(listed, order), ", "), F.lit("]")),
        "union": lambda: F.array_join(F.array_sort(F.collect_set(text)), delimiter),
    }[function]()
    if not ignore_null and function in ("sum", "avg", "min", "max", "std", "population_std_dev", "variance", "median"):
        return F.when(F.count(c) == F.count(F.lit(1)), made)
    return made


def aggregate(df: DataFrame, group_by: list[str], operations: list[dict[str, Any]], order_by: list[str] | None = None, null_keys: str = "drop", delimiter: str = ",") -> DataFrame:
    """Groups with operations (output, function, input, ignore_null, scale); rows with a null key are dropped unless null_keys is keep.

    No rows give no row, without keys too.
    """
    order = order_by or df.columns[:1]
    some = df.dropna(subset=group_by) if group_by and null_keys == "drop" else df
    made = [aggregation(x["function"], x["input"], order, x.get("ignore_null", True), delimiter, x.get("scale", 18)).alias(x["output"]) for x in operations]
    out = some.groupBy(*group_by).agg(*made, F.count(F.lit(1)).alias("__rows"))
    return out.where("__rows > 0").drop("__rows")


def unique_rows(df: DataFrame, keys: list[str] | None = None, keep: str = "first", order_by: list[str] | None = None, case_insensitive: list[str] = (), only_once_each: bool = False) -> Flows:
    """unique: one row for each key (keep first or last by order_by; none: only keys that stand alone); duplicate: the others, or one of each key.

    Nulls equal each other.
    """
    keys = keys or df.columns
    by = [F.lower(F.col(f"`{k}`")) if k in case_insensitive else F.col(f"`{k}`") for k in keys]
    order = [F.col(f"`{c}`").desc() if keep == "last" else F.col(f"`{c}`") for c in order_by or keys]
    at = spare(df, "place")
    marked = df.withColumn(at, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if keep not in ("first", "last"):
        marked = marked.withColumn(at, F.when(F.count(F.lit(1)).over(Window.partitionBy(*by)) > 1, F.col(at) + 1).otherwise(1))
    duplicate = marked.where(F.col(at) == 2 if only_once_each else F.col(at) > 1)
    return {"unique": marked.where(F.col(at) == 1).drop(at), "duplicate": duplicate.drop(at)}


def denormalize(df: DataFrame, columns: list[dict[str, Any]], order_by: list[str], null_as_empty: bool = False) -> DataFrame:
    """One row for each combination of the other columns; the named ones joined by their delimiter, merge: each value once."""
    names = [x["column"] for x in columns]
    rest = [c for c in df.columns if c not in names and c not in order_by]
    made = []
    for x in columns:
        text = F.col(f"`{x['column']}`").cast("string")
        text = F.coalesce(text, F.lit("")) if null_as_empty else text
        made.append(F.array_join(_ordered_list(text, order_by, x.get("merge", False)), x.get("delimiter", ";")).alias(x["column"]))
    return df.groupBy(*rest).agg(*made).select(*[c for c in df.columns if c in rest or c in names])
