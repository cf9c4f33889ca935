"""Sorting, sampling by position, paging with running balances, last rows, sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.errors import ConfigurationError
from flowloom.operators.rows import Flows
from flowloom.shared import kept, spare


def sort_rows(df: DataFrame, criteria: list[dict[str, str]]) -> DataFrame:
    """Rows by criteria (column, type num, alpha or date, order asc or desc); nulls and what is no number or date last either way. Unknown columns are ignored."""
    keys = []
    for x in criteria:
        if x["column"] not in df.columns:
            continue
        c = F.col(f"`{x['column']}`")
        kind = x.get("type", "alpha")
        c = c.cast("string").try_cast("double") if kind == "num" else c.try_cast("timestamp") if kind == "date" else c.cast("string")
        keys.append(c.desc_nulls_last() if x.get("order", "asc") == "desc" else c.asc_nulls_last())
    return df.orderBy(*keys) if keys else df


def numbered(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """df with its row number from 1 by order_by, found without gathering all rows in one task.

    Rows are sorted by range, and a table of one row for each partition holds how many
    come before. The bounds of the ranges are sampled, so the sorted rows are kept
    once: both the counts and the numbers come from the same partitions.
    """
    if not order_by:
        raise ConfigurationError("positions need an order")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order_by]
    at, part, start = spare(df, "at"), spare(df, "part"), spare(df, "start")
    placed = kept(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    placed = placed.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33))
    before = placed.groupBy(part).agg(F.count(F.lit(1)).alias("held")).orderBy(part).collect()  # one row for each partition
    starts, total = [], 0
    for r in before:
        starts.append((r[part], total))
        total += r["held"]
    held = F.broadcast(spark.createDataFrame(starts or [(0, 0)], f"{part} long, {start} long"))
    return placed.join(held, part).withColumn(name, F.col(start) + F.col(at) - F.shiftleft(part, 33) + 1).drop(part, start, at)


def sample_rows(df: DataFrame, positions: str, order_by: list[str]) -> Flows:
    """main: the rows at positions like "1,5,10..20" by order_by; reject: the others."""
    found, at = [], spare(df, "position")
    for part in filter(None, (x.strip() for x in positions.split(","))):
        lo, _, hi = part.partition("..")
        if not re.fullmatch(r"\d+", lo) or hi and not re.fullmatch(r"\d+", hi):
            raise ConfigurationError(f"not a position: {part!r}")
        found.append(F.col(at).between(int(lo), int(hi or lo)))
    hit = F.lit(False)
    for x in found:
        hit = hit | x
    rows = numbered(df, order_by, at)
    return {"main": rows.where(hit).drop(at), "reject": rows.where(~hit).drop(at)}


def paginate(df: DataFrame, account: str, amount: str, flag: str, opening: str, sort_columns: list[str], page_size: int = 10000, debit: str = "D") -> DataFrame:
    """Rows with page, page_debit, page_credit, page_opening and page_closing.

    Each account's rows, sorted as text, are dealt into pages; a page's closing
    balance is its opening minus debits plus credits and the next page's opening.
    Amounts that are blank or no number count 0. Pages are summed before balances
    are carried, so only page totals go through the running sum.
    """
    number = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")).try_cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))
    by_text = [F.col(f"`{c}`").cast("string").asc_nulls_last() for c in sort_columns]
    rows = df.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(account).orderBy(*by_text)) - 1) / page_size) + 1)
    is_debit = F.coalesce(F.trim(F.col(f"`{flag}`")) == debit, F.lit(False))
    pages = rows.groupBy(F.col(account).alias("__account"), F.col("page").alias("__page")).agg(
        F.sum(F.when(is_debit, number(amount)).otherwise(0)).alias("page_debit"), F.sum(F.when(is_debit, 0).otherwise(number(amount))).alias("page_credit"), F.min(number(opening)).alias("__open")
    )
    w = Window.partitionBy("__account").orderBy("__page")
    moved = F.sum(F.col("page_credit") - F.col("page_debit")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    pages = pages.withColumns({"page_closing": first + moved}).withColumn("page_opening", F.col("page_closing") - F.col("page_credit") + F.col("page_debit")).drop("__open")
    return rows.join(pages, rows[account].eqNullSafe(pages["__account"]) & (rows["page"] == pages["__page"])).drop("__account", "__page")


def last_rows(df: DataFrame, count: int, order_by: list[str]) -> dict[str, object]:
    """The cells of the last rows by order_by as `column_offset`, 0 the newest; null where there are fewer rows."""
    found = df.orderBy(*[F.col(f"`{c}`").desc() for c in order_by]).limit(count).collect()
    return {f"{c}_{i}": (found[i][c] if i < len(found) else None) for i in range(count) for c in df.columns}


def number_rows(df: DataFrame, name: str, order_by: list[str], start: int = 1, step: int = 1) -> DataFrame:
    """df with start, start + step and so on over all rows by order_by."""
    at = spare(df, "position")
    return numbered(df, order_by, at).withColumn(name, F.lit(start) + (F.col(at) - 1) * step).drop(at)


def sequence(start: int, step: int, order_by: list[str], partition_by: list[str]) -> Column:
    """start, start + step and so on within each partition_by group, by order_by; number_rows numbers a whole table."""
    if not partition_by:
        raise ConfigurationError("without groups use number_rows, which does not gather all rows in one task")
    return F.lit(start) + (F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by)) - 1) * step
