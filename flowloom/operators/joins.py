"""Lookup joins: one lookup by keys, and maps over several lookups with filters, variables, outputs and rejects."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.rows import Flows


def one_per_key(lookup: DataFrame, keys: list[str], order_by: list[str] | None, last: bool) -> DataFrame:
    """The first or last row of each key by order_by, by an aggregate that Spark combines before the shuffle; without order any one.

    Rows with a null key can't match and are left out.
    """
    rest = [c for c in lookup.columns if c not in keys]
    some = lookup.dropna(subset=keys)
    if not rest:
        return some.dropDuplicates(keys)
    row, order = F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in order_by or rest])
    best = (F.max_by if last else F.min_by)(row, order)
    return some.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*lookup.columns)


def join(main: DataFrame, lookup: DataFrame, keys: dict[str, str], inner: bool = False, lookup_columns: dict[str, str] | None = None, case_sensitive: bool = True, order_by: list[str] | None = None) -> Flows:
    """main joined to the first lookup row of each key (main column: lookup column).

    lookup_columns: output name to lookup column. reject has the unmatched rows with
    errorCode JOIN_REJECT; in a left join they stay in main as well. Null keys match
    nothing. Which side is broadcast is left to Spark, which knows the sizes.
    """
    fold = (lambda c: c) if case_sensitive else (lambda c: F.lower(c.cast("string")))
    wanted = lookup_columns or {}
    small = lookup.select(*[fold(F.col(f"`{b}`")).alias(f"__k{i}") for i, b in enumerate(keys.values())], *[F.col(f"`{c}`").alias(f"__v_{o}") for o, c in wanted.items()], *[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order_by or [])])
    names = [f"__k{i}" for i in range(len(keys))]
    small = one_per_key(small, names, [f"__o{i}" for i in range(len(order_by or []))], last=False).withColumn("__hit", F.lit(True))
    on = functools.reduce(operator.and_, [fold(F.col(f"`{a}`")) == F.col(n) for a, n in zip(keys, names, strict=True)])
    both = main.join(small, on, "inner" if inner else "left")
    kept = [F.col(f"`{c}`") for c in main.columns if c not in wanted]
    out = both.select(*kept, *[F.col(f"`__v_{o}`").alias(o) for o in wanted])
    reject = main.join(small.select(*names), on, "left_anti").withColumns({"errorCode": F.lit("JOIN_REJECT"), "errorMessage": F.lit("No matching lookup row")})
    return {"main": out, "reject": reject}


@dataclass
class Lookup:
    """A lookup of a map.

    keys: lookup column to SQL expression over the flows joined before. matching:
    UNIQUE_MATCH and LAST_MATCH take the last row of a key by order_by, FIRST_MATCH
    the first, ALL_MATCHES all. filter: a SQL condition on the lookup, or with
    condition on both sides for theta joins. Unmatched rows of an inner lookup go to
    the reject outputs; without keys and condition every row matches.
    """

    name: str
    df: DataFrame
    keys: dict[str, str] = field(default_factory=dict)
    inner: bool = False
    matching: str = "UNIQUE_MATCH"
    filter: str | None = None
    condition: str | None = None
    order_by: list[str] = field(default_factory=list)


@dataclass
class Output:
    """An output of a map: column name to SQL expression, and a filter.

    is_reject: rows that no plain output took; inner_join_reject: rows without a
    match; catch_errors: rows that one of the map's errors holds for, with the
    error's name in errorMessage behind the columns.
    """

    name: str
    columns: dict[str, str]
    filter: str | None = None
    is_reject: bool = False
    inner_join_reject: bool = False
    catch_errors: bool = False


def _flow(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def map_rows(main: DataFrame, name: str, lookups: list[Lookup] = (), outputs: list[Output] = (), variables: dict[str, str] | None = None, main_filter: str | None = None, errors: dict[str, str] | None = None) -> Flows:
    """main (called name) joined with lookups in turn; each output selects SQL expressions over `flow.column` and `Var.name`.

    Outputs filter independently, so a row may go to several. Every flow is one
    struct column while rows are joined, which Spark prunes to what is used.

    errors names the SQL conditions over the flows under which variables and outputs
    can't be computed (`{"no number": "try_cast(m.a as int) is null"}`). Such rows go
    to the outputs that catch errors and to no other; the first condition that holds
    gives the name. Without such an output they are gone. Catching outputs can't use
    variables, and their own expressions must not fail on these rows.
    """
    rows = _flow(main, name)
    rows = rows.where(F.coalesce(F.expr(main_filter), F.lit(False))) if main_filter else rows
    missed: list[DataFrame] = []
    seen = [name]
    for x in lookups:
        side = _flow(x.df, x.name)
        side = side.where(F.coalesce(F.expr(x.filter), F.lit(False))) if x.filter else side
        on = F.lit(True)
        if x.keys:
            flat = side.select(*[F.col(f"{x.name}.`{k}`").alias(f"__k{i}") for i, k in enumerate(x.keys)], *[F.col(f"{x.name}.`{c}`").alias(f"__o{i}") for i, c in enumerate(x.order_by)], x.name)
            keys = [f"__k{i}" for i in range(len(x.keys))]
            if x.matching == "ALL_MATCHES" or x.condition:
                side = flat.dropna(subset=keys).drop(*[f"__o{i}" for i in range(len(x.order_by))])
            else:
                side = one_per_key(flat, keys, [f"__o{i}" for i in range(len(x.order_by))] or None, last=x.matching != "FIRST_MATCH").select(*keys, x.name)
            on = functools.reduce(operator.and_, [F.expr(e) == F.col(k) for k, e in zip(keys, x.keys.values(), strict=True)])
        on = on & F.expr(x.condition) if x.condition else on
        if x.keys and x.condition and x.matching != "ALL_MATCHES":
            # a lookup that depends on the row: of the matches of each row one stays
            numbered = rows.withColumn("__row", F.monotonically_increasing_id())
            order = [(F.col(f"{x.name}.`{c}`").asc() if x.matching == "FIRST_MATCH" else F.col(f"{x.name}.`{c}`").desc()) for c in x.order_by or [next(iter(x.keys))]]
            joined = numbered.join(side, on, "left").withColumn("__n", F.row_number().over(Window.partitionBy("__row").orderBy(*order))).where("__n = 1").drop("__n", "__row")
        else:
            joined = rows.join(side, on, "left")
        if x.inner:
            missed.append(joined.where(F.col(x.name).isNull()).select(*seen))
            joined = joined.where(F.col(x.name).isNotNull())
        rows = joined.select(*seen, x.name)
        seen.append(x.name)

    def with_variables(df: DataFrame) -> DataFrame:
        lacking = {x.name: F.lit(None).cast(_flow(x.df, x.name).schema[0].dataType) for x in lookups if x.name not in df.columns}
        df = df.withColumns(lacking) if lacking else df
        made: list = []
        for var, e in (variables or {}).items():
            df = df.withColumn(f"__var_{var}", F.expr(e))
            made.append(F.col(f"__var_{var}").alias(var))
            df = df.withColumn("Var", F.struct(*made))
        return df

    error = F.coalesce(*[F.when(F.expr(c), F.lit(e)) for e, c in errors.items()]) if errors else F.lit(None).cast("string")
    # rows are parted below the variables, which are then computed for the others only
    failed = rows.where(error.isNotNull())
    rows = with_variables(rows.where(error.isNull()) if errors else rows)
    passes = {o.name: F.coalesce(F.expr(o.filter), F.lit(False)) if o.filter else F.lit(True) for o in outputs}
    plain = [passes[o.name] for o in outputs if not (o.is_reject or o.inner_join_reject or o.catch_errors)]
    out: Flows = {}
    for o in outputs:
        columns = [F.expr(e).alias(c) for c, e in o.columns.items()]
        if o.catch_errors:
            out[o.name] = failed.where(passes[o.name]).select(*columns, error.alias("errorMessage"))
        elif o.inner_join_reject:
            sides = [with_variables(m).where(passes[o.name]).select(*columns) for m in missed]
            out[o.name] = functools.reduce(DataFrame.unionByName, sides) if sides else rows.limit(0).select(*columns)
        elif o.is_reject:
            taken = functools.reduce(operator.or_, plain) if plain else F.lit(False)
            out[o.name] = rows.where(~taken & passes[o.name]).select(*columns)
        else:
            out[o.name] = rows.where(passes[o.name]).select(*columns)
    return out
