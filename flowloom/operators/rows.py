"""Row-wise operators: projection, filters, type conversion, replacement, checks, union."""

from __future__ import annotations

import decimal
import functools
import math
import operator
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.errors import ConfigurationError
from flowloom.shared import spare

Flows = dict[str, DataFrame]


def filter_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns in that order; all without names."""
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def _prepared(column: Column, function: str) -> Column:
    name, _, arg = function.partition("(")
    size = int(arg.rstrip(") ")) if arg else 0
    made = {
        "LOWER": F.lower, "UPPER": F.upper, "LOWER_FIRST": lambda c: F.lower(F.left(c, F.lit(1))), "UPPER_FIRST": lambda c: F.upper(F.left(c, F.lit(1))),
        "LENGTH": F.length, "TRIM": F.trim, "LTRIM": F.ltrim, "RTRIM": F.rtrim, "ABS": lambda c: F.abs(c.try_cast("double")),
        "LEFT": lambda c: F.left(c, F.lit(size)), "RIGHT": lambda c: F.right(c, F.lit(size)),
    }.get(name.strip().upper())
    return made(column) if made else column


def _number(value: Any) -> int | float | decimal.Decimal | None:
    """value as a number, whole ones exactly; None if it is none."""
    text = str(value).strip()
    if re.fullmatch(r"[+-]?\d{1,18}", text):
        return int(text)
    try:
        return float(text)
    except ValueError:
        return None


def condition(types: dict[str, str], column: str, operator_: str, value: Any = None, function: str = "") -> Column:
    """One comparison over columns of the given types; false or null where it does not hold, so != and NOT_CONTAINS hold for null.

    Number columns are compared as they are, which lets Spark push the comparison
    into the scan; text is compared as numbers where the value is one.
    """
    if column not in types:
        return F.lit(False)
    c = _prepared(F.col(f"`{column}`"), function or "")
    name = operator_.strip().upper()
    if name in ("IS_NULL", "IS_NOT_NULL"):
        return c.isNull() if name == "IS_NULL" else c.isNotNull()
    if name in ("==", "!=", ">", "<", ">=", "<="):
        compare = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}[name]
        number, kind = None if value is None else _number(value), types[column] if not function else "string"
        if number is None:
            out = compare(c if kind == "string" else c.cast("string"), F.lit(str(value)))
        elif kind in ("tinyint", "smallint", "int", "bigint") and isinstance(number, float):
            out = compare(c.cast("decimal(20,0)"), F.lit(decimal.Decimal(str(number)))) if math.isfinite(number) else compare(c.cast("double"), F.lit(number))
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            out = compare(c, F.lit(number))
        else:
            out = compare(c.cast("string").try_cast("double"), F.lit(float(number)))
        # != holds where nothing can be compared
        return (out | out.isNull()) if name == "!=" else out
    text = c.cast("string")
    made = {
        "MATCHES": lambda: text.rlike(f"^(?:{value})$"), "CONTAINS": lambda: text.contains(str(value)), "NOT_CONTAINS": lambda: ~text.contains(str(value)),
        "STARTS_WITH": lambda: text.startswith(str(value)), "ENDS_WITH": lambda: text.endswith(str(value)),
        "LENGTH_LT": lambda: F.length(text) < int(value), "LENGTH_GT": lambda: F.length(text) > int(value),
    }.get(name)
    if not made:
        raise ConfigurationError(f"unknown filter operator {operator_!r}")
    return (made() | c.isNull()) if name == "NOT_CONTAINS" else made()


def filter_rows(df: DataFrame, conditions: list[dict[str, Any]] = (), logical_op: str = "&&", advanced: str | None = None) -> Flows:
    """main: rows that pass; reject: the others with errorMessage.

    conditions: column, operator, value and function each; advanced: a SQL
    condition, which must hold as well. Without any all rows pass.
    """
    parts = [condition(dict(df.dtypes), x["column"], x["operator"], x.get("value"), x.get("function", "")) for x in conditions]
    keep = functools.reduce(operator.and_ if logical_op.upper() in ("&&", "AND") else operator.or_, parts) if parts else F.lit(True)
    if advanced:
        keep = keep & F.expr(advanced)
    said = f" {logical_op} ".join(f"{x['column']} {x['operator']} {x.get('value', '')}".strip() for x in conditions) or (advanced or "")
    return {"main": df.where(keep), "reject": df.where(~F.coalesce(keep, F.lit(False))).withColumn("errorMessage", F.lit(f"The row does not match the filter: {said}"))}


def convert_type(df: DataFrame, conversions: dict[str, str], empty_to_null: bool = False) -> Flows:
    """Columns cast to Spark types; rows with a value that can't be cast go to reject with error_code and error_message."""
    types, made, bad = dict(df.dtypes), {}, []
    for name, kind in conversions.items():
        source = F.col(f"`{name}`")
        if types[name] == "string":
            source = F.trim(source)
            source = F.when(source != "", source) if empty_to_null or kind != "string" else source
        out = (F.when(F.lower(source) == "true", True).when(source.isNotNull(), False) if kind == "boolean" and types[name] == "string" else source.try_cast(kind))
        made[name] = out
        bad.append(F.when(source.isNotNull() & out.isNull(), F.lit(f"cannot convert {name} to {kind}")))
    message = F.concat_ws("; ", *bad)
    why = spare(df, "why")
    marked = df.withColumn(why, message)
    return {
        "main": marked.where(F.col(why) == "").drop(why).withColumns(made),
        "reject": marked.where(F.col(why) != "").withColumns({"error_code": F.lit("CONVERSION_ERROR"), "error_message": F.col(why)}).drop(why),
    }


def replace(df: DataFrame, substitutions: list[dict[str, Any]], strict_match: bool = True) -> DataFrame:
    """Text replaced in order: column, search, replacement, and case_sensitive (no), whole_word, use_glob, use_regex.

    strict_match: the whole value must match. Nulls stay.
    """
    for x in substitutions:
        pattern = str(x["search"])
        if x.get("use_glob"):
            pattern = "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", c) for c in pattern)
        elif not x.get("use_regex"):
            pattern = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
        if x.get("whole_word"):
            pattern = rf"\b(?:{pattern})\b"
        if strict_match and not x.get("use_regex"):
            pattern = f"^(?:{pattern})$"
        if not x.get("case_sensitive"):
            pattern = f"(?iu){pattern}"
        to = str(x.get("replacement", ""))
        to = re.sub(r"\\(\d)", r"$\1", to) if x.get("use_regex") else to.replace("\\", "\\\\").replace("$", "\\$")
        df = df.withColumn(x["column"], F.regexp_replace(F.col(f"`{x['column']}`").cast("string"), F.lit(pattern), F.lit(to)))
    return df


def schema_compliance(df: DataFrame, checks: list[dict[str, Any]], all_empty_are_null: bool = True) -> Flows:
    """Rows checked column by column: nullable, type, length and date_pattern; reject has errorCode 8 and all reasons.

    length counts characters, or bytes where charset is given.
    """
    from flowloom.plans.schema import TYPES, spark_pattern

    found = []
    for x in checks:
        c = F.col(f"`{x['column']}`").cast("string")
        value = F.when(F.trim(c) != "", c) if all_empty_are_null else c
        kind, reasons = TYPES.get(x.get("type", "str"), "string"), []
        if not x.get("nullable", True):
            reasons.append((value.isNull(), "cannot be null"))
        if x.get("date_pattern"):
            reasons.append((value.isNotNull() & F.try_to_timestamp(value, F.lit(spark_pattern(x["date_pattern"]))).isNull(), "invalid date format"))
        elif kind in ("bigint", "double", "decimal"):
            reasons.append((value.isNotNull() & F.trim(value).try_cast("decimal(38,18)" if kind == "decimal" else kind).isNull(), "invalid type"))
        elif kind == "boolean":
            reasons.append((value.isNotNull() & ~F.lower(F.trim(value)).isin("true", "false"), "invalid type"))
        if x.get("length", -1) >= 0:
            size = F.octet_length(F.encode(value, x["charset"])) if x.get("charset") else F.length(value)
            reasons.append((size > x["length"], "exceed max length"))
        found += [F.when(when, F.lit(f"{x['column']}:{why}")) for when, why in reasons]
    why = spare(df, "why")
    marked = df.withColumn(why, F.concat_ws(";", *found))
    return {
        "main": marked.where(F.col(why) == "").drop(why),
        "reject": marked.where(F.col(why) != "").withColumns({"errorCode": F.lit(8), "errorMessage": F.col(why)}).drop(why),
    }


def unite(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, columns by name; what an input lacks is null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def replicate(df: DataFrame, copies: int) -> Flows:
    """The same rows under main and output_1 to output_n."""
    return {"main": df} | {f"output_{i}": df for i in range(1, copies + 1)}
