"""Declared schemas: column order, types, defaults and rejects, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.shared import spare

#: Names of types in job files and their Spark types.
TYPES = {
    "str": "string", "id_String": "string", "id_Character": "string", "object": "string", "id_Object": "string",
    "int": "bigint", "id_Integer": "bigint", "id_Long": "bigint", "id_Short": "bigint", "id_Byte": "bigint",
    "float": "double", "id_Double": "double", "id_Float": "double", "bool": "boolean", "id_Boolean": "boolean",
    "datetime": "timestamp_ntz", "id_Date": "timestamp_ntz", "Decimal": "decimal", "id_BigDecimal": "decimal",
}
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")
_STRPTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM"}
_DEFAULTS = {"string": "''", "bigint": "0", "double": "0.0", "boolean": "false", "timestamp_ntz": "timestamp_ntz'1970-01-01'"}


@dataclass(frozen=True)
class Field:
    """A declared column. For decimals, length is the number of digits and precision the scale."""

    name: str
    type: str = "str"
    nullable: bool = True
    length: int = -1
    precision: int = -1
    date_pattern: str | None = None
    treat_empty_as_null: bool | None = None

    @property
    def spark(self) -> str:
        kind = TYPES.get(self.type, "string")
        return f"decimal({self.length if self.length > 0 else 38},{self.precision if self.precision >= 0 else 18})" if kind == "decimal" else kind


def spark_pattern(pattern: str) -> str:
    """A date pattern as Spark writes it; strptime's are translated."""
    for a, b in _STRPTIME.items():
        pattern = pattern.replace(a, b)
    return pattern


def converted(field: Field, source: Column, source_type: str = "string") -> Column:
    """source as the field's type; what can't be converted is null."""
    kind = field.spark
    empty = field.treat_empty_as_null if field.treat_empty_as_null is not None else kind != "string"
    if source_type == "string" and empty:
        source = F.when(source != "", source)
    if kind == "string":
        return source.cast("string")
    if source_type != "string":
        out = source.try_cast(kind)
    elif kind == "boolean":
        text = F.lower(F.trim(source))
        out = F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)
    elif kind == "timestamp_ntz":
        formats = ([spark_pattern(field.date_pattern)] if field.date_pattern else []) + list(DATE_FORMATS)
        out = F.coalesce(*[F.try_to_timestamp(source, F.lit(f)).cast("timestamp_ntz") for f in formats])
    elif kind == "bigint":
        number = F.trim(source).try_cast("double")
        out = F.coalesce(F.trim(source).try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))
    else:
        out = F.trim(source).try_cast(kind if kind == "double" else "decimal(38,18)")
    if kind == "double" and field.precision >= 0:
        out = F.bround(out, field.precision)
    return out.cast(kind) if kind.startswith("decimal") else out


def enforce(df: DataFrame, fields: list[Field]) -> dict[str, DataFrame]:
    """df with the declared columns first, converted, others behind them; rows with a null where none may be go to reject.

    A missing column becomes null, or its type's default where it may not be null.
    reject keeps raw values and names the first violated column.
    """
    types = dict(df.dtypes)
    values, bad = [], F.lit(None).cast("string")
    for f in reversed(fields):
        if f.name in types and not f.nullable:
            bad = F.when(F.col(f"`{f.name}`").isNull(), F.lit(f"Column '{f.name}': non-nullable column has null")).otherwise(bad)
    for f in fields:
        if f.name in types:
            values.append(converted(f, F.col(f"`{f.name}`"), types[f.name]).alias(f.name))
        else:
            default = "null" if f.nullable else _DEFAULTS.get(f.spark, "0")
            values.append(F.expr(f"cast({default} as {f.spark})").alias(f.name))
    names = {f.name for f in fields}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    why = spare(df, "why")
    marked = df.withColumn(why, bad)
    reject = marked.where(F.col(why).isNotNull()).withColumns({"errorCode": F.lit("SCHEMA_VIOLATION"), "errorMessage": F.col(why)}).drop(why)
    return {"main": marked.where(F.col(why).isNull()).select(*values, *rest), "reject": reject}
