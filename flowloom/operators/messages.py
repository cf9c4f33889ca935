"""Financial block messages: parsed into rows, then mapped to output fields."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_messages(df: DataFrame, column: str) -> DataFrame:
    """df with block1, block2, block3, block5 and fields: array of (tag, value) of block 4, continuation lines joined by a space.

    All expressions are Spark's own. Texts without a block give nulls and no fields.
    """
    c = F.col(f"`{column}`")
    block = lambda n: F.nullif(F.regexp_extract(c, rf"\{{{n}:((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", 1), F.lit(""))
    body = F.regexp_extract(c, r"(?s)\{4:(.*?)\r?\n?-\}", 1)
    tagged = F.regexp_extract_all(body, F.lit(r"(?s)(:\d{2}[A-Z]?:.*?)(?=\r?\n:\d{2}[A-Z]?:|\z)"), 1)
    fields = F.transform(tagged, lambda x: F.struct(F.regexp_extract(x, r"^:(\d{2}[A-Z]?):", 1).alias("tag"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^:\d{2}[A-Z]?:", ""), r"\r?\n", " ")).alias("value")))
    return df.withColumns({f"block{n}": block(n) for n in (1, 2, 3, 5)} | {"fields": fields})


def message_field(tag: str, default: str = "") -> Column:
    """The first value of a tag of parsed messages."""
    return F.coalesce(F.get(F.filter("fields", lambda f: f["tag"] == tag), F.lit(0))["value"], F.lit(default))


def statement_lines(df: DataFrame) -> DataFrame:
    """One row for each :61: of parsed messages with the :86: right behind it: columns line_no, field61 and field86."""
    pairs = F.transform("fields", lambda f, i: F.struct(f["tag"].alias("tag"), f["value"].alias("field61"), F.when(F.get("fields", i + 1)["tag"] == "86", F.get("fields", i + 1)["value"]).alias("field86")))
    lines = F.filter(pairs, lambda p: p["tag"] == "61")
    return df.select("*", F.posexplode(lines).alias("line_no", "__line")).select(*df.columns, "line_no", "__line.field61", "__line.field86")


def transform_messages(df: DataFrame, fields: list[dict[str, Any]]) -> DataFrame:
    """Output columns from a list of settings: name, type and what the type needs.

    direct: source; constant: value; regex: source, pattern, group; substring:
    source, start, length; split: source, delimiter, index; concatenate: sources,
    delimiter; conditional: SQL condition, then, otherwise; expression: SQL. default
    stands in for null and empty values.
    """
    for x in fields:
        kind = x.get("type", "direct")
        source = F.col(f"`{x['source']}`").cast("string") if x.get("source") else None
        made = {
            "direct": lambda: source, "constant": lambda: F.lit(x.get("value", "")), "regex": lambda: F.regexp_extract(source, x["pattern"], x.get("group", 1)),
            "substring": lambda: F.substring(source, x["start"] + 1, x["length"]), "split": lambda: F.get(F.split(source, r"\Q" + x["delimiter"] + r"\E", -1), F.lit(x["index"])),
            "concatenate": lambda: F.concat_ws(x.get("delimiter", ""), *[F.col(f"`{s}`").cast("string") for s in x["sources"]]),
            "conditional": lambda: F.when(F.expr(x["condition"]), F.expr(x["then"])).otherwise(F.expr(x["otherwise"])), "expression": lambda: F.expr(x["expression"]),
        }[kind]().cast("string")
        df = df.withColumn(x["name"], F.coalesce(F.nullif(made, F.lit("")), F.lit(x.get("default", ""))))
    return df


def movement(value: str) -> dict[str, Column]:
    """Parts of a :61: line: value date, entry date, debit or credit mark, amount and the rest."""
    c, pattern = F.col(f"`{value}`"), r"^(\d{6})(\d{4})?(R?[CD])[A-Z]?(\d+,\d*)([A-Z]\w{3})?(.*)$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return {"value_date": F.try_to_timestamp(part(1), F.lit("yyMMdd")).cast("date"), "entry_date": part(2), "mark": part(3), "amount": F.replace(part(4), F.lit(","), F.lit(".")).try_cast("decimal(18,2)"), "kind": part(5), "reference": part(6)}
