"""File readers."""

from __future__ import annotations

import configparser
import fnmatch
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.operators.extract import extract_json, extract_xml
from flowloom.operators.reshape import _literal
from flowloom.operators.rows import Flows
from flowloom.plans.schema import Field, converted
from flowloom.shared import spare


#: Character sets that Spark decodes, and where ISO-8859-15 differs from ISO-8859-1.
_KNOWN = ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")
_LATIN9 = ("\xa4\xa6\xa8\xb4\xb8\xbc\xbd\xbe", "€ŠšŽžŒœŸ")


def _decoded(content: Column, encoding: str) -> Column:
    """Bytes as text; character sets that Spark lacks are decoded in Arrow batches."""
    if encoding.upper() in _KNOWN:
        return F.decode(content, encoding)
    if encoding.upper() == "ISO-8859-15":
        return F.translate(F.decode(content, "ISO-8859-1"), *_LATIN9)

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return decode(content)


def _lines(spark: SparkSession, path: str, row_separator: str = "\n", encoding: str = "UTF-8", header: int = 0, footer: int = 0, limit: int | None = None, remove_empty: bool = True) -> DataFrame:
    """The lines of one file or of all below a path as `value`, each file without its first `header` and last `footer`, at most `limit` in all, in the order of paths.

    Lines are only counted where that is asked for, by the blocks in which Spark reads
    files; only in blocks where a head, a foot or the limit ends are lines numbered.
    """
    lines = spark.read.option("lineSep", row_separator).text(path)
    counted = header or footer or limit is not None
    if counted:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    if encoding.upper() not in ("UTF-8", "UTF8"):
        lines = lines.withColumn("value", _decoded(F.col("value").cast("binary"), encoding))
    lines = lines.withColumn("value", F.regexp_replace("value", r"\r$", "")) if row_separator == "\n" else lines
    if header or footer:
        by_file = Window.partitionBy("file").orderBy("block")
        before = F.coalesce(F.sum("held").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        behind = F.coalesce(F.sum("held").over(by_file.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
        blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("held")).select("file", "block", "held", before.alias("before"), behind.alias("behind"))
        ends = blocks.select("file", "block", F.greatest(F.lit(header) - F.col("before"), F.lit(0)).alias("lo"), (F.col("held") - F.greatest(F.lit(footer) - F.col("behind"), F.lit(0))).alias("hi"), "held")
        lines = _cut(lines, ends.where("lo > 0 or hi < held").drop("held"))
    if remove_empty:
        lines = lines.where("value <> ''")
    if limit is not None:
        # one row for each block goes through this window
        before = F.coalesce(F.sum("held").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("held")).select("file", "block", "held", before.alias("before")).where(F.col("before") < limit)
        # at most `limit` blocks are left
        some = lines.join(F.broadcast(blocks.select("file", "block")), ["file", "block"], "left_semi")
        lines = _cut(some, blocks.where(F.col("before") + F.col("held") > limit).select("file", "block", F.lit(0).alias("lo"), (F.lit(limit) - F.col("before")).alias("hi")))
    return lines.select("value") if counted else lines


def _cut(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """lines without those up to lo and behind hi in the blocks of ends (file, block, lo, hi), which are a few for each file."""
    number = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    touched = lines.join(F.broadcast(ends), ["file", "block"]).withColumn("number", number).where("number > lo and number <= hi")
    return lines.join(F.broadcast(ends), ["file", "block"], "left_anti").unionByName(touched.select(*lines.columns))


def read_delimited(spark: SparkSession, path: str, fields: list[Field], separator: str = ";", csv: bool = False, quote: str = '"', escape: str = "\\", header: int = 0, footer: int = 0, limit: int | None = None, encoding: str = "ISO-8859-15", row_separator: str = "\n", remove_empty: bool = True, trim: bool = False, check_fields_num: bool = False) -> Flows:
    """Delimited lines as typed columns.

    Without csv, separators are plain text of any length and nothing is quoted; with
    it, quoted fields may hold separators and line ends. Extra columns are dropped,
    missing ones empty. reject has rows with FIELD_COUNT, TYPE_CONVERSION or DATE_FORMAT.
    """
    if csv and not (header > 1 or footer or limit is not None):
        latin9 = encoding.upper() == "ISO-8859-15"
        raw = spark.read.csv(path, sep=separator[0], quote=quote, escape=escape, encoding="ISO-8859-1" if latin9 else encoding, multiLine=True, header=header == 1, enforceSchema=True, schema=", ".join(f"`{f.name}` string" for f in fields), mode="PERMISSIVE")
        values = {f.name: F.coalesce(F.translate(f"`{f.name}`", *_LATIN9) if latin9 else F.col(f"`{f.name}`"), F.lit("")) for f in fields}
        count = F.lit(len(fields))
    else:
        raw = _lines(spark, path, row_separator, encoding, header, footer, limit, remove_empty)
        tokens = F.from_csv("value", ", ".join(f"`{f.name}` string" for f in fields), {"sep": separator[0], "quote": quote, "escape": escape}) if csv else F.split("value", _literal(separator), -1)
        raw = raw.withColumn("__tokens", tokens)
        values = {f.name: F.coalesce(F.col("__tokens")[f.name] if csv else F.get("__tokens", F.lit(i)), F.lit("")) for i, f in enumerate(fields)}
        count = F.lit(len(fields)) if csv else F.size("__tokens")
    text = raw.select(*[(F.trim(v) if trim else v).alias(n) for n, v in values.items()], count.alias("__count"))
    return typed(text, fields, F.when(F.col("__count") != len(fields), "FIELD_COUNT") if check_fields_num else None)


def typed(text: DataFrame, fields: list[Field], code=None) -> Flows:
    """Text columns converted to the fields' types; rows with text that can't be are rejected with its first reason."""
    reasons = [code] if code is not None else []
    made = {}
    for f in fields:
        c = F.col(f"`{f.name}`")
        made[f.name] = converted(f, c)
        if f.spark != "string":
            reasons.append(F.when((F.trim(c) != "") & made[f.name].isNull(), "DATE_FORMAT" if f.spark == "timestamp_ntz" else "TYPE_CONVERSION"))
    why = spare(text, "code")
    marked = text.withColumn(why, F.coalesce(*reasons, F.lit(None).cast("string")))
    names = [F.col(f"`{f.name}`") for f in fields]
    reject = marked.where(F.col(why).isNotNull()).select(*names, F.col(why).alias("errorCode"), F.concat(F.lit("row rejected: "), why).alias("errorMessage"))
    return {"main": marked.where(F.col(why).isNull()).select(*[v.alias(n) for n, v in made.items()]), "reject": reject}


def read_positional(spark: SparkSession, path: str, fields: list[Field], widths: list[int], trim: bool = True, thousands: str = "", decimal: str = ".", **lines: Any) -> Flows:
    """Lines cut at widths into typed columns; thousands and decimal: separators of numbers."""
    raw, made, at = _lines(spark, path, **lines), {}, 1
    for f, width in zip(fields, widths, strict=True):
        c = F.substring("value", at, width)
        c = F.trim(c) if trim else c
        if f.spark in ("bigint", "double") or f.spark.startswith("decimal"):
            c = F.replace(c, F.lit(thousands), F.lit("")) if thousands else c
            c = F.replace(c, F.lit(decimal), F.lit(".")) if decimal != "." else c
        made[f.name], at = c, at + width
    return typed(raw.select(*[c.alias(n) for n, c in made.items()]), fields)


def read_full_rows(spark: SparkSession, path: str, column: str = "line", random: int | None = None, seed: int = 0, **lines: Any) -> DataFrame:
    """One column with each line; random: that many lines drawn."""
    rows = _lines(spark, path, **lines).select(F.col("value").alias(column))
    return rows.orderBy(F.rand(seed)).limit(random) if random is not None else rows


def read_raw(spark: SparkSession, path: str, as_text: bool = True, encoding: str = "UTF-8", column: str = "content") -> DataFrame:
    """Each file as one row, as text or bytes."""
    content = F.col("content")
    return spark.read.format("binaryFile").load(path).select((_decoded(content, encoding) if as_text else content).alias(column))


def read_json(spark: SparkSession, path: str, mapping: dict[str, str], loop: str | None = None, encoding: str = "UTF-8") -> Flows:
    """Whole JSON files: a row for each element of the array at loop, JSON paths as columns."""
    flows = extract_json(read_raw(spark, path, True, encoding, "__json"), "__json", mapping, loop)
    return {"main": flows["main"].drop("__json"), "reject": flows["reject"].drop("__json")}


def read_xml(spark: SparkSession, path: str, loop: str, mapping: dict[str, str], encoding: str = "UTF-8", limit: int | None = None) -> Flows:
    """Whole XML files: a row for each element at loop, paths as columns."""
    flows = extract_xml(read_raw(spark, path, True, encoding, "__xml"), "__xml", loop, mapping, limit)
    return {"main": flows["main"].drop("__xml"), "reject": flows["reject"].drop("__xml")}


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, columns: list[str]) -> DataFrame:
    """Large XML files split at a row tag; child elements are columns of text, empty ones null."""
    return spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").schema(", ".join(f"`{c}` string" for c in columns)).load(path).select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns])


def read_properties(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """(section, key, value) of .properties or .ini files, which are small: one row a file is parsed in its task."""

    @F.udf("array<struct<section:string,key:string,value:string>>")
    def parsed(text: str) -> list[tuple[str, str, str]]:
        reader = configparser.ConfigParser(interpolation=None, strict=False, allow_no_value=True, comment_prefixes=("#", ";", "!"))
        reader.optionxform = str  # type: ignore[assignment,method-assign]
        reader.read_string(text if re.search(r"^\s*\[", text, re.M) else "[default]\n" + text)
        return [(s, k, v or "") for s in reader.sections() for k, v in reader.items(s)]

    rows = read_raw(spark, path).select(F.explode(parsed("content")).alias("r")).select("r.*")
    return rows.where(F.col("section") == section) if section else rows


def list_files(spark: SparkSession, path: str, masks: list[str] = ("*",), exclude: list[str] = (), recursive: bool = True, order_by: str = "path", descending: bool = False) -> list[dict[str, Any]]:
    """path, name, length and modificationTime of the files that a mask matches, as a driver list to iterate over; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime").collect()
    rows = [{"path": r["path"], "name": r["path"].rpartition("/")[2], "length": r["length"], "modificationTime": r["modificationTime"]} for r in found]
    rows = [r for r in rows if any(fnmatch.fnmatch(r["name"], m) for m in masks) and not any(fnmatch.fnmatch(r["name"], m) for m in exclude)]
    return sorted(rows, key=lambda r: r[order_by], reverse=descending)


def file_properties(spark: SparkSession, path: str, md5: bool = False) -> DataFrame:
    """path, directory, name, size, time and perhaps md5 of each file."""
    f = spark.read.format("binaryFile").load(path)
    made = [F.col("path").alias("abs_path"), F.regexp_replace("path", "/[^/]*$", "").alias("dirname"), F.element_at(F.split("path", "/"), -1).alias("basename"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return f.select(*made, *([F.md5("content").alias("md5")] if md5 else []))


def count_rows(spark: SparkSession, path: str, ignore_empty: bool = False, row_separator: str = "\n", encoding: str = "UTF-8") -> int:
    """The number of lines of the files at path."""
    return _lines(spark, path, row_separator, encoding, remove_empty=ignore_empty).count()
