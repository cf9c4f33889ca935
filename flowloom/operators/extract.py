"""Fields taken out of text columns: delimited, regular expression, positional, JSON, XML, record sets."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.reshape import _literal
from flowloom.operators.rows import Flows
from flowloom.shared import spare


def _split(df: DataFrame, made: dict[str, Column], code: Column, null_source: str, source: Column, ignore_null: bool) -> Flows:
    """main gets the made columns where code is null; reject the rest with errorCode. Null sources are dropped or rejected."""
    why = spare(df, "code")
    marked = df.withColumn(why, F.when(source.isNull(), F.lit(null_source)).otherwise(code))
    reject = marked.where(F.col(why).isNotNull())
    reject = reject.where(F.col(why) != null_source) if ignore_null else reject
    return {
        "main": marked.where(F.col(why).isNull()).withColumns(made).drop(why),
        "reject": reject.withColumns({"errorCode": F.col(why), "errorMessage": F.concat(F.lit("extraction failed: "), why)}).drop(why),
    }


def extract_delimited(df: DataFrame, field: str, columns: list[str], separator: str = ";", trim: bool = False, check_fields_num: bool = False, ignore_source_null: bool = True) -> Flows:
    """Tokens of a text as columns by position, null where there are too few; another count is rejected on check_fields_num."""
    source = F.col(f"`{field}`").cast("string")
    tokens = F.split(source, _literal(separator), -1)
    made = {c: (F.trim(F.get(tokens, F.lit(i))) if trim else F.get(tokens, F.lit(i))) for i, c in enumerate(columns)}
    code = F.when(F.size(tokens) != len(columns), "FIELD_COUNT_MISMATCH") if check_fields_num else F.lit(None).cast("string")
    return _split(df, made, code, "NULL_SOURCE", source, ignore_source_null)


def extract_regex(df: DataFrame, field: str, regex: str, columns: list[str], ignore_source_null: bool = False) -> Flows:
    """Groups of the first match as columns by position; a group that took no part is "", as an empty one is (Spark tells them not apart)."""
    source = F.col(f"`{field}`").cast("string")
    groups = re.compile(regex).groups
    made = {c: (F.regexp_extract(source, regex, i + 1) if i < groups else F.lit(None).cast("string")) for i, c in enumerate(columns)}
    code = F.when(~source.rlike(regex), "NO_MATCH").when(F.lit(groups != len(columns)), "FIELD_COUNT_MISMATCH")
    return _split(df, made, code, "NULL_SOURCE", source, ignore_source_null)


def extract_positional(df: DataFrame, field: str, widths: list[int], columns: list[str], trim: bool = False, check_fields_num: bool = False, ignore_source_null: bool = True) -> Flows:
    """Runs of characters as columns; on check_fields_num lines shorter than all widths are rejected."""
    source = F.regexp_replace(F.col(f"`{field}`").cast("string"), "^\ufeff", "")
    made, at = {}, 1
    for c, width in zip(columns, widths, strict=True):
        made[c] = F.trim(F.substring(source, at, width)) if trim else F.substring(source, at, width)
        at += width
    code = F.when(F.length(source) < at - 1, "EXTRACTION_ERROR") if check_fields_num else F.lit(None).cast("string")
    return _split(df, made, code, "NULL_SOURCE", source, ignore_source_null)


def extract_json(df: DataFrame, field: str, mapping: dict[str, str], loop: str | None = None) -> Flows:
    """JSON paths as columns (as text; objects and arrays as JSON, nothing as ""), one row for each element of the array at loop.

    Paths of the mapping are relative to the element. Null and unparseable sources go to reject.
    """
    source = F.col(f"`{field}`").cast("string")
    parsed = F.try_parse_json(source)
    code = F.when(F.trim(source) == "", "NO_JSON").when(parsed.isNull(), "PARSE_ERROR")
    flows = _split(df, {}, code, "NO_JSON", source, False)
    main, item = flows["main"], source
    if loop:
        elements = F.from_json(F.get_json_object(source, re.sub(r"\[\*\]$", "", loop)), "array<string>")
        main = main.withColumn("__item", F.explode(elements))
        item = F.col("__item")
    made = {c: F.coalesce(F.get_json_object(item, p), F.lit("")) for c, p in mapping.items()}
    return {"main": main.withColumns(made).drop("__item"), "reject": flows["reject"].withColumn("errorJSONField", source)}


def _local(tree: ET.Element) -> ET.Element:
    for e in tree.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return tree


def xml_rows(text: str, loop: str, mapping: dict[str, str], root_fallback: bool = False) -> list[dict[str, str]]:
    """The mapped paths below each element at loop, by local names; `@a` and `x/@a` are attributes, `.` the element's text, missing ones ""."""
    root = _local(ET.fromstring(text))
    steps = [s for s in loop.strip("/").split("/") if s and s != "."]
    nodes = [root] if not steps or steps == [root.tag] else root.findall(("./" + "/".join(steps[1:] if steps[0] == root.tag else steps)) if not loop.startswith("//") else ".//" + "/".join(steps))

    def value(e: ET.Element, path: str) -> str:
        at, _, attribute = path.strip().removeprefix("./").partition("@")
        at = at.strip("/")
        node = e if at in ("", ".") else e.find(at)
        node = root.find(at) if node is None and root_fallback else node
        if node is None:
            return ""
        return node.get(attribute, "") if attribute else "".join(node.itertext()).strip()

    return [{c: value(e, p) for c, p in mapping.items()} for e in nodes]


def extract_xml(df: DataFrame, field: str, loop: str, mapping: dict[str, str], limit: int | None = None) -> Flows:
    """One row for each element at loop of an XML text, with the mapped paths; null and malformed sources go to reject.

    A document is parsed in its row's task; other columns stay.
    """

    @F.pandas_udf("array<map<string,string>>")
    def parsed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict[str, str]] | None:
            try:
                return xml_rows(text, loop, mapping)[:limit] if text else None
            except ET.ParseError:
                return None

        return texts.map(one)

    source = F.col(f"`{field}`")
    marked = df.withColumn("__rows", parsed(source))
    bad = F.when(source.isNull() | (F.trim(source) == ""), "NO_XML").when(F.col("__rows").isNull(), "PARSE_ERROR")
    marked = marked.withColumn("__code", bad)
    main = marked.where("__code is null").withColumn("__row", F.explode("__rows")).withColumns({c: F.col("__row")[c] for c in mapping}).drop("__rows", "__row", "__code")
    reject = marked.where("__code is not null").withColumns({"errorCode": F.col("__code"), "errorMessage": F.concat(F.lit("extraction failed: "), "__code"), "errorXMLField": source}).drop("__rows", "__code")
    return {"main": main, "reject": reject}


def parse_record_set(df: DataFrame, field: str, attributes: list[str]) -> DataFrame:
    """One row for each object of a JSON array (or a single object) with the named attributes as text; other columns go, unparseable rows give none."""
    source = F.trim(F.col(f"`{field}`").cast("string"))
    listed = F.when(source.startswith("["), source).otherwise(F.concat(F.lit("["), source, F.lit("]")))
    items = df.where(F.try_parse_json(source).isNotNull()).select(F.explode(F.from_json(listed, "array<map<string,string>>")).alias("__item")).where("__item is not null")
    return items.select(*[F.col("__item")[a].alias(a) for a in attributes])


def xml_map(df: DataFrame, field: str, loop: str, mapping: dict[str, str], expression_filter: str | None = None) -> Flows:
    """Like extract_xml, with only the mapped columns, paths missing below an element looked up from the root, and a SQL condition on the result."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for text in x["doc"]:
                try:
                    rows += [(*r.values(), None, None) for r in xml_rows(text, loop, mapping, True)] if text else [(*[None] * len(mapping), "NO_XML", text)]
                except ET.ParseError:
                    rows.append((*[None] * len(mapping), "PARSE_ERROR", text))
            yield pd.DataFrame(rows, columns=[*mapping, "errorCode", "errorXMLField"])

    made = df.select(F.col(f"`{field}`").alias("doc")).mapInPandas(work, ", ".join(f"`{c}` string" for c in [*mapping, "errorCode", "errorXMLField"]))
    main = made.where("errorCode is null").select(*mapping)
    return {"main": main.where(F.coalesce(F.expr(expression_filter), F.lit(False))) if expression_filter else main, "reject": made.where("errorCode is not null").select("errorCode", "errorXMLField")}
