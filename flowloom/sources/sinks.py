"""Writers. Each writes a folder of part files from the tasks and returns its input as main."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.rows import Flows


def _text(df: DataFrame, name: str, date_pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    c, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind.startswith("timestamp") or kind == "date":
        c = F.date_format(c, date_pattern)
    return F.coalesce(c.cast("string"), F.lit(""))


def write_delimited(df: DataFrame, path: str, separator: str = ";", header: bool = False, csv: bool = False, quote: str = '"', escape: str = "\\", mode: str = "overwrite", split_every: int = 0, compression: str = "none", encoding: str = "UTF-8", date_pattern: str = "yyyy-MM-dd HH:mm:ss") -> Flows:
    """Lines of cells joined by separator; csv: all cells quoted; split_every: rows a file at most. The header stands in each file."""
    cells = df.select(*[_text(df, c, date_pattern).alias(c) for c in df.columns])
    if csv or header:
        writer = cells.write.mode(mode).option("sep", separator).option("header", str(header).lower()).option("encoding", encoding).option("compression", compression).option("emptyValue", "")
        writer = writer.option("quoteAll", "true").option("quote", quote).option("escape", escape) if csv else writer.option("quote", "\0").option("escapeQuotes", "false")
        (writer.option("maxRecordsPerFile", split_every) if split_every else writer).csv(path)
    else:
        writer = cells.select(F.concat_ws(separator, *[F.col(f"`{c}`") for c in cells.columns]).alias("value")).write.mode(mode).option("compression", compression)
        (writer.option("maxRecordsPerFile", split_every) if split_every else writer).text(path)
    return {"main": df}


def positional_line(df: DataFrame, formats: list[dict]) -> Column:
    """One text of cells padded or cut to size: column, size, padding, align (L, R, C), keep (ALL, LEFT, RIGHT)."""
    parts = []
    for x in formats:
        c, size, pad = _text(df, x["column"]), x["size"], x.get("padding", " ")
        keep = x.get("keep", "ALL")
        c = F.left(c, F.lit(size)) if keep == "LEFT" else F.right(c, F.lit(size)) if keep == "RIGHT" else c
        short = F.length(c) < size
        align = x.get("align", "L")
        if align == "C":
            padded = F.rpad(F.lpad(c, F.length(c) + F.floor((size - F.length(c)) / 2).cast("int"), F.lit(pad)), size, pad)
        else:
            padded = F.lpad(c, size, pad) if align == "R" else F.rpad(c, size, pad)
        parts.append(F.when(short, padded).otherwise(c))
    return F.concat(*parts)


def write_positional(df: DataFrame, path: str, formats: list[dict], mode: str = "overwrite", compression: str = "none") -> Flows:
    """Fixed-width lines."""
    df.select(positional_line(df, formats).alias("value")).write.mode(mode).option("compression", compression).text(path)
    return {"main": df}


def write_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "root", attributes: list[str] = (), mode: str = "overwrite") -> Flows:
    """An element for each row; attributes: columns written as attributes."""
    named = df.select(*[F.col(f"`{c}`").alias(f"_{c}" if c in attributes else c) for c in df.columns])
    named.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).mode(mode).save(path)
    return {"main": df}


def grouped_xml(df: DataFrame, group_by: list[str], group_tag: str, loop_tag: str, order_by: list[str]) -> DataFrame:
    """group_by and `xml`: a group element with its columns as attributes and one loop element for each row; a group must fit a task."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    cells = [F.concat(F.lit(f"<{c}>"), escaped(c), F.lit(f"</{c}>")) for c in df.columns if c not in group_by]
    row = F.concat(F.lit(f"<{loop_tag}>"), *cells, F.lit(f"</{loop_tag}>")).alias("__row")
    listed = F.sort_array(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in order_by], row)))
    heads = [F.concat(F.lit(f' {c}="'), escaped(c), F.lit('"')) for c in group_by]
    inside = F.array_join(F.transform(listed, lambda r: r["__row"]), "")
    return df.groupBy(*group_by).agg(inside.alias("__in")).select(*group_by, F.concat(F.lit(f"<{group_tag}"), *heads, F.lit(">"), "__in", F.lit(f"</{group_tag}>")).alias("xml"))


def log_rows(df: DataFrame, max_rows: int = 100, style: str = "table", separator: str = "|", show=print) -> Flows:
    """The first rows printed: basic, table or vertical."""
    rows = df.limit(max_rows).collect()
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    if style == "basic":
        show("\n".join(separator.join(r) for r in cells))
    elif style == "vertical":
        show("\n\n".join("\n".join(f"{c}: {v}" for c, v in zip(df.columns, r, strict=True)) for r in cells))
    else:
        widths = [max(map(len, x)) for x in zip(df.columns, *cells, strict=True)]
        show("\n".join(" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, *cells]))
    return {"main": df}
