"""WARC archives: written as text parts with revisits, read by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch

FILE_BYTES = 32 << 20
#: Fixed values of the format: version line, line end, end of a record, revisit profile.
MAGIC, CRLF, END = "WARC/1.0", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", scratch: Scratch | None = None) -> None:
    """Write one record for each row of pages under path, as gzip parts of about FILE_BYTES before compression.

    The payload is the text in UTF-8, a null one empty. Of the records whose equal
    payloads have min_bytes or more, that with the largest id is the response and
    the others are revisits of it (without payload); if a row with that id is
    repeated, each copy is a response. A null id is below every other. Line ends
    and other control characters in a URL are written %20, a null URL is left out.
    Other columns are not written; an empty table gives parts without records.

    Which records revisit others is found from ids and digests alone: the largest
    id of a digest is aggregated before the shuffle.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    narrow = scratch.save(rows.select("id", "digest", F.octet_length("payload").alias("n")))
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heads = scratch.save(narrow.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("id").alias("head"), F.count("*").alias("held")).where("held > 1").select("digest", "head"))
    revisits = narrow.join(heads, "digest").where("not (id <=> head)").select("id", "digest", "head").distinct()
    parts = max(int(total // FILE_BYTES) + 1, pages.sparkSession.sparkContext.defaultParallelism)
    key = lambda df: df.withColumn("key", F.coalesce("id", F.lit(-1))).repartition(parts, "key", "digest")
    typed = key(rows).alias("r").join(key(revisits).alias("v"), (F.col("r.key") == F.col("v.key")) & (F.col("r.digest") == F.col("v.digest")) & F.col("r.id").eqNullSafe(F.col("v.id")), "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit(CRLF))
    again = F.col("v.head").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(again, "").otherwise(F.col("r.payload")))
    record = F.concat(
        F.lit(MAGIC + CRLF), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("r.id"))),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z" + CRLF), F.coalesce(line("WARC-Target-URI", F.regexp_replace("r.url", r"[\x00-\x1f\x7f]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("r.digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("v.head"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )
    typed.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    scratch.drop(narrow, heads)


_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.I)


def _field(head: bytes, name: str) -> str | None:
    found = re.search(rb"\r\n" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r\n", head, re.I)
    return found[1].decode("utf-8", "replace") if found else None


def _candidates(path: str, data: bytes) -> Iterator[tuple]:
    """Whatever in a file looks like a record: its offset, where the next must start, and its content."""
    for found in _MAGIC.finditer(data):
        at = found.start()
        stop = data.find(b"\r\n\r\n", at)
        length = _LENGTH.search(data, at, stop + 2) if stop >= 0 else None
        if not length:
            continue
        start, size = stop + 4, int(length[1])
        after = start + size + 4
        if data[after - 4 : after] != b"\r\n\r\n" or after > len(data):
            continue
        head, block = data[at : stop + 2], data[start : start + size]
        payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        stated = (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
        yield path, at, after, _field(head, "WARC-Type"), _field(head, "WARC-Record-ID"), _field(head, "WARC-Refers-To"), _field(head, "WARC-Target-URI"), len(payload), digest, stated


FIELDS = "path string, at long, after long, record_type string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string, stated_digest string"


def read_warc(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """The true records of all archives (.warc, gzip or not) under path, in the columns of FIELDS.

    Each file's task emits everything that looks like a record, payloads that hold
    the magic included, with the offset its successor would have. Pointer jumping
    from offset 0 of each file then keeps the records on the chain: in round k the
    set reached grows by jumps over 2**k records and the jumps double.
    """
    scratch = scratch or Scratch(spark)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for name, content in zip(x["path"], x["content"], strict=True):
                data = content
                if data[:2] == b"\x1f\x8b":
                    parts = []
                    while data:
                        member = zlib.decompressobj(31)
                        parts.append(member.decompress(data))
                        data = member.unused_data
                    data = b"".join(parts)
                yield pd.DataFrame(list(_candidates(name, data)), columns=[c.split()[0] for c in FIELDS.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    found = scratch.save(files.mapInPandas(work, FIELDS))
    # files by number, which stays small in memory where long equal paths would not
    found_at = found.withColumn("file", F.xxhash64("path"))
    jump = found_at.select("file", F.col("at").alias("a"), F.col("after").alias("b"))
    reached = scratch.save(jump.where("a = 0").select("file", "a").distinct())
    jump = scratch.save(jump)
    count = reached.count()
    while True:
        step = jump.join(reached, ["file", "a"]).select("file", F.col("b").alias("a"))
        more = scratch.save(reached.unionByName(step).distinct())
        scratch.drop(reached)
        reached, before, count = more, count, more.count()
        if count == before:
            break
        onward = jump.select("file", F.col("a").alias("b"), F.col("b").alias("c"))
        further = scratch.save(jump.join(onward, ["file", "b"]).select("file", "a", F.col("c").alias("b")))
        scratch.drop(jump)
        jump = further
    return found_at.join(reached.withColumnRenamed("a", "at"), ["file", "at"], "left_semi").select(*found.columns)


def archived_pages(records: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id) of read records.

    A revisit's payload is that of the response it refers to. Payloads whose digest
    is not the stated one fail the read.
    """
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) as long)")
    records = scratch.save(records)
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("found")).distinct()
    own = records.where("record_type = 'response'").select("record_id", "record_type", "stated_digest", "payload_bytes", F.col("payload_digest").alias("found"), F.lit(None).cast("string").alias("refers_to"))
    again = records.where("record_type = 'revisit'").select("record_id", "record_type", "stated_digest", "refers_to")
    again = again.join(first, (again["refers_to"] == first["refers_to"]) & (again["stated_digest"] == first["found"]), "left").drop(first["refers_to"])
    out = own.unionByName(again)
    checked = F.when(F.col("found") == F.col("stated_digest"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("payload of "), "record_id", F.lit(" does not have its stated digest"))))
    return out.select(page("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
