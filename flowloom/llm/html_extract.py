"""Main text of web pages: marked parts and site templates removed, blocks in page order."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch

#: Pages of a host from which a subtree is a template, and shares of them: outside article and main against noise only.
LEAST_PAGES, NOISE_SHARE, INSIDE_SHARE = 5, 0.001, 0.5
SALTS = 16

#: Fixed values of the format: elements without content, of raw text, that break lines, and that start a new paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What is not main text, by element and by the words of class, id and role.
LEFT_OUT = frozenset("aside button dialog footer form head header input label menu nav object select svg search option datalist fieldset".split()) | RAW
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promotion related replies reply respond share sharing sidebar sidebars social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo search alert".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


class Element:
    """An element with its place among the blocks of text, whether it is left out, and a hash of its subtree."""

    __slots__ = ("tag", "left_out", "article", "first", "hash", "until")

    def __init__(self, tag: str, left_out: bool, article: bool, first: int):
        self.tag, self.left_out, self.article, self.first, self.hash, self.until = tag, left_out, article, first, xxhash.xxh3_64(tag.encode()), first


def parse(source: str | None) -> tuple[list[tuple[str, bool, bool]], list[Element]]:
    """The blocks of a page as (text, left out, in article), and its block elements with the range of blocks that they hold."""
    source = source or ""
    blocks: list[tuple[str, bool, bool]] = []
    elements: list[Element] = []
    root = Element("#", False, False, 0)
    stack, words, at = [root], [], 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
        words.clear()
        if text:
            blocks.append((text, stack[-1].left_out, stack[-1].article))
            data = text.encode("utf-8", "replace")
            for e in stack:
                e.hash.update(data)

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1].tag in BLOCK:
                flush()
            e = stack.pop()
            e.until = len(blocks)
            stack[-1].hash.update(b"<" + e.hash.digest())
            if e.tag in BLOCK and e.until > e.first:
                elements.append(e)

    while at < len(source):
        found = _TOKEN.search(source, at)
        if not found:
            words.append(source[at:])
            break
        words.append(source[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag), 0)
            if tag in BLOCK:
                flush()
            if depth and not (tag not in BLOCK and any(e.tag in BLOCK for e in stack[depth:])):
                close(depth)
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in BLOCK:
            flush()
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
            limit = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}.get(tag, ())
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag in limit:
                    break
                if stack[d].tag in ends:
                    close(d)
            # a paragraph ends where another block starts in it
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == "p":
                    close(d)
                    break
                if stack[d].tag in BLOCK:
                    break
        attributes = found[3]
        named = " ".join(x for m in _NAMES.findall(attributes) for x in m).lower() if attributes else ""
        out = stack[-1].left_out or tag in LEFT_OUT or tag not in ("html", "body", "article", "main") and bool(MARKS.intersection(_WORDS.split(named))) or tag == "article" and bool({"comment", "comments", "reply"}.intersection(_WORDS.split(named))) or bool(attributes and _HIDDEN.search(attributes))
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            stack.append(Element(tag, out, stack[-1].article or tag in ("article", "main"), len(blocks)))
    flush()
    close(1)
    return blocks, elements


def _kept(source: str | None) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int, bool]]]:
    """The blocks of a page that are not left out, as (text, in article), and the elements that hold some, as (first, until, key, in article).

    The key is the hash of the subtree; its last bit says whether it stands in article or main.
    """
    blocks, elements = parse(source)
    at = [0]
    for _, out, _ in blocks:
        at.append(at[-1] + (not out))
    held = [(at[e.first], at[e.until], _signed(e.hash.intdigest() >> 1 << 1 | e.article), e.article) for e in elements if e.tag not in ("html", "body")]
    return [(text, article) for text, out, article in blocks if not out], [x for x in held if x[0] < x[1]]


def _joined(blocks: list[tuple[str, bool]], spans: Iterable[tuple[int, int]]) -> str:
    """The text of blocks without those in spans: of article and main only, if these hold half of it or more."""
    gone = [False] * len(blocks)
    for first, until in spans:
        gone[first:until] = [True] * (until - first)
    left = [b for b, g in zip(blocks, gone, strict=True) if not g]
    inside = sum(len(text) for text, article in left if article)
    hint = inside and 2 * inside >= sum(len(text) for text, _ in left)
    return "\n".join(text for text, article in left if article or not hint)


def main_text(source: str | None, templates: frozenset[int] = frozenset()) -> str:
    """A page's main text: its blocks without left-out ones and those of subtrees whose keys templates has.

    Where article and main hold half of that text or more, only theirs.
    """
    blocks, elements = _kept(source)
    return _joined(blocks, [(first, until) for first, until, key, _ in elements if key in templates])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _print(texts: Iterable[str]) -> int:
    return _signed(xxhash.xxh3_64_intdigest("\n".join(texts).encode("utf-8", "replace")))


def _parsed(pages: DataFrame, kind: str) -> DataFrame:
    """Each page parsed once: its kept blocks and elements, a key for equal rows, and the hashes of its text and of its article's text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for source in x["html"]:
                blocks, elements = _kept(source)
                inside = [text for text, article in blocks if article]
                rows.append(([t for t, _ in blocks], [a for _, a in blocks], *([e[i] for e in elements] for i in range(4)), _print(t for t, _ in blocks), _print(inside) if inside else None))
            out = pd.DataFrame(rows, columns=["texts", "inside", "firsts", "untils", "hashes", "held", "page", "article"])
            out["article"] = pd.array(out["article"], "Int64")
            yield pd.concat([x[["id", "url", "host", "key"]].reset_index(drop=True), out], axis=1)

    schema = f"id {kind}, url string, host string, key long, texts array<string>, inside array<boolean>, firsts array<int>, untils array<int>, hashes array<long>, held array<boolean>, page long, article long"
    return pages.withColumn("key", F.xxhash64("id", "url", "html")).mapInPandas(work, schema)


def site_templates(parsed: DataFrame) -> DataFrame:
    """(host, hash): the subtrees that recur on a host.

    A subtree counts once for all pages of equal text, in article and main once for
    all of equal article text, so copies of a page make no template. It is one from
    LEAST_PAGES such pages on, if these are NOISE_SHARE of the host's or more; in
    article and main, where a line that recurs may well be the authors', if they
    are INSIDE_SHARE or more. Counts are summed before the shuffle.
    """
    each = parsed.select("host", "page", "article", F.explode(F.arrays_zip("hashes", "held")).alias("e"))
    each = each.select("host", F.col("e.hashes").alias("hash"), F.col("e.held").alias("held"), F.when(F.col("e.held"), F.col("article")).otherwise(F.col("page")).alias("body")).distinct()
    count = each.groupBy("host", "hash", "held").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    bodies = parsed.select("host", F.explode(F.array(F.struct(F.lit(False).alias("held"), F.col("page").alias("body")), F.struct(F.lit(True).alias("held"), F.col("article").alias("body")))).alias("b"))
    total = bodies.select("host", "b.held", "b.body").where("body is not null").distinct().groupBy("host", "held").agg(F.count("*").alias("total"))
    share = F.when(F.col("held"), INSIDE_SHARE).otherwise(NOISE_SHARE)
    return count.join(total, ["host", "held"]).where(F.col("pages") >= share * F.col("total")).select("host", "hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """page id, url, text and n_chars (code points) for every row.

    Character references are decoded; white space inside a block becomes one space;
    blocks are trimmed and joined in page order by one line end, empty ones left
    out. Null, empty and broken pages give what text they have, perhaps "". Null
    urls share one host; repeated rows give equal rows; other columns are not used.

    Subtrees that recur on many pages of a host are found first. The subtrees of all
    pages are joined with them one by one, a large host's dealt out over SALTS.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host.alias("host"))
    kind = pages.schema[id_col].dataType.simpleString()
    parsed = scratch.save(_parsed(rows, kind))
    templates = scratch.save(site_templates(parsed)).withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    elements = parsed.select("key", "host", F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"), F.explode("hashes").alias("hash"))
    hits = scratch.save(elements.join(templates, ["host", "hash", "salt"]).groupBy("key").agg(F.collect_set("hash").alias("found")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts = []
            for blocks, inside, firsts, untils, hashes, found in zip(x["texts"], x["inside"], x["firsts"], x["untils"], x["hashes"], x["found"], strict=True):
                gone = frozenset(found) if found is not None else frozenset()
                texts.append(_joined(list(zip(blocks, inside, strict=True)), [(f, u) for f, u, h in zip(firsts, untils, hashes, strict=True) if h in gone]))
            yield pd.DataFrame({"id": x["id"], "url": x["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = parsed.select("id", "url", "key", "texts", "inside", "firsts", "untils", "hashes").join(hits, "key", "left").drop("key").mapInPandas(work, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col)
