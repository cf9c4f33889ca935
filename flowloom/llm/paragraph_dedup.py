"""Substring dedup: passages that repeat across documents, by paragraph MinHash banding and by exact runs of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.anchored import Strings, repeated_strings
from flowloom.llm.common import Scratch, fields, gives_back, gives_back_each, of_ids, unused
from flowloom.llm.neardup import Similarity, link_keyed
from flowloom.llm.sketch import band_keys, run_hashes, sets_of_words, sketches, word_hashes, word_places

#: 21 bands of 3: paragraphs at a similarity of 0.75 are missed with a probability of 1e-5.
HOW = Similarity(coordinates=64, rows=3)
LEAST_WORDS = 30
#: Owners from here on stand for documents without an id.
NO_ID = 1 << 62


def _keyed_docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, owner, id, text): k stands for id and text, so rows repeated in full are one; owner is the id."""
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = read.select(F.xxhash64("id", "text").alias("k"), "id", "text")
    return read.withColumn("owner", F.coalesce("id", F.lit(NO_ID) + F.shiftrightunsigned("k", 3)))


def _word_runs(contexts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, place, class) of all runs of `length` words: runs of one class have equal hashes."""
    sizes = np.array([len(c) for c in contexts])
    joined = np.concatenate(contexts)
    kind = run_hashes(joined, length).view(np.int64)
    owner = np.repeat(np.arange(len(contexts)), sizes)[: len(kind)]
    ends = np.cumsum(sizes)
    at = np.flatnonzero(np.arange(len(kind)) + length <= ends[owner])
    return owner[at], at - (ends - sizes)[owner[at]], kind[at]


def _runs(least: int) -> Strings:
    return Strings(length=least, gram=min(8, max(least // 2, 1)), across=True, symbols=word_hashes, classes=_word_runs, digest=xxhash.xxh3_128_digest)


def _first_lines(sizes: list[int], doc: list[int], least: int) -> np.ndarray:
    """Which lines begin a paragraph, from the lines' words and documents.

    A line of `least` words or more is one. Shorter lines in a row are one together, up to the
    next longer line, the end of the document, or the first blank line where they have `least` words.
    """
    out, held, before, closed = [], 0, -1, False
    for i, (n, d) in enumerate(zip(sizes, doc, strict=True)):
        if d != before or n >= least or closed:
            out.append(i)
            held = 0
        held += n
        before, closed = d, held >= least and n in (0, held)
    return np.array(out, np.int64)


def _paragraph_rows(docs: DataFrame, least: int, how: Similarity) -> DataFrame:
    """(k, owner, start, stop, n, id, keys) of every paragraph: its words, its set's size and print, and its band keys.

    Of equal sets in a batch one has the keys: the rest of a large group of copies is met by its print.
    """

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            known: set[int] = set()
            for at in range(0, len(x), 256):
                part = x.iloc[at : at + 256]
                lines = [t.split("\n") if t else [] for t in part["text"]]
                hashes = word_hashes([line for doc in lines for line in doc])
                sizes = np.array([len(h) for h in hashes], np.int64)
                doc = np.repeat(np.arange(len(part)), [len(d) for d in lines])
                if not sizes.sum():
                    continue
                words, begins = np.concatenate(hashes), np.cumsum(sizes) - sizes
                first = _first_lines(sizes.tolist(), doc.tolist(), least)
                start = begins[first]
                stop = np.append(start[1:], len(words))
                before = np.concatenate(([0], np.cumsum(np.bincount(doc, weights=sizes, minlength=len(part)).astype(np.int64))))
                long_ = np.flatnonzero(stop - start >= least)
                start, stop, of = start[long_], stop[long_], doc[first[long_]]
                sets = sets_of_words([words[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], how.width)
                prints = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
                new = [j for j, p in enumerate(prints) if not (p in known or known.add(p))]
                keys: list[np.ndarray | None] = [None] * len(sets)
                for j, k in zip(new, band_keys(sketches([sets[j] for j in new], how.coordinates), how.rows) if new else (), strict=True):
                    keys[j] = k
                yield pd.DataFrame({
                    "k": part["k"].to_numpy(np.int64)[of], "owner": part["owner"].to_numpy(np.int64)[of], "start": start - before[of], "stop": stop - before[of],
                    "n": np.array([len(s) for s in sets], np.int64), "id": np.array(prints, np.int64), "keys": pd.Series(keys, dtype=object),
                })

    return docs.select("k", "owner", "text").mapInPandas(work, "k long, owner long, start int, stop int, n long, id long, keys array<long>")


def _sets_of_paragraphs(docs: DataFrame, paragraphs: DataFrame, how: Similarity, scratch: Scratch) -> Callable[[DataFrame], DataFrame]:
    """Gives the full sets (id, hashes) of the paragraphs in a table of ids: one place of each is read."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 256):
                part = x.iloc[at : at + 256]
                words = word_hashes(part["text"].tolist())
                places = [h[a:b] for h, start, stop in zip(words, part["start"], part["stop"], strict=True) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                sets = sets_of_words(places, how.width)
                yield pd.DataFrame({"id": np.concatenate(part["id"].tolist()), "hashes": pd.Series([s.view(np.int64) for s in sets], dtype=object)})

    def sets(ids: DataFrame) -> DataFrame:
        places = paragraphs.join(ids, "id").groupBy("id").agg(F.min(F.struct("k", "start", "stop")).alias("at"))
        wanted = scratch.save(places.select("id", "at.*").groupBy("k").agg(F.collect_list(F.struct("id", "start", "stop")).alias("wanted")))
        some = of_ids(docs.select("k", "text"), wanted, "k").join(wanted, "k").select("text", *fields("wanted", "id", "start", "stop"))
        return some.mapInPandas(work, "id long, hashes array<long>").groupBy("id").agg(F.any_value("hashes").alias("hashes"))

    return sets


def _spans(docs: DataFrame, least: int, how: Similarity, scratch: Scratch) -> DataFrame:
    """(k, spans) with the words (start, stop, first) that are to go from each document; spans may overlap."""
    rows = scratch.save(_paragraph_rows(docs, least, how))
    keyed = rows.where("keys is not null").select("id", "n", "keys")
    label = link_keyed(keyed, _sets_of_paragraphs(docs, rows, how, scratch), scratch, how)
    grouped = rows.select("k", "owner", "start", "stop", "id").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    grouped = scratch.save(grouped)
    repeated = grouped.groupBy("component").agg(F.min("owner").alias("first"), F.max("owner").alias("last")).where("first < last").drop("last")
    lines = scratch.save(grouped.join(repeated, "component").where("owner <> first").select("k", "start", "stop", "first"))
    scratch.drop(rows, grouped)
    inner = Scratch(docs.sparkSession)
    runs = repeated_strings(docs, _runs(least), inner).select("k", F.filter("spans", lambda s: s["first"] != F.col("owner")).alias("spans")).where(F.size("spans") > 0)
    one = lines.select("k", F.array(F.struct("start", "stop", "first")).alias("spans"))
    spans = scratch.save(one.unionByName(runs).groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    inner.clear()
    scratch.drop(lines)
    return spans


def _merged(starts: pd.Series, stops: pd.Series, firsts: pd.Series | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, stop, first) of the documents' spans in words, in order and disjoint; first is the least of those that overlap (0 if not given)."""
    sizes = [len(x) for x in starts]
    if not sum(sizes):
        return (np.empty(0, np.int64),) * 4
    doc = np.repeat(np.arange(len(sizes)), sizes)
    # a document's places stand behind those of all before
    start, stop = (np.concatenate(x.tolist()).astype(np.int64) + (doc << 32) for x in (starts, stops))
    by = np.argsort(start)
    start, stop, doc = start[by], stop[by], doc[by]
    head = np.flatnonzero(np.concatenate(([True], start[1:] >= np.maximum.accumulate(stop)[:-1])))
    first = np.minimum.reduceat(np.concatenate(firsts.tolist())[by], head) if firsts is not None else np.zeros(len(head), np.int64)
    doc = doc[head]
    return doc, start[head] - (doc << 32), np.maximum.reduceat(stop, head) - (doc << 32), first


def _passages(docs: DataFrame, least: int, how: Similarity, scratch: Scratch) -> DataFrame:
    """(id, start, stop, words, first) of all that is to go, in characters, disjoint within a document."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in (b.iloc[at : at + 256] for b in batches for at in range(0, len(b), 256)):
            begins, ends = zip(*word_places(x["text"].tolist()), strict=True)
            doc, a, b, first = _merged(x["start"], x["stop"], x["first"])
            before = np.cumsum([0, *(len(e) for e in begins)])[doc]
            begin, end = np.concatenate(begins)[before + a], np.concatenate(ends)[before + b - 1]
            made = pd.DataFrame({"id": pd.array(x["id"].array[doc], "Int64"), "start": begin, "stop": end, "words": b - a, "first": pd.array(first, "Int64")})
            made.loc[first >= NO_ID, "first"] = pd.NA
            yield made

    spans = _spans(docs, least, how, scratch)
    found = docs.select("k", "id", "text").join(spans, "k").select("id", "text", *fields("spans", "start", "stop", "first"))
    return scratch.save(found.mapInPandas(work, "id long, start int, stop int, words long, first long"))


@gives_back_each
def _left(text: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
    """The texts without the words of their spans and what stands between those; null where there are no spans."""
    out: list[str | None] = [None] * len(text)
    some = np.flatnonzero(start.notna())
    for group in (some[at : at + 256] for at in range(0, len(some), 256)):
        texts = text.iloc[group].tolist()
        doc, a, b, _ = _merged(start.iloc[group], stop.iloc[group])
        cuts = np.searchsorted(doc, np.arange(len(group) + 1))
        for j, (begin, end) in enumerate(word_places(texts)):
            spans = slice(cuts[j], cuts[j + 1])
            begin, end = begin[a[spans]].tolist(), end[b[spans] - 1].tolist()
            out[group[j]] = "".join([texts[j][x:y] for x, y in zip([0, *end], [*begin, None], strict=True)])
    return pd.Series(out, dtype=object)


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, how: Similarity = HOW, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The passages to remove: id, start, stop (characters of the text), n_words, first_doc_id (where it stays).

    Every run of least_words or more that a document with a smaller id has too goes,
    without case (A-Z), wherever it starts and ends and over line ends; a phrase over
    and over is such a run too. Paragraphs are lines of least_words or more, and
    shorter lines in a row that have as many together (see _first_lines); those whose
    word shingles are similar (0.75 or more, directly or in a chain) form a component,
    and the document of the smallest id in it keeps its own. Repeats within one
    document, and between rows that share an id, stay. Null, empty and short texts have no passages. Rows repeated in
    full give equal rows; null ids come last. Other columns are not used, whatever
    their names; an empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    found = _passages(_keyed_docs(docs, id_col, text_col), least_words, how, scratch)
    return found.select(F.col("id").alias(id_col), "start", "stop", F.col("words").alias("n_words"), F.col("first").alias("first_doc_id")).distinct()


def drop_repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, how: Similarity = HOW, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs with the passages of repeated_passages cut out of the texts; rows and other columns stay as they are."""
    scratch = scratch or Scratch(docs.sparkSession)
    spans = _spans(_keyed_docs(docs, id_col, text_col), least_words, how, scratch)
    key, made = unused(docs, "k"), unused(docs, "spans")
    # the texts are cut where they meet their spans, so they are shuffled once
    joined = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), text_col)).join(spans.toDF(key, made), key, "left")
    left = F.pandas_udf(_left, "string")(F.when(F.col(made).isNotNull(), F.col(text_col)), f"{made}.start", f"{made}.stop")
    return joined.select(*[F.coalesce(left, text_col).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
