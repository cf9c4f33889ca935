"""Exact repeats of 400 bytes: suffixes sorted by the difference-cover algorithm and compared with their neighbours, dealt out by content anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.anchored import Strings, repeated_strings
from flowloom.llm.common import Scratch
from flowloom.llm.sketch import loads

LENGTH, GRAM = 400, 64


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The sorted suffixes of s (integers of 1 and more) by the difference cover {1, 2} modulo 3.

    Triples at the sampled positions are sorted and named; if names repeat, the
    string of names is sorted by recursion; the remaining suffixes are sorted by
    their first symbol and the rank of the sampled suffix behind it and merged in.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    bits = int(t.max()).bit_length()
    assert 3 * bits < 64, "three symbols fit one number: texts are sorted in batches"
    triple = (t[sample] << 2 * bits) | (t[sample + 1] << bits) | t[sample + 2]
    order = np.argsort(triple)
    triple = triple[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.concatenate([[True], triple[1:] != triple[:-1]]))
    if names[order[-1]] < len(sample):
        order = suffix_array(names)
    by = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[by] = np.arange(1, len(by) + 1)
    by = by[by < n]
    wide = (len(sample) + 1).bit_length()
    rest = np.arange(0, n, 3)
    key = (t[rest] << wide) | rank[rest + 1]
    turn = np.argsort(key)
    rest, key = rest[turn], key[turn]
    # the place of a remaining suffix: how many sampled ones of either kind come before it
    ones, twos = by[by % 3 == 1], by[by % 3 == 2]
    before = np.searchsorted((t[ones] << wide) | rank[ones + 1], key)
    pair = lambda i: (((t[i] << bits) | t[i + 1]) << wide) | rank[i + 2]
    assert 2 * bits + wide < 64, "texts are sorted in batches"
    before += np.searchsorted(pair(twos), pair(rest))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = by
    return out


def common_prefix(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes of s from each place of a equal those from the place of b beside it."""
    eight = loads(s)
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    for at in [length - 8, *range(0, length - 8, 8)]:
        equal = eight[a[left] + at] == eight[b[left] + at]
        same[left[~equal]] = False
        left = left[equal]
    return same


def equal_neighbours(s: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes of s from each place in order equal those from the place before it in order.

    Where the strings one byte earlier are neighbours too and equal, only the last
    byte is left to compare; all others are compared throughout.
    """
    before = np.full(len(s) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    a = np.flatnonzero(before >= 0)
    b = before[a]
    chained = np.concatenate(([False], (np.diff(a) == 1) & (np.diff(b) == 1)))
    same = np.zeros(len(a), bool)
    head = np.flatnonzero(~chained)
    same[head] = common_prefix(s, a[head], b[head], length)
    broken = np.cumsum(chained & (s[a + length - 1] != s[b + length - 1]))
    of = head[np.cumsum(~chained) - 1] if len(a) else head
    broken = broken - broken[of]
    same |= same[of] & (broken == 0)
    # behind the first difference the strings hold it for a while, and may be equal again
    open_ = np.flatnonzero(chained & ~same)
    same[open_] = common_prefix(s, a[open_], b[open_], length)
    out = np.zeros(len(s) + 1, bool)
    out[a] = same
    return out[order]


def sorted_strings(contexts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, place, class) of all strings of `length` bytes: those whose bytes are equal are of one class.

    One suffix array is built over all contexts, each closed by a symbol of its own.
    Equal strings stand together in it; each is compared with its neighbour by bytes.
    """
    sizes = np.array([len(c) + 1 for c in contexts])
    joined = np.concatenate([np.append(c, np.uint8(0)) for c in contexts])
    owner = np.repeat(np.arange(len(contexts)), sizes)
    ends = np.cumsum(sizes)
    symbols = joined.astype(np.int64) + 1
    symbols[ends - 1] = 257 + np.arange(len(contexts))
    order = suffix_array(symbols)
    order = order[order + length < ends[owner[order]]]
    kind = np.cumsum(~equal_neighbours(joined, order, length)) if len(order) else order
    return owner[order], order - (ends - sizes)[owner[order]], kind


def _bytes(texts: list[str | None]) -> list[np.ndarray]:
    return [np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8) for t in texts]


WHAT = Strings(length=LENGTH, gram=GRAM, across=False, symbols=_bytes, classes=sorted_strings, ranges=12)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, what: Strings = WHAT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and repeated (whether anything goes) for every row.

    A byte is removed if a 400-byte string over it also starts anywhere else, in
    another document or the same. Null and empty texts have 0 bytes. Rows repeated
    in full are each other's repeats. Other columns are not used, whatever their
    names; an empty table gives an empty table.

    Every string is represented by an anchor that its content picks, so equal
    strings meet under one anchor (see anchored). The contexts of an anchor are one
    text whose suffixes are sorted by the difference-cover algorithm; neighbours
    are compared byte by byte.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    read = read.select("id", "text", F.xxhash64("id", "text").alias("k"))
    spans = repeated_strings(read.select("k", F.col("k").alias("owner"), "text"), what, scratch)
    gone = scratch.save(spans.groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for doc, text, spans in zip(x["id"].array, x["text"], x["spans"], strict=True):
                data = text.encode("utf-8", "replace")
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["stop"]) for s in spans) if spans is not None else ():
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in [*merged, [len(data), len(data)]]:
                    kept.update(data[at:a])
                    at = b
                out.append((doc, len(data), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), bool(merged)))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated"])

    joined = read.join(gone, "k", "left").select("id", "text", "spans")
    return joined.mapInPandas(remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean").withColumnRenamed("id", id_col)
