"""Strings of symbols that occur more than once in a corpus, found under anchors that their content picks.

Every string of `length` symbols picks one gram in itself by its content alone, so equal
strings meet under equal anchors. An anchor's context is what holds all strings around it.
Anchors seen once are dropped; the different contexts of the others meet in groups whose
size is bounded: a group that is too large is dealt out again by longer common cores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch, fields, gives_back, with_keys
from flowloom.llm.sketch import U, loads, run_hashes

#: Symbols that are looked at together (their hashes fit a processor's cache), and those of the contexts that one call compares.
CHUNK, BATCH = 1 << 16, 40_000
#: A group that is too large is dealt into so many parts at each step: rows times steps are fewest at three.
PARTS = 3


def digest(data: bytes, off: int) -> bytes:
    """128 bits that stand for a context and where its anchor is in it; a cryptographic hash, so equal ones mean equal contexts."""
    return hashlib.blake2b(data, digest_size=16, person=off.to_bytes(8, "little")).digest()


@dataclass(frozen=True)
class Strings:
    """Which strings: `length` symbols with anchors of `gram` symbols; across: only what two owners have counts as repeated.

    symbols: texts to arrays of bytes (uint8) or numbers (uint64). classes: contexts to
    (context, place, class) of all strings in them; strings are equal if their classes are.
    held: contexts in a group that one task compares, about 3 MB of text for strings of 400 bytes. digest: 128 bits
    that stand for a context and the anchor's place in it; a plain hash serves where symbols are hashes themselves.
    ranges: of places around the anchor by which contexts are narrowed before they are compared (0: not at all, where comparing costs little).
    """

    length: int
    gram: int
    across: bool
    symbols: Callable[[list[str | None]], list[np.ndarray]]
    classes: Callable[[list[np.ndarray], int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    held: int = 4000
    digest: Callable[[bytes, int], bytes] = digest
    ranges: int = 0

    @property
    def reach(self) -> int:
        return self.length - self.gram

    @property
    def twice(self) -> str:
        return "lo < hi" if self.across else "copies > 1"


def _gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    return run_hashes(loads(x)[: max(len(x) - 7, 0)], gram // 8, 8) if x.dtype == np.uint8 else run_hashes(x, gram)


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours: the suffix minimum of one block and the prefix minimum of the next."""
    padded = np.concatenate([key, np.full(-len(key) % w, np.iinfo(key.dtype).max, key.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(key) - w + 1], ahead[w - 1 : len(key)])


def _pieces(texts: list[np.ndarray], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(text, start, symbols) in lists of about CHUNK symbols; long texts in pieces that overlap by all but one symbol of a string."""
    out, size = [], 0
    for i, x in enumerate(texts):
        for start in range(0, len(x) - length + 1, CHUNK):
            piece = x[start : start + CHUNK + length - 1]
            if out and size + len(piece) > CHUNK:
                yield out
                out, size = [], 0
            out.append((i, start, piece))
            size += len(piece)
    if out:
        yield out


def anchor_places(texts: list[np.ndarray], what: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the grams that stand for the strings around them, in order.

    Each string picks its gram of least hash, the leftmost of equals.
    """
    found = []
    low = U((1 << 18) - 1)
    for group in _pieces(texts, what.length):
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        joined = np.concatenate([p for _, _, p in group])
        h = _gram_hashes(joined, what.gram)
        best = _least((h & ~low) | np.arange(len(h), dtype=U), what.reach + 1) & low
        owner = np.repeat(np.arange(len(group)), sizes)
        fits = np.arange(len(best)) + what.length <= ends[owner[: len(best)]]
        at = np.unique(best[fits].astype(np.int64))
        owner = owner[at]
        shift = np.array([s for _, s, _ in group]) - (ends - sizes)
        found.append((np.array([i for i, _, _ in group])[owner], at + shift[owner], h[at].view(np.int64)))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    text, place, h = (np.concatenate(x) for x in zip(*found, strict=True))
    _, once = np.unique(text << 40 | place, return_index=True)
    return text[once], place[once], h[once]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _seen(docs: DataFrame, what: Strings) -> DataFrame:
    """(k, owner, pos, anchor, c1, c2, off, size) of every anchor: its place and hash, its context's digest, its place in it and the context's size."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for start in range(0, len(x), 256):
                part = x.iloc[start : start + 256]
                texts = what.symbols(part["text"].tolist())
                text, pos, anchor = anchor_places(texts, what)
                if not len(text):
                    continue
                off = np.minimum(pos, what.reach)
                stop = np.minimum(pos + what.length, np.array([len(t) for t in texts])[text])
                raw = [t.tobytes() for t in texts]
                wide = texts[0].itemsize
                c1, c2 = _halves([what.digest(raw[t][(p - o) * wide : s * wide], o) for t, p, o, s in zip(text.tolist(), pos.tolist(), off.tolist(), stop.tolist(), strict=True)])
                yield pd.DataFrame({
                    "k": part["k"].to_numpy(np.int64)[text], "owner": part["owner"].to_numpy(np.int64)[text], "pos": pos, "anchor": anchor,
                    "c1": c1, "c2": c2, "off": off, "size": stop - pos + off,
                })

    return docs.select("k", "owner", "text").mapInPandas(work, "k long, owner long, pos int, anchor long, c1 long, c2 long, off int, size int")


_ITEM = "grp long, c1 long, c2 long, copies long, lo long, hi long, held long, lo_o int, hi_o int, off int, data binary"


def _contexts(docs: DataFrame, kinds: DataFrame, what: Strings) -> DataFrame:
    """The kinds (anchor, c1, c2, copies, lo, hi, held, k, pos, off, size) with their symbols, as items of groups by anchor."""

    @gives_back
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for start in range(0, len(x), 256):
                part = x.iloc[start : start + 256]
                each = {c: np.concatenate(part[c].tolist()) for c in names}
                wide = np.dtype(_kind(what)).itemsize
                raw = [t.tobytes() for t in what.symbols(part["text"].tolist())]
                begin = (each["pos"].astype(np.int64) - each["off"]) * wide
                end = begin + each["size"].astype(np.int64) * wide
                of = np.repeat(np.arange(len(part)), [len(p) for p in part["pos"]])
                yield pd.DataFrame({
                    "grp": each["anchor"], **{c: each[c] for c in ("c1", "c2", "copies", "lo", "hi", "held")}, "lo_o": 0, "hi_o": what.reach, "off": each["off"],
                    "data": [raw[t][a:b] for t, a, b in zip(of.tolist(), begin.tolist(), end.tolist(), strict=True)],
                })

    names = ("anchor", "c1", "c2", "copies", "lo", "hi", "held", "pos", "off", "size")
    wanted = kinds.groupBy("k").agg(F.collect_list(F.struct(*names)).alias("wanted"))
    return docs.select("k", "text").join(wanted, "k").select("text", *fields("wanted", *names)).mapInPandas(cut, _ITEM)


def _narrowed(items: pd.DataFrame, what: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, begin, end) with the symbols of the items' data that can hold a repeated string; items without any are left out.

    The strings of a range of places around the anchor all hold the same core (see
    _dealt_again). Where no other context of the group has that core, none of them
    repeats. Contexts that are repeated themselves stay whole.
    """
    wide = np.dtype(_kind(what)).itemsize
    size = items["data"].str.len().to_numpy() // wide
    off = items["off"].to_numpy(np.int64)
    twice = items["lo"].to_numpy() < items["hi"].to_numpy() if what.across else items["copies"].to_numpy() > 1
    begin, end = np.where(twice, 0, size), np.where(twice, size, 0)
    _, group = np.unique(items["grp"].to_numpy(), return_inverse=True)
    data = items["data"].tolist()
    step = -(-(what.reach + 1) // what.ranges)
    for a in range(0, what.reach + 1, step):
        b = min(a + step - 1, what.reach)
        has = np.flatnonzero((off >= a) & (off + what.length - size <= b))
        if not len(has):
            continue
        low, high = (off[has] - a) * wide, (off[has] - b + what.length) * wide
        seeds = group[has].tolist()
        core = np.array([xxhash.xxh3_64_intdigest(data[i][x:y], g) for i, x, y, g in zip(has.tolist(), low.tolist(), high.tolist(), seeds, strict=True)], np.uint64)
        _, kind, often = np.unique(core, return_inverse=True, return_counts=True)
        has = has[often[kind] > 1]
        begin[has] = np.minimum(begin[has], np.maximum(off[has] - b, 0))
        end[has] = np.maximum(end[has], np.minimum(off[has] - a + what.length, size[has]))
    item = np.flatnonzero(begin < end)
    return item, begin[item], end[item]


def repeated_in(items: pd.DataFrame, what: Strings) -> pd.DataFrame:
    """For items (grp, c1, c2, copies, lo, hi, lo_o, hi_o, off, data) of whole groups, the repeated strings as (grp, c1, c2, a, b, first) relative to the anchor.

    A string repeats if it stands at the same place around the anchor in other contexts of the group, or if its context has copies.
    """
    kind = _kind(what)
    raw = [np.frombuffer(d, kind) for d in items["data"]]
    if what.ranges:
        some, begin, end = _narrowed(items, what)
        raw = [raw[i][a:b] for i, a, b in zip(some.tolist(), begin.tolist(), end.tolist(), strict=True)]
    if raw:
        item, start, cls = what.classes(raw, what.length)
    else:
        item, start, cls = (np.empty(0, np.int64),) * 3
    if what.ranges:
        item, start = some[item], start + begin[item]
    col = lambda c: items[c].to_numpy(np.int64)
    o = col("off")[item] - start
    twice = col("lo") < col("hi") if what.across else col("copies") > 1
    _, cls, often = np.unique(cls, return_inverse=True, return_counts=True)
    ok = (o >= col("lo_o")[item]) & (o <= col("hi_o")[item]) & ((often[cls] > 1) | twice[item])
    item, start, cls, o = item[ok], start[ok], cls[ok], o[ok]
    if not len(item):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("grp", "c1", "c2", "a", "b", "first")})
    _, group = np.unique(col("grp"), return_inverse=True)
    # a group, a class and a place around the anchor as one number
    key = (group[item] * len(often) + cls) * (what.reach + 1) + o
    by = np.argsort(key)
    item, start, key = item[by], start[by], key[by]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    number, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    lo, hi = np.minimum.reduceat(col("lo")[item], heads), np.maximum.reduceat(col("hi")[item], heads)
    hit = (lo < hi if what.across else np.add.reduceat(col("copies")[item], heads) > 1)[number]
    first = lo[number] if what.across else np.zeros(len(item), np.int64)
    item, start, first = item[hit], start[hit], first[hit]
    by = np.lexsort((start, item))
    item, start, first = item[by], start[by], first[by]
    opens = np.concatenate(([True], (item[1:] != item[:-1]) | (np.diff(start) > (1 if what.across else what.length)) | (first[1:] != first[:-1]))) if len(item) else np.empty(0, bool)
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(item)) - 1 if len(begin) else begin
    of = item[begin]
    off = col("off")[of]
    return pd.DataFrame({"grp": col("grp")[of], "c1": col("c1")[of], "c2": col("c2")[of], "a": start[begin] - off, "b": start[end] + what.length - off, "first": first[begin]})


def _kind(what: Strings) -> type:
    return what.symbols([""])[0].dtype.type


def _compared(items: DataFrame, what: Strings) -> DataFrame:
    """items, a group in one partition, to the repeated strings (grp, c1, c2, a, b, first)."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = np.dtype(_kind(what)).itemsize
        held: list[pd.DataFrame] = []
        size = 0
        for x in batches:
            group = x["grp"].to_numpy()
            sums = np.cumsum(x["data"].str.len().to_numpy() // wide)
            # a group may go on in the next batch, so it is cut off only where the next one begins
            heads = np.flatnonzero(np.concatenate(([not held or held[-1]["grp"].iloc[-1] != group[0]], group[1:] != group[:-1])))
            at = 0
            for head in heads.tolist():
                before = int(sums[head - 1]) if head else 0
                if size + before - (int(sums[at - 1]) if at else 0) >= BATCH:
                    held.append(x.iloc[at:head])
                    yield repeated_in(pd.concat(held), what)
                    held, size, at = [], 0, head
            held.append(x.iloc[at:])
            size += int(sums[-1]) - (int(sums[at - 1]) if at else 0)
        if held:
            yield repeated_in(pd.concat(held), what)

    return items.repartition("grp").sortWithinPartitions("grp").mapInPandas(work, "grp long, c1 long, c2 long, a int, b int, first long")


def _dealt_again(items: DataFrame, what: Strings) -> DataFrame:
    """Items of groups that are too large, dealt out by where their strings stand around the anchor and by the core that such strings share.

    The places lo_o to hi_o fall into PARTS ranges. All strings of a range hold the
    symbols from its least to its greatest place on, so equal strings have equal
    cores; what all strings of the range hold together is the new item's data.
    """

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = np.dtype(_kind(what)).itemsize
        for x in batches:
            for at in range(0, len(x), 1000):
                out, digests = [], []
                for r in x.iloc[at : at + 1000].itertuples(index=False):
                    size, data, off = len(r.data) // wide, bytes(r.data), r.off
                    step = -(-(r.hi_o - r.lo_o + 1) // PARTS)
                    for a in range(r.lo_o, r.hi_o + 1, step):
                        b = min(a + step - 1, r.hi_o)
                        if off < a or off - b + what.length > size:
                            continue
                        core = data[(off - a) * wide : (off - b + what.length) * wide]
                        begin = max(off - b, 0)
                        slice_ = data[begin * wide : min(off - a + what.length, size) * wide]
                        digests.append(what.digest(slice_, off - begin))
                        grp = xxhash.xxh3_64_intdigest(core, seed=(r.grp ^ (a << 20) ^ b) & ((1 << 64) - 1)) - (1 << 63)
                        out.append((grp, r.copies, r.lo, r.hi, a, b, off - begin, slice_, r.grp, r.c1, r.c2))
                made = pd.DataFrame(out, columns=["grp", "copies", "lo", "hi", "lo_o", "hi_o", "off", "data", "up", "up1", "up2"])
                made["c1"], made["c2"] = _halves(digests)
                yield made

    return items.mapInPandas(work, "grp long, copies long, lo long, hi long, lo_o int, hi_o int, off int, data binary, up long, up1 long, up2 long, c1 long, c2 long")


def repeated_strings(docs: DataFrame, what: Strings, scratch: Scratch) -> DataFrame:
    """docs (k, owner, text) to (k, owner, spans) with an array of (start, stop, first): the stretches of symbols whose every string is repeated.

    A row is one anchor. first is the least owner of the strings (0 unless
    what.across). Stretches of one document overlap where anchors do, and may be repeated. Groups of at most
    what.held contexts are compared in a task; larger ones are dealt out again until
    a group holds contexts that agree throughout or is small: at the last step a
    group is one string, so this ends for any input.
    """
    stats = [F.sum("copies").alias("copies"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    counted = lambda df: df.withColumns({"copies": F.lit(1), "lo": F.col("owner"), "hi": F.col("owner")})
    seen = scratch.save(_seen(docs, what))
    # written, so that nothing is aggregated in the join's stage and Spark can split the partition of an anchor that is everywhere
    shared = scratch.save(counted(seen).groupBy("anchor").agg(*stats).where(what.twice).select("anchor"))
    live = scratch.save(with_keys(seen, shared, "anchor"))
    scratch.drop(seen, shared)
    kinds = scratch.save(counted(live).groupBy("anchor", "c1", "c2").agg(*stats, F.min(F.struct("k", "pos", "off", "size")).alias("one")))
    many = scratch.save(kinds.groupBy("anchor").agg(F.count("*").alias("held")).where("held > 1"))
    whole = kinds.join(many, "anchor", "left_anti").where(what.twice).where(F.col("one.size") >= what.length)
    first = F.col("lo") if what.across else F.lit(0).cast("long")
    found = [whole.select("anchor", "c1", "c2", (-F.col("one.off")).alias("a"), (F.col("one.size") - F.col("one.off")).alias("b"), first.alias("first"))]
    level = scratch.save(_contexts(docs, with_keys(kinds, many, "anchor").select("anchor", "c1", "c2", "copies", "lo", "hi", "held", "one.*"), what))
    up: DataFrame | None = None  # (grp, c1, c2) of the level to those of the first
    while True:
        small = scratch.save(_compared(level.where(F.col("held") <= what.held), what).distinct())
        found.append(_risen(small, up))
        large = level.where(F.col("held") > what.held)
        if large.isEmpty():
            break
        again = scratch.save(_dealt_again(large, what))
        scratch.drop(level)
        members = again.select("grp", "c1", "c2", "up", "up1", "up2").distinct()
        members = members.select("grp", "c1", "c2", F.col("up").alias("anchor"), F.col("up1").alias("t1"), F.col("up2").alias("t2")) if up is None else members.join(up.toDF("up", "up1", "up2", "anchor", "t1", "t2"), ["up", "up1", "up2"]).drop("up", "up1", "up2")
        up = scratch.save(members)
        parts = scratch.save(again.groupBy("grp", "c1", "c2").agg(*stats, *[F.any_value(c).alias(c) for c in ("lo_o", "hi_o", "off", "data")]))
        held = scratch.save(parts.groupBy("grp").agg(F.count("*").alias("held")))
        parts = parts.join(held, "grp")
        size = F.octet_length("data") / np.dtype(_kind(what)).itemsize
        alike = parts.where("held = 1").where(what.twice)
        found.append(_risen(alike.select("grp", "c1", "c2", (-F.col("off")).alias("a"), (size - F.col("off")).cast("int").alias("b"), first.alias("first")), up))
        level = scratch.save(parts.where("held > 1").select(*[c.split()[0] for c in _ITEM.split(", ")]))
        scratch.drop(again)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    # one row for each context, so that the join below makes no more rows than there are anchors
    every = scratch.save(every.groupBy("anchor", "c1", "c2").agg(F.collect_set(F.struct("a", "b", "first")).alias("found")))
    scratch.drop(kinds, many, level)
    spans = F.transform("found", lambda x: F.struct((F.col("pos") + x["a"]).alias("start"), (F.col("pos") + x["b"]).alias("stop"), x["first"].alias("first")))
    return with_keys(live, every, ["anchor", "c1", "c2"]).select("k", "owner", spans.alias("spans"))


def _risen(found: DataFrame, up: DataFrame | None) -> DataFrame:
    """(grp, c1, c2, a, b, first) of a level as that of the anchors' contexts."""
    if up is None:
        return found.withColumnRenamed("grp", "anchor")
    return found.join(up, ["grp", "c1", "c2"]).select("anchor", F.col("t1").alias("c1"), F.col("t2").alias("c2"), "a", "b", "first")
