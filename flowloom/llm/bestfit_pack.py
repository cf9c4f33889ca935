"""Best-fit packing of tokenised documents by hierarchical residual packing."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch, gives_back

CAPACITY = 2048
GROUP = 100_000
#: Characters of texts whose parts are looked at together, and ids that are laid out at once.
GROUP_CHARS, LAID_OUT = 1 << 24, 1 << 17
#: ASCII and Latin-1 letters.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


def _laid_out(ids: np.ndarray, count: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The ids of the entries that index names, one after the other; entry e has count[e] of ids, in order."""
    first, out = np.cumsum(count) - count, [np.empty(0, ids.dtype)]
    for at in range(0, len(index), LAID_OUT):
        some = index[at : at + LAID_OUT]
        n = count[some]
        ends = np.cumsum(n)
        out.append(ids[np.arange(ends[-1]) + np.repeat(first[some] - (ends - n), n)])
    return np.concatenate(out)


class _Encoder:
    """The ids of texts, by their distinct parts between ASCII white space.

    No token of this tokenizer spans white space, and it ignores case, so parts are
    taken with A-Z in lower case. Points and commas behind a letter are tokens of
    their own, apart from the word. Nothing is kept from one group of texts to the
    next: what words a corpus has grows with it, and a worker's memory would.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        plain = pc.match_substring_regex(words, _PLAIN)
        at = [np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (plain, pc.invert(plain))]
        ids, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        letters, rest = (words.take(pa.array(x)).to_pylist() for x in at)
        for i in range(0, len(letters), 10_000):
            # one call for many words: a word of letters alone ends at the first token that ends a word
            some = letters[i : i + 10_000]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[found]) + 1
            assert len(ends) == len(some), "a word of letters is one word to the tokenizer"
            ids.append(found)
            counts.append(np.diff(ends, prepend=0))
        for i in range(0, len(rest), 10_000):
            each = [x.ids for x in self.tokenizer.encode_batch_fast(rest[i : i + 10_000], add_special_tokens=False)]
            ids.append(np.array([i for x in each for i in x], "<u4"))
            counts.append(np.array([len(x) for x in each], np.int64))
        # from letters and rest back to the order of words
        count, back = np.concatenate(counts), np.argsort(np.concatenate(at))
        return _laid_out(np.concatenate(ids), count, back), count[back]

    def _of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts, as _of_words: each is a word, and the points and commas behind its last letter."""
        word = pc.utf8_rtrim(parts, ".,")
        word = pc.if_else(pc.match_substring_regex(word, "[A-Za-z]$"), word, parts)
        n = pc.binary_length(parts)
        cut = np.flatnonzero(pc.not_equal(pc.binary_length(word), n).to_numpy(zero_copy_only=False))
        tails = [p[len(w) :] for p, w in zip(parts.take(pa.array(cut)).to_pylist(), word.take(pa.array(cut)).to_pylist(), strict=True)]
        both = pa.concat_arrays([word, pa.array([*tails, ""], pa.string())]).dictionary_encode()
        index = both.indices.to_numpy()
        tail = np.full(len(parts), index[-1])
        tail[cut] = index[len(parts) : -1]
        ids, count = self._of_words(both.dictionary)
        index = np.stack([index[: len(parts)], tail], 1)
        return _laid_out(ids, count, index.ravel()), count[index].sum(1)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = pa.array([x or "" for x in texts], pa.string())
        # special tokens are told from text by case
        parts = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_lower(whole)))
        distinct = parts.flatten().dictionary_encode()
        ids, count = self._of_parts(distinct.dictionary)
        index = distinct.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(count[index])))[np.cumsum(pc.list_value_length(parts).to_numpy())]
        data = _laid_out(ids, count, index).tobytes()
        return [data[a:b] for a, b in zip([0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist(), strict=True)]


_encoders: dict[str, _Encoder] = {}


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """For each text its ids as little-endian unsigned 32-bit numbers."""
    encoder = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
    out: list[bytes] = []
    group: list[str | None] = []
    held = 0
    for text in texts:
        if group and held + len(text or "") > GROUP_CHARS:
            out += encoder.encode(group)
            group, held = [], 0
        group.append(text)
        held += len(text or "")
    return out + encoder.encode(group) if group else out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): the ids of each text and a closing 0, cut only where longer than capacity."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for doc, ids in zip(x["id"].array, encode(x["text"].tolist(), tokenizer), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            out["id"] = pd.array(out["id"], "Int64")
            yield out

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInPandas(work, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: largest first, each into the fullest bin that it fits."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left
    open_ = 0  # bit r: a bin with r left
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            to = room[left].pop()
            if not room[left]:
                open_ &= ~(1 << left)
        else:
            left, to, made = capacity, made, made + 1
        bins[i], offsets[i] = to, capacity - left
        rest = left - size
        if rest:
            room[rest].append(to)
            open_ |= 1 << rest
    return bins, offsets


def _packed(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """items (item long, size long) to (item, size, bin, base): each partition packs its own, at most GROUP at a time."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        made = (level << 20) + TaskContext.get().partitionId() << 36
        held: list[pd.DataFrame] = []

        def pack() -> pd.DataFrame:
            nonlocal made
            x = pd.concat(held, ignore_index=True)
            held.clear()
            bins, base = best_fit(x["size"].to_numpy(), capacity)
            x["bin"], x["base"] = bins + made, base
            made += len(x)
            return x

        for x in batches:
            while len(x):
                room = GROUP - sum(map(len, held))
                held.append(x.iloc[:room])
                x = x.iloc[room:]
                if sum(map(len, held)) >= GROUP:
                    yield pack()
        if held:
            yield pack()

    return items.mapInPandas(work, "item long, size long, bin long, base long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """A row for each piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document, null and empty texts (one closing 0) and rows repeated or
    without id included, is tokenised whole; only those longer than capacity are
    cut. Pieces fill sequences without gaps from offset 0. Other columns are not
    used; an empty table gives an empty table.

    Partitions pack their own pieces by best fit, GROUP at a time. Bins filled to within a 256th of
    the capacity are done; the others become items of the next round, in which
    eight times fewer partitions pack them, so underfull bins meet ever more
    others. Rounds end at one partition, or when one saves less than one bin in a
    thousand. No task packs more than GROUP items at once, whatever the number of
    underfull bins; only bin numbers and sizes move between rounds.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    all_pieces = scratch.save(pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("item", F.monotonically_increasing_id()))
    items = all_pieces.select("item", F.col("length").alias("size"))
    groups = max(1, -(-items.count() // GROUP))
    items = items.coalesce(groups)  # merges partitions in place where they hold few pieces
    placed, level, done = None, 0, capacity - capacity // 256
    while True:
        step = scratch.save(_packed(items, capacity, level))
        placed = step.select("item", "bin", "base") if placed is None else _moved(placed, step)
        bins = step.groupBy("bin").agg(F.sum("size").alias("size"), F.count("*").alias("held"))
        bins = scratch.save(bins.where(F.col("size") < done))
        count, joined = bins.agg(F.count("*"), F.coalesce(F.sum(F.col("held") - 1), F.lit(0))).first()
        if groups == 1 or not count or level and joined < count / 1000:
            break
        level, groups = level + 1, max(-(-count // GROUP), groups // 8, 1)
        items = bins.select(F.col("bin").alias("item"), "size").repartition(groups, F.xxhash64("item", F.lit(level)))
    return all_pieces.join(placed, "item").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("base").alias("offset")
    )


def _moved(placed: DataFrame, step: DataFrame) -> DataFrame:
    """placed with the bins that step has put into others in their new places."""
    moves = step.select(F.col("item").alias("bin"), F.col("bin").alias("into"), F.col("base").alias("at"))
    return placed.join(moves, "bin", "left").select(
        "item", F.coalesce("into", "bin").alias("bin"), (F.col("base") + F.coalesce("at", F.lit(0))).alias("base")
    )
