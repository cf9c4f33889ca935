"""Benchmark decontamination: CGK random-walk embeddings, bit-sampling LSH and exact edit distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import unused
from flowloom.llm.sketch import U, mix, pieces_of, placed_hashes, prefix_hashes, shingle_hashes

#: Words of the grams that choose windows: an item uses the longest of which an occurrence with all its edits still holds one.
GRAMS = (3, 2, 1)
#: CGK places are sampled from the steps in which nearly all walks are still inside the window (a walk moves on in half of its steps).
STEPS = 1.75
BLOCK = 20_000
#: Bytes of texts that are hashed and looked up together: their arrays fit a processor's cache.
GROUP = 1 << 16
#: Gram hashes by their low bits: most grams of a text are none of the items', and one look tells.
LOW = (1 << 20) - 1


@dataclass(frozen=True)
class Match:
    """An item of n words is found where a text holds it with at most floor(edits * n) word insertions, deletions and changes.

    Items under least_words are too short to identify and not looked for. Each of
    `walks` embeddings is compared in `bits` sampled places; a window that agrees
    with the item in all places of some embedding is verified.
    """

    edits: float = 0.2
    least_words: int = 5
    walks: int = 64
    bits: int = 2


@dataclass
class _Item:
    item_id: int
    words: np.ndarray
    most: int
    gram: int
    enough: int
    keys: np.ndarray = field(default=None)  # type: ignore[assignment]


def word_sequence(text: str | None) -> np.ndarray:
    """Hashes of a text's words in order: runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case."""
    return np.concatenate([np.empty(0, U), *(prefix_hashes(x, ())[0] for x in pieces_of(text))])


def word_sequences(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of word_sequence for texts in a row, and where each text's end: in groups of about GROUP bytes, hashed at once."""
    group: list[bytes] = []
    held = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        words, starts = placed_hashes(b"\n".join(group))
        ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in group]))
        group.clear()
        return words, ends

    for text in texts:
        data = text.encode("utf-8", "replace") if text else b""
        if group and held + len(data) > GROUP:
            yield flush()
            held = 0
        if len(data) > GROUP:
            words = word_sequence(text)
            yield words, np.array([len(words)])
        else:
            group.append(data)
            held += len(data) + 1
    if group:
        yield flush()


def cgk_keys(windows: np.ndarray, how: Match) -> np.ndarray:
    """windows (w, n) of word hashes to (w, walks) hash keys.

    Chakraborty, Goldenberg and Koucky's embedding: a pointer walks over the window
    and in each step writes the word under it and moves on if a random bit of step
    and word says so; edits become few changed places. Each walk's key hashes `bits`
    places sampled from the first STEPS * n steps, for behind these many walks have
    left the window and agree with any other.
    """
    w, n = windows.shape
    walk = mix(np.arange(1, how.walks + 1, dtype=U))
    steps = max(1, int(STEPS * n))
    chosen = np.random.default_rng(n).integers(0, steps, (how.walks, how.bits))
    # a walk ends at its last sampled step, so walks stand in the order in which they end, the longest first
    last = chosen.max(1)
    order = np.argsort(-last, kind="stable")
    going = np.searchsorted(-last[order], -np.arange(steps), side="right")
    walk, chosen = walk[order], chosen[order]
    words = np.concatenate([windows, np.zeros((w, steps), U)], axis=1)
    at = np.repeat(np.arange(w)[:, None] * words.shape[1], how.walks, axis=1)
    words = words.ravel()
    key = np.broadcast_to(walk, at.shape).copy()
    for step in range(int(last.max()) + 1):
        at = at[:, : going[step]]
        word = words[at]
        taken = np.flatnonzero((chosen[: going[step]] == step).any(1))
        if len(taken):
            key[:, taken] = mix(key[:, taken] ^ mix(word[:, taken] + U(step)))
        at = at + (mix(word ^ mix(walk[: going[step]] + U(step))) & U(1)).view(np.int64)
    out = np.empty_like(key)
    out[:, order] = key
    return out


def least_edits_each(item: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fewest word edits between item and any run of each row of texts, which holds so many words as its size says."""
    words = np.arange(texts.shape[1]) < sizes[:, None]
    step = np.arange(texts.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(texts), texts.shape[1] + 1), np.int32)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        # what stands behind a text's words is equal to nothing, so runs into it need no fewer edits
        new[:, 1:] = np.minimum(row[:, :-1] + ((texts != word) | ~words), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row.min(1)


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The fewest word edits between item and any run of text, and where the first best run ends."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    return int(row.min()), int(row.argmin())


class _Grams:
    """The grams of the items that use grams of q words."""

    def __init__(self, items: list[_Item], q: int):
        self.q = q
        each = [shingle_hashes(x.words, q) if x.gram == q else np.empty(0, U) for x in items]
        of = np.repeat(np.arange(len(each)), [len(x) for x in each])
        offset = np.concatenate([np.arange(len(x)) for x in each])
        gram = np.concatenate(each)
        order = np.argsort(gram, kind="stable")
        self.of, self.offset = of[order], offset[order]
        self.names, self.first = np.unique(gram[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(gram)))
        self.low = np.zeros(LOW + 1, bool)
        self.low[self.names & U(LOW)] = True

    def met(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place of the gram, diagonal) of each gram that words and an item share."""
        none = np.empty(0, np.int64)
        if len(words) < self.q:
            return none, none, none
        grams = shingle_hashes(words, self.q)
        place = np.flatnonzero(self.low[(grams & U(LOW)).view(np.int64)])
        at = np.minimum(np.searchsorted(self.names, grams[place]), len(self.names) - 1)
        same = self.names[at] == grams[place]
        place, at = place[same], at[same]
        if not len(place):
            return none, none, none
        times = self.count[at]
        entry = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        place = np.repeat(place, times)
        return self.of[entry], place, place - self.offset[entry]


class Index:
    """The items with their grams and embedding keys."""

    def __init__(self, items: list[tuple[int, str | None]], how: Match):
        self.how, self.items = how, []
        for item_id, text in items:
            words = word_sequence(text)
            n, most = len(words), int(how.edits * len(words))
            if item_id is not None and n >= how.least_words:
                # q-gram lemma: an occurrence shares this many of the item's grams of q words
                shared = lambda q: n - q + 1 - q * most  # noqa: B023, E731
                q = next((q for q in GRAMS if shared(q) > 0), 1)
                self.items.append(_Item(item_id, words, most, q, max(1, shared(q)), cgk_keys(words[None, :], how)[0]))
        self.enough = np.array([x.enough for x in self.items], np.int64)
        self.grams = [_Grams(self.items, q) for q in sorted({x.gram for x in self.items}, reverse=True)]

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, edits, first word of the best place) of the items in a text."""
        return self.find_all([text])[0]

    def find_all(self, texts: Iterable[str | None]) -> list[list[tuple[int, int, int]]]:
        """find for each of the texts; words and grams are looked up for many texts at once."""
        return [hits for words, ends in word_sequences(texts) for hits in self._found(words, ends)]

    def _found(self, words: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """The items in texts whose words stand in a row, the words of each up to one of ends."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in ends]
        begins = np.concatenate(([0], ends[:-1]))
        for grams in self.grams:
            item, place, diagonal = grams.met(words)
            doc = np.searchsorted(ends, place, side="right")
            within = place + grams.q <= ends[doc]
            item, doc, diagonal = item[within], doc[within], diagonal[within] - begins[doc[within]]
            key = doc * len(self.items) + item
            by = np.argsort(key, kind="stable")
            diagonal = diagonal[by]
            pair, first, held = np.unique(key[by], return_index=True, return_counts=True)
            for j in np.flatnonzero(held >= self.enough[pair % len(self.items)]).tolist():
                d, i = divmod(int(pair[j]), len(self.items))
                best = self._best(self.items[i], np.sort(diagonal[first[j] : first[j] + held[j]]), words[begins[d] : ends[d]])
                if best:
                    out[d].append((i, *best))
        return [[(self.items[i].item_id, *best) for i, *best in sorted(hits)] for hits in out]

    def _best(self, it: _Item, starts: np.ndarray, words: np.ndarray) -> tuple[int, int] | None:
        """(edits, first word) of the best place of an item among the diagonals of the grams that it shares with a text's words."""
        # runs of diagonals within the edits of each other that hold enough triples
        ahead = np.searchsorted(starts, starts + 2 * it.most, side="right") - np.arange(len(starts))
        best = None
        windows = np.unique(np.maximum(np.minimum(starts[ahead >= it.enough], len(words) - 1), 0))
        if not len(windows):
            return None
        windows = np.unique(np.concatenate([windows + k for k in range(0, 2 * it.most + 1)]))
        windows = np.minimum(windows, max(len(words) - len(it.words), 0))
        windows = np.unique(windows)
        n = len(it.words)
        padded = np.concatenate([words, np.zeros(n + 2 * it.most, U)])
        for part in np.array_split(windows, -(-len(windows) // 256)):
            keys = cgk_keys(padded[part[:, None] + np.arange(n)], self.how)
            near = part[(keys == it.keys).any(1)]
            if len(near):
                lo = np.maximum(near - it.most, 0)
                each = least_edits_each(it.words, padded[lo[:, None] + np.arange(n + 2 * it.most)], np.minimum(near + n + it.most, len(words)) - lo)
                least = int(each.argmin())
                if each[least] <= it.most and (best is None or each[least] < best[0]):
                    best = (int(each[least]), int(near[least]))
            if best and best[0] == 0:
                break
        return best


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Match = Match(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, edits, start_word): a row for each document and benchmark item found in its text, with its best place.

    Words are compared without case and punctuation, whole texts are searched.
    Windows of an item's length that share too few of its word grams to be within
    the edits (q-gram lemma, exact) are not embedded; the others are embedded,
    hashed and verified by exact edit distance. Null and empty texts and items hold
    nothing; rows with a null id are searched too, repeated rows give repeated
    rows; other columns are not used, empty tables give an empty table.

    The items go to the tasks in blocks of BLOCK at most, one pass over the
    documents for each block, so what is sent is bounded however many items there are.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, edits int, start_word int"
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def searched(items: list[tuple[int, str | None]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(sent.value, how)
            for x in batches:
                rows = [(d, *hit) for d, hits in zip(x["id"].array, index.find_all(x["text"]), strict=True) for hit in hits]
                yield pd.DataFrame(rows, columns=[id_col, "item_id", "edits", "start_word"])

        return read.mapInPandas(work, schema)

    out, block = None, []
    for r in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == BLOCK:
            part = searched(block)
            out, block = part if out is None else out.unionByName(part), []
    if block or out is None:
        part = searched(block)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, how: Match = Match(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows in whose text a benchmark item is found; all columns as they are. Rows without id stay or go by their own text."""
    sent = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").where("item_id is not null").limit(BLOCK + 1).toLocalIterator()])
    if len(sent.value) > BLOCK:
        name = unused(docs, "gone")
        gone = contaminated(docs, benchmark, how, id_col, text_col).select(F.col(id_col).alias(name)).distinct()
        return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")
    made: list[Index] = []

    @F.pandas_udf("boolean")
    def found(text: pd.Series) -> pd.Series:
        if not made:
            made.append(Index(sent.value, how))
        return pd.Series([bool(hits) for hits in made[0].find_all(text)], dtype=bool)

    return docs.where(~found(F.col(text_col)))
