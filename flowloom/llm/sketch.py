"""Word-shingle sets and their fast similarity sketches, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(256, dtype=U) + U(0x1F0D))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2**64, up to n at least."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            each = np.full(size, U(base), U)
            each[0] = 1
            _powers[name] = np.multiply.accumulate(each)
    return _powers["up"], _powers["down"]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
LONG_WORD = 64


def loads(raw: np.ndarray) -> np.ndarray:
    """For each place of raw (bytes) the eight bytes from there on as one number; behind the end stand zeros."""
    out = np.zeros(len(raw) + 8, np.uint8)
    out[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, "<u8", out, strides=(1,))


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data start, and their 64-bit hashes with A-Z taken as a-z.

    Eight bytes at a time go through the finaliser, so no two words cancel out as
    they can in a polynomial; words above LONG_WORD bytes go through xxh3.
    """
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True]))))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    low = _LOWER[raw]
    eight = loads(low)
    h = mix(size.astype(U) + U(_BASE))
    part, at = np.arange(len(starts)), 0
    while len(part):
        left = np.minimum(size[part] - at, 8)
        h[part] = mix(h[part] * U(_BASE) + (eight[starts[part] + at] & _KEEP[left]))
        at += 8
        part = part[(size[part] > at) & (size[part] <= LONG_WORD)]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(low[starts[i] : ends[i]].tobytes())
    return starts, h


def word_places(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the first character of each of its words (see word_hashes) and the one behind its last."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    group: list[bytes] = []

    def places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words start and end in bytes, and the characters that begin before each byte."""
        raw = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True]))))
        return edge[::2], edge[1::2], np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))

    def flush() -> None:
        starts, ends, chars = places(b"\n".join(group))
        stops = np.cumsum([len(x) + 1 for x in group])
        cuts = [0, *np.searchsorted(starts, stops).tolist()]
        for x, stop, a, b in zip(group, stops.tolist(), cuts, cuts[1:], strict=False):
            first = chars[stop - len(x) - 1]
            out.append((chars[starts[a:b]] - first, chars[ends[a:b]] - first))
        group.clear()

    held = 0
    for text in texts:
        data = text.encode("utf-8", "replace")
        if group and held + len(data) > PIECE:
            flush()
            held = 0
        if len(data) > PIECE:
            found, before = [], 0
            for piece in _pieces(data):
                starts, ends, chars = places(piece)
                found.append((chars[starts] + before, chars[ends] + before))
                before += chars[-1]
            out.append(tuple(np.concatenate(x) for x in zip(*found, strict=True)))
        else:
            group.append(data)
            held += len(data) + 1
    if group:
        flush()
    return out


def run_hashes(x: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of n numbers that stand `step` places apart in x.

    Runs of 1, 2, 4 and so on are hashed from their halves, and the run from those
    that make it up; the finaliser between them leaves no algebra to cancel out.
    """
    many = len(x) - (n - 1) * step
    if many <= 0:
        return np.empty(0, U)
    out, done, size, level = None, 0, 1, x
    while True:
        if n & size:
            part = level[done * step : done * step + many]
            out = mix(part) if out is None else mix(out * U(_BASE) + part)
            done += size
        if done == n:
            return out
        level = mix(level[: len(level) - size * step] * U(_BASE) + level[size * step :])
        size *= 2


def _pieces(data: bytes):
    """data in pieces of about PIECE bytes, cut at white space."""
    at = 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(s, at, at + PIECE) for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        if cut <= at:
            cut = min((x for x in (data.find(s, at + PIECE) for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if x > 0), default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


_BREAK = np.ones(256, bool)
_BREAK[[*b"0123456789", *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def pieces_of(text: str | None) -> list[bytes]:
    """The UTF-8 bytes of a text in pieces of about PIECE bytes, cut at white space."""
    return list(_pieces(text.encode("utf-8", "replace"))) if text else []


def _runs_of_letters(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_BREAK[raw], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    up, down = _power(len(raw))
    return edge[::2], edge[1::2], np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[raw] * up[: len(raw)]))), down


def placed_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of prefix_hashes, and where they start."""
    starts, ends, total, down = _runs_of_letters(data)
    return mix((total[ends] - total[starts]) * down[starts] + U(1)), starts


def prefix_hashes(data: bytes, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the words of data, and for each length those of the first bytes of longer words.

    Here words are runs of ASCII letters and digits and of non-ASCII characters.
    """
    starts, ends, total, down = _runs_of_letters(data)
    out = [mix((total[ends] - total[starts]) * down[starts] + U(1))]
    for n in lengths:
        at = starts[ends - starts > n]
        out.append(mix((total[at + n] - total[at]) * down[at] + U(n)))
    return out


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the hashes of its words, in order.

    Words are what stands between the ASCII white space 0x20 and 0x09 to 0x0D, with
    A-Z in lower case. Null and empty texts have none. Long texts go in pieces.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        starts, h = _hash_words(b"\n".join(group))
        ends = np.cumsum([len(x) + 1 for x in group])
        cuts = [0, *np.searchsorted(starts, ends).tolist()]
        out.extend(h[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        group.clear()

    held = 0
    for text in texts:
        data = text.encode("utf-8", "replace") if text else b""
        if group and held + len(data) > PIECE:
            flush()
            held = 0
        if len(data) > PIECE:
            out.append(np.concatenate([_hash_words(x)[1] for x in _pieces(data)]))
        else:
            group.append(data)
            held += len(data) + 1
    if group:
        flush()
    return out


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of `width` words in order, from the words' hashes; fewer words are one run."""
    n = len(h)
    if not n:
        return np.empty(0, U)
    k = min(n, width)
    out = np.full(n - k + 1, U(k), U)
    for i in range(k):
        out = mix(out * U(_BASE) + h[i : n - k + 1 + i])
    return out


def distinct_shingles(h: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of `width` words, from the words' hashes."""
    x = np.sort(shingle_hashes(h, width))
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words.

    A text with fewer words is one run, one without words has none.
    """
    return sets_of_words(word_hashes(texts), width)


def sets_of_words(words: list[np.ndarray], width: int) -> list[np.ndarray]:
    """distinct_shingles of each array, hashed in one pass over all of them."""
    sizes = np.array([len(h) for h in words], np.int64)
    many = np.maximum(sizes - width + 1, 0)
    ends = np.cumsum(many)
    if not many.sum():
        return [distinct_shingles(h, width) for h in words]
    # a run takes part if it ends in the array it starts in
    last = np.cumsum(sizes)
    starts = np.arange(last[-1] - width + 1)
    runs = shingle_hashes(np.concatenate(words), width)[starts + width <= np.repeat(last, sizes)[: len(starts)]]
    for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True):
        runs[a:b].sort()
    new = np.concatenate(([True], runs[1:] != runs[:-1]))
    new[(ends - many)[many > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    runs = runs[new]
    bounds = zip(kept[ends - many].tolist(), kept[ends].tolist(), strict=True)
    return [runs[a:b] if b > a else distinct_shingles(h, width) for h, (a, b) in zip(words, bounds, strict=True)]


def sketches(sets: list[np.ndarray], t: int, seed: int = 1) -> np.ndarray:
    """Fast similarity sketches (Dahlgaard, Knudsen and Thorup 2017) of t coordinates each.

    Round i < t throws every element into a hashed bin with a value in [i, i+1);
    round t + j throws all elements into bin j. A bin keeps its smallest value, so
    after at most 2t rounds every coordinate is filled, and two sets agree in a
    coordinate with probability equal to their Jaccard similarity. Rounds end for a
    set as soon as its bins are full. An empty set keeps the largest value throughout.
    """
    bits = t.bit_length() - 1
    assert t == 1 << bits and t <= 1024, "t is a power of two, and rounds up to 2t fit eleven bits"
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, U)
    if not sizes.sum():
        return out.reshape(-1, t)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    low, free = U((1 << 53) - 1), np.iinfo(np.uint64).max
    grid, rows = out.reshape(-1, t), np.flatnonzero(sizes)
    # a look at all bins costs more than a round, and rounds leave full bins as they are
    every = max(t // 128, 1)
    for i in range(2 * t):
        h = mix(element ^ mix(np.array([seed * 1_000_003 + i], U)))
        where = owner * t + ((h >> U(64 - bits)).astype(np.int64) if i < t else i - t)
        # values grow from round to round, so only bins that are free can change
        new = out[where] == free
        np.minimum.at(out, where[new], (U(i) << U(53)) | (h[new] & low))
        if (i + 1) % every:
            continue
        open_ = (grid[rows] == free).any(1)
        if not open_.any():
            break
        if not open_.all():
            rows = rows[open_]
            keep = np.zeros(len(sets), bool)
            keep[rows] = True
            keep = keep[owner]
            element, owner = element[keep], owner[keep]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` coordinates, distinct between bands."""
    n, t = sketch.shape
    bands = sketch[:, : t // rows * rows].reshape(n, t // rows, rows)
    key = np.broadcast_to(mix(np.arange(1, t // rows + 1, dtype=U)), bands.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key.view(np.int64)
