import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from flowloom.llm import anchored
from flowloom.llm.suffix_dedup import WHAT, repeats, suffix_array


def brute(texts):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for (doc, _), d in zip(texts, data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((doc, len(d), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return Counter(out)


def test_suffix_array():
    r = random.Random(1)
    for n in [*range(1, 12), 50, 300]:
        for size in (1, 2, 5, 300):
            s = [r.randint(1, size) for _ in range(n)]
            assert suffix_array(np.array(s)).tolist() == sorted(range(n), key=lambda i: s[i:])


def texts():
    r = random.Random(2)
    noise = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    shared, long_ = noise(900), noise(420)
    out = [(1, noise(500) + shared + noise(100)), (2, shared), (3, noise(30) + shared[200:800] + noise(50) + shared[100:550]), (4, noise(2000)),
           (5, "x" * 1000), (6, "xy" * 300), (7, "xy" * 199), (8, None), (9, ""), (10, "é" * 250), (11, noise(399)), (None, shared[5:]), (12, noise(800)), (13, "ab" + noise(3) * 150)]
    out += [out[12], (14, out[12][1]), (15, shared[:399]), (16, shared[:400] + "z"), (17, long_ + "q" + long_)]
    out += [(100 + i, noise(10 + i) + long_ + noise(40)) for i in range(30)]
    return out


def run(spark, rows, what=WHAT):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, k int, pos int").repartition(4)
    return Counter(tuple(r)[:5] for r in repeats(df, what=what).collect())


def test_against_brute_force(spark):
    rows = texts()
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("held", [1, 3])
def test_groups_dealt_again(spark, held):
    rows = texts()
    assert run(spark, rows, replace(WHAT, held=held)) == brute(rows)


def test_no_rows(spark):
    assert not run(spark, [])


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_long_text_in_parts(monkeypatch):
    r = random.Random(3)
    raw = np.array([r.randrange(256) for _ in range(20_000)], np.uint8)
    whole = anchored.anchor_places([raw], WHAT)
    assert len(whole[1]) < 300 and np.diff(whole[1]).max() <= 400 - 64 + 1
    monkeypatch.setattr(anchored, "CHUNK", 3000)
    parts = anchored.anchor_places([raw[:100], raw], WHAT)
    assert parts[0].tolist() == [1] * len(whole[1]) and all((a == b).all() for a, b in zip(whole[1:], parts[1:]))


def test_strings_that_polynomials_confuse(spark):
    """Blocks in Thue-Morse order cancel out in any polynomial modulo a power of two; the bytes are compared here."""
    order = [bin(i).count("1") % 2 for i in range(128)]
    one, other = ("".join((a, b)[i] for i in order) + "-" * 16 for a, b in (("UTI", "Vts"), ("Vts", "UTI")))
    rows = [(1, one), (2, other), (3, one[:-1])]
    assert run(spark, rows) == brute(rows) and all(r[2] == 0 for r in run(spark, rows))


def test_contexts_are_narrowed_before_they_are_compared():
    """What no other context of the group can share is not sorted: the rest of two contexts, and the whole of a third."""
    r = random.Random(5)
    noise = lambda n: bytes(r.randrange(256) for _ in range(n))
    gram, left, right = noise(64), noise(336), noise(100)
    data = [left + gram + right + noise(236), noise(36) + left[36:] + gram + right + noise(236), noise(336) + gram + noise(336)]
    items = pd.DataFrame({"grp": 1, "c1": range(3), "c2": 0, "copies": 1, "lo": range(3), "hi": range(3), "lo_o": 0, "hi_o": 336, "off": 336, "data": data})
    sizes = []

    def classes(contexts, length):
        sizes.extend(len(c) for c in contexts)
        return WHAT.classes(contexts, length)

    found = anchored.repeated_in(items, replace(WHAT, classes=classes))
    assert found.values.tolist() == anchored.repeated_in(items, replace(WHAT, ranges=0)).values.tolist()
    assert found[["c1", "a", "b"]].values.tolist() == [[0, -300, 164], [1, -300, 164]]
    assert len(sizes) == 2 and all(464 <= n <= 464 + 2 * 29 for n in sizes)
    alone = anchored.repeated_in(items.iloc[2:], WHAT)
    assert not len(alone) and len(anchored.repeated_in(items.iloc[2:].assign(copies=2), WHAT)) == 1
