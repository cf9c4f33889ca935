import random

import numpy as np

from flowloom.llm import decontaminate
from flowloom.llm.decontaminate import Index, Match, contaminated, drop_contaminated, least_edits, word_sequence


def brute(docs, items, how=Match()):
    out = set()
    for d, text in docs:
        for i, item in items:
            words = word_sequence(item)
            if len(words) >= how.least_words and len(word_sequence(text)) and least_edits(words, word_sequence(text))[0] <= int(how.edits * len(words)):
                out.add((d, i))
    return out


def slow_edits(a, b):
    best = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(best[j - 1] + (x != y), best[j] + 1, new[-1] + 1))
        best = new
    return min(best)


def test_edit_distance():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 9))] for _ in "ab")
        assert least_edits(np.array(a, np.uint64), np.array(b, np.uint64))[0] == slow_edits(a, b)


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        at = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[at] = f"new{r.randrange(999)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"new{r.randrange(999)}")
    return words


def test_recall_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(12, 60)))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "too short"), (None, items[0][1])]
    docs = []
    for d in range(400):
        host = [r.choice(vocabulary) for _ in range(r.randrange(0, 200))]
        if d % 2:
            item = items[d % 40][1].split()
            at = r.randrange(len(host) + 1)
            host[at:at] = edited(r, item, r.randrange(0, int(0.2 * len(item)) + 1))
        docs.append((d, " | ".join(host).upper() if d % 3 else ", ".join(host)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[4][1] * 2), (502, items[4][1] * 2)]
    expected = brute(docs, [x for x in items if x[0] is not None])
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contaminated(df, bench).collect()}
    assert got <= expected
    assert len(got) >= 0.97 * len(expected)
    kept = {x.doc_id for x in drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_short_items_with_one_change():
    r = random.Random(11)
    for n in (5, 6, 7, 9):
        found = 0
        for _ in range(200):
            words = [f"w{r.randrange(10**6)}" for _ in range(n)]
            index = Index([(1, " ".join(words))], Match())
            words[r.randrange(n)] = "other"
            found += bool(index.find(" ".join([f"x{r.randrange(99)}" for _ in range(20)] + words + ["y"] * 20)))
        assert found >= 0.95 * 200, (n, found)


def test_exact_occurrences_always_found():
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(20))) for i in range(20)]
    index = Index(items, Match())
    for i, text in items:
        assert (i, 0) in {x[:2] for x in index.find("w1 w2 " * 50 + text + " w3" * 9)}


def test_edit_distance_of_many_rows():
    r = random.Random(6)
    for _ in range(100):
        a = [r.randrange(4) for _ in range(r.randrange(1, 9))]
        rows = [[r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(7)]
        # behind a row's words stands what the item has too
        texts = np.array([x + [a[0]] * (12 - len(x)) for x in rows], np.uint64)
        got = decontaminate.least_edits_each(np.array(a, np.uint64), texts, np.array([len(x) for x in rows]))
        assert got.tolist() == [slow_edits(a, x) for x in rows]


def test_many_texts_are_hashed_together(monkeypatch):
    calls = []
    for name in ("prefix_hashes", "placed_hashes"):
        monkeypatch.setattr(decontaminate, name, lambda *x, f=getattr(decontaminate, name): calls.append(1) or f(*x))
    r = random.Random(9)
    items = [(i, " ".join(f"w{r.randrange(60)}" for _ in range(r.choice((5, 8, 20))))) for i in range(20)]
    index = Index(items, Match())
    texts = [None, "", "w1", "é" * 40_000 + " " + items[3][1]]
    for _ in range(500):
        words = [f"w{r.randrange(60)}" for _ in range(r.randrange(30))]
        words[5:5] = edited(r, items[r.randrange(20)][1].split(), r.randrange(4))
        texts.append(" ".join(words))
    # a text that ends where the next one goes on with an item's words
    texts += [" ".join(items[2][1].split()[:3]), " ".join(items[2][1].split()[3:])]
    one = [index.find(t) for t in texts]
    calls.clear()
    assert index.find_all(texts) == one and sum(map(bool, one)) > 300
    assert len(calls) < 20
