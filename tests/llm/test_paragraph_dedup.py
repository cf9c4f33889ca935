import random

import numpy as np
import pandas as pd

from flowloom.llm.common import fields
from flowloom.llm.paragraph_dedup import _left, _merged, drop_repeated_passages, repeated_passages


def sentence(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n)).capitalize() + "."


def make(spark):
    r = random.Random(4)
    text = lambda k: "\n".join(" ".join(sentence(r, 12) for _ in range(4)) for _ in range(k))
    line = " ".join(sentence(r, 12) for _ in range(5))
    changed = line.split()
    changed[30] = "other"
    inline = " ".join([sentence(r, 14), sentence(r, 3), sentence(r, 14), sentence(r, 14)])
    short = sentence(r, 12)
    docs = [(1, text(2) + "\n" + line), (2, line + "\n" + text(1)), (3, text(1) + "\n" + " ".join(changed)), (4, text(1) + " " + inline + " " + text(1)),
            (5, "Start of it. " + inline + " end of it"), (6, short + " " + text(1)), (7, short), (8, "\n".join([" ".join(sentence(random.Random(1), 40) for _ in range(2))] * 3)),
            (9, None), (10, ""), (11, text(30)), (11, "twice " + sentence(r, 60)), (None, line)]
    docs.append(docs[0])
    return docs, line, " ".join(changed), inline, spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, start int, k string").repartition(4)


def test_passages(spark):
    docs, line, changed, inline, df = make(spark)
    text = {d: t for d, t in docs if d != 11}
    got = {(r.doc_id, text[r.doc_id][r.start : r.stop], r.first_doc_id) for r in repeated_passages(df).collect()}
    assert got == {(2, line, 1), (3, changed, 1), (5, inline, 4), (None, line, 1)}
    kept = drop_repeated_passages(df)
    assert kept.columns == df.columns and kept.count() == len(docs)
    left = {r.doc_id: r.text for r in kept.collect() if r.doc_id != 11}
    assert left == text | {2: text[2].replace(line, ""), 3: text[3].replace(changed, ""), 5: text[5].replace(inline, ""), None: ""}
    assert repeated_passages(df.limit(0)).count() == 0


def test_passages_off_the_lines(spark):
    r = random.Random(7)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    spliced, verse, below = " ".join(words(50)), "\n".join(" ".join(words(4)) for _ in range(13)), " ".join(words(29))
    docs = {1: " ".join(words(70) + [spliced] + words(70)), 2: " ".join(words(9) + ["\u00e9\u00e9"] + [spliced.upper()] + words(80)), 3: " ".join(words(20)) + "\n" + verse + "\n" + " ".join(words(9)),
            4: " ".join(words(5)) + "\n" + verse + "\nand " + below + " end", 5: " ".join(words(25) + [below] + words(25)), 6: " ".join([*words(3), spliced[: len(spliced) // 2], *words(40)])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {(x.doc_id, docs[x.doc_id][x.start : x.stop], x.n_words, x.first_doc_id) for x in repeated_passages(df).collect()}
    assert got == {(2, spliced.upper(), 50, 1), (4, verse, 52, 3)}


def test_runs_against_all_windows(spark):
    r = random.Random(8)
    pool = [" ".join(r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(r.randrange(15, 60))) for _ in range(12)]
    docs = {i: r.choice([" ", "\n"]).join(r.choice(pool)[r.randrange(20) :] for _ in range(6)) for i in range(60)}
    first, gone = {}, set()
    for i, text in docs.items():
        words = text.split()
        for at in range(len(words) - 29):
            if first.setdefault(tuple(words[at : at + 30]), i) < i:
                gone |= {(i, x) for x in range(at, at + 30)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    cut = {i: [False] * len(t) for i, t in docs.items()}
    for x in repeated_passages(df).collect():
        cut[x.doc_id][x.start : x.stop] = [True] * (x.stop - x.start)
    for i, text in docs.items():
        starts = [at for at in range(len(text)) if not text[at].isspace() and (at == 0 or text[at - 1].isspace())]
        assert {x for x, at in enumerate(starts) if cut[i][at]} >= {x for d, x in gone if d == i}


def test_short_lines_between_repeats(spark):
    r = random.Random(9)
    a, b, c, d, e, f = (sentence(r, n) for n in (16, 16, 20, 20, 20, 20))
    poem = lambda: "\n".join(sentence(r, 4) for _ in range(9))
    own, short = [poem(), poem()], sentence(r, 3)
    docs = {1: f"{a} {sentence(r, 30)} {b}", 2: f"{sentence(r, 9)}\n{a}\n{own[0]}\n{b}\n{sentence(r, 9)}", 3: f"{c} {d} {sentence(r, 30)} {e} {f}", 4: f"{c} {d}\n{own[1]}\n{e} {f}",
            5: f"{sentence(r, 12)} {a} {short} {sentence(r, 12)}", 6: f"{a} {short} {b}"}
    left = {x.doc_id: x.text for x in drop_repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    # no earlier document has the whole of document 6
    assert left == docs | {4: f"\n{own[1]}\n"}


def test_phrases_and_short_lines(spark):
    r = random.Random(10)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = [words(9) for _ in range(12)]
    list_ = "\n".join(" ".join(x) for x in rows)
    for i in (4, 8):
        rows[i] = [*rows[i][:4], "other", *rows[i][5:]]
    changed, loop = "\n".join(" ".join(x) for x in rows), "And is. " * 40
    docs = {1: f"{' '.join(words(40))}\n{list_}\n\n{' '.join(words(3))}", 2: f"{changed}\n{' '.join(words(50))}", 3: f"{' '.join(words(20))} {loop}{' '.join(words(20))}",
            4: f"{' '.join(words(60))} {loop}{' '.join(words(60))}", 5: "so " * 35, 6: f"{' '.join(words(12))}\n{'so ' * 90}"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {(x.doc_id, docs[x.doc_id][x.start : x.stop], x.first_doc_id) for x in repeated_passages(df).collect()}
    assert got == {(2, changed, 1), (4, loop.strip(), 3), (6, ("so " * 90).strip(), 5)}


def test_spans_are_merged_for_many_documents_at_once():
    r = random.Random(12)
    spans = [[(a, a + r.randrange(1, 9), r.randrange(5)) for a in (r.randrange(60) for _ in range(r.randrange(0, 12)))] for _ in range(200)]
    expected = []
    for d, each in enumerate(spans):
        own = []
        for a, b, first in sorted(each):
            if own and a < own[-1][2]:
                own[-1][2:] = max(own[-1][2], b), min(own[-1][3], first)
            else:
                own.append([d, a, b, first])
        expected += map(tuple, own)
    columns = [pd.Series([np.array([x[i] for x in each], np.int64) for each in spans]) for i in range(3)]
    assert list(zip(*(x.tolist() for x in _merged(*columns)), strict=True)) == expected
    assert [len(x) for x in _merged(columns[0].iloc[:0], columns[1].iloc[:0])] == [0] * 4


def test_workers_get_spans_as_numbers(spark):
    """Structs come to a worker as a Python object each: for batches of 10 000 documents they took hundreds of MB."""
    seen = spark.createDataFrame([(1, [(1, 2, 3), (4, 5, 6)])], "k long, spans array<struct<start:int,stop:int,first:long>>").select(*fields("spans", "start", "first"))

    def kinds(batches):
        for x in batches:
            yield pd.DataFrame({"kind": [f"{type(x[c].iloc[0]).__name__} {x[c].iloc[0].dtype}" for c in x]})

    assert [x.kind for x in seen.mapInPandas(kinds, "kind string").collect()] == ["ndarray int32", "ndarray int64"]
    text = "A b\tc  d é f"
    left = _left(pd.Series([text, "none", text]), pd.Series([np.array([1, 2]), None, np.array([0])]), pd.Series([np.array([3, 4]), None, np.array([6])]))
    assert left.tolist() == ["A  é f", None, ""]
