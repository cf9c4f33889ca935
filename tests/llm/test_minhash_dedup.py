import random

import numpy as np

from flowloom.llm import neardup, sketch
from flowloom.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from flowloom.llm.neardup import Similarity


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * both >= 75 * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if d is not None else None, d is None or least[find(i)] == d) for i, (d, s) in enumerate(sets)), key=str)


def corpus(r):
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    docs = [(i, " ".join(text(r.randrange(0, 60)))) for i in range(60)]
    passage = text(60)
    for i in range(100, 180):  # share most of a passage, some enough to be linked
        docs.append((i, " ".join(text(r.randrange(3, 25)) + passage + text(r.randrange(3, 15)))))
    base = text(80)
    for i in range(200, 260):  # a family of near copies of which only some pairs are alike
        copy = list(base)
        for _ in range(r.randrange(0, 5)):
            copy[r.randrange(80)] = r.choice(words)
        docs.append((i, "\t".join(copy).upper()))
    docs += [(300, None), (301, ""), (302, " \n "), (303, "A b"), (304, "a\x0bB"), (305, "a b c"), (None, " ".join(base)), (200, docs[140][1]), (306, "x " * 3000), (307, "x " * 9)]
    return [*docs, docs[0]]


def check(spark, docs, how=Similarity()):
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, id string, n int").repartition(5)
    got = sorted((tuple(r) for r in near_duplicates(df, how).collect()), key=str)
    return df, got


def test_against_brute_force(spark):
    docs = [d for d in corpus(random.Random(11)) if d[0] != 200 or "W" in (d[1] or "")]
    _, got = check(spark, docs)
    assert got == brute(docs)


def test_large_buckets_take_the_exact_way(spark, monkeypatch):
    docs = [d for d in corpus(random.Random(12)) if d[0] != 200 or "W" in (d[1] or "")]
    used = []
    plain = neardup._rare_pairs
    monkeypatch.setattr(neardup, "_rare_pairs", lambda *a: used.append(1) or plain(*a))
    _, got = check(spark, docs, Similarity(small=3))
    assert got == brute(docs) and used


def test_drop_keeps_one_of_each_group(spark):
    docs = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "q"), (3, "q"), (None, "q"), (4, None), (5, None)]
    df, _ = check(spark, docs)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_sets_of_many_arrays():
    rng = np.random.default_rng(0)
    for _ in range(200):
        words = [rng.integers(0, rng.integers(1, 9), rng.choice([0, 1, 4, 5, 6, 60])).astype(np.uint64) for _ in range(rng.integers(0, 9))]
        for width in (1, 5):
            expected = [sketch.distinct_shingles(h, width) for h in words]
            assert [s.tolist() for s in sketch.sets_of_words(words, width)] == [s.tolist() for s in expected]


def test_sketches_estimate_similarity_for_small_sets_too():
    rng = np.random.default_rng(1)
    for t in (64, 1024):
        for n, both in ((4, 3), (40, 30)):
            agree = []
            for _ in range(60):
                pool = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
                made = sketch.sketches([np.sort(pool[:n]), np.sort(pool[n - both :])], t, seed=2)
                assert (made != np.iinfo(np.uint64).max).all()
                agree.append((made[0] == made[1]).mean())
            assert abs(np.mean(agree) - both / (2 * n - both)) < 0.05


def test_second_sketch_is_a_row_for_each_set(spark):
    from flowloom.llm.neardup import Similarity, _rebanded

    sets = spark.createDataFrame([(i, 40, list(range(i, i + 40))) for i in range(5)], "id long, n long, hashes array<long>")
    rows = _rebanded(sets, Similarity()).collect()
    assert sorted(r.id for r in rows) == list(range(5)) and all(len(set(r["keys"])) == 128 for r in rows)


def test_keys_that_meet_are_found_in_packed_arrays(spark):
    """Keys go to their partitions as arrays: a row for each band of each set cost op7 most of its first join."""
    r = random.Random(21)
    sets = [(i, i % 7 + 1, [r.randrange(-(1 << 63), 1 << 63) for _ in range(5)] + [r.choice([-5, 3 << 40, i])]) for i in range(400)]
    rows = spark.createDataFrame([*sets, *sets[:50]], "id long, n long, keys array<long>").repartition(5)
    by = {}
    for i, n, keys in sets:
        for k in keys:
            by.setdefault(k, []).append((i, n))
    wanted = [(k, i, n, len(x), *min(x)) for k, x in by.items() if len(x) > 1 for i, n in x]
    got = neardup._buckets(rows, "key, id, n, held, head, head_n")
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and len(wanted) > 200
    assert "Generate" not in got._jdf.queryExecution().toString() and not neardup._buckets(rows.limit(0), "key, id").count()
