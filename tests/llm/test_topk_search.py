import math
import random

from pyspark.sql import functions as F

from flowloom.llm.topk_search import top_k


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, found = set(), {}
    for q, qv in good:
        for c, cv in good:
            if q % 50 == 0 and c != q and len(cv) == len(qv):
                s, best = sum(a * b for a, b in zip(qv, cv)), found.setdefault(q, {})
                best[c] = max(best.get(c, s), s)
    for q, best in found.items():
        for rank, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, c, max(-(1 << 63), min((1 << 63) - 1, s))))
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, number int, score int").repartition(3)
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, k).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(7)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 7) for i in range(40)]
    rows += [(100, [3.0] * 7), (7, [9.0] * 7), (7, [9.0] * 7)]  # ids twice
    rows += [(5000, None), (5001, [None] + [1.0] * 6), (5050, [float("nan")] * 7), (None, [1.0] * 7), (5100, [float("inf")] * 7), (6000, [1.0, 2.0]), (6001, [1.0]), (6002, [])]
    assert run(spark, rows) == brute(rows, 5)


def test_large_components_and_few_rows(spark):
    rows = [(0, [1e30, -1e9]), (1, [1e30, 5.0]), (2, [-3e11, 1e12]), (3, [1e13, 1e3])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == set()
    assert run(spark, [(50, [1.0])]) == set()
