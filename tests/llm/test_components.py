import random

from flowloom.llm.common import Scratch
from flowloom.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    r = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    r.shuffle(path)
    for edges in (path, [(100, i) for i in range(80)], [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(5, 5), (None, 3), (-7, 3), (-7, 3)], []):
        df = spark.createDataFrame(edges, "a long, b long")
        assert {x.node: x.component for x in components(df, Scratch(spark)).collect()} == plain(edges)
