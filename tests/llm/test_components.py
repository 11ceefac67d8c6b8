import random

import pytest

from keelson.llm.components import components


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("edges", [
    [(k + 1, k) for k in range(12)],
    [(0, k) for k in range(1, 30)] + [(40, k) for k in range(30, 40)],
    [(a, b) for r in [random.Random(3)] for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(45)) if a != b],
])
def test_against_union_find(spark, edges):
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute(edges)
    assert all(got.get(x, x) == c for x, c in want.items())


def test_no_edges(spark):
    rows = spark.createDataFrame([(None, 1), (2, 2)], "u long, v long")
    assert components(rows).collect() == [] and components(rows.limit(0)).collect() == []
