import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from keelson.llm import clusters as C

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType()), T.StructField("q", T.IntegerType())])


def nearest(vectors, centroids):
    out = []
    for v in vectors:
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids]
        out.append((d.index(min(d)), min(d)))
    return out


@given(st.integers(1, 40), st.integers(1, 4), st.sampled_from([1, 3, 1000, C.LARGEST - 1]), st.integers(0, 10**6), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_tree_against_all_distances(k, dim, size, seed, leaf):
    rng = np.random.default_rng(seed)
    centroids = rng.integers(-size, size + 1, (k, dim))
    vectors = np.concatenate([rng.integers(-size, size + 1, (60, dim)), centroids])
    number, d = C.nearest(C.build(centroids, leaf), vectors)
    assert list(zip(number.tolist(), d.tolist())) == nearest(vectors, centroids)


def brute(rows, dim, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    m = [list(v) for _, v in order[:k]]
    for _ in range(rounds):
        a = nearest([v for _, v in kept], m)
        for c in range(len(m)):
            mine = [v for (_, v), (x, _) in zip(kept, a) if x == c]
            if mine:
                m[c] = [sum(col) // len(mine) for col in zip(*mine)]
    a = nearest([v for _, v in kept], m)
    total = sum(d for _, d in a)
    return sorted(((i, c, d, sum(y for x, y in a if x == c), total, hashlib.sha256(",".join(map(str, m[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, a)), key=str)


def result(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return sorted(map(tuple, C.clusters(df, **kw).collect()), key=str)


def test_rounds_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).round(2).tolist()) for i in range(300)]
    rows += [(None, [0.5, 0.5, -0.5]), (7, [0.5, 0.5, -0.5]), (8, None), (9, [1.0, 2.0]), (10, [1.0, None, 2.0]), (11, [1.0, float("nan"), 2.0]), (12, [float("inf"), 0.0, 0.0]), (13, [])]
    rows += [(1000 + i, [0.25, 0.25, 0.25]) for i in range(200)]            # a very common vector
    assert result(spark, rows, dim=3, k=5, rounds=4) == brute(rows, 3, 5, 4)


def test_ties_few_vectors_and_empty_clusters(spark):
    same = [(i, [1.0, -1.0]) for i in range(6)]
    out = result(spark, same, dim=2, k=4, rounds=3)
    assert out == brute(same, 2, 4, 3) and {r[1] for r in out} == {0}       # equal centroids: all go to the first
    few = [(1, [0.0, 0.0]), (2, [1.0, 0.0])]
    assert result(spark, few, dim=2, k=8, rounds=2) == brute(few, 2, 8, 2)


def test_empty_table_and_limits(spark):
    assert result(spark, [], dim=2) == [] and result(spark, [(1, None)], dim=2) == []
    with pytest.raises(Exception, match="does not fit"):
        result(spark, [(1, [1e9, 0.0])], dim=2)
    with pytest.raises(ValueError, match="too many"):
        result(spark, [(1, [1.0, 0.0])], dim=2, k=1 << 22)
