"""Exact quantiles that narrow ranks against percentile."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.plans.quantiles import exact_quantiles, with_quantiles


@pytest.mark.parametrize("few", [1, 50, 10**6])
def test_against_percentile(spark, few):
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.5, -0.5])) for g in "ab" for _ in range(3000)] + [("c", 7.0)] * 2000 + [("d", None), (None, 1.0), (None, 2.0), ("e", 3.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    wanted = {"lo": (F.col("v"), 0.05), "mid": (F.col("v"), 0.5), "hi": (F.abs("v"), 0.95)}
    got = {r.g: (r.lo, r.mid, r.hi) for r in exact_quantiles(d, ["g"], wanted, few=few, accuracy=1000).collect()}
    want = {r.g: (r.lo, r.mid, r.hi) for r in d.groupBy("g").agg(*[F.percentile(c, p).alias(n) for n, (c, p) in wanted.items()]).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k]) if want[k][0] is not None else got[k] == (None, None, None)


def test_whole_table_and_empty(spark):
    d = spark.createDataFrame([(float(k),) for k in range(11)], "v double")
    s = with_quantiles(d.agg(F.count("*").alias("n")), d, [], {"mid": (F.col("v"), 0.5)}).first()
    assert (s.n, s.mid) == (11, 5.0)
    none = d.limit(0)
    assert with_quantiles(none.agg(F.count("*").alias("n")), none, [], {"mid": (F.col("v"), 0.5)}).first().mid is None
