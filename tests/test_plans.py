"""Plan helpers against brute force."""

import math
import random

from pyspark.sql import functions as F

from keelson.operators.evaluate import average_precision
from keelson.plans import matching
from keelson.plans.joins import checked_join
from keelson.plans.ordered import inside_intervals, linear_recurrence, nearest_asof, scan, time_slices


def test_scan_equals_plain_order(spark):
    rnd = random.Random(1)
    rows = [(k, t, rnd.choice([None, 1, 2, 3])) for k in "ab" for t in sorted(rnd.sample(range(500), 60))]
    df = time_slices(spark.createDataFrame(rows, "k string, t bigint, v int"), "t", 37)
    out = scan(df, ["k"], ["t"], lag={"p": F.col("v")}, lead={"n": F.col("t")}, run_sum={"s": F.col("v")}, run_max={"m": F.col("v")},
               fill={"f": F.col("v")}, backfill={"b": F.col("v")}).collect()
    got = {(r.k, r.t): r for r in out}
    for k in "ab":
        seq = [r for r in rows if r[0] == k]
        for i, (_, t, v) in enumerate(seq):
            r = got[(k, t)]
            past, ahead = [x[2] for x in seq[: i + 1] if x[2]], [x[2] for x in seq[i:] if x[2]]
            assert r.p == (seq[i - 1][2] if i else None)
            assert r.n == (seq[i + 1][1] if i + 1 < len(seq) else None)
            assert r.s == sum(past) and r.m == (max(past) if past else None)
            assert r.f == (past[-1] if past else None) and r.b == (ahead[0] if ahead else None)


def test_average_precision_with_heavy_ties(spark):
    rnd = random.Random(2)
    rows = [(i, 0.0 if rnd.random() < 0.5 else round(rnd.random(), 2), int(rnd.random() < 0.3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, s double, y int").withColumn("g", F.lit("x"))
    got = average_precision(df, ["g"], "s", "y", "id", parts=16).first().ap
    tp, acc = 0, 0.0
    for n, (_, _, y) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        tp += y
        acc += y * tp / n
    assert math.isclose(got, acc / tp, rel_tol=1e-12)


def test_nearest_asof(spark):
    rnd = random.Random(3)
    left = [("a", i, rnd.randrange(20000)) for i in range(80)]
    right = [("a", t, float(t)) for t in sorted(rnd.sample(range(0, 20000, 7), 60))]
    lf = spark.createDataFrame(left, "k string, i int, t bigint")
    rf = spark.createDataFrame(right, "k string, t bigint, v double")
    for side in ("nearest", "backward", "forward"):
        got = {r.i: r.v for r in nearest_asof(lf, rf, ["k"], t="t", payload=["v"], max_age=300, side=side, slice_factor=2).collect()}
        for _, i, t in left:
            c = [(abs(rt - t), rt, v) for _, rt, v in right if abs(rt - t) <= 300 and (side == "nearest" or (rt <= t if side == "backward" else rt >= t))]
            assert got[i] == (min(c)[2] if c else None)


def test_linear_recurrence_over_blocks(spark):
    rnd = random.Random(4)
    rows = [("k", i, 0.0 if rnd.random() < 0.05 else rnd.random(), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, a double, b double")
    got = {r.i: r.y for r in linear_recurrence(df, ["k"], "i", F.col("a"), F.col("b"), "y", block=8).collect()}
    y = 0.0
    for _, i, a, b in rows:
        y = a * y + b
        assert math.isclose(got[i], y, rel_tol=1e-9)


def test_intervals_inclusive_and_reversed(spark):
    f = spark.createDataFrame([("c", t) for t in range(0, 100, 10)], "k string, t bigint")
    iv = spark.createDataFrame([("c", 20, 30), ("c", 70, 60), ("c", 25, 27)], "k string, a bigint, b bigint")
    out = inside_intervals(f, iv, ["k"], t="t", start="a", end="b", width=15)
    assert sorted(r.t for r in out.filter("inside").collect()) == [20, 30, 60, 70]


def test_rounds_equal_fold(spark):
    rnd = random.Random(5)
    rows = [(g, l, r, round(rnd.random(), 3)) for g in range(4) for l in range(8) for r in range(8) if rnd.random() < 0.4]
    df = spark.createDataFrame(rows, "g int, l bigint, r bigint, d double")
    a = matching._fold(df, ["g"], "l", "r", [F.col("d")]).collect()
    b = matching._rounds(df, ["g"], "l", "r", [F.col("d")]).collect()
    want = set()
    for g in range(4):
        ls, rs = set(), set()
        for d, l, r in sorted((d, l, r) for gg, l, r, d in rows if gg == g):
            if l not in ls and r not in rs:
                ls.add(l), rs.add(r), want.add((g, l, r))
    assert {tuple(x) for x in a} == want == {tuple(x) for x in b}


def test_a_side_counted_as_large_is_not_broadcast(spark):
    big = spark.range(50).withColumnRenamed("id", "k")
    small = spark.range(0, 50, 3).withColumnRenamed("id", "k")
    j = checked_join(big, small, ["k"], "left_anti", max_rows=10)
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in j.collect()) == [k for k in range(50) if k % 3]
