"""Streams over landed files, one file a trigger."""

import math
import time

from pyspark.sql import functions as F

from keelson.queries import CATALOG
from keelson.streaming import groups as G
from keelson.streaming import landing as L
from keelson.streaming import live as X
from keelson.streaming import ordered as O
from keelson.streaming import records as LR


def point(second, x, y):
    return f"2024-06-01,10:{second // 60:02d}:{second % 60:02d}.000,{x},{y},0.1,0.5"


def write(folder, boat, chunk, lines):
    path = folder / boat
    path.mkdir(parents=True, exist_ok=True)
    (path / f"mmwave_{chunk}.csv").write_text("date,time,x,y,z,v\n" + "\n".join(lines) + "\n")
    time.sleep(0.02)


def test_two_boats_three_chunks_and_late_rows(spark, tmp_path):
    chunks = ["2024-06-01_10-00-00", "2024-06-01_10-01-00", "2024-06-01_10-02-00"]
    want = {}
    for k, chunk in enumerate(chunks):
        for boat in ("boatA", "boatB"):
            seconds = [60 * k + 2 * g for g in range(3)]
            write(tmp_path / f"land{k}", boat, chunk, [point(s, 1.0 + n, 5.0 + n) for s in seconds for n in range(2)])
            for s in seconds:
                want[boat, chunk, s] = [2, 5.0]
    # late: the last group of boatA's first chunk, and a group that is out of reach
    write(tmp_path / "land7", "boatA", chunks[0], [point(4, 0.0, 2.0)])
    want["boatA", chunks[0], 4] = [3, 2.0]
    write(tmp_path / "land8", "boatA", chunks[0], [point(0, 0.0, 1.0)])
    stream = X.radar_stream(spark, f"{tmp_path}/*/*", files_per_trigger=1)
    rows = L.run_to_table(G.chunk_groups(stream, [], {"n": ("x", "count"), "least": ("y", "min")}, history=7, idle_ms=None), "roll")
    newest = {b: max(k for k in want if k[0] == b) for b in ("boatA", "boatB")}
    base = F.unix_millis(F.lit("2024-06-01 10:00:00").cast("timestamp"))
    got = G.settled(rows).withColumn("s", ((F.col("t_ms") - base) / 1000).cast("int")).collect()
    assert len(got) == len({(r.session, r.chunk, r.s) for r in got})                 # no group twice
    assert {(r.session, r.chunk, r.s): [r.n, r.least] for r in got} == {k: v for k, v in want.items() if k != newest[k[0]]}
    again = rows.filter("revision > 0").collect()
    assert [(r.session, r.n, r.revision) for r in again] == [("boatA", 3, 1)]        # the late row hands its group out once more
    assert rows.agg(F.max("late_rows")).first()[0] == 0


def test_rows_beyond_the_history_are_counted(spark):
    rows = spark.createDataFrame([("s", "c", t, 1.0) for t in range(0, 3000, 100)] + [("s", "c", 0, 9.0), ("s", "c", 3000, 1.0)], "session string, chunk string, t long, y double")
    tick = F.when(F.col("y") == 9.0, 1).when(F.col("t") == 3000, 2).otherwise(0)
    stream = L.land(rows, tick, 3).withColumn("ts", F.timestamp_millis("t"))
    out = L.run_to_table(G.chunk_groups(stream, [], {"n": ("y", "count")}, history=4, idle_ms=None), "late")
    assert G.settled(out).filter("n <> 1").count() == 0 and out.count() == 30 and out.agg(F.max("late_rows")).first()[0] == 1


def test_offset_clocks_lose_no_group(spark):
    """Two recordings, one an hour behind, landed file by file: all groups but the last of each."""
    rows = [(s, "0", base + 100 * g + 20 * k, g + k / 10, float(g)) for s, base in (("a", 3_600_000), ("b", 0)) for g in range(6) for k in range(3)]
    df = spark.createDataFrame(rows, "session string, chunk string, t bigint, x double, y double")
    stream = L.land(df, (F.col("t") % 3_600_000 / 100).cast("int"), 6).withColumn("ts", F.timestamp_millis("t"))
    out = L.run_to_table(G.chunk_groups(stream, [], {"n": ("x", "count"), "least": ("y", "min")}, idle_ms=None), "offset").collect()
    assert sorted((r.session, r.t_ms, r.n, r.least) for r in out) == sorted((c, b + 100 * g, 3, float(g)) for c, b in (("a", 3_600_000), ("b", 0)) for g in range(5))


def test_ordered_state_takes_late_rows_in_place(spark):
    rows = [("k", f, f * 1000, ((f * 37) % 10) / 10) for f in range(40)]
    df = spark.createDataFrame(rows, "k string, f long, t long, p double").withColumn("ts", F.timestamp_millis(F.lit(10**12) + F.col("t")))
    tick = F.floor(F.col("t") / 10_000).cast("int") + (F.col("f") % 7 == 3).cast("int")
    stream = L.land(df, tick, 5, heartbeat="ts").withWatermark("ts", "11 seconds")
    out = O.in_order(stream.select("k", "f", "p", "ts"), ["k"], ["f"], O.both(O.persisted(), carry=["f"]), "k string, f long, y double")
    got = {r.f: r.y for r in L.run_to_table(out, "late").filter("k = 'k'").collect()}
    y, want = 0.0, {}
    for _, f, _, p in rows:
        y = want[f] = max(p, y * (math.exp(-0.5) if f else 0))
    assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], rel_tol=1e-12) for f in want)


def test_latest_wins_writes_each_batch_once(spark):
    rows = spark.createDataFrame([("a", k, k * 10) for k in range(10)] + [("b", 100, 35)], "clip_id string, n long, t long").withColumn("ts", F.timestamp_millis("t"))
    log = L.TickLog()
    out = L.run_to_table(L.land(rows, F.floor(F.col("t") / 30).cast("int"), 4), "latest", X.latest_wins, log)
    assert sorted((r.batch_id, r.clip_id, r.n, r.skipped_rows) for r in out.collect()) == [(0, "a", 2, 2), (1, "a", 5, 2), (1, "b", 100, 0), (2, "a", 8, 2), (3, "a", 9, 0)]
    assert sorted((r.batch_id, r.input_rows) for r in L.over_budget(spark, log, 1e9).filter("NOT over_budget").collect()) == [(0, 3), (1, 4), (2, 3), (3, 1)]


def test_rolled_chunks_take_rows_one_landing_late(spark, tmp_path):
    # one boat of 20,000 groups, 5,000 a landing
    rows = spark.range(0, 400_000, 20).select(
        F.col("id").alias("l_orderkey"), (F.col("id") * 7 % 20_000).alias("l_partkey"), (F.col("id") % 1000).alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        F.lit("A").alias("l_returnflag"), F.lit(1.0).alias("l_quantity"), F.lit(0.0).alias("l_tax"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = CATALOG["S15_X07_chunk_roll"].build(spark, str(tmp_path)).agg(F.count("*"), F.sum("n_points"), F.max("late_rows")).first()
    assert tuple(out) == (19_999, 19_999, 0)


def test_large_landings_are_cut_into_files(spark, monkeypatch):
    monkeypatch.setattr(L, "FILE_ROWS", 100, raising=False)
    # landings of 450, 3 and 450 rows: the one in the middle fills fewer files than the others
    rows = spark.range(903, numPartitions=3).withColumn("tick", F.when(F.col("id") < 450, 0).when(F.col("id") < 453, 1).otherwise(2))
    stream = L.land(rows, F.col("tick"), 3)
    out = L.run_to_table(stream.withColumn("file", F.input_file_name()), "files", lambda b: b.groupBy("tick").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")))
    got = {(r["batch_id"], r["tick"]): (r["n"], r["files"]) for r in out.collect()}
    assert {k: n for k, (n, _) in got.items()} == {(0, 0): 450, (1, 1): 3, (2, 2): 450}
    assert got[0, 0][1] == got[2, 2][1] == 5


def test_bins_kept_together_give_what_they_give_apart(spark):
    """Two bins in one state, one of them silent long enough to be forgotten."""
    rows = [("k", b, f, f * 1000, ((f * 37 + b) % 10) / 10) for b in range(2) for f in range(60) if b or not 10 < f < 50]
    df = spark.createDataFrame(rows, "k string, b long, f long, t long, p double").withColumn("ts", F.timestamp_millis(F.lit(10**12) + F.col("t")))
    tick = F.floor(F.col("t") / 10_000).cast("int") + (F.col("f") % 7 == 3).cast("int")
    count = lambda state, row: (state.setdefault("seen", []).append(row["f"]) or len(state["seen"]),)
    step = O.both(O.persisted(gap_s=100.0), count, carry=["f"])

    def run(name, **kw):
        stream = L.land(df, tick, 7, heartbeat="ts").withWatermark("ts", "11 seconds").select("k", "b", "f", "p", "ts")
        out = O.in_order(stream, ["k", "b"], ["f"], step, "k string, b long, f long, y double, n long", idle_s=5.0, **kw)
        return sorted(tuple(r) for r in L.run_to_table(out, name).filter("k = 'k'").collect())

    apart = run("apart")
    assert run("together", within=1) == apart and len(apart) == len(rows)
    assert {r[2]: r[4] for r in apart if r[1] == 0}[50] == 1                         # bin 0 began anew after its silence


def test_landing_works_rows_out_once(spark):
    n = spark.sparkContext.accumulator(0)

    def seen(k):
        n.add(1)
        return k

    rows = spark.range(50).select(F.udf(seen, "long")("id").alias("id"))
    out = L.run_to_table(L.land(rows, F.pmod("id", F.lit(5)), 5), "once")
    assert out.count() == 50 and n.value <= 100


def test_samples_are_looked_up_by_slices_of_time(spark):
    frames = [("a", t) for t in range(0, 60_000, 700)] + [("b", 500)]
    samples = [("a", t) for t in range(0, 40_000, 1000)]
    stamp = lambda d: d.withColumn("ts", F.timestamp_millis(F.lit(10**12) + F.col("t")))
    left = L.land(stamp(spark.createDataFrame(frames, "clip_id string, t long")), F.lit(0), 1, heartbeat="ts").withWatermark("ts", "10 seconds").drop("t")
    right = L.land(stamp(spark.createDataFrame(samples, "s_clip string, t long")), F.lit(0), 1, heartbeat="ts")
    right = right.select("s_clip", F.col("ts").alias("sample_ts"), F.col("t").alias("result_id")).withWatermark("sample_ts", "10 seconds")
    out = LR.freshest(left, right, ["clip_id"])
    assert "__s_slice" in out._jdf.queryExecution().analyzed().toString()            # state of a row is that of a slice, not of its recording
    got = {(r.clip_id, r.t): r.result_id for r in L.run_to_table(out, "near").filter("clip_id <> ''").select("clip_id", (F.unix_millis("ts") - 10**12).alias("t"), "result_id").collect()}
    near = lambda c, t: max([s for k, s in samples if k == c and t - 2000 <= s <= t], default=None)
    assert got == {(c, t): near(c, t) for c, t in frames}
