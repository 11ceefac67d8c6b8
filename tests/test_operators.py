"""Hand-computed cases."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from keelson.functions import clock, sun
from keelson.functions import geometry as G
from keelson.operators import association as AS
from keelson.operators import boxes as B
from keelson.operators import curation as C
from keelson.operators import radar as R
from keelson.operators import sectors as S
from keelson.operators import smoothing as SM
from keelson.operators import tracking as K
from keelson.params import FISHEYE
from keelson.sources import sinks as K06


def bins(spark, series, **cols):
    rows = [("c", 0, i, i / 3.0, *v) for i, v in enumerate(series)]
    names = ", ".join(f"{n} {t}" for n, t in cols.items())
    return spark.createDataFrame(rows, f"clip_id string, bin_index bigint, frame_index bigint, t_s double, {names}")


@pytest.mark.parametrize("hits,min_hits,max_age,want", [
    ("TTT", 3, 5, "FFT"), ("TTFFF", 2, 3, "FTTTF"), ("TTFFTT", 5, 2, "FFFFFF"), ("TFTFT", 3, 5, "FFFFT")])
def test_confirmation(spark, hits, min_hits, max_age, want):
    d = bins(spark, [(h == "T",) for h in hits], hit="boolean")
    got = SM.confirm_sectors(d, "hit", min_hits, max_age).orderBy("frame_index").collect()
    assert "".join("T" if r.confirmed else "F" for r in got) == want


def test_persistence_decay_and_gap(spark):
    rows = [("c", 0, 0, 0.0, 0.8), ("c", 0, 1, 1.0, 0.0), ("c", 0, 2, 61.0, 0.1), ("c", 0, 3, 60.5, 0.05)]
    d = spark.createDataFrame(rows, "clip_id string, bin_index bigint, frame_index bigint, t_s double, p double")
    got = [r.p_smooth for r in SM.persist_score(d).orderBy("frame_index").collect()]
    assert got == pytest.approx([0.8, 0.8 * math.exp(-0.5), 0.1, 0.05])


def test_regrid_native_width_is_identity(spark):
    rows = [("c", 0, i, -45.0 + 15 * i, i / 10, 0.5, 0.1, float(i), None, 0.2, i == 3, 1, 0, 0) for i in range(7)]
    d = spark.createDataFrame(rows, "clip_id string, frame_index bigint, bin_index bigint, bin_center_deg double, score double, p double, threat double, "
                                    "min_range_m double, ttc_s double, closing_mps double, confirmed boolean, hit_fisheye int, hit_thermal int, hit_mmwave int")
    got = S.regrid(d, 15.0).orderBy("center_deg").collect()
    assert [r.center_deg for r in got] == [-45.0 + 15 * i for i in range(7)]
    assert [r.score for r in got] == [i / 10 for i in range(7)]
    wide = S.regrid(d, 105.0).collect()
    assert len(wide) == 1 and wide[0].score == 0.6 and wide[0].min_range_m == 0.0 and wide[0].confirmed


def test_deletion_rules(spark):
    rows = [("a", None, None, None), ("b", "2024-01-02", None, None), ("c", "2024-01-02", "2024-01-03", None), ("d", "2024-01-02", "2024-01-01", None), ("e", None, None, "x")]
    d = spark.createDataFrame(rows, "k string, deleted_at string, restored_at string, purged_at string")
    got = d.filter(C.is_deleted(F.col("deleted_at"), F.col("restored_at"), F.col("purged_at"))).collect()
    assert sorted(r.k for r in got) == ["b", "d", "e"]


def test_utc_with_zone_and_midnight(spark):
    d = spark.createDataFrame([("2024-01-15", "12:00:00.0", "12-00-00"), ("2024-07-15", "12:00:00.0", "12-00-00"), ("2024-01-15", "00:00:10.0", "23-59-00")], "d string, t string, s string")
    got = [r.u for r in d.select(clock.to_utc(F.col("d"), F.col("t"), "CET", F.col("s")).alias("u")).collect()]
    assert got == [dt.datetime(2024, 1, 15, 11), dt.datetime(2024, 7, 15, 10), dt.datetime(2024, 1, 15, 23, 0, 10)]


def test_bad_frame_id_fails(spark):
    d = spark.createDataFrame([("a/b",)], "f string")
    with pytest.raises(Exception, match="unexpected frame id"):
        d.select(clock.parse_frame_id(F.col("f"))["scene"]).collect()


def test_sun_at_equinox_noon(spark):
    t = dt.datetime(2024, 3, 20, 12, 7, tzinfo=dt.UTC).timestamp()
    p = spark.range(1).select(sun.position(F.lit(0.0), F.lit(0.0), F.lit(t)).alias("p"), sun.daypart_thermal(F.lit(None).cast("double")).alias("n"), sun.daypart_eval(F.lit(None).cast("double")).alias("e")).first()
    assert p.p.elevation > 89 and p.n == "day" and p.e == "dusk"


def test_geometry_round_trips(spark):
    d = spark.range(1).select(
        G.pitch_roll_from_up(G.up_from_pitch_roll(F.lit(0.2), F.lit(-0.1))).alias("pr"),
        G.horizon_from_up(G.up_from_horizon(F.lit(0.03), F.lit(310.0), FISHEYE), FISHEYE).alias("h"),
        G.water_range(F.lit(FISHEYE.cx), F.lit(FISHEYE.cy + FISHEYE.fy), FISHEYE, G.up_level()).alias("r"),
        G.water_range(F.lit(FISHEYE.cx), F.lit(FISHEYE.cy - 5), FISHEYE, G.up_level()).alias("none"),
        G.quaternion_to_euler(*[F.lit(0.0)] * 4).alias("q")).first()
    assert (d.pr.pitch, d.pr.roll) == pytest.approx((0.2, -0.1)) and (d.h.slope, d.h.intercept) == pytest.approx((0.03, 310.0))
    assert d.r == pytest.approx(0.25 * math.sqrt(2)) and d.none is None and tuple(d.q) == (0.0, 0.0, 0.0)


def test_nms_chain(spark):
    # b falls to a; c overlaps only b, so it stays
    rows = [("k", 0, 1, "x", 0.9, 0.0, 0.0, 10.0, 10.0), ("k", 0, 2, "x", 0.8, 3.0, 0.0, 13.0, 10.0), ("k", 0, 3, "x", 0.7, 6.0, 0.0, 16.0, 10.0)]
    d = spark.createDataFrame(rows, "clip_id string, frame_index bigint, box_id bigint, cls string, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box_id for r in B.nms(d, 0.5).collect()) == [1, 3]


def test_box_tracker_survives_short_gap(spark):
    rows = [("c", f, f, 0.9, 10.0 + f, 10.0, 60.0 + f, 60.0) for f in (0, 1, 2, 5, 6, 30)] + [("c", 3, 99, 0.2, 400.0, 10.0, 450.0, 60.0)]
    d = spark.createDataFrame(rows, "clip_id string, frame_index bigint, box_id bigint, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = {r.box_id: (r.stretch, r.track_id, r.confirmed) for r in K.track_boxes(d).collect()}
    assert 99 not in got                                  # weak boxes never start a track
    assert len({got[f][:2] for f in (0, 1, 2, 5, 6)}) == 1 and got[6][2]
    assert got[30][:2] != got[6][:2]


def test_target_tracker_follows_and_resets(spark):
    frames = [("c", i, 100 * i + (2000 if i > 6 else 0)) for i in range(10)]
    obs = [("c", i, 7, 0.1 * i, 5.0, 3, -0.5) for i in range(10)]
    f = spark.createDataFrame(frames, "clip_id string, frame_index bigint, t_ms bigint")
    o = spark.createDataFrame(obs, "clip_id string, frame_index bigint, cluster_id bigint, cx double, cy double, n_points bigint, v_radial double")
    got = K.track_targets(o, f).orderBy("frame_index").collect()
    assert [r.hits for r in got] == [1, 2, 3, 4, 5, 6, 7, 1, 2, 3] and {r.stretch for r in got} == {1, 2}
    m = K.motion_fields(K.track_targets(o, f)).filter("frame_index = 6").first()
    assert m.motion_state == "closing" and m.closing_mps == pytest.approx(0.5)


def test_identity_pairs_after_three_and_breaks(spark):
    t = [("c", i, 1, 5.0) for i in range(20)]
    c = [("c", i, 9, 3.0) for i in range(20)]
    e = [("c", i, 1, 9) for i in range(8)]
    got = K.pair_identities(spark.createDataFrame(t, "clip_id string, frame_index bigint, track_id bigint, bearing double"),
                            spark.createDataFrame(c, "clip_id string, frame_index bigint, camera_id bigint, bearing double"),
                            spark.createDataFrame(e, "clip_id string, frame_index bigint, track_id bigint, camera_id bigint")).collect()
    at = sorted(r.frame_index for r in got)
    assert at == list(range(2, 12)) and all(r.offset_deg == pytest.approx(2.0) for r in got)


def test_sources_and_sinks(spark, tmp_path):
    from keelson.operators.align import radar_ordinals  # noqa: F401
    from keelson.sources import scans, sinks

    d = tmp_path / "m1"
    d.mkdir()
    (d / "mmwave_2024-06-01_12-00-00.csv").write_text("Date,Time,X,Y,Z,V\n2024-06-01,12:00:00.157,1,2,0,0.5\n2024-06-01,12:00:00.257,,,,\n2024-06-01,12:00:00.257,99,1,0,0\n2024-06-01,12:00:00.299,1,3,0,11\n")
    (d / "fisheye_2024-06-01_12-00-00.mp4").write_bytes(b"x")
    r = scans.radar_rows(scans.read_lines(spark, str(d / "mmwave_*.csv"))).orderBy("ts", F.col("x").isNull()).collect()
    assert [x.rounded_time for x in r] == ["12:00:00.1", "12:00:00.2", "12:00:00.2"] and r[0].clip_id == "m1/2024-06-01_12-00-00"
    assert [x.v for x in r] == [0.5, None, None] and [x.x for x in r] == [1.0, None, 1.0]
    cat = scans.capture_catalogue(scans.list_files(spark, str(tmp_path)), str(tmp_path), ("fisheye",)).collect()
    assert [c.clip_id for c in cat] == ["m1/2024-06-01_12-00-00"] and cat[0].thermal is None
    (tmp_path / "cur.json").write_text(json.dumps({"version": 1, "sets": {"m1/x": {"deleted_at": "2024-01-01", "cuts": [{"start_ts": "1", "end_ts": "2"}]}}}))
    sets, cuts = scans.read_curation(spark, str(tmp_path / "cur.json"))
    assert sets.first().clip_key == "m1__x" and cuts.count() == 1
    with pytest.raises(ValueError):
        scans.curation_tables(spark, {"version": 2})
    b = spark.createDataFrame([("c1", 0, 0, 0.5, None), ("c1", 0, 1, float("nan"), 1.0)], "clip_id string, frame_index bigint, bin_index bigint, p double, r double")
    sinks.write_features(b, b.select("clip_id", "frame_index").distinct(), b.select("clip_id").distinct(), str(tmp_path / "feat"))
    back = scans.read_features(spark, str(tmp_path / "feat"), "bins", ["c1"])
    assert back.filter("p IS NULL").count() == 1
    sinks.write_release(sets.select("clip_key"), str(tmp_path / "rel"))
    with pytest.raises(Exception):
        sinks.write_release(sets.select("clip_key"), str(tmp_path / "rel"))


def test_stream_equals_batch(spark):
    from keelson.queries import CATALOG
    from keelson.queries.sectors import scored

    sf = "/root/testdata/sf0.001"
    got = CATALOG["X05_stateful_smoothing"].build(spark, sf)
    want = SM.persist_score(scored(spark, sf)).select("clip_id", "bin_index", "frame_index", (F.round("p_smooth", 6) + F.lit(0.0)).alias("p_smooth"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_gate_fit_recovers_structure(spark):
    import random

    from keelson.operators.scorer import fit_gated_mixture

    rnd = random.Random(0)
    rows = []
    for _ in range(600):
        e = [rnd.random() for _ in range(3)]
        rows.append((*e, *[rnd.random() for _ in range(8)], int(e[2] > 0.5)))
    from keelson.functions.scoring import CONTEXT, SENSORS
    d = spark.createDataFrame(rows, ", ".join([f"e_{s} double" for s in SENSORS] + [f"c_{c} double" for c in CONTEXT] + ["y int"]))
    g = fit_gated_mixture(d, "y", seeds=(0,), epochs=60)[0]
    w = d.select(*g.gates()).agg(*[F.avg(f"w_{s}").alias(s) for s in SENSORS]).first()
    assert w.radar > w.fisheye and w.radar > w.thermal


def test_annotation_plan_spacing_and_rare_classes(spark):
    from keelson.operators.review import annotation_plan

    rows = [("c", i, f"f{i:03d}", 0.5 if i != 40 else 0.49, ["duck"] if i == 40 else ["boat"], ["part:day"], True) for i in range(100)]
    d = spark.createDataFrame(rows, "clip_id string, idx bigint, frame_id string, u double, classes array<string>, cells array<string>, labelled boolean")
    got = annotation_plan(d, 6).orderBy("rank").collect()
    idx = sorted(int(r.frame_id[1:]) for r in got)
    assert len(got) == 6 and all(b - a >= 8 for a, b in zip(idx, idx[1:]))
    assert "f040" in {r.frame_id for r in got[:2]}
    assert [r.frame_id for r in got] == [r.frame_id for r in annotation_plan(d, 6).orderBy("rank").collect()]


def test_annotation_plan_against_direct_search(spark):
    """Rounds with a tiny shortlist pick what a full search over all candidates picks."""
    import random
    from collections import Counter

    from keelson.operators import review as V

    rng = random.Random(4)
    rows = [(f"c{k % 3}", k // 3, f"f{k:03d}", rng.choice([0.2, 0.4, 0.4, 0.9]), rng.sample(["duck", "boat", "person", ""], rng.randrange(3)),
             rng.sample(["part:day", "part:night", "cloud:1"], rng.randrange(3)), rng.random() < 0.5) for k in range(150)]
    d = spark.createDataFrame(rows, "clip_id string, idx bigint, frame_id string, u double, classes array<string>, cells array<string>, labelled boolean")
    weights = {"duck": 2.5}
    classes, cells, taken, want = Counter(), Counter(), [], []

    def gain(r):
        g = r[3] + (0 if r[6] else 0.15) + sum(weights.get(c, 1) / math.sqrt(1 + classes[c]) for c in set(r[4]) - {""})
        return g + 0.8 * sum(1 / math.sqrt(1 + cells[c]) for c in r[5]) / max(1, len(r[5]))

    while len(want) < 20:
        free = [r for r in rows if all(r[0] != c or abs(r[1] - i) >= V.MIN_SPACING for c, i in taken)]
        if not free:
            break
        r = min(free, key=lambda r: (-round(gain(r), 12), r[0], r[2]))
        want.append(r[2])
        taken.append((r[0], r[1]))
        classes.update(set(r[4]) - {""})
        cells.update(r[5])
    got = V.annotation_plan(d, 20, weights, pool=None, shortlist=7).orderBy("rank").collect()
    assert [r.frame_id for r in got] == want and len(want) < 20


def test_feature_batches_keep_other_clips(spark, tmp_path):
    from keelson.sources.scans import read_features
    from keelson.sources.sinks import write_features

    def batch(clip, value):
        bins = spark.createDataFrame([(clip, k, value) for k in range(3)], "clip_id string, frame_index bigint, p double")
        write_features(bins, bins.select("clip_id", "frame_index"), spark.createDataFrame([(clip, "v1")], "clip_id string, version string"), str(tmp_path))

    batch("a", 0.1)
    batch("b", 0.2)
    batch("a", 0.3)
    got = read_features(spark, str(tmp_path), "bins").groupBy("clip_id").agg({"p": "max", "frame_index": "count"}).collect()
    assert {r.clip_id: (r["max(p)"], r["count(frame_index)"]) for r in got} == {"a": (0.3, 3), "b": (0.2, 3)}
    assert read_features(spark, str(tmp_path), "meta").count() == 2


def test_polygons_of_one_size_go_by_id(spark):
    n = range(60)
    flat = lambda u, v, s: [c / d for x, y in ((u - s, v), (u, v - s / 2), (u + s, v), (u, v + s / 2)) for c, d in ((x, 864.0), (y, 648.0))]
    polys = spark.createDataFrame([("c", k, i, flat(100 + 7 * k + 3 * i, 320 + k + i, 38.0)) for k in n for i in (1, 2)], "clip_id string, frame_index long, poly_id long, polygon array<double>")
    dets = spark.createDataFrame([("c", k, k, 105.0 + 7 * k, 321.0 + k, 10) for k in n], "clip_id string, frame_index long, det_id long, u double, v double, size int")
    got = AS.cover_polygon(dets, AS.polygon_table(polys)).collect()
    assert {r.det_id: r.poly_id for r in got} == {k: 1 for k in n}


def test_attitude_mapping_does_not_copy_rows(spark, monkeypatch):
    import statistics

    from keelson.operators import reports
    rows = [(0.1 * ((7 * i) % 11), 0.2 * ((5 * i) % 13), 0.3 * ((3 * i) % 17), 0.1 * ((9 * i) % 19)) for i in range(40)]
    d = spark.createDataFrame(rows, "ref_pitch double, ref_roll double, imu_pitch double, imu_roll double")
    ranked = []
    exact = reports.exact_quantiles
    monkeypatch.setattr(reports, "exact_quantiles", lambda df, *a, **k: (ranked.append(df.count()), exact(df, *a, **k))[1])
    got = reports.attitude_mapping(d).collect()
    assert len(got) == 8 and ranked == [40]
    for r in got:
        mp = [r.sign_pitch * (x[3] if r.swap else x[2]) for x in rows]
        mr = [r.sign_roll * (x[2] if r.swap else x[3]) for x in rows]
        for ref, m, corr, off, resid in (([x[0] for x in rows], mp, r.corr_pitch, r.offset_pitch, r.resid_pitch), ([x[1] for x in rows], mr, r.corr_roll, r.offset_roll, r.resid_roll)):
            a, b = statistics.median(ref), statistics.median(m)
            cov = statistics.fmean((x - a) * (y - b) for x, y in zip(ref, m))
            gap = [x - y for x, y in zip(ref, m)]
            assert corr == pytest.approx(cov / (statistics.pstdev(ref) * statistics.pstdev(m))) and off == pytest.approx(statistics.median(gap)) and resid == pytest.approx(statistics.pstdev(gap))
    assert reports.attitude_mapping(d.filter("ref_pitch > 99")).count() == 0


def test_consecutive_matching_shuffles_points_once(spark):
    """Frames in blocks of four, a missing frame and a late one, against brute force."""
    rows = [("a", f, 100 * f + (900 if f > 12 else 0), 10 * f + k, (k * 37 + f * 11) % 23 / 10, (k * 29 + f * 7) % 19 / 10) for f in range(20) if f != 6 for k in range(9)]
    points = spark.createDataFrame(rows, "clip_id string, frame_index long, t_ms long, point_id long, x double, y double")
    m = R.match_consecutive(points, block=4)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1
    want = set()
    for f in range(20):
        used = set()
        cur, prev = ([r for r in rows if r[1] == g] for g in (f, f - 1))
        for d, a, b in sorted((math.sqrt((c[4] - p[4]) ** 2 + (c[5] - p[5]) ** 2), c[3], p[3]) for c in cur for p in prev if 0 < c[2] - p[2] <= 500):
            if d <= 0.5 and not {("l", a), ("r", b)} & used:
                used |= {("l", a), ("r", b)}
                want.add((f, a, b))
    got = [(r.frame_index, r.point_id, r.p_id) for r in m.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {f for f, _, _ in want} >= {4, 8, 12, 16} and not {6, 7, 13} & {f for f, _, _ in want}


def test_export_places_each_time_among_the_cuts_once(spark, monkeypatch):
    seen = []
    real = K06.mark_cut
    monkeypatch.setattr(K06, "mark_cut", lambda d, *a, **kw: (seen.append(d.count()), real(d, *a, **kw))[1])
    keys = [f"Lake1/frames/ts=00-00-{s:02d}.5.jpg" for s in range(10)] * 50 + ["Lake1/meta.json"] * 3 + ["Lake2/frames/ts=00-00-05.5.jpg"]
    cuts = spark.createDataFrame([("Lake1", "00:00:04.0", "00:00:06.5")], "clip_key string, start_ts string, end_ts string")
    got = [r.key for r in K06.export_listing(spark.createDataFrame([(k,) for k in keys], "key string"), cuts).collect()]
    assert sorted(got) == sorted(k for k in keys if not k.startswith("Lake1/frames") or k[22:24] not in ("04", "05", "06"))
    assert seen == [11]


def test_heading_is_costed_in_batches_and_agrees_with_a_plain_search(spark):
    import numpy as np

    hp, rng = S.HeadingPolicy(), np.random.default_rng(3)
    rows = []
    for k in range(200):
        m = (7, 2, 1)[k % 3]
        known = lambda hi: [None if rng.random() < 0.3 else float(x) for x in rng.uniform(0, hi, m)]
        rows.append(("c", k, [-45.0 + 15 * j for j in range(m)], [float(x) for x in rng.uniform(0, 0.9 if k % 4 else 0.3, m)], known(15), known(60)))
    d = spark.createDataFrame(rows, "clip_id string, frame_index long, centers array<double>, scores array<double>, min_range_m array<double>, ttc_s array<double>")
    planned = S.recommend_heading(d)
    assert "lambda" not in planned.select("best_cost")._jdf.queryExecution().optimizedPlan().toString().replace("\n", " ").split("costed", 1)[0]
    got = {r.frame_index: r for r in planned.collect()}
    for _, k, centers, scores, near, ttc in rows:
        costs = []
        for i in range(int(centers[-1] - centers[0]) + 1):
            th, worst = centers[0] + i, [0.0, 0.0, 0.0]
            for c, s, r, t in zip(centers, scores, near, ttc):
                block = 0.0 if s < hp.alert else 0.5 * (s - hp.alert) / (hp.blocked - hp.alert) if s < hp.blocked else 0.5 + 0.5 * (s - hp.blocked) / (1 - hp.blocked)
                amps = (block, 0.0 if s < hp.alert or r is None else 5 / (max(r, 0.5) + 5), 0.0 if s < hp.alert or t is None else 5 / (max(t, 0.5) + 5))
                worst = [max(w, a * math.exp(-(th - c) ** 2 / 288)) for w, a in zip(worst, amps)]
            b, n, t = worst[0], 0.3 * worst[1], 0.6 * worst[2]
            costs.append((b + n + t + 0.2 * min(abs(th) / 30, 1), i, th, b))
        cost, i, th, b = min(costs)
        rival = any(j != i and c <= (cost * 1.05 if cost else 1e-9) and abs(h - th) >= 30 for c, j, h, _ in costs)
        assert abs(got[k].best_cost - cost) < 1e-9
        assert got[k].heading_deg == (None if b >= hp.abstain or rival else th)
    empty = d.limit(1).select("clip_id", "frame_index", *[F.lit(None).cast("array<double>").alias(c) for c in ("centers", "scores", "min_range_m", "ttc_s")])
    assert S.recommend_heading(empty).select("heading_deg", "heading_reason").first() == (None, "all_blocked")
