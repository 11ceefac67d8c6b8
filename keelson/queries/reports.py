"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.fixtures import load, view
from keelson.functions import geometry as G
from keelson.functions.rounding import r6, tidy
from keelson.operators import association as AS
from keelson.operators import evaluate as E
from keelson.operators import radar as R
from keelson.operators import reports as P
from keelson.params import FISHEYE
from keelson.queries.catalog import query
from keelson.queries.evaluation import STRATA
from keelson.queries.radar import GATED, _kept
from keelson.queries.sectors import scored
from keelson.queries.vision import DETS, PAIRS, POLY, SD, detections


def matched(spark, sf):
    d = detections(spark, sf)
    return AS.aggregate_matches(d, AS.box_gate(d, AS.projected(_kept(spark, sf)))).withColumn("mono_range_m", F.col("range_m"))


@query("A26_J27_range_errors", "fx_radar", "fx_det", sql=PAIRS + """, e AS (SELECT cls, (range_m - rr) / rr AS e FROM mt WHERE range_m IS NOT NULL AND rr > 0)
SELECT cls, count(*) AS n, round(median(abs(e)), 5) AS median_abs_rel, round(avg(e), 5) AS mean_signed_rel, round(avg(CAST(abs(e) <= 0.2 AS DOUBLE)), 6) AS within_20pct FROM e GROUP BY 1""")
def range_errors(spark, sf):
    d = P.range_errors(matched(spark, sf), ["cls"], "range_m", "radar_range_m")
    return d.select("cls", "n", F.round("median_abs_rel", 5).alias("median_abs_rel"), F.round("mean_signed_rel", 5).alias("mean_signed_rel"), F.round("within_20pct", 6).alias("within_20pct"))


@query("J27_survey_ranges", "fx_det", sql=DETS + """ SELECT det_id, round(raw_range_m - (1 + det_id % 14), 4) + 0.0 AS error_m, round((raw_range_m - (1 + det_id % 14)) / (1 + det_id % 14), 4) + 0.0 AS rel_error FROM dd""")
def survey(spark, sf):
    d = view(spark, sf, "fx_det").filter("sensor = 'fisheye'").withColumn("true_m", (1 + F.col("det_id") % 14).cast("double"))
    s = P.survey_ranges(d, G.water_range(F.col("u").cast("double"), F.col("v") + F.col("size") / 2.0, FISHEYE, G.up_level()))
    return s.select("det_id", (F.round("error_m", 4) + F.lit(0.0)).alias("error_m"), (F.round("rel_error", 4) + F.lit(0.0)).alias("rel_error"))


@query("A45_range_change", "fx_det", sql=DETS + """, d AS (SELECT cls, raw_range_m * (0.5e0 + (det_id % 8) / 8e0) - raw_range_m AS d FROM dd WHERE raw_range_m IS NOT NULL AND det_id % 5 > 0)
SELECT cls, count(*) AS n, count(*) FILTER (abs(d) > 1e-9) AS changed, round(avg(d), 5) + 0.0 AS mean_delta_m, round(median(d), 5) + 0.0 AS median_delta_m, round(avg(CAST(d > 0 AS DOUBLE)), 6) AS share_farther FROM d GROUP BY 1""")
def range_change(spark, sf):
    d = detections(spark, sf).withColumn("after", F.expr("CASE WHEN det_id % 5 > 0 THEN raw_range_m * (0.5D + (det_id % 8) / 8D) END"))
    g = P.range_change(d, ["cls"], "raw_range_m", "after")
    return g.select("cls", "n", "changed", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("mean_delta_m", "median_delta_m")], F.round("share_farther", 6).alias("share_farther"))


@query("A27_association_report", "fx_radar", "fx_det", sql=PAIRS + """, r AS (SELECT cls, rr, radar_hits, range_m, CASE WHEN rr IS NOT NULL THEN angle_deg - radar_bearing_deg END AS re, CASE WHEN rr IS NOT NULL AND range_m IS NOT NULL THEN (range_m - rr) / rr END AS rl FROM mt)
SELECT cls, count(*) AS n_det, count(rr) AS n_matched, round(median(re), 5) + 0.0 AS resid_median, round(avg(re), 5) + 0.0 AS resid_mean, round(quantile_cont(re, 0.05), 5) AS resid_p5, round(quantile_cont(re, 0.95), 5) AS resid_p95,
 round(median(rl), 5) + 0.0 AS rel_median, round(avg(rl), 5) + 0.0 AS rel_mean, round(quantile_cont(rl, 0.05), 5) AS rel_p5, round(quantile_cont(rl, 0.95), 5) AS rel_p95, round(avg(CAST(abs(rl) <= 0.2 AS DOUBLE)), 5) AS within_20pct FROM r GROUP BY 1""")
def association_report(spark, sf):
    g = P.association_report(matched(spark, sf), ["cls"])
    return g.select(*[c if t != "double" else (F.round(c, 5) + F.lit(0.0)).alias(c) for c, t in g.dtypes])


@query("A27_gate_report", "fx_radar", "fx_det", sql=PAIRS + """
SELECT cls, count(*) AS n_det, count(*) FILTER (radar_hits > 0) AS n_matched, count(rr) AS n_radar_ranged, count(*) FILTER (rr IS NULL AND radar_hits > 0) AS n_compat_rejected, CAST(0 AS BIGINT) AS n_vetoed, round(median(rr), 6) AS median_radar_m, count(*) FILTER (range_m < 3) AS n_near FROM mt GROUP BY 1""")
def gate_report(spark, sf):
    return tidy(P.gate_report(matched(spark, sf), ["cls"]))


@query("A27_margin_sweep", "fx_radar", "fx_det", sql=PAIRS + POLY + """,
sp AS (SELECT pr.det_id, pr.point_id, d.raw_range_m IS NOT NULL AND pr.y < d.raw_range_m AS own, """ + SD.format(u="pr.pu", v="pr.pv", p="i.poly_id") + """ AS sd FROM pr JOIN dd d USING (det_id) JOIN inst i ON i.clip_id = pr.clip_id AND i.frame_index = pr.frame_index),
m AS (SELECT unnest([0e0, 12e0, 40e0, 120e0]) AS margin_px)
SELECT margin_px, round(count(*) FILTER (own AND sd >= -margin_px) / count(*) FILTER (own), 6) AS own_kept, round(count(*) FILTER (NOT own AND sd >= -margin_px) / count(*) FILTER (NOT own), 6) AS foreground_kept FROM sp, m GROUP BY 1""")
def margin_sweep(spark, sf):
    d = detections(spark, sf)
    pairs = AS.box_gate(d, AS.projected(_kept(spark, sf)))
    det = view(spark, sf, "fx_det").filter("sensor = 'thermal'")
    u, v, s = F.col("u") / 864.0, F.col("v") / 648.0, F.col("size") * 2.0
    inst = AS.polygon_table(det.select("clip_id", "frame_index", F.col("det_id").alias("poly_id"),
                                       F.array(u - s / 864, v, u, v - s / 1296, u + s / 864, v, u, v + s / 1296).alias("polygon")))
    j = pairs.join(inst.select("clip_id", "frame_index", "poly"), ["clip_id", "frame_index"])
    own = F.coalesce(F.col("y") < F.col("raw_range_m"), F.lit(False))
    j = j.select(own.alias("own"), G.signed_distance(F.col("pu"), F.col("pv"), F.col("poly")).alias("sd"))
    return tidy(P.margin_sweep(j, [0.0, 12.0, 40.0, 120.0]))


@query("A28_clutter_occupancy", "fx_radar", sql=""", g AS (SELECT unnest(range(12)) AS ix), h AS (SELECT unnest(range(6)) AS iy),
p AS (SELECT least(11, CAST(floor((x + 1.5e0) / 0.25e0) AS BIGINT)) AS ix, CAST(floor((y - 0.5e0) / 0.25e0) AS BIGINT) AS iy, count(*) AS n FROM fx_radar WHERE y >= 0.5 AND sqrt(x*x + y*y) < 2 AND abs(coalesce(v, 0)) <= 0.1217e0 * 1.05e0 AND x BETWEEN -1.5 AND 1.5 GROUP BY 1, 2)
SELECT g.ix, h.iy, round(coalesce(n, 0) / (SELECT count(DISTINCT (clip_id, frame_index)) FROM fx_radar), 9) AS per_frame FROM g CROSS JOIN h LEFT JOIN p ON p.ix = g.ix AND p.iy = h.iy""")
def clutter(spark, sf):
    d = view(spark, sf, "fx_radar")
    return P.clutter_map(d, d.select("clip_id", "frame_index").distinct()).withColumn("per_frame", F.round("per_frame", 9))


@query("A28_J24_clutter_what_if", "fx_radar", sql=""", z AS (SELECT * FROM (VALUES (0, 0.15e0, -0.75e0, 0.25e0, 0e0, 1.2e0), (1, 0.3e0, -1e0, 0.25e0, 0e0, 1.3e0), (2, 0.6e0, -1e0, 1e0, 0e0, 1.3e0)) t(zone, h, a, b, c, d)),
p AS (SELECT *, greatest(-45e0, least(45e0, round_even(degrees(atan2(x, y)) / 15, 0) * 15)) AS bc, abs(coalesce(v, 0)) AS av FROM fx_radar WHERE y BETWEEN 0.2 AND 9 AND sqrt(x*x + y*y) < 1.3),
s AS (SELECT zone, clip_id, frame_index, bc, arg_min(CASE WHEN x BETWEEN -0.75 AND 0.25 AND y <= 1.2 THEN CASE WHEN av < 2.2e0 * 0.1217e0 THEN 'in_box_noise' ELSE 'in_box_doppler' END WHEN x < -0.75 AND y < 1.3 THEN 'port_fringe' ELSE 'other' END, point_id) AS o
 FROM p, z WHERE NOT (x BETWEEN a AND b AND y BETWEEN c AND d AND av <= h) GROUP BY 1, 2, 3, 4),
t AS (SELECT clip_id, frame_index, -45e0 + 15 * b AS bc, CASE WHEN frame_index % 3 > 0 THEN (frame_index + b) % 2 END AS y FROM (SELECT DISTINCT clip_id, frame_index FROM fx_radar), (SELECT unnest(range(7)) AS b))
SELECT CAST(zone AS BIGINT) AS zone, count(*) AS rows, count(*) FILTER (y = 1) AS label_pos, count(*) FILTER (y = 0) AS label_neg, count(*) FILTER (y IS NULL) AS unlabelled, count(*) FILTER (o = 'in_box_noise') AS in_box_noise, count(*) FILTER (o = 'in_box_doppler') AS in_box_doppler,
 count(*) FILTER (o = 'port_fringe') AS port_fringe, count(*) FILTER (o = 'other') AS other FROM s LEFT JOIN t USING (clip_id, frame_index, bc) GROUP BY 1""")
def what_if(spark, sf):
    d = view(spark, sf, "fx_radar")
    t = R.dense_bins(d.select("clip_id", "frame_index").distinct()).select(
        "clip_id", "frame_index", "bin_center_deg", F.expr("CASE WHEN frame_index % 3 > 0 THEN (frame_index + bin_index) % 2 END").alias("y_nav"))
    keys = ("keep_above", "x_min", "x_max", "y_lo", "y_hi")
    zones = [dict(zip(keys, v)) for v in ((0.15, -0.75, 0.25, 0.0, 1.2), (0.3, -1.0, 0.25, 0.0, 1.3), (0.6, -1.0, 1.0, 0.0, 1.3))]
    return tidy(P.clutter_what_if(d, t, zones, 0.2, 9.0))


GTV = """, gi AS (SELECT clip_id, frame_index, det_id AS gt_id, cls, degrees(atan2(u - size * 2e0 - 444.11e0, 418.51e0)) AS a, degrees(atan2(u + size * 2e0 - 444.11e0, 418.51e0)) AS b FROM fx_det WHERE sensor = 'fisheye'),
gt AS (SELECT clip_id, frame_index, gt_id, cls, greatest(a, -77e0 / 2.82e0) AS lo, least(b, 82e0 / 2.82e0) AS hi FROM gi WHERE b >= -77e0 / 2.82e0 AND a <= 82e0 / 2.82e0 AND least(b, 82e0 / 2.82e0) - greatest(a, -77e0 / 2.82e0) <= 16),
fr AS (SELECT DISTINCT clip_id, frame_index FROM fx_det WHERE sensor = 'fisheye'),
rk AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS r FROM fr),
ds AS (SELECT d.clip_id, d.frame_index, det_id, (u / 5.4e0 - 77) / 2.82e0 AS a FROM fx_det d JOIN fr USING (clip_id, frame_index) WHERE sensor = 'thermal'),
cl AS (SELECT gt_id, clip_id, frame_index, unnest(range(greatest(0, CAST(trunc((lo + 77e0 / 2.82e0) / 2) AS BIGINT)), least(28, CAST(trunc((hi + 77e0 / 2.82e0) / 2) AS BIGINT)) + 1)) AS cell, (SELECT 1) AS one FROM gt),
oc AS (SELECT clip_id, cell, count(DISTINCT frame_index) AS k FROM cl GROUP BY 1, 2), tf AS (SELECT clip_id, count(*) AS nf FROM fr GROUP BY 1),
st AS (SELECT gt_id, avg(CASE WHEN k >= 0.15e0 * nf THEN 1e0 ELSE 0e0 END) >= 0.5 AS static FROM cl JOIN oc USING (clip_id, cell) JOIN tf USING (clip_id) GROUP BY 1)"""


def truth(spark, sf):
    d = view(spark, sf, "fx_det").filter("sensor = 'fisheye'").withColumn("gt_id", F.col("det_id"))
    frames = d.select("clip_id", "frame_index").distinct()
    u, s = F.col("u").cast("double"), F.col("size") * 2.0
    gt = P.gt_intervals(d, G.bearing_pinhole(u - s, FISHEYE), G.bearing_pinhole(u + s, FISHEYE), P.THERMAL_FOV, max_width=16.0).select("clip_id", "frame_index", "gt_id", "cls", "lo_deg", "hi_deg")
    dets = view(spark, sf, "fx_det").filter("sensor = 'thermal'").join(frames, ["clip_id", "frame_index"], "left_semi").select(
        "clip_id", "frame_index", "det_id", ((F.col("u") / 5.4 - 77) / 2.82).alias("angle_deg"))
    return P.mark_static(gt, frames, P.THERMAL_FOV), dets, frames


@query("F09_gt_intervals", "fx_det", sql=GTV + " SELECT gt.gt_id, cls, round(lo, 6) + 0.0 AS lo_deg, round(hi, 6) + 0.0 AS hi_deg, coalesce(static, false) AS static FROM gt LEFT JOIN st USING (gt_id)")
def gt_static(spark, sf):
    return truth(spark, sf)[0].select("gt_id", "cls", r6("lo_deg"), r6("hi_deg"), "static")


@query("J12_A29_bearing_report", "fx_radar", "fx_det", sql=GATED + GTV + """,
hg AS (SELECT g.gt_id, coalesce(static, false) AS static, EXISTS (SELECT 1 FROM ds d WHERE d.clip_id = g.clip_id AND d.frame_index = g.frame_index AND d.a BETWEEN lo - 3 AND hi + 3) AS hit FROM gt g LEFT JOIN st USING (gt_id)),
dl AS (SELECT f.clip_id, f.frame_index, lo, hi FROM rk f JOIN rk o ON o.clip_id = f.clip_id AND o.r BETWEEN f.r - 2 AND f.r + 2 JOIN gt ON gt.clip_id = o.clip_id AND gt.frame_index = o.frame_index),
tp AS (SELECT d.det_id, min(CASE WHEN a BETWEEN lo AND hi THEN 0e0 ELSE least(abs(a - lo), abs(a - hi)) END) AS e FROM ds d JOIN dl ON dl.clip_id = d.clip_id AND dl.frame_index = d.frame_index AND a BETWEEN lo - 3 AND hi + 3 GROUP BY 1),
dd AS (SELECT d.det_id, e, EXISTS (SELECT 1 FROM pol p WHERE p.clip_id = d.clip_id AND p.frame_index = d.frame_index AND abs(p.ang - d.a) <= 3) AS rd FROM ds d LEFT JOIN tp USING (det_id)),
x AS (SELECT count(*) AS n_det, count(e) AS n_tp, count(*) FILTER (e IS NULL AND rd) AS n_radar, count(*) FILTER (e IS NULL AND NOT rd) AS n_fp, avg(e) AS mae FROM dd),
y AS (SELECT count(*) AS n_gt, count(*) FILTER (hit) AS nr, count(*) FILTER (static) AS ns, count(*) FILTER (static AND hit) AS rs FROM hg)
SELECT (SELECT count(*) FROM fr) AS n_frames, n_gt, n_det, n_tp, n_radar, n_fp, round(nr / n_gt, 6) AS recall, round(CASE WHEN ns > 0 THEN rs / ns END, 6) AS recall_static, round((nr - rs) / (n_gt - ns), 6) AS recall_moving, round(n_tp / n_det, 6) AS precision_strict,
 round(n_tp / (n_tp + n_fp), 6) AS precision_lenient, round(2 * (n_tp / (n_tp + n_fp)) * (nr / n_gt) / (n_tp / (n_tp + n_fp) + nr / n_gt), 6) AS f1, round(mae, 6) AS bearing_mae, round(n_fp / (SELECT count(*) FROM fr), 6) AS fp_per_frame FROM x, y""")
def bearing_report(spark, sf):
    gt, dets, frames = truth(spark, sf)
    radar = R.with_polar(_kept(spark, sf))
    g, d = P.bearing_matches(dets, gt, radar, 3.0, P.dilated(gt, frames, 2))
    return tidy(P.bearing_report(g, d, frames))


@query("A29_bearing_bins", "fx_det", sql=GTV + """, v AS (SELECT unnest([{'i': 1, 'a': -37.5e0}, {'i': 2, 'a': -22.5e0}, {'i': 3, 'a': -7.5e0}, {'i': 4, 'a': 7.5e0}, {'i': 5, 'a': 22.5e0}]) AS z),
g AS (SELECT DISTINCT clip_id, frame_index, z.i AS b FROM gt JOIN v ON lo < z.a + 15 AND hi >= z.a), d AS (SELECT DISTINCT clip_id, frame_index, CAST(floor((a + 52.5) / 15) AS BIGINT) AS b FROM ds WHERE CAST(floor((a + 52.5) / 15) AS BIGINT) BETWEEN 1 AND 5)
SELECT count(*) FILTER (g.b IS NOT NULL AND d.b IS NOT NULL) AS bin_tp, count(*) FILTER (g.b IS NULL) AS bin_fp, count(*) FILTER (d.b IS NULL) AS bin_fn FROM g FULL JOIN d ON g.clip_id = d.clip_id AND g.frame_index = d.frame_index AND g.b = d.b""")
def bearing_bins(spark, sf):
    gt, dets, _ = truth(spark, sf)
    return P.bearing_bins(gt, dets, P.THERMAL_FOV)


@query("J28_interval_overlap", "fx_det", sql=GTV + """, pv AS (SELECT clip_id, frame_index, det_id, (u / 5.4e0 - size / 2e0 - 77) / 2.82e0 AS pl, (u / 5.4e0 + size * 2e0 - 77) / 2.82e0 AS ph FROM fx_det WHERE sensor = 'thermal'), p AS (SELECT * FROM pv WHERE ph - pl <= 35),
h AS (SELECT cls, EXISTS (SELECT 1 FROM p WHERE p.clip_id = g.clip_id AND p.frame_index = g.frame_index AND pl <= hi + 6 AND ph >= lo - 6) AS hit FROM gt g), t AS (SELECT EXISTS (SELECT 1 FROM gt g WHERE p.clip_id = g.clip_id AND p.frame_index = g.frame_index AND pl <= hi + 6 AND ph >= lo - 6) AS tp FROM p)
SELECT cls, count(*) AS n_gt, count(*) FILTER (hit) AS n_recalled, (SELECT count(*) FILTER (tp) FROM t) AS n_tp, (SELECT count(*) FROM t) AS n_pred FROM h GROUP BY 1""")
def overlap(spark, sf):
    gt, _, _ = truth(spark, sf)
    u, s = F.col("u") / 5.4, F.col("size")
    pred = view(spark, sf, "fx_det").filter("sensor = 'thermal'").select("clip_id", "frame_index", F.col("det_id").alias("pred_id"), ((u - s / 2.0 - 77) / 2.82).alias("lo_deg"), ((u + s * 2.0 - 77) / 2.82).alias("hi_deg"))
    g, p = P.interval_overlap(pred, gt, 6.0)
    t = p.agg(F.count_if("tp").alias("n_tp"), F.count("*").alias("n_pred")).withColumn("k", F.lit(1))
    return g.groupBy("cls").agg(F.count("*").alias("n_gt"), F.count_if("hit").alias("n_recalled")).withColumn("k", F.lit(1)).join(t, "k").drop("k")


def banded(spark, sf):
    e = F.col("sun_elevation_deg")
    return view(spark, sf, "fx_scores").withColumn("band", F.when(e > 6, "day").when(e < -6, "night").otherwise("dusk"))


BAND = """, b AS (SELECT *, CASE WHEN sun_elevation_deg > 6 THEN 'day' WHEN sun_elevation_deg < -6 THEN 'night' ELSE 'dusk' END AS band FROM fx_scores)"""


@query("A30_handover_table", "fx_scores", sql=BAND + " SELECT band, hit_fisheye, hit_thermal, hit_mmwave, count(*) AS n, round(avg(p), 6) AS mean_p FROM b GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20")
def handover(spark, sf):
    return tidy(P.handover_table(banded(spark, sf)))


def _elim(n):
    steps, prev = [], "m0"
    for k in range(n):
        cols = []
        for i in range(n):
            for j in range(n + 1):
                cols.append(f"a{i}_{j}" if i == k or j <= k else f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}")
        steps.append(f"m{k + 1} AS (SELECT band, n, {', '.join(cols)} FROM {prev})")
        prev = f"m{k + 1}"
    return ", ".join(steps)


_X = ["1e0", "hit_fisheye", "hit_thermal", "hit_mmwave"]


@query("A30_handover_fit", "fx_scores", sql=BAND + ", m0 AS (SELECT band, count(*) AS n, " + ", ".join(f"sum(({_X[i]}) * ({_X[j] if j < 4 else 'p'}))::DOUBLE AS a{i}_{j}" for i in range(4) for j in range(5)) + " FROM b GROUP BY 1 HAVING count(*) >= 50), " + _elim(4) + """
SELECT band, n, round(a0_4 / a0_0, 6) AS w_bias, round(a1_4 / a1_1, 6) + 0.0 AS w_fisheye, round(a2_4 / a2_2, 6) + 0.0 AS w_thermal, round(a3_4 / a3_3, 6) + 0.0 AS w_radar FROM m4""")
def handover_fit(spark, sf):
    return tidy(P.handover_fit(banded(spark, sf)))


@query("A31_bucket_medians", "fx_scores", sql=""", t AS (SELECT clip_id, min(t_ms) AS t0 FROM fx_scores GROUP BY 1), b AS (SELECT clip_id, CAST(floor((t_ms - t0) / 7000e0) AS BIGINT) AS bucket, t_ms, p, CAST(floor(t_ms / 60000e0) AS BIGINT) AS mi FROM fx_scores JOIN t USING (clip_id)),
m AS (SELECT clip_id, mi AS minute, avg(p) AS mp FROM b GROUP BY 1, 2)
SELECT clip_id, bucket, count(*) AS n, round(median(t_ms / 1000e0), 6) AS t_mid, round(median(p), 6) AS value, (SELECT count(*) FROM m WHERE m.clip_id = b.clip_id) AS n_minutes FROM b GROUP BY 1, 2 HAVING count(*) >= 3""")
def medians(spark, sf):
    d = scored(spark, sf)
    m = P.per_minute(d, ["clip_id"], "t_s", "p").groupBy("clip_id").agg(F.count("*").alias("n_minutes"))
    return tidy(P.bucket_medians(d, ["clip_id"], "t_s", "p", 7.0).join(m, "clip_id"))


TRV = """WITH ev AS (SELECT floor(event_id / 40e0) AS launch, event_id % 40 AS pos, CASE WHEN floor(event_id / 40e0) % 2 = 0 THEN NULL ELSE 2 END AS tr, * FROM events),
te AS (SELECT CAST(launch AS BIGINT) AS launch, pos, coalesce(tr, 1) AS trial, CASE WHEN pos = 0 THEN 'start' WHEN pos = 1 THEN 'hardware' WHEN pos IN (2, 12) THEN 'decide' WHEN pos IN (3, 13) THEN 'checkpoint' WHEN pos IN (4, 36, 39) THEN 'phase' WHEN pos % 3 = 0 THEN 'cycle' WHEN pos = 37 THEN 'station' ELSE 'sectors' END AS kind,
 pos * 1.5e0 AS t_s, CASE WHEN pos <= 4 THEN 'GO' WHEN pos = 36 THEN 'STATION' WHEN pos = 39 THEN 'DONE' ELSE 'GO' END AS phase, CASE WHEN user_id % 4 = 0 THEN 'ok' WHEN user_id % 4 = 1 THEN 'blocked' ELSE 'fixed' END AS result,
 CASE user_id % 5 WHEN 0 THEN 'checkpoint reached' WHEN 1 THEN 'abort: operator' WHEN 2 THEN 'link stale' WHEN 3 THEN 'timeout' ELSE 'drifted' END AS why, (event_id * 7 % 90) - 45e0 AS rel, (event_id * 13 % 360) * 1e0 AS ab, (event_id * 17 % 360) * 1e0 AS hd, value AS dist,
 46e0 + (event_id * 3 % 100) / 1e5 AS lat, 9e0 + (event_id * 7 % 100) / 1e5 AS lon, CASE WHEN pos = 37 AND user_id % 3 = 0 THEN 'square' END AS pattern, user_id, event_type, event_id FROM ev)"""


def trial_events(spark, sf):
    e = load(spark, sf, "events").selectExpr("CAST(floor(event_id / 40e0) AS BIGINT) AS launch", "event_id % 40 AS pos", "*")
    return P.normalise_trials(e.selectExpr(
        "launch", "pos", "CASE WHEN launch % 2 = 0 THEN NULL ELSE 2 END AS trial",
        "CASE WHEN pos = 0 THEN 'start' WHEN pos = 1 THEN 'hardware' WHEN pos IN (2, 12) THEN 'decide' WHEN pos IN (3, 13) THEN 'checkpoint' WHEN pos IN (4, 36, 39) THEN 'phase' WHEN pos % 3 = 0 THEN 'cycle' WHEN pos = 37 THEN 'station' ELSE 'sectors' END AS kind",
        "pos * 1.5e0 AS t_s", "CASE WHEN pos <= 4 THEN 'GO' WHEN pos = 36 THEN 'STATION' WHEN pos = 39 THEN 'DONE' ELSE 'GO' END AS phase",
        "CASE WHEN user_id % 4 = 0 THEN 'ok' WHEN user_id % 4 = 1 THEN 'blocked' ELSE 'fixed' END AS result",
        "CASE user_id % 5 WHEN 0 THEN 'checkpoint reached' WHEN 1 THEN 'abort: operator' WHEN 2 THEN 'link stale' WHEN 3 THEN 'timeout' ELSE 'drifted' END AS why",
        "(event_id * 7 % 90) - 45e0 AS rel_heading_deg", "(event_id * 13 % 360) * 1e0 AS abs_heading_deg", "(event_id * 17 % 360) * 1e0 AS heading", "value AS distance_m",
        "46e0 + (event_id * 3 % 100) / 1e5 AS lat", "9e0 + (event_id * 7 % 100) / 1e5 AS lon", "CASE WHEN pos = 37 AND user_id % 3 = 0 THEN 'square' END AS pattern",
        "CASE WHEN pos = 0 AND user_id % 2 = 0 THEN concat('run ', user_id) END AS name", "CASE WHEN pos = 0 THEN event_type END AS note", "CASE WHEN pos = 1 THEN CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS dry_run",
        "CASE WHEN pos IN (2, 12) THEN (event_id * 3 % 100) / 100e0 END AS field_p", "CASE WHEN pos IN (2, 12) THEN event_id % 9 END AS n_records",
        "transform(sequence(0, 6), i -> i * 15e0 - 45e0) AS bins", "transform(sequence(0, 6), i -> ((event_id * 31 + i * 17) % 100) / 100e0) AS p",
        "transform(sequence(0, 6), i -> CASE WHEN (event_id + i) % 3 = 0 THEN NULL ELSE ((event_id * 11 + i * 7) % 90) / 10e0 END) AS min_range_m"))


@query("S12_A32_trial_summary", sql=TRV + """,
b AS (SELECT launch, trial, count(*) FILTER (kind = 'decide') AS decisions, count(*) FILTER (kind = 'decide' AND result = 'blocked') AS refused, arg_max(rel, pos) FILTER (kind = 'decide' AND result <> 'blocked') AS rel_heading_deg, arg_max(ab, pos) FILTER (kind = 'checkpoint') AS abs_heading_deg,
 arg_max(dist, pos) FILTER (kind = 'checkpoint') AS checkpoint_m, max(CASE WHEN kind = 'phase' AND phase = 'GO' THEN t_s END) AS go, max(CASE WHEN kind = 'phase' AND phase = 'STATION' THEN t_s END) AS st, max(CASE WHEN kind = 'phase' AND phase = 'DONE' THEN t_s END) AS dn, max(CASE WHEN kind = 'phase' AND phase = 'DONE' THEN why END) AS wy,
 max(CASE WHEN pos = 0 AND user_id % 2 = 0 THEN concat('run ', user_id) END) AS name, max(CASE WHEN pos = 0 THEN event_type END) AS note, bool_or(user_id % 3 = 1) FILTER (pos = 1) AS armed, arg_max((event_id * 3 % 100) / 100e0, pos) FILTER (kind = 'decide' AND result <> 'blocked') AS field_p,
 arg_max(event_id % 9, pos) FILTER (kind = 'decide' AND result <> 'blocked') AS n_records_hold, CASE WHEN count(*) FILTER (pos = 37) > 0 THEN coalesce(max(pattern), 'hold') END AS station_pattern FROM te GROUP BY 1, 2),
cp AS (SELECT launch, trial, pos, ab, lead(pos, 1, 1000) OVER (PARTITION BY launch, trial ORDER BY pos) AS nx FROM te WHERE kind = 'checkpoint'),
s AS (SELECT t.launch, t.trial, t.event_id, t.pos, (cp.ab - hd + 180) - floor((cp.ab - hd + 180) / 360) * 360 - 180 AS course, unnest(range(7)) AS i FROM te t JOIN cp ON cp.launch = t.launch AND cp.trial = t.trial AND t.pos > cp.pos AND t.pos < cp.nx WHERE kind = 'sectors' AND phase = 'GO'),
sn AS (SELECT *, CASE WHEN (event_id + i) % 3 = 0 THEN NULL ELSE ((event_id * 11 + i * 7) % 90) / 10e0 END AS rg FROM s WHERE abs(i * 15 - 45 - course) <= 15),
c AS (SELECT launch, trial, max(((event_id * 31 + i * 17) % 100) / 100e0) AS mp, min(rg) AS cm, arg_min(i * 15e0 - 45, [rg, pos, i]) FILTER (rg IS NOT NULL) AS cd FROM sn GROUP BY 1, 2)
SELECT launch, CAST(trial AS BIGINT) AS trial, decisions, refused, rel_heading_deg + 0.0 AS rel_heading_deg, abs_heading_deg, checkpoint_m, CASE WHEN dn IS NULL THEN 'no log' WHEN wy LIKE 'checkpoint reached%' THEN 'reached' WHEN wy LIKE 'abort%' THEN 'abort' WHEN wy LIKE '%stale%' THEN 'stale link' WHEN wy LIKE '%timeout%' THEN 'timeout' ELSE wy END AS outcome,
 round(coalesce(st, dn) - go, 1) AS go_s, round(dn - st, 1) AS station_s, round(mp, 2) AS max_p_course, round(cm, 1) AS closest_m, cd AS closest_deg, name, note, armed, field_p, n_records_hold, station_pattern, go * 0 + 4.5e0 + CASE WHEN checkpoint_m IS NULL THEN NULL ELSE 15e0 END AS t_decide_s FROM b LEFT JOIN c USING (launch, trial)""")
def trials(spark, sf):
    t = P.trial_summary(trial_events(spark, sf))
    return tidy(t.select("launch", "trial", "decisions", "refused", "rel_heading_deg", "abs_heading_deg", "checkpoint_m", "outcome", "go_s", "station_s", "max_p_course", "closest_m", "closest_deg", "name", "note", "armed", "field_p", "n_records_hold", "station_pattern", "t_decide_s"))


@query("A32_trial_geometry", sql=TRV + """, f AS (SELECT launch, trial, arg_min(lat, pos) AS la, arg_min(lon, pos) AS lo, arg_max(lat, pos) AS lb, arg_max(lon, pos) AS lp, count(*) AS n FROM te WHERE kind = 'cycle' GROUP BY 1, 2),
d AS (SELECT launch, trial, max(pos) AS pos, arg_max(event_id, pos) AS e FROM te WHERE kind = 'decide' AND result <> 'blocked' GROUP BY 1, 2), t AS (SELECT launch, trial, e, unnest(range(7)) AS i FROM d),
o AS (SELECT launch, trial, max(((e * 31 + i * 17) % 100) / 100e0) AS mp, arg_max(i, [((e * 31 + i * 17) % 100), -i]) AS bi FROM t GROUP BY 1, 2)
SELECT launch, CAST(trial AS BIGINT) AS trial, round(sqrt(pow((lp - lo) * 111320e0 * cos(radians(la)), 2) + pow((lb - la) * 111320e0, 2)), 5) AS moved_m, CASE WHEN mp >= 0.6 THEN bi * 15e0 - 45 END AS obstacle_bin_deg, coalesce(n, 0) / 10e0 AS leg_s
FROM (SELECT DISTINCT launch, trial FROM te) x LEFT JOIN f USING (launch, trial) LEFT JOIN o USING (launch, trial)""")
def trial_geometry(spark, sf):
    g = P.trial_geometry(trial_events(spark, sf))
    return g.select("launch", F.col("trial").cast("bigint").alias("trial"), F.round("moved_m", 5).alias("moved_m"), (F.col("obstacle_bin_deg") + F.lit(0.0)).alias("obstacle_bin_deg"), "leg_s")


@query("J20_hold_window", "fx_scores", sql=""", d AS (SELECT DISTINCT clip_id, frame_index AS decision_id, t_ms AS td FROM fx_scores)
SELECT d.clip_id, decision_id, bin_index, count(*) AS n, round(median(p), 6) AS median_p FROM d JOIN fx_scores s ON s.clip_id = d.clip_id AND s.t_ms >= td - 10000 AND s.t_ms < td + 600 GROUP BY 1, 2, 3""")
def hold(spark, sf):
    d = scored(spark, sf)
    dec = d.select("clip_id", F.col("frame_index").alias("decision_id"), "t_s").distinct()
    return tidy(P.hold_window(dec, d))


@query("J21_frame_at_instant", "fx_radar", "fx_imu", sql=""", f AS (SELECT clip_id, frame_index, min(t_ms) AS t_ms FROM fx_radar GROUP BY 1, 2), l AS (SELECT clip_id, arg_max(frame_index, t_ms) AS lf FROM f GROUP BY 1)
SELECT i.clip_id, i.row_no AS instant_id, coalesce((SELECT min(f.frame_index) FROM f WHERE f.clip_id = i.clip_id AND f.t_ms >= i.t_ms AND f.t_ms <= i.t_ms + 360000), lf) AS frame_index FROM fx_imu i JOIN l USING (clip_id)""")
def frame_at(spark, sf):
    f = view(spark, sf, "fx_radar").groupBy("clip_id", "frame_index").agg(F.min("t_ms").alias("t_ms"))
    return P.frame_at(view(spark, sf, "fx_imu").select("clip_id", F.col("row_no").alias("instant_id"), "t_ms"), f)


@query("A33_service_timing", "fx_scores", sql=""", r AS (SELECT clip_id, t_ms / 1000e0 AS t_s, 50e0 + (row_id * 37 % 600) AS tick, CASE WHEN row_id % 4 > 0 THEN (row_id % 90) / 100e0 END AS lat, row_id % 3 > 0 AS sf, CASE WHEN row_id % 2 = 0 THEN row_id % 5 > 0 END AS yf, row_id % 11 > 0 AS sk, row_id % 13 AS sr, 600e0 + row_id % 1200 AS ck, 40e0 + row_id % 45 AS tc, CASE WHEN row_id % 900 = 1 THEN '0x5' ELSE '0x0' END AS th FROM (SELECT clip_id, max(t_ms) AS t_ms, max(row_id) AS row_id FROM fx_scores GROUP BY clip_id, frame_index))
SELECT clip_id, count(*) AS n, round((count(*) - 1) / (max(t_s) - min(t_s)), 6) AS rate_hz, round(quantile_cont(tick, 0.5), 6) AS tick_p50, round(quantile_cont(tick, 0.95), 6) AS tick_p95, round(avg(CAST(tick > 333.3 AS DOUBLE)), 6) AS over_budget, round(median(lat), 6) AS latency_p50, round(avg(CAST(sf AS DOUBLE)), 6) AS seg_fresh,
 round(avg(CAST(yf AS DOUBLE)), 6) AS yolo_fresh, round(avg(CAST(sk AS DOUBLE)), 6) AS scorer_ok, max(sr) AS skipped_rows, median(ck) AS clock_mhz, min(ck) AS clock_min, max(tc) AS temp_max, bool_or(th <> '0x0') AS throttled_any FROM r GROUP BY 1""")
def timing(spark, sf):
    d = scored(spark, sf).groupBy("clip_id", "frame_index").agg(F.max("t_s").alias("t_s"), F.max("row_id").alias("row_id")).selectExpr(
        "clip_id", "t_s", "50e0 + (row_id * 37 % 600) AS tick_ms", "CASE WHEN row_id % 4 > 0 THEN (row_id % 90) / 100e0 END AS source_latency_s", "row_id % 3 > 0 AS seg_fresh",
        "CASE WHEN row_id % 2 = 0 THEN row_id % 5 > 0 END AS yolo_fresh", "row_id % 11 > 0 AS scorer_ok", "row_id % 13 AS skipped_rows", "600e0 + row_id % 1200 AS clock_mhz", "40e0 + row_id % 45 AS temp_c",
        "CASE WHEN row_id % 900 = 1 THEN '0x5' ELSE '0x0' END AS throttled")
    return tidy(P.service_timing(d, ["clip_id"]))


SWEEP = """, c AS (SELECT * FROM (VALUES (0, 0.5e0, 9e0, 0.3e0, 15e0), (1, 1e0, 6e0, 0.3e0, 15e0), (2, 0.5e0, 9e0, 0.6e0, 15e0), (3, 4e0, 5e0, 0.3e0, 5e0)) t(combo, a, b, h, st)),
fr AS (SELECT DISTINCT split_part(clip_id, '/', 1) AS scene, clip_id, frame_index FROM fx_radar),
g AS (SELECT combo, clip_id, frame_index, min(y) AS mr FROM fx_radar, c WHERE y BETWEEN a AND b AND NOT (x BETWEEN -1 AND 0.25 AND y BETWEEN 0 AND 1.3 AND abs(coalesce(v, 0)) <= h) AND degrees(atan2(x, y)) >= -52.5 AND degrees(atan2(x, y)) < 52.5 GROUP BY 1, 2, 3),
pf AS (SELECT c.combo, scene, fr.clip_id, fr.frame_index, CASE WHEN mr IS NOT NULL THEN 1e0 / 3 ELSE 0e0 END AS ms, mr FROM fr CROSS JOIN c LEFT JOIN g ON g.combo = c.combo AND g.clip_id = fr.clip_id AND g.frame_index = fr.frame_index),
sm AS (SELECT combo, scene, count(*) AS n_frames, avg(CAST(ms >= 0.33 AS DOUBLE)) AS hit_rate, avg(ms) AS mm, avg(mr) AS mr FROM pf GROUP BY 1, 2)"""
COMBOS = [dict(zip(("y_min", "y_max", "keep_above", "step"), v)) for v in ((0.5, 9, 0.3, 15), (1, 6, 0.3, 15), (0.5, 9, 0.6, 15), (4, 5, 0.3, 5))]


def sweep_frames(spark, sf):
    d = view(spark, sf, "fx_radar").withColumn("scene", F.split("clip_id", "/")[0])
    return P.sweep(d, d.select("scene", "clip_id", "frame_index").distinct(), COMBOS)


@query("A39_sweep_summary", "fx_radar", sql=SWEEP + " SELECT CAST(combo AS BIGINT) AS combo, scene, n_frames, round(hit_rate, 6) AS hit_rate, round(mm, 6) AS mean_max_score, round(mr, 6) AS mean_min_range, round(CASE WHEN scene = 'Lake3' THEN hit_rate ELSE 0 END, 6) AS fp_proxy FROM sm")
def sweep_summary(spark, sf):
    return tidy(P.sweep_summary(sweep_frames(spark, sf), "Lake3"))


@query("T03_K05_sweep_ranking", "fx_radar", sql=SWEEP + " SELECT CAST(combo AS BIGINT) AS combo, round(sum(CASE scene WHEN 'Lake0' THEN 0.4e0 WHEN 'Lake1' THEN 0.3e0 WHEN 'Lake3' THEN 0.2e0 ELSE 0e0 END * CASE WHEN scene = 'Lake3' THEN 1 - hit_rate ELSE hit_rate END), 6) AS proxy FROM sm GROUP BY 1")
def sweep_ranking(spark, sf):
    return tidy(P.sweep_ranking(P.sweep_summary(sweep_frames(spark, sf), "Lake3"), {"Lake0": 0.4, "Lake1": 0.3, "Lake3": 0.2}, "Lake3"))


@query("A40_attitude_mapping", "fx_imu", sql=""", b AS (SELECT radians(pitch) * -0.9e0 + radians(yaw) / 50 AS rp, radians(roll) * 0.8e0 + 0.02e0 AS rr, radians(pitch) AS ip, radians(roll) AS ir FROM fx_imu),
c AS (SELECT * FROM (SELECT unnest([false, true]) AS swap), (SELECT unnest([1e0, -1e0]) AS sp), (SELECT unnest([1e0, -1e0]) AS sr)),
d AS (SELECT swap, sp, sr, rp, rr, sp * CASE WHEN swap THEN ir ELSE ip END AS mp, sr * CASE WHEN swap THEN ip ELSE ir END AS mr FROM b, c),
m AS (SELECT swap, sp, sr, median(rp) AS rpm, median(rr) AS rrm, median(mp) AS mpm, median(mr) AS mrm, stddev_pop(rp) AS rps, stddev_pop(rr) AS rrs, stddev_pop(mp) AS mps, stddev_pop(mr) AS mrs FROM d GROUP BY 1, 2, 3)
SELECT swap, sp AS sign_pitch, sr AS sign_roll, count(*) AS n, round(avg((rp - rpm) * (mp - mpm)) / (max(rps) * max(mps)), 5) + 0.0 AS corr_pitch, round(avg((rr - rrm) * (mr - mrm)) / (max(rrs) * max(mrs)), 5) + 0.0 AS corr_roll, round(median(rp - mp), 5) + 0.0 AS offset_pitch, round(median(rr - mr), 5) + 0.0 AS offset_roll,
 round(stddev_pop(rp - mp), 5) AS resid_pitch, round(stddev_pop(rr - mr), 5) AS resid_roll FROM d JOIN m USING (swap, sp, sr) GROUP BY 1, 2, 3""")
def mapping(spark, sf):
    d = view(spark, sf, "fx_imu").selectExpr("radians(pitch) * -0.9e0 + radians(yaw) / 50 AS ref_pitch", "radians(roll) * 0.8e0 + 0.02e0 AS ref_roll", "radians(pitch) AS imu_pitch", "radians(roll) AS imu_roll")
    g = P.attitude_mapping(d).drop("score")
    return g.select(*[c if t != "double" or c.startswith("sign") else (F.round(c, 5) + F.lit(0.0)).alias(c) for c, t in g.dtypes])
