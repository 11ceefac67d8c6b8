"""Scorer inference, feature/target tables and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.fixtures import load, view
from keelson.functions import clock
from keelson.functions import scoring as Q
from keelson.functions.rounding import r6, tidy
from keelson.functions.sun import daypart_eval
from keelson.operators import evaluate as E
from keelson.operators import radar as R
from keelson.operators import targets as T
from keelson.queries.catalog import query
from keelson.queries.radar import GATED, _kept
from keelson.queries.sectors import HEAD, SC, records, scored
from keelson.queries.vision import DETS, detections

MODEL = Q.GatedMixture(
    u=(0.2, -0.1, 0.3), v=((0.1, -0.2, 0.3, 0.0, 0.1, 0.05, -0.3, 0.2), (0.0, 0.1, 0.4, 0.2, -0.1, 0.0, 0.1, -0.2), (0.3, 0.1, -0.1, 0.0, 0.2, 0.1, 0.0, -0.4)),
    b0=-1.2, b=(0.1, 0.2, -0.1, 0.05, 0.0, 0.1, -0.3, -0.5))
KX, KY = (0.1, 0.3, 0.5, 0.8), (0.02, 0.2, 0.6, 0.9)

FEAT = """, ft AS (SELECT *, CASE WHEN hit_fisheye = 1 THEN p / 10 END AS sf, CASE WHEN hit_thermal = 1 THEN row_id % 5 END AS tc, CASE WHEN hit_mmwave = 1 THEN row_id % 9 END AS rn,
 CASE WHEN row_id % 4 > 0 THEN (row_id % 256) * 1e0 END AS lum, row_id % 7 = 0 AS dark FROM fx_scores)"""


def features(spark, sf):
    d = scored(spark, sf)
    return d.withColumns({
        "seg_obstacle_frac": F.expr("CASE WHEN hit_fisheye = 1 THEN p / 10 END"),
        "thermal_det_count": F.expr("CASE WHEN hit_thermal = 1 THEN row_id % 5 END"),
        "radar_n_points": F.expr("CASE WHEN hit_mmwave = 1 THEN row_id % 9 END"),
        "luminance_mean": F.expr("CASE WHEN row_id % 4 > 0 THEN CAST(row_id % 256 AS DOUBLE) END"),
        "is_dark": F.expr("row_id % 7 = 0"), "thermal_quality_ok": F.expr("row_id % 3 = 0"),
        "seg_available": F.col("hit_fisheye") == 1, "imu_available": F.expr("row_id % 2 = 0"),
        "radar_min_range_m": F.col("min_range_m"), "yolo_max_conf": F.col("p"),
    })


MIX = FEAT + """, ec AS (SELECT *, tanh(coalesce(sf, 0) / 0.05e0) AS e0, tanh(coalesce(tc, 0) / 2e0) AS e1, tanh(coalesce(rn, 0) / 5e0) AS e2,
 greatest(-1e0, least(1e0, sun_elevation_deg / 90)) AS c0, coalesce(lum, 127.5e0) / 255 AS c1, CASE WHEN dark THEN 1e0 ELSE 0e0 END AS c2, CASE WHEN row_id % 3 = 0 THEN 1e0 ELSE 0e0 END AS c3,
 hit_fisheye * 1e0 AS c4, CASE WHEN row_id % 2 = 0 THEN 1e0 ELSE 0e0 END AS c5, abs(bin_center_deg) / 55e0 AS c6, greatest(0e0, least(15e0, coalesce(min_range_m, 15e0))) / 15e0 AS c7 FROM ft),
gw AS (SELECT *, """ + ", ".join(f"ln(1 + exp({u}e0 + " + " + ".join(f"({w}e0) * c{k}" for k, w in enumerate(v)) + f")) AS w{i}" for i, (u, v) in enumerate(zip(MODEL.u, MODEL.v))) + """ FROM ec),
pr AS (SELECT *, 1 / (1 + exp(-(w0 * e0 + w1 * e1 + w2 * e2 - 1.2e0 + """ + " + ".join(f"({w}e0) * c{k}" for k, w in enumerate(MODEL.b)) + """))) AS pm FROM gw)"""


@query("P28_P29_P30_gated_mixture", "fx_scores", sql=MIX + """
SELECT row_id, round(e0, 6) AS e_fisheye, round(e1, 6) AS e_thermal, round(e2, 6) AS e_radar, round(c0, 6) + 0.0 AS c_sun, round(c7, 6) AS c_range, round(w0, 6) AS w_fisheye, round(w1, 6) AS w_thermal, round(w2, 6) AS w_radar, round(pm, 6) AS p FROM pr""")
def mixture(spark, sf):
    d = infer(features(spark, sf))
    return d.select("row_id", r6("e_fisheye"), r6("e_thermal"), r6("e_radar"), r6("c_sun_elevation_norm", "c_sun"), r6("c_range_norm", "c_range"),
                    r6("w_fisheye"), r6("w_thermal"), r6("w_radar"), r6("p_model", "p"))


def infer(d):
    d = d.select("*", *Q.evidence(), *Q.context())
    d = d.select("*", *MODEL.gates())
    return d.withColumn("p_model", MODEL.probability())


@query("P31_calibrator", "fx_scores", sql="""
, m AS (SELECT row_id, (p + (p * p)) / 2 AS q FROM fx_scores)
SELECT row_id, round(CASE WHEN q <= 0.1 THEN 0.02e0 WHEN q >= 0.8 THEN 0.9e0 WHEN q < 0.3 THEN 0.02e0 + 0.18e0 * (q - 0.1e0) / 0.2e0 WHEN q < 0.5 THEN 0.2e0 + 0.4e0 * (q - 0.3e0) / 0.2e0 ELSE 0.6e0 + 0.3e0 * (q - 0.5e0) / 0.3e0 END, 9) AS p_cal FROM m""")
def calibrator(spark, sf):
    p = F.col("p")
    d = view(spark, sf, "fx_scores").withColumn("q", Q.ensemble([p, p * p]))
    return d.select("row_id", F.round(Q.interpolate(F.col("q"), KX, KY), 9).alias("p_cal"))


THREAT = """, th AS (SELECT *, CASE row_id % 4 WHEN 0 THEN 'boat|buoy' WHEN 1 THEN '' WHEN 2 THEN 'duck' ELSE 'kayak|float' END AS cl, CASE WHEN row_id % 6 > 2 THEN free_m / 2 END AS cpa FROM sc),
sv AS (SELECT *, CASE row_id % 4 WHEN 0 THEN 0.6e0 WHEN 1 THEN 1e0 WHEN 2 THEN 0.8e0 ELSE 1e0 END AS sev, CASE WHEN min_range_m IS NOT NULL THEN greatest(0e0, least(1e0, 1 - min_range_m / 15)) END AS t1, CASE WHEN ttc_s IS NOT NULL THEN greatest(0e0, least(1e0, 1 - ttc_s / 60)) END AS t2,
 CASE WHEN cpa IS NOT NULL AND ttc_s IS NOT NULL THEN greatest(0e0, least(1e0, 1 - cpa / 5)) * greatest(0e0, least(1e0, 1 - ttc_s / 60)) END AS t3 FROM th)"""


@query("P26_P27_threat_bands", "fx_scores", sql=SC + THREAT + """
SELECT row_id, sev AS severity, round(p * sev * coalesce(greatest(t1, t2), 0.3e0), 12) AS threat, round(p * sev * coalesce(greatest(t1, t2, t3), 0.3e0), 12) AS threat_motion,
 CASE WHEN min_range_m <= 5 THEN 'near<=5m' WHEN min_range_m <= 15 THEN 'mid5-15m' ELSE 'far/unknown' END AS band FROM sv""")
def threats(spark, sf):
    d = scored(spark, sf).withColumn("cl", F.expr("CASE row_id % 4 WHEN 0 THEN 'boat|buoy' WHEN 1 THEN '' WHEN 2 THEN 'duck' ELSE 'kayak|float' END"))
    d = d.withColumn("cpa", F.expr("CASE WHEN row_id % 6 > 2 THEN free_m / 2 END")).withColumn("sev", Q.severity(F.col("cl")))
    a = (F.col("p"), F.col("min_range_m"), F.col("ttc_s"), F.col("sev"))
    return d.select("row_id", F.col("sev").alias("severity"), F.round(Q.threat(*a), 12).alias("threat"),
                    F.round(Q.threat(*a, cpa=F.col("cpa"), t_cpa=F.col("ttc_s")), 12).alias("threat_motion"),
                    Q.range_band(F.col("min_range_m"), F.lit(None).cast("double")).alias("band"))


@query("P40_radar_only_input", "fx_scores", sql=FEAT + """
SELECT row_id, clip_id, frame_index, bin_index, p, min_range_m, closing_mps + 0.0 AS closing_mps, sun_elevation_deg, CAST(NULL AS DOUBLE) AS seg_obstacle_frac, CAST(NULL AS DOUBLE) AS free_m, CAST(NULL AS DOUBLE) AS luminance_mean, p AS yolo_max_conf,
 CAST(NULL AS BIGINT) AS thermal_det_count, rn AS radar_n_points, min_range_m AS radar_min_range_m, false AS seg_available, row_id % 2 = 0 AS imu_available, false AS is_dark, false AS thermal_quality_ok, CAST(0 AS BIGINT) AS hit_fisheye, CAST(0 AS BIGINT) AS hit_thermal, CAST(hit_mmwave AS BIGINT) AS hit_mmwave FROM ft""")
def radar_only(spark, sf):
    whole = ["row_id", "clip_id", "frame_index", "bin_index", "p", "min_range_m", "closing_mps", "sun_elevation_deg", "seg_obstacle_frac", "free_m", "luminance_mean", "yolo_max_conf",
             "thermal_det_count", "radar_n_points", "radar_min_range_m", "seg_available", "imu_available", "is_dark", "thermal_quality_ok", "hit_fisheye", "hit_thermal", "hit_mmwave"]
    d = Q.radar_only(features(spark, sf)).select(*whole)
    return d.withColumns({c: F.col(c).cast("bigint") for c in ("thermal_det_count", "hit_fisheye", "hit_thermal", "hit_mmwave")} | {"closing_mps": F.col("closing_mps") + F.lit(0.0)})


THR = ", ".join(f"{t}e0" for t in E.THRESHOLDS)


@query("A18_threshold_sweep", "fx_scores", sql=f""", t AS (SELECT unnest([{THR}]) AS threshold),
c AS (SELECT scene, threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn FROM fx_scores, t GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS rc FROM c),
e AS (SELECT *, CASE WHEN tp > 0 THEN 2 * pr * rc / (pr + rc) WHEN tp + fp + fn > 0 THEN 0e0 END AS f1 FROM d),
b AS (SELECT scene, max(f1) AS bf, arg_max(threshold, [f1, -threshold]) AS bt FROM e GROUP BY 1)
SELECT e.scene, threshold, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, round(bf, 6) AS best_f1, bt AS best_threshold FROM e JOIN b USING (scene)""")
def threshold_sweep(spark, sf):
    t = E.threshold_table(view(spark, sf, "fx_scores"), ["scene"], "p", "y")
    return tidy(t.join(E.best_f1(t, ["scene"]), "scene"))


AP = """, ag AS (SELECT *, sum(y) OVER (PARTITION BY {k} ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING) AS tp, row_number() OVER (PARTITION BY {k} ORDER BY p DESC, row_id) AS rk FROM {src})"""


@query("A19_average_precision", "fx_scores", sql=AP.format(k="scene", src="fx_scores") + """
SELECT scene, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(sum(tp / rk * y) / sum(y), 6) AS ap FROM ag GROUP BY 1""")
def avg_precision(spark, sf):
    return tidy(E.average_precision(view(spark, sf, "fx_scores"), ["scene"], "p", "y", "row_id"))


@query("A20_A23_calibration", "fx_scores", sql="""
, b AS (SELECT scene, p, y, CASE """ + " ".join(f"WHEN p < {(i + 1) * 0.1!r}e0 THEN {i}" for i in range(9)) + """ ELSE 9 END AS bin FROM fx_scores),
t AS (SELECT scene, bin, count(*) AS n, avg(p) AS ms, avg(y) AS fp FROM b GROUP BY 1, 2),
e AS (SELECT scene, sum(n * abs(ms - fp)) / sum(n) AS ece FROM t GROUP BY 1), r AS (SELECT scene, avg((p - y) * (p - y)) AS br FROM b GROUP BY 1)
SELECT t.scene, CAST(bin AS BIGINT) AS bin, n, round(ms, 6) AS mean_score, round(fp, 6) AS frac_positive, round(ece, 6) AS ece, round(br, 6) AS brier FROM t JOIN e USING (scene) JOIN r USING (scene)""")
def calibration(spark, sf):
    d = view(spark, sf, "fx_scores")
    t = E.reliability(d, ["scene"], "p", "y")
    tot = t.groupBy("scene").agg(F.sum("n").alias("n_total"))
    return tidy(t.join(E.calibration_error(t, tot, ["scene"]), "scene").join(E.brier(d, ["scene"], "p", "y"), "scene"))


STRATA = """, s0 AS (SELECT *, CASE WHEN sun_elevation_deg > 6 THEN 'day' WHEN sun_elevation_deg < -6 THEN 'night' ELSE 'dusk' END AS dp, CASE WHEN min_range_m <= 5 THEN 'near<=5m' WHEN min_range_m <= 15 THEN 'mid5-15m' ELSE 'far/unknown' END AS rb FROM fx_scores),
st AS (SELECT 'all' AS stratum, 'all' AS value, p, y, row_id FROM s0 UNION ALL SELECT 'scene', scene, p, y, row_id FROM s0 UNION ALL SELECT 'daypart', dp, p, y, row_id FROM s0 UNION ALL SELECT 'range_band', rb, p, y, row_id FROM s0)"""


@query("A21_stratified_report", "fx_scores", sql=STRATA + AP.format(k="stratum, value", src="st") + """,
a AS (SELECT stratum, value, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, sum(tp / rk * y) / sum(y) AS ap, count(*) FILTER (p >= 0.5 AND y = 1) AS t, count(*) FILTER (p >= 0.5 AND y = 0) AS f, count(*) FILTER (p < 0.5 AND y = 1) AS m FROM ag GROUP BY 1, 2)
SELECT stratum, value, n, n_pos, round(ap, 6) AS ap, round(CASE WHEN t + f > 0 THEN t / (t + f) END, 6) AS precision, round(CASE WHEN t + m > 0 THEN t / (t + m) END, 6) AS recall,
 round(CASE WHEN t > 0 THEN 2 * t / (2 * t + f + m) WHEN f + m > 0 THEN 0e0 END, 6) AS f1 FROM a""")
def stratified(spark, sf):
    cols = {"scene": F.col("scene"), "daypart": daypart_eval(F.col("sun_elevation_deg")),
            "range_band": Q.range_band(F.col("min_range_m"), F.lit(None).cast("double"))}
    return tidy(E.stratified_report(view(spark, sf, "fx_scores"), cols, "p", "y", "row_id"))


@query("A22_blocked_rates", "fx_scores", sql="""
SELECT scene, count(DISTINCT (clip_id, frame_index)) AS n_frames, round(count(*) FILTER (p >= 0.33) / count(DISTINCT (clip_id, frame_index)), 6) AS blocked_33,
 round(count(*) FILTER (p >= 0.5) / count(DISTINCT (clip_id, frame_index)), 6) AS blocked_50, round(count(*) FILTER (p >= 0.66) / count(DISTINCT (clip_id, frame_index)), 6) AS blocked_66 FROM fx_scores GROUP BY 1""")
def blocked(spark, sf):
    return tidy(E.blocked_rate(view(spark, sf, "fx_scores"), "p"))


@query("A24_U03_bin_counters", "fx_scores", sql=SC + """, b AS (SELECT *, score >= 0.33 AS pd, y = 1 AS ac FROM sc),
f AS (SELECT scene, clip_id, frame_index, count(*) FILTER (pd AND ac) AS i, count(*) FILTER (pd OR ac) AS u, count(*) FILTER (pd AND NOT ac) AS x FROM b GROUP BY 1, 2, 3),
o AS (SELECT scene, count(*) AS n_frames, avg(CASE WHEN u = 0 THEN 1e0 ELSE i / u END) AS si, sum(x) AS fb, count(*) FILTER (x > 0) AS ff FROM f GROUP BY 1)
SELECT b.scene, """ + ", ".join(f"count(*) FILTER ({c} AND ac) AS {n}_tp, count(*) FILTER ({c} AND NOT ac) AS {n}_fp, count(*) FILTER (NOT ({c}) AND ac) AS {n}_fn, count(*) FILTER (NOT ({c}) AND NOT ac) AS {n}_tn" for n, c in (("fused", "pd"), ("radar", "hit_mmwave = 1"))) + """,
 max(n_frames) AS n_frames, round(max(si), 6) AS sector_iou, CAST(max(fb) AS BIGINT) AS fp_bins, max(ff) AS fp_frames FROM b JOIN o USING (scene) GROUP BY 1""")
def counters(spark, sf):
    d = scored(spark, sf).withColumns({"fused": F.col("score") >= 0.33, "radar": F.col("hit_mmwave") == 1, "ac": F.col("y") == 1})
    return tidy(E.bin_counters(d, ["scene"], ["fused", "radar"], "ac").join(E.sector_overlap(d, ["scene"], "fused", "ac"), "scene"))


@query("A24_nearest_confusion", "fx_scores", sql=SC + """, b AS (SELECT * FROM sc),
a AS (SELECT x.scene, x.bin_center_deg AS actual_deg, q.bin_center_deg AS pd, row_number() OVER (PARTITION BY x.clip_id, x.frame_index, x.bin_index ORDER BY abs(q.bin_center_deg - x.bin_center_deg), q.bin_center_deg) AS rn
 FROM b x JOIN b q ON q.clip_id = x.clip_id AND q.frame_index = x.frame_index AND q.score >= 0.33 WHERE x.y = 1)
SELECT scene, actual_deg, pd AS predicted_deg, count(*) AS n FROM a WHERE rn = 1 GROUP BY 1, 2, 3""")
def confusion(spark, sf):
    d = scored(spark, sf).groupBy("scene", "clip_id", "frame_index").agg(
        F.collect_list(F.when(F.col("score") >= 0.33, F.col("bin_center_deg"))).alias("pd"),
        F.collect_list(F.when(F.col("y") == 1, F.col("bin_center_deg"))).alias("ac"))
    return E.nearest_confusion(d, ["scene"], "pd", "ac")


@query("A25_heading_metrics", "fx_scores", sql=HEAD + """, lb AS (SELECT clip_id, frame_index, CASE WHEN frame_index % 5 > 0 THEN frame_index % 91 - 45e0 END AS lab, CASE WHEN heading_reason NOT IN ('all_blocked', 'ambiguous') THEN z.th END AS raw FROM re)
SELECT clip_id, count(*) AS n_labelled, count(*) FILTER (lab IS NULL) AS n_label_null, round(avg(abs(raw - lab)), 6) AS raw_mae, round(avg(CASE WHEN abs(raw - lab) <= 15 THEN 1e0 WHEN abs(raw - lab) > 15 THEN 0e0 END), 6) AS raw_within15,
 count(*) FILTER (lab IS NULL AND raw IS NULL) AS raw_correct_abstain, count(*) FILTER (lab IS NULL AND raw IS NOT NULL) AS raw_false_recommend, count(*) FILTER (lab IS NOT NULL AND raw IS NULL) AS raw_missed_recommend FROM lb GROUP BY 1""")
def heading_metrics(spark, sf):
    from keelson.operators.sectors import recommend_heading
    d = recommend_heading(records(spark, sf)).withColumn("lab", F.expr("CASE WHEN frame_index % 5 > 0 THEN frame_index % 91 - 45D END")).withColumn("raw", F.col("heading_deg"))
    return tidy(E.heading_metrics(d, ["clip_id"], "lab", ["raw"]))


@query("A21_open_water_person", "fx_scores", sql="""
, f AS (SELECT clip_id, frame_index, """ + ", ".join(f"count(*) FILTER (p >= {t} AND y = 0) AS b{i}" for i, t in enumerate((0.33, 0.5, 0.66))) + """ FROM fx_scores WHERE scene = 'Lake1' GROUP BY 1, 2)
SELECT round(avg(b0), 6) AS fp_33, round(avg(b1), 6) AS fp_50, round(avg(b2), 6) AS fp_66, (SELECT round(count(*) FILTER (p >= 0.5 AND y = 1) / count(*) FILTER (y = 1), 6) FROM fx_scores WHERE row_id % 4 = 1) AS person_recall FROM f""")
def open_water(spark, sf):
    d = view(spark, sf, "fx_scores")
    fp = E.false_blocks(d.filter("scene = 'Lake1'"), "p", "y")
    per = d.withColumn("cls", F.expr("CASE WHEN row_id % 4 = 1 THEN 'boat|person' ELSE 'boat' END")).filter(F.col("cls").contains("person"))
    rec = E.threshold_table(per.withColumn("k", F.lit(1)), ["k"], "p", "y", [0.5]).select("k", F.col("recall").alias("person_recall"))
    return tidy(fp.withColumn("k", F.lit(1)).join(rec, "k").drop("k"))


TGT = DETS + """, lb AS (SELECT clip_id, frame_index, det_id, cls, angle_deg AS bearing, raw_range_m AS rg FROM dd),
fr AS (SELECT clip_id, frame_index, bool_or(det_id % 2 = 0) AS au, count(*) AS n FROM dd GROUP BY 1, 2),
su AS (SELECT f.clip_id, f.frame_index, g.b, l.cls, l.rg, l.frame_index = f.frame_index AS same FROM fr f CROSS JOIN (SELECT unnest(range(7)) AS b) g JOIN lb l ON l.clip_id = f.clip_id AND l.frame_index BETWEEN f.frame_index - 7 AND f.frame_index + 7 AND abs(-45 + 15 * g.b - bearing) <= 7.5 + 1),
ag AS (SELECT clip_id, frame_index, b, bool_or(coalesce(rg <= 6, false)) AS rel, bool_or(same) AS same, string_agg(DISTINCT cls, '|' ORDER BY cls) FILTER (same) AS cl, min(rg) FILTER (same) AS near FROM su GROUP BY 1, 2, 3)"""


@query("J11_A17_P37_target_table", "fx_det", sql=TGT + """
SELECT f.clip_id, f.frame_index, g.b AS bin_index, CAST(-45 + 15 * g.b AS DOUBLE) AS bin_center_deg, CAST(a.b IS NOT NULL AS BIGINT) AS y_obstacle, CAST(coalesce(rel, true) AS BIGINT) AS y_relevant, CAST(a.b IS NOT NULL AND rel AS BIGINT) AS y_nav,
 CAST(a.b IS NOT NULL AND NOT same AS BIGINT) AS from_dilation, coalesce(cl, '') AS label_classes, round(near, 5) AS label_min_range_m, n AS n_labels_frame, CAST(au AS BIGINT) AS audited
FROM fr f CROSS JOIN (SELECT unnest(range(7)) AS b) g LEFT JOIN ag a ON a.clip_id = f.clip_id AND a.frame_index = f.frame_index AND a.b = g.b""")
def target_table(spark, sf):
    d = detections(spark, sf)
    boxes = d.select(*T.FRAME, F.col("angle_deg").alias("bearing_deg"), "cls", F.col("raw_range_m").alias("range_m"))
    lab = d.select(*T.FRAME, (F.col("det_id") % 2 == 0).alias("audited"))
    t = T.target_table(boxes, lab, tolerance_deg=1.0, max_relevant_m=6.0)
    return t.withColumn("label_min_range_m", F.round("label_min_range_m", 5))


@query("P37_label_geometry", "fx_det", sql="""
, b AS (SELECT det_id, u / 864e0 - size / 500e0 AS xa, u / 864e0 + (size - 25) / 500e0 AS xb, v / 648e0 + (size - 20) / 300e0 AS ya, v / 648e0 AS yb FROM fx_det),
c AS (SELECT det_id, greatest(0e0, least(1e0, least(xa, xb))) AS x0, greatest(0e0, least(1e0, greatest(xa, xb))) AS x1, greatest(0e0, least(1e0, least(ya, yb))) AS y0, greatest(0e0, least(1e0, greatest(ya, yb))) AS y1 FROM b),
d AS (SELECT *, degrees(atan2((x0 + x1) / 2 * 864 - 444.11e0, 418.51e0)) AS be, ((x0 + x1) / 2 * 160 - 77) / 2.82e0 AS tb FROM c WHERE x1 > x0 AND y1 > y0)
SELECT det_id, round(x0, 6) AS x0, round(y1, 6) AS y1, round(be, 6) + 0.0 AS bearing_deg, round(tb, 6) + 0.0 AS thermal_deg, CASE WHEN be >= -52.5 AND be < 52.5 THEN CAST(floor((be + 52.5) / 15) * 15 - 45 AS BIGINT) END AS bin_deg FROM d""")
def label_geometry(spark, sf):
    d = view(spark, sf, "fx_det")
    u, v, s = F.col("u") / 864.0, F.col("v") / 648.0, F.col("size")
    d = d.withColumn("b", T.tidy_box(u - s / 500.0, v + (s - 20) / 300.0, u + (s - 25) / 500.0, v)).filter("b IS NOT NULL")
    d = d.withColumn("be", T.box_bearing(F.col("b.x0"), F.col("b.x1")))
    bins = T.box_bins(F.array("be"))
    return d.select("det_id", r6("b.x0", "x0"), r6("b.y1", "y1"), r6("be", "bearing_deg"), r6(T.thermal_box_bearing(F.col("b.x0"), F.col("b.x1")), "thermal_deg"),
                    F.when(F.size(bins) > 0, F.element_at(bins, 1)).cast("bigint").alias("bin_deg"))


@query("J10_label_resolution", "fx_det", "fx_radar", sql="""
, lb AS (SELECT clip_id, det_id, CASE WHEN det_id % 3 = 0 THEN frame_index ELSE -1 END AS idx, CASE WHEN det_id % 3 = 1 THEN t_ms WHEN det_id % 3 = 2 THEN t_ms + 50 END AS lt FROM fx_det),
f AS (SELECT clip_id, frame_index, min(t_ms) AS t_ms FROM fx_radar GROUP BY 1, 2), mx AS (SELECT clip_id, max(frame_index) - 3 AS m FROM f GROUP BY 1)
SELECT det_id, CASE WHEN idx >= 0 THEN idx ELSE f.frame_index END AS frame_index FROM lb JOIN mx USING (clip_id) LEFT JOIN f ON f.clip_id = lb.clip_id AND f.t_ms = lb.lt WHERE CASE WHEN idx >= 0 THEN idx ELSE f.frame_index END <= m""")
def label_resolution(spark, sf):
    ts = clock.hms_tenths
    lab = view(spark, sf, "fx_det").select("clip_id", "det_id", F.expr("CASE WHEN det_id % 3 = 0 THEN frame_index ELSE -1 END").alias("frame_idx"),
                                           F.when(F.col("det_id") % 3 == 1, ts(F.col("t_ms") / 1000.0)).when(F.col("det_id") % 3 == 2, F.lit("off the clock")).alias("frame_ts"))
    f = view(spark, sf, "fx_radar").groupBy("clip_id", "frame_index").agg(F.min("t_ms").alias("t_ms"))
    clips = f.groupBy("clip_id").agg((F.max("frame_index") - 3).alias("max_index")).withColumns({"base_s": F.lit(0.0), "silent": F.lit(False)})
    return T.resolve_labels(lab, f.select("clip_id", "frame_index", ts(F.col("t_ms") / 1000.0).alias("rounded_time")), clips).select("det_id", "frame_index")


@query("J09_A07_feature_merge", "fx_scores", sql="""
, fr AS (SELECT clip_id, frame_index, max(sun_elevation_deg) AS sun, max(p) AS p_frame FROM fx_scores GROUP BY 1, 2), tg AS (SELECT clip_id, frame_index, bin_index, y AS y_nav FROM fx_scores)
SELECT b.clip_id, b.frame_index, b.bin_index, round(b.p, 6) AS p, round(p_frame, 6) AS p_frame, round(sun, 6) + 0.0 AS sun, y_nav FROM fx_scores b LEFT JOIN fr USING (clip_id, frame_index) JOIN tg USING (clip_id, frame_index, bin_index)""")
def feature_merge(spark, sf):
    d = view(spark, sf, "fx_scores")
    fr = d.groupBy("clip_id", "frame_index").agg(F.max("sun_elevation_deg").alias("sun"), F.max("p").alias("p"))
    tg = d.select("clip_id", "frame_index", "bin_index", F.col("y").alias("y_nav"))
    m = T.merge_features(d.select("clip_id", "frame_index", "bin_index", "p"), fr, tg)
    return tidy(m)


@query("A15_frame_context", "fx_radar", "fx_levels", "fx_imu", sql=GATED + """,
fr AS (SELECT clip_id, frame_index, min(t_ms) AS t_ms, count(x) AS raw FROM fx_radar GROUP BY 1, 2), pt AS (SELECT clip_id, frame_index, count(*) AS n, count(vx) AS nv, median(snr) AS ms FROM pol GROUP BY 1, 2),
lv AS (SELECT clip_id, frame_index, sum(n * level) / sum(n) AS m FROM fx_levels GROUP BY 1, 2),
im AS (SELECT f.clip_id, f.frame_index, roll, row_number() OVER (PARTITION BY f.clip_id, f.frame_index ORDER BY abs(f.t_ms - i.t_ms), i.t_ms) AS rn FROM fr f JOIN fx_imu i ON i.clip_id = f.clip_id AND abs(f.t_ms - i.t_ms) <= 1000)
SELECT f.clip_id, f.frame_index, raw AS radar_n_points_raw, coalesce(pt.n, 0) AS radar_n_points, coalesce(nv > 0, false) AS radar_has_doppler, pt.n > 0 AND pt.n IS NOT NULL AS radar_has_snr, round(ms, 6) AS radar_median_snr_db, round(m, 6) AS luminance_mean,
 coalesce(m < 25, false) AS is_dark, round(roll, 6) + 0.0 AS attitude_roll_deg, roll IS NOT NULL AS imu_available FROM fr f LEFT JOIN pt USING (clip_id, frame_index) LEFT JOIN lv USING (clip_id, frame_index) LEFT JOIN (SELECT * FROM im WHERE rn = 1) i USING (clip_id, frame_index)""")
def frame_context(spark, sf):
    from keelson.operators import align as A
    from keelson.operators import masks as K
    raw = R.frame_counts(view(spark, sf, "fx_radar"))
    pts = R.with_polar(_kept(spark, sf))
    vel = pts.select(*T.FRAME).distinct().withColumn("velocity_source", F.lit("doppler"))
    lv = K.frame_levels(view(spark, sf, "fx_levels"), {}).select(*T.FRAME, F.col("mean").alias("luminance_mean"))
    att = A.attach_attitude(raw.select(*T.FRAME, "t_ms"), view(spark, sf, "fx_imu")).select(*T.FRAME, F.col("roll").alias("attitude_roll_deg"))
    c = T.frame_context(raw.select(*T.FRAME), points=pts, raw=raw, levels=lv, attitude=att, velocity=vel)
    return tidy(c.select(*T.FRAME, "radar_n_points_raw", "radar_n_points", "radar_has_doppler", "radar_has_snr", "radar_median_snr_db", "luminance_mean", "is_dark", "attitude_roll_deg", "imu_available"))
