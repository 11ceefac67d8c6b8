"""Geometry, radar-camera association and mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.fixtures import view
from keelson.functions import geometry as G
from keelson.functions import motion as M
from keelson.functions.rounding import r6, tidy
from keelson.operators import association as AS
from keelson.operators import masks as K
from keelson.operators import radar as R
from keelson.params import FISHEYE, RADAR_TO_FISHEYE
from keelson.queries.catalog import query
from keelson.queries.radar import GATED, _kept

KC = (0.05, -0.02, 0.004, -0.001)
PD = (0.1, -0.03, 0.001, -0.002, 0.005)


@query("P13_P14_projections", "fx_radar", sql="""
, c AS (SELECT clip_id, frame_index, point_id, x - 0.0516e0 AS a, -z + 0.0020e0 AS b, y - 0.0043e0 AS c FROM fx_radar),
n AS (SELECT *, CASE WHEN c > 1e-6 THEN a / c END AS p, CASE WHEN c > 1e-6 THEN b / c END AS q FROM c),
m AS (SELECT *, p * p + q * q AS r2, sqrt(p * p + q * q) AS r, atan(sqrt(p * p + q * q)) AS t FROM n),
k AS (SELECT *, CASE WHEN r > 1e-12 THEN t * (1 + 0.05e0 * t * t - 0.02e0 * t * t * t * t + 0.004e0 * pow(t, 6) - 0.001e0 * pow(t, 8)) / r ELSE 1e0 END AS s, 1 + 0.1e0 * r2 - 0.03e0 * r2 * r2 + 0.005e0 * r2 * r2 * r2 AS ra FROM m)
SELECT clip_id, frame_index, point_id, round(418.51e0 * p + 444.11e0, 3) AS u, round(418.58e0 * q + 300.5e0, 3) AS v,
 round(418.51e0 * p * s + 444.11e0, 3) AS fu, round(418.58e0 * q * s + 300.5e0, 3) AS fv,
 CASE WHEN r < 3 THEN round(418.51e0 * (p * ra + 2 * 0.001e0 * p * q - 0.002e0 * (r2 + 2 * p * p)) + 444.11e0, 3) END AS lu, CASE WHEN r < 3 THEN round(418.58e0 * (q * ra + 0.001e0 * (r2 + 2 * q * q) - 2 * 0.002e0 * p * q) + 300.5e0, 3) END AS lv FROM k""")
def projections(spark, sf):
    d = view(spark, sf, "fx_radar").withColumn("ray", G.camera_ray(F.col("x"), F.col("y"), F.col("z"), RADAR_TO_FISHEYE))
    ray = F.col("ray")
    d = d.withColumn("s", G.fisheye_scale(ray, KC))
    near = F.sqrt(ray["a"] * ray["a"] + ray["b"] * ray["b"]) < 3         # the lens polynomial holds that far
    p, k, lens = G.project(ray, FISHEYE), G.project_raw_fisheye(ray, F.col("s"), FISHEYE), G.project_raw_pinhole(ray, FISHEYE, PD)
    return d.select("clip_id", "frame_index", "point_id", F.round(p["u"], 3).alias("u"), F.round(p["v"], 3).alias("v"),
                    F.round(k["u"], 3).alias("fu"), F.round(k["v"], 3).alias("fv"), F.when(near, F.round(lens["u"], 3)).alias("lu"), F.when(near, F.round(lens["v"], 3)).alias("lv"))


DETS = """, fd AS (SELECT *, degrees(atan2(u - 444.11e0, 418.51e0)) AS angle_deg, (u - 444.11e0) / 418.51e0 AS dx, (v + size / 2e0 - 300.5e0) / 418.58e0 AS dy, (v + size / 2e0 - 3e0 - 300.5e0) / 418.58e0 AS dz FROM fx_det WHERE sensor = 'fisheye'),
rg AS (SELECT *, CASE WHEN -dy < -1e-9 THEN 0.25e0 / dy * sqrt(dx * dx + dy * dy + 1) END AS raw_range_m, CASE WHEN -dz < -1e-9 THEN 0.25e0 / dz * sqrt(dx * dx + dz * dz + 1) END AS hi FROM fd),
dd AS (SELECT clip_id, frame_index, det_id, u, v, size, cls, confidence, angle_deg, raw_range_m, CASE WHEN raw_range_m <= 15 AND hi <= 15 THEN raw_range_m END AS range_m, raw_range_m IS NULL OR raw_range_m <= 30 AS vote FROM rg)"""


def detections(spark, sf):
    d = view(spark, sf, "fx_det").filter("sensor = 'fisheye'")
    u, v = F.col("u").cast("double"), F.col("v") + F.col("size") / 2.0
    r = G.reliable_range(u, v, FISHEYE, G.up_level(), 15.0)
    d = d.withColumn("angle_deg", G.bearing_pinhole(u, FISHEYE)).withColumn("__r", r)
    return d.select("clip_id", "frame_index", "det_id", "u", "v", "size", "cls", "confidence", "angle_deg", "t_ms",
                    F.col("__r.range_m").alias("range_m"), F.col("__r.raw_range_m").alias("raw_range_m"), G.may_vote(F.col("__r.raw_range_m")).alias("vote"))


@query("P15_P17_P20_P21_detection_ranges", "fx_det", sql=DETS + """
SELECT det_id, round(angle_deg, 6) + 0.0 AS angle_deg, round((u - 472e0) / 7.2e0, 6) + 0.0 AS linear_deg, round(raw_range_m, 5) AS raw_range_m, round(range_m, 5) AS range_m, vote FROM dd""")
def det_ranges(spark, sf):
    d = detections(spark, sf)
    return d.select("det_id", r6("angle_deg"), r6(G.bearing_linear(F.col("u"), FISHEYE), "linear_deg"),
                    F.round("raw_range_m", 5).alias("raw_range_m"), F.round("range_m", 5).alias("range_m"), "vote")


@query("P16_column_bands", "fx_det", sql="""
, b AS (SELECT det_id, angle, CAST(round_even(444.11e0 + 418.51e0 * tan(radians(angle)), 0) AS BIGINT) AS a, CAST(round_even(444.11e0 + 418.51e0 * tan(radians(angle + 15)), 0) AS BIGINT) AS z FROM (SELECT det_id, (u % 130) - 65 AS angle FROM fx_det))
SELECT det_id, CASE WHEN least(z, 864) > greatest(a, 0) THEN greatest(a, 0) END AS u0, CASE WHEN least(z, 864) > greatest(a, 0) THEN least(z, 864) END AS u1 FROM b""")
def column_bands(spark, sf):
    d = view(spark, sf, "fx_det").withColumn("a", (F.col("u") % 130 - 65).cast("double"))
    b = G.column_band(F.col("a"), F.col("a") + 15, FISHEYE)
    return d.select("det_id", b["u0"].cast("bigint").alias("u0"), b["u1"].cast("bigint").alias("u1"))


@query("P18_up_vectors", "fx_imu", sql="""
, a AS (SELECT row_no, radians(pitch) AS p, radians(roll) AS r, pitch / 100 AS s, 300 + roll * 4 AS i FROM fx_imu),
h AS (SELECT *, s * 418.51e0 AS hx, -418.58e0 AS hy, s * 444.11e0 - 300.5e0 + i AS hz FROM a)
SELECT row_no, round(-sin(r), 6) + 0.0 AS ux, round(-cos(r) * cos(p), 6) AS uy, round(cos(r) * sin(p), 6) + 0.0 AS uz, round(p, 6) + 0.0 AS pitch_back, round(r, 6) + 0.0 AS roll_back,
 round(hx / sqrt(hx*hx+hy*hy+hz*hz), 6) + 0.0 AS hx, round(hz / sqrt(hx*hx+hy*hy+hz*hz), 6) + 0.0 AS hz, round(s, 6) + 0.0 AS slope_back, round(i, 4) AS intercept_back FROM h""")
def up_vectors(spark, sf):
    d = view(spark, sf, "fx_imu")
    u = G.up_from_pitch_roll(F.radians("pitch"), F.radians("roll"))
    h = G.up_from_horizon(F.col("pitch") / 100, 300 + F.col("roll") * 4, FISHEYE)
    b, l = G.pitch_roll_from_up(u), G.horizon_from_up(h, FISHEYE)
    return d.select("row_no", r6(u["x"], "ux"), r6(u["y"], "uy"), r6(u["z"], "uz"), r6(b["pitch"], "pitch_back"), r6(b["roll"], "roll_back"),
                    r6(h["x"], "hx"), r6(h["z"], "hz"), r6(l["slope"], "slope_back"), F.round(l["intercept"], 4).alias("intercept_back"))


@query("P19_attitude_arbitration", "fx_imu", sql="""
, a AS (SELECT row_no, pitch / 100 AS s, 300 + roll * 20 AS i, (row_no % 10) / 10e0 AS wc, (row_no * 3 % 10) / 10e0 AS hc, row_no % 4 > 0 AS has_imu FROM fx_imu)
SELECT row_no, CASE WHEN wc >= 0.4 THEN 'water_edge' WHEN has_imu THEN 'imu' WHEN hc >= 0.5 AND abs(s * 444.11e0 + i - 300.5e0) <= 170 THEN 'horizon' ELSE 'level' END AS source,
 CASE WHEN hc >= 0.5 AND abs(s * 444.11e0 + i - 300.5e0) <= 170 THEN 'horizon' WHEN has_imu THEN 'imu' WHEN wc >= 0.4 THEN 'water_edge' ELSE 'level' END AS other_order FROM a""")
def arbitration(spark, sf):
    d = view(spark, sf, "fx_imu")
    s, i = F.col("pitch") / 100, 300 + F.col("roll") * 20

    def line(c):
        return F.struct(s.alias("slope"), i.alias("intercept"), c.alias("conf"))

    imu = F.when(F.col("row_no") % 4 > 0, F.struct(F.radians("pitch").alias("pitch"), F.radians("roll").alias("roll")))
    a = dict(water=line(F.col("row_no") % 10 / 10.0), horizon=line(F.col("row_no") * 3 % 10 / 10.0), imu=imu)
    return d.select("row_no", G.arbitrate_attitude(FISHEYE, **a)["source"].alias("source"),
                    G.arbitrate_attitude(FISHEYE, **a, order=("horizon", "imu", "water_edge", "level"))["source"].alias("other_order"))


@query("P22_P23_attitude_mapping", "fx_imu", sql="""
, q AS (SELECT row_no, radians(yaw) AS y, radians(pitch) AS p, radians(roll) AS r FROM fx_imu),
e AS (SELECT *, cos(r/2)*cos(p/2)*cos(y/2) + sin(r/2)*sin(p/2)*sin(y/2) AS w, sin(r/2)*cos(p/2)*cos(y/2) - cos(r/2)*sin(p/2)*sin(y/2) AS qx, cos(r/2)*sin(p/2)*cos(y/2) + sin(r/2)*cos(p/2)*sin(y/2) AS qy, cos(r/2)*cos(p/2)*sin(y/2) - sin(r/2)*sin(p/2)*cos(y/2) AS qz FROM q)
SELECT row_no, round(r, 5) + 0.0 AS roll_back, round(p, 5) + 0.0 AS pitch_back, round(atan2(2*(w*qz+qx*qy), 1-2*(qy*qy+qz*qz)), 5) + 0.0 AS yaw_back,
 round(atan2(cos(p)*cos(r), sin(p)), 5) + 0.0 AS cam_pitch, round(asin(-cos(p)*sin(r)), 5) + 0.0 AS cam_roll,
 round(atan2(cos(y)*sin(r) - sin(y)*sin(p)*cos(r), -sin(y)*sin(r) - cos(y)*sin(p)*cos(r)), 5) + 0.0 AS heading, round(-r + 0.1e0, 5) + 0.0 AS map_pitch, round(p - 0.2e0, 5) + 0.0 AS map_roll FROM e WHERE abs(sin(r)) + abs(sin(p)) > 0""")
def attitude_mapping(spark, sf):
    d = view(spark, sf, "fx_imu").selectExpr("row_no", "radians(yaw) AS y", "radians(pitch) AS p", "radians(roll) AS r")
    d = d.filter("abs(sin(r)) + abs(sin(p)) > 0")
    c, s = (lambda k: F.cos(F.col(k) / 2)), (lambda k: F.sin(F.col(k) / 2))
    w = c("r") * c("p") * c("y") + s("r") * s("p") * s("y")
    x = s("r") * c("p") * c("y") - c("r") * s("p") * s("y")
    yq = c("r") * s("p") * c("y") + s("r") * c("p") * s("y")
    z = c("r") * c("p") * s("y") - s("r") * s("p") * c("y")
    e = G.quaternion_to_euler(w, x, yq, z)
    a = G.camera_attitude(F.col("y"), F.col("p"), F.col("r"))
    m = G.euler_mapping(F.col("p"), F.col("r"), swap=True, sign_pitch=-1.0, mount_pitch=0.1, mount_roll=-0.2)
    cols = {"roll_back": e["roll"], "pitch_back": e["pitch"], "yaw_back": e["yaw"], "cam_pitch": a["pitch"], "cam_roll": a["roll"],
            "heading": a["heading"], "map_pitch": m["pitch"], "map_roll": m["roll"]}
    return d.select("row_no", *[(F.round(v, 5) + F.lit(0.0)).alias(k) for k, v in cols.items()])


PAIRS = GATED + DETS + """,
px AS (SELECT *, 418.51e0 * (x - 0.0516e0) / (y - 0.0043e0) + 444.11e0 AS pu, 418.58e0 * (-z + 0.0020e0) / (y - 0.0043e0) + 300.5e0 AS pv FROM kept WHERE y - 0.0043e0 > 1e-6),
pr AS (SELECT d.clip_id, d.frame_index, d.det_id, p.point_id, p.x, p.y, pu, pv FROM dd d JOIN px p ON p.clip_id = d.clip_id AND p.frame_index = d.frame_index
 AND pu BETWEEN d.u - size / 2e0 - 32 AND d.u + size / 2e0 + 32 AND pv BETWEEN d.v - size / 2e0 - 32 AND d.v + size / 2e0 + 32),
ag AS (SELECT clip_id, frame_index, det_id, CAST(count(*) AS BIGINT) AS n, min(y) AS r, degrees(median(atan2(x, y))) AS b FROM pr GROUP BY 1, 2, 3),
mt AS (SELECT dd.*, coalesce(n, 0) AS radar_hits, r AS rr, b AS radar_bearing_deg FROM dd LEFT JOIN ag USING (clip_id, frame_index, det_id))"""


@query("J04_box_gate", "fx_radar", "fx_det", sql=PAIRS + """
SELECT det_id, radar_hits, round(rr, 6) AS radar_range_m, round(radar_bearing_deg, 6) + 0.0 AS radar_bearing_deg FROM mt""")
def box_gate(spark, sf):
    d = detections(spark, sf)
    m = AS.aggregate_matches(d, AS.box_gate(d, AS.projected(_kept(spark, sf))))
    return m.select("det_id", "radar_hits", r6("radar_range_m"), r6("radar_bearing_deg"))


RUNS = """, runs AS (SELECT clip_id, frame_index, col, 0 AS row0, 647 AS row1, 1 AS cls FROM fx_masks WHERE open = 0
 UNION ALL SELECT clip_id, frame_index, col, 0, r0 - 1, 2 FROM fx_masks WHERE open > 0
 UNION ALL SELECT clip_id, frame_index, col, r0, r1 - 1, 0 FROM fx_masks WHERE open > 0 AND r1 > r0
 UNION ALL SELECT clip_id, frame_index, col, r1, 647, CASE WHEN wet > 0 THEN 1 ELSE 0 END FROM fx_masks WHERE open > 0)"""


def runs(spark, sf):
    m = view(spark, sf, "fx_masks")

    def run(a, b, c):
        return F.struct(F.lit(a).cast("bigint").alias("row0") if isinstance(a, int) else a.cast("bigint").alias("row0"),
                        (F.lit(b) if isinstance(b, int) else b).cast("bigint").alias("row1"), (F.lit(c) if isinstance(c, int) else c).alias("cls"))

    r0, r1 = F.col("r0"), F.col("r1")
    rows = F.when(F.col("open") == 0, F.array(run(0, 647, 1))).otherwise(
        F.array(run(0, r0 - 1, 2), run(r0, r1 - 1, 0), run(r1, 647, F.when(F.col("wet") > 0, 1).otherwise(0))))
    return m.select("clip_id", "frame_index", "col", F.explode(rows).alias("z")).select("clip_id", "frame_index", "col", "z.*").filter("row1 >= row0")


@query("J06_F05_A12_association_chain", "fx_radar", "fx_det", "fx_masks", sql=PAIRS + RUNS + """,
ob AS (SELECT * FROM runs WHERE cls = 0),
own AS (SELECT pr.clip_id, pr.frame_index, pr.det_id, min(pr.y) AS o FROM pr JOIN ob ON ob.clip_id = pr.clip_id AND ob.frame_index = pr.frame_index AND ob.col = round_even(pu, 0) AND round_even(pv, 0) BETWEEN row0 AND row1 GROUP BY 1, 2, 3),
ar AS (SELECT mt.*, CASE WHEN rr IS NULL THEN NULL WHEN o IS NOT NULL THEN o WHEN raw_range_m IS NULL OR rr < 0.5 * raw_range_m THEN NULL ELSE rr END AS radar_range_m FROM mt LEFT JOIN own USING (clip_id, frame_index, det_id)),
lf AS (SELECT DISTINCT clip_id, frame_index FROM kept),
vt AS (SELECT ar.*, CASE WHEN lf.clip_id IS NOT NULL AND radar_hits = 0 AND coalesce(radar_range_m, range_m) BETWEEN 1 AND 8 AND abs(angle_deg) <= 50 THEN NULL ELSE coalesce(radar_range_m, range_m) END AS final_m FROM ar LEFT JOIN lf USING (clip_id, frame_index)),
occ AS (SELECT pr.clip_id, pr.frame_index, pr.det_id, CAST(floor((degrees(atan2(x, y)) + 52.5) / 15) AS BIGINT) AS b, min(y) AS r FROM pr WHERE degrees(atan2(x, y)) >= -52.5 AND degrees(atan2(x, y)) < 52.5 GROUP BY 1, 2, 3, 4),
okd AS (SELECT DISTINCT occ.det_id FROM occ JOIN vt USING (det_id) WHERE radar_range_m IS NOT NULL AND angle_deg >= -52.5 AND angle_deg < 52.5 AND b = CAST(floor((angle_deg + 52.5) / 15) AS BIGINT)),
cb AS (SELECT clip_id, frame_index, count(DISTINCT b) AS nb, min(r) AS near FROM occ WHERE det_id IN (SELECT det_id FROM okd) GROUP BY 1, 2)
SELECT det_id, round(radar_range_m, 6) AS radar_range_m, round(range_m, 5) AS mono_range_m, round(final_m, 5) AS range_m, coalesce(nb, 0) AS frame_confirmed_bins, round(near, 6) AS frame_nearest FROM vt LEFT JOIN cb USING (clip_id, frame_index)""")
def association_chain(spark, sf):
    d, kept = detections(spark, sf), _kept(spark, sf)
    pairs = AS.box_gate(d, AS.projected(kept))
    m = AS.arbitrate_ranges(AS.aggregate_matches(d, pairs), pairs, runs(spark, sf).filter("cls = 0"))
    conf = AS.confirmed_bins(m, pairs).groupBy(*AS.FRAME).agg(
        F.count("*").alias("nb"), F.min("confirmed_range_m").alias("near"))
    v = AS.radar_veto(m, kept.select(*AS.FRAME).distinct()).join(conf, AS.FRAME, "left")
    return v.select("det_id", r6("radar_range_m"), F.round("mono_range_m", 5).alias("mono_range_m"), F.round("range_m", 5).alias("range_m"),
                    F.coalesce("nb", F.lit(0)).alias("frame_confirmed_bins"), r6("near", "frame_nearest"))


POLY = """, inst AS (SELECT clip_id, frame_index, det_id AS poly_id, CAST(u AS DOUBLE) AS cu, CAST(v AS DOUBLE) AS cv, size * 2e0 AS s FROM fx_det WHERE sensor = 'thermal'),
ed AS (SELECT poly_id, cu - s AS ax, cv AS ay, cu AS bx, cv - s / 2 AS bz FROM inst UNION ALL SELECT poly_id, cu, cv - s / 2, cu + s, cv FROM inst UNION ALL SELECT poly_id, cu + s, cv, cu, cv + s / 2 FROM inst UNION ALL SELECT poly_id, cu, cv + s / 2, cu - s, cv FROM inst)"""

SD = """(SELECT CASE WHEN sum(CASE WHEN (ay > {v}) <> (bz > {v}) AND {u} < ax + ({v} - ay) / (bz - ay) * (bx - ax) THEN 1 ELSE 0 END) % 2 = 1 THEN 1 ELSE -1 END
 * min(sqrt(pow({u} - ax - greatest(0e0, least(1e0, (({u}-ax)*(bx-ax)+({v}-ay)*(bz-ay)) / ((bx-ax)*(bx-ax)+(bz-ay)*(bz-ay)))) * (bx-ax), 2) + pow({v} - ay - greatest(0e0, least(1e0, (({u}-ax)*(bx-ax)+({v}-ay)*(bz-ay)) / ((bx-ax)*(bx-ax)+(bz-ay)*(bz-ay)))) * (bz-ay), 2))) FROM ed WHERE ed.poly_id = {p})"""


@query("J05_P44_instance_gate", "fx_radar", "fx_det", sql=PAIRS + POLY + """,
cd AS (SELECT d.det_id, d.clip_id, d.frame_index, i.poly_id, d.size, i.s, d.u, d.v FROM dd d JOIN inst i USING (clip_id, frame_index)),
sd AS (SELECT *, """ + SD.format(u="cd.u", v="cd.v", p="cd.poly_id") + """ AS sd FROM cd),
ch AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY CASE WHEN sd >= 0 THEN 0 ELSE 1 END, CASE WHEN sd >= 0 THEN s * s ELSE -sd END, poly_id) AS rn FROM sd WHERE sd >= -size / 2e0),
cv AS (SELECT * FROM ch WHERE rn = 1),
ip AS (SELECT cv.det_id, p.point_id FROM cv JOIN px p ON p.clip_id = cv.clip_id AND p.frame_index = cv.frame_index AND abs(pu - cv.u) < 400 WHERE """ + SD.format(u="p.pu", v="p.pv", p="cv.poly_id") + """ >= -12),
al AS (SELECT det_id, count(*) AS n, 'instance' AS gate FROM ip GROUP BY 1 UNION ALL SELECT det_id, count(*), 'box' FROM pr WHERE det_id NOT IN (SELECT det_id FROM cv) GROUP BY 1)
SELECT det_id, CAST(n AS BIGINT) AS n, gate FROM al""")
def instance_gate(spark, sf):
    det = view(spark, sf, "fx_det").filter("sensor = 'thermal'")
    u, v, s = F.col("u") / 864.0, F.col("v") / 648.0, F.col("size") * 2.0
    w, h = s / 864.0, s / 2.0 / 648.0
    inst = det.select("clip_id", "frame_index", F.col("det_id").alias("poly_id"),
                      F.array(u - w, v, u, v - h, u + w, v, u, v + h).alias("polygon"))
    p = AS.instance_gate(detections(spark, sf), AS.projected(_kept(spark, sf)), AS.polygon_table(inst))
    return p.groupBy("det_id", "gate").agg(F.count("*").alias("n"))


@query("J07_angular_association", "fx_radar", "fx_det", sql=GATED + DETS + """
SELECT d.det_id, CAST(count(p.point_id) AS BIGINT) AS n_radar, round(min(p.y), 6) AS near_radar_m FROM dd d LEFT JOIN pol p ON p.clip_id = d.clip_id AND p.frame_index = d.frame_index AND abs(p.ang - d.angle_deg) <= 4e0 GROUP BY 1""")
def angular(spark, sf):
    a = AS.angular_association(detections(spark, sf), R.with_polar(_kept(spark, sf)), 4.0)
    return a.select("det_id", "n_radar", r6("near_radar_m"))


@query("A05_detection_bins", "fx_radar", "fx_det", sql=PAIRS + """
SELECT clip_id, frame_index, CAST(floor((angle_deg + 52.5) / 15) AS BIGINT) AS bin_index, CAST(count(*) AS BIGINT) AS fisheye_det_count, max(size) AS fisheye_det_max_size_px, round(min(range_m), 5) AS fisheye_det_min_range_m,
 round(min(raw_range_m), 5) AS fisheye_det_min_raw_range_m, CAST(count(*) FILTER (vote) AS BIGINT) AS fisheye_det_votes, CAST(sum(radar_hits) AS BIGINT) AS fisheye_det_radar_hits, round(min(rr), 5) AS fisheye_det_min_radar_range_m
FROM mt WHERE angle_deg >= -52.5 AND angle_deg < 52.5 GROUP BY 1, 2, 3""")
def detection_bins(spark, sf):
    d = detections(spark, sf)
    m = AS.aggregate_matches(d, AS.box_gate(d, AS.projected(_kept(spark, sf))))
    b = AS.detection_bins(m, "fisheye")
    return b.select(*[F.round(c, 5).alias(c) if c.endswith("_m") else F.col(c) for c in b.columns])


@query("A06_typed_bins", "fx_radar", "fx_det", sql=DETS + """,
bx AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_index, CAST(floor((angle_deg + 52.5) / 15) AS BIGINT) ORDER BY confidence DESC, det_id) AS rn, CAST(floor((angle_deg + 52.5) / 15) AS BIGINT) AS b FROM dd WHERE angle_deg >= -52.5 AND angle_deg < 52.5),
fr AS (SELECT DISTINCT clip_id, frame_index FROM fx_radar), ran AS (SELECT DISTINCT clip_id, frame_index FROM dd)
SELECT f.clip_id, f.frame_index, g.b AS bin_index, r.clip_id IS NOT NULL AS yolo_available, confidence AS yolo_max_conf, cls AS yolo_top_cls
FROM fr f CROSS JOIN (SELECT unnest(range(7)) AS b) g LEFT JOIN ran r ON r.clip_id = f.clip_id AND r.frame_index = f.frame_index LEFT JOIN (SELECT * FROM bx WHERE rn = 1) x ON x.clip_id = f.clip_id AND x.frame_index = f.frame_index AND x.b = g.b""")
def typed_bins(spark, sf):
    d = detections(spark, sf)
    box = F.struct("det_id", (F.col("u") / 864.0).alias("x0"), (F.col("u") / 864.0).alias("x1"), "cls", "confidence")
    boxes = d.groupBy("clip_id", "frame_index").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return AS.typed_bins(boxes, view(spark, sf, "fx_radar").select("clip_id", "frame_index").distinct())


COLS = RUNS + """, cp AS (SELECT clip_id, frame_index, col, min(row0) FILTER (cls = 1) AS top_water_row, coalesce(max(row1 - row0 + 1) FILTER (cls = 1 AND row1 = 647), 0) AS bottom_run, coalesce(sum(row1 - row0 + 1) FILTER (cls = 0), 0) AS obstacle_px FROM runs GROUP BY 1, 2, 3)"""


@query("A47_class_fractions", "fx_masks", sql=RUNS + """
SELECT clip_id, frame_index, round(coalesce(sum(row1 - row0 + 1) FILTER (cls = 0), 0) / sum(row1 - row0 + 1), 6) AS obstacle_frac, round(coalesce(sum(row1 - row0 + 1) FILTER (cls = 1), 0) / sum(row1 - row0 + 1), 6) AS water_frac,
 round(coalesce(sum(row1 - row0 + 1) FILTER (cls = 2), 0) / sum(row1 - row0 + 1), 6) AS sky_frac FROM runs GROUP BY 1, 2""")
def class_fractions(spark, sf):
    return tidy(K.class_fractions(runs(spark, sf)))


@query("A08_mask_bins", "fx_masks", "fx_det", sql=COLS + """,
bd AS (SELECT b, greatest(0, CAST(round_even(444.11e0 + 418.51e0 * tan(radians(-52.5e0 + 15 * b)), 0) AS BIGINT)) AS u0, least(864, CAST(round_even(444.11e0 + 418.51e0 * tan(radians(-37.5e0 + 15 * b)), 0) AS BIGINT)) AS u1 FROM (SELECT unnest(range(7)) AS b)),
fr AS (SELECT clip_id, frame_index, b, sum(obstacle_px) / (count(*) * 648e0) AS f FROM cp JOIN bd ON col >= u0 AND col < u1 GROUP BY 1, 2, 3),
cm AS (SELECT clip_id, frame_index, CAST(floor((degrees(atan2(u - 444.11e0, 418.51e0)) + 52.5) / 15) AS BIGINT) AS b, count(*) AS n, max(CAST(size AS DOUBLE)) AS m FROM fx_det WHERE degrees(atan2(u - 444.11e0, 418.51e0)) >= -52.5 AND degrees(atan2(u - 444.11e0, 418.51e0)) < 52.5 GROUP BY 1, 2, 3),
ff AS (SELECT DISTINCT clip_id, frame_index FROM cp)
SELECT ff.clip_id, ff.frame_index, g.b AS bin_index, round(f, 6) AS seg_obstacle_frac, coalesce(n, 0) AS seg_comp_count, m AS seg_comp_max_size_px FROM ff CROSS JOIN (SELECT unnest(range(7)) AS b) g
 LEFT JOIN fr ON fr.clip_id = ff.clip_id AND fr.frame_index = ff.frame_index AND fr.b = g.b LEFT JOIN cm ON cm.clip_id = ff.clip_id AND cm.frame_index = ff.frame_index AND cm.b = g.b""")
def mask_bins(spark, sf):
    comps = view(spark, sf, "fx_det").select("clip_id", "frame_index", F.col("u").alias("cx"), F.col("size").cast("double").alias("size_px"))
    return tidy(K.mask_bins(K.column_profile(runs(spark, sf), 648), comps))


@query("A09_free_space", "fx_masks", sql=COLS + """,
d AS (SELECT *, (col - 472e0) / 7.2e0 AS be, (col - 444.11e0) / 418.51e0 AS dx, (648 - bottom_run - 300.5e0) / 418.58e0 AS dy FROM cp),
r AS (SELECT *, CASE WHEN -dy < -1e-9 AND 0.25e0 / dy * sqrt(dx*dx + dy*dy + 1) <= 15 THEN 0.25e0 / dy * sqrt(dx*dx + dy*dy + 1) END AS rg FROM d WHERE be >= -52.5 AND be < 52.5)
SELECT clip_id, frame_index, CAST(floor((be + 52.5) / 15) AS BIGINT) AS bin_index, round(min(CASE WHEN bottom_run = 0 THEN 0e0 WHEN bottom_run >= 648 THEN NULL ELSE rg END), 5) AS free_space_m, bool_or(bottom_run = 0) AS free_space_blocked FROM r GROUP BY 1, 2, 3""")
def free_space(spark, sf):
    f = K.free_space(K.column_profile(runs(spark, sf), 648))
    return f.withColumn("free_space_m", F.round("free_space_m", 5))


EDGE = COLS + """, o1 AS (SELECT clip_id, frame_index, count(*) AS w, count(top_water_row) AS nv, regr_slope(top_water_row, col) AS s, regr_intercept(top_water_row, col) AS b FROM cp GROUP BY 1, 2),
rs AS (SELECT cp.clip_id, cp.frame_index, col, top_water_row AS y, y - (s * col + b) AS r FROM cp JOIN o1 USING (clip_id, frame_index) WHERE top_water_row IS NOT NULL),
sd AS (SELECT clip_id, frame_index, CASE WHEN stddev_pop(r) = 0 THEN 1e0 ELSE stddev_pop(r) END AS sd FROM rs GROUP BY 1, 2),
kp AS (SELECT rs.*, abs(r) < 2 * sd AS keep FROM rs JOIN sd USING (clip_id, frame_index)),
o2 AS (SELECT clip_id, frame_index, count(*) FILTER (keep) AS nk, regr_slope(y, col) FILTER (keep) AS s2, regr_intercept(y, col) FILTER (keep) AS b2 FROM kp GROUP BY 1, 2),
ln AS (SELECT clip_id, frame_index, w, nv, nk >= 2 AND nk < nv AS rf, CASE WHEN nk >= 2 AND nk < nv THEN s2 ELSE s END AS s, CASE WHEN nk >= 2 AND nk < nv THEN b2 ELSE b END AS b FROM o1 LEFT JOIN o2 USING (clip_id, frame_index)),
rm AS (SELECT kp.clip_id, kp.frame_index, sqrt(avg(pow(y - s * col - b, 2))) AS rms FROM kp JOIN ln USING (clip_id, frame_index) WHERE NOT rf OR keep GROUP BY 1, 2),
eg AS (SELECT clip_id, frame_index, CASE WHEN nv < greatest(2, floor(0.3 * w)) THEN 0 ELSE s END AS slope, CASE WHEN nv < greatest(2, floor(0.3 * w)) THEN 0 ELSE b END AS intercept, CASE WHEN nv < greatest(2, floor(0.3 * w)) THEN 0 ELSE nv / w / (1 + rms / 12.96e0) END AS conf FROM ln LEFT JOIN rm USING (clip_id, frame_index))"""


@query("A10_water_edge", "fx_masks", sql=EDGE + " SELECT clip_id, frame_index, round(slope, 5) + 0.0 AS slope, round(intercept, 3) + 0.0 AS intercept, round(conf, 5) AS conf FROM eg")
def water_edge(spark, sf):
    e = K.water_edge(K.column_profile(runs(spark, sf), 648), 648)
    return e.select("clip_id", "frame_index", (F.round("slope", 5) + F.lit(0.0)).alias("slope"), (F.round("intercept", 3) + F.lit(0.0)).alias("intercept"), F.round("conf", 5).alias("conf"))


@query("A46_intrusion_intervals", "fx_masks", sql=EDGE + """,
dp AS (SELECT clip_id, frame_index, col, sum(greatest(0, row1 - greatest(row0, ceil(CASE WHEN conf > 0 THEN slope * col + intercept + 1 ELSE 324 END)) + 1)) AS depth FROM runs JOIN eg USING (clip_id, frame_index) WHERE cls = 0 GROUP BY 1, 2, 3),
nb AS (SELECT *, max(CASE WHEN depth >= 2 THEN col END) OVER (PARTITION BY clip_id, frame_index ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa, min(CASE WHEN depth >= 2 THEN col END) OVER (PARTITION BY clip_id, frame_index ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS na FROM dp),
ac AS (SELECT *, sum(CASE WHEN pa IS NULL OR col - pa > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, frame_index ORDER BY col) AS run FROM nb WHERE depth >= 2 OR (pa = col - 1 AND na = col + 1)),
iv AS (SELECT clip_id, frame_index, min(col) AS x0, max(col) + 1 AS x1, sum(depth) AS d FROM ac GROUP BY clip_id, frame_index, run)
SELECT clip_id, frame_index, round((x0 - 77e0) / 2.82e0, 6) AS lo_deg, round((x1 - 77e0) / 2.82e0, 6) AS hi_deg, CAST(d AS BIGINT) AS depth FROM iv WHERE x1 - x0 >= 2""")
def intrusion(spark, sf):
    r = runs(spark, sf)
    e = K.water_edge(K.column_profile(r, 648), 648)
    return tidy(K.intrusions(r, e, height=648))


@query("A11_J26_waterline_contact", "fx_masks", "fx_det", sql=RUNS + DETS + """,
wd AS (SELECT *, greatest(0, floor(u - size / 2e0)) AS c0, least(863, ceil(u + size / 2e0)) AS c1, greatest(0, floor(v - size / 2e0) - 40) AS w0, least(647, ceil(v + size / 2e0) + 40) AS w1 FROM dd),
hit AS (SELECT w.*, r.col, r.row0, r.row1, r.cls AS k FROM wd w JOIN runs r ON r.clip_id = w.clip_id AND r.frame_index = w.frame_index AND r.col BETWEEN c0 AND c1),
dp AS (SELECT o.det_id, o.col, max(least(o.row1, least(x.row1, o.w1) - 1)) AS ro FROM hit o JOIN hit x ON x.det_id = o.det_id AND x.col = o.col AND o.k = 0 AND x.k = 1
 WHERE least(o.row1, least(x.row1, o.w1) - 1) >= greatest(o.row0, o.w0, x.row0 - 3) AND x.row0 <= o.w1 GROUP BY 1, 2),
ct AS (SELECT det_id, quantile_cont(ro, 0.8) AS cv, median(col) AS cu FROM dp GROUP BY 1),
rr AS (SELECT dd.det_id, cu, cv, raw_range_m, (cu - 444.11e0) / 418.51e0 AS ex, (cv - 300.5e0) / 418.58e0 AS ey FROM ct JOIN dd USING (det_id))
SELECT det_id, cu AS contact_u, round(cv, 6) AS contact_v, round(CASE WHEN -ey < -1e-9 THEN 0.25e0 / ey * sqrt(ex*ex + ey*ey + 1) END - raw_range_m, 4) + 0.0 AS delta_m FROM rr""")
def contact(spark, sf):
    d = detections(spark, sf)
    c = K.waterline_contact(d, runs(spark, sf), min_columns=1).join(d.select("det_id", "raw_range_m"), "det_id")
    r = G.water_range(F.col("contact_u"), F.col("contact_v"), FISHEYE, G.up_level())
    return c.select("det_id", "contact_u", r6("contact_v"), (F.round(r - F.col("raw_range_m"), 4) + F.lit(0.0)).alias("delta_m"))


@query("F04_glint_filter", "fx_masks", "fx_det", sql=RUNS + """,
wd AS (SELECT *, greatest(0, floor(u - size / 2e0)) AS c0, least(864, ceil(u + size / 2e0)) - 1 AS c1, greatest(0, floor(v - size / 2e0)) AS w0, least(648, ceil(v + size / 2e0)) - 1 AS w1 FROM fx_det WHERE sensor = 'fisheye'),
px AS (SELECT w.det_id, sum(greatest(0, least(row1, w1) - greatest(row0, w0) + 1)) / max((c1 - c0 + 1) * (w1 - w0 + 1)) AS f FROM wd w JOIN runs r ON r.clip_id = w.clip_id AND r.frame_index = w.frame_index AND r.col BETWEEN c0 AND c1 AND r.cls = 0 WHERE c1 >= c0 AND w1 >= w0 GROUP BY 1)
SELECT det_id FROM px WHERE f >= 0.02""")
def glint(spark, sf):
    return K.drop_glints(view(spark, sf, "fx_det").filter("sensor = 'fisheye'"), runs(spark, sf), 0.02).select("det_id")


@query("A16_F08_frame_levels", "fx_levels", sql="""
, c AS (SELECT *, sum(n) OVER (PARTITION BY clip_id, frame_index ORDER BY level) AS cum, sum(n) OVER (PARTITION BY clip_id, frame_index) AS tot FROM fx_levels),
a AS (SELECT clip_id, frame_index, max(tot) AS tot, sum(n * level) / max(tot) AS mean, sum(n * level * level) / max(tot) AS sq,
""" + ",\n".join(f"min(level) FILTER (cum > floor((tot - 1) * {q}e0)) AS l{k}, min(level) FILTER (cum > ceil((tot - 1) * {q}e0)) AS h{k}" for k, q in (("01", 0.01), ("05", 0.05), ("95", 0.95), ("99", 0.99))) + """ FROM c GROUP BY 1, 2),
q AS (SELECT clip_id, frame_index, mean, sqrt(greatest(0e0, sq - mean * mean)) AS std,
""" + ", ".join(f"l{k} + (h{k} - l{k}) * ((tot - 1) * {q}e0 - floor((tot - 1) * {q}e0)) AS p{k}" for k, q in (("01", 0.01), ("05", 0.05), ("95", 0.95), ("99", 0.99))) + """ FROM a)
SELECT clip_id, frame_index, round(mean, 5) AS mean, round(std, 5) AS std, round(p05, 5) AS p05, round(p95, 5) AS p95, round(p99 - p01, 5) AS dyn_range, mean < 25 AS is_dark, std < 25 OR p99 - p01 < 120 AS quality_low FROM q""")
def levels(spark, sf):
    d = K.frame_flags(K.frame_levels(view(spark, sf, "fx_levels"), {"p01": 0.01, "p05": 0.05, "p95": 0.95, "p99": 0.99}))
    return d.select("clip_id", "frame_index", *[F.round(c, 5).alias(c) for c in ("mean", "std", "p05", "p95", "dyn_range")], "is_dark", "quality_low")
