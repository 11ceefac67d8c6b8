"""Radar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.fixtures import view
from keelson.functions import motion as M
from keelson.functions.rounding import r6, tidy
from keelson.operators import radar as R
from keelson.params import RadarGate
from keelson.queries.catalog import CATALOG, query

GATED = """, nf AS (SELECT clip_id, frame_index, count(*) AS n FROM fx_radar GROUP BY ALL),
g AS (SELECT r.* FROM fx_radar r JOIN nf USING (clip_id, frame_index) WHERE n BETWEEN 1 AND 500),
kept AS (SELECT * FROM g WHERE y BETWEEN 0.5 AND 9.0
  AND NOT (x BETWEEN -1.0 AND 0.25 AND y BETWEEN 0.0 AND 1.3 AND abs(coalesce(v, 0)) <= 0.30)),
pol AS (SELECT *, degrees(atan2(x, y)) AS ang, CASE WHEN v IS NULL THEN NULL ELSE v * (x / sqrt(x*x+y*y)) END AS vx,
  CASE WHEN v IS NULL THEN NULL ELSE v * (y / sqrt(x*x+y*y)) END AS vy FROM kept),
pb AS (SELECT *, CAST(floor((ang + 52.5) / 15) AS BIGINT) AS b FROM pol WHERE ang >= -52.5 AND ang < 52.5)"""


def _kept(spark, sf):
    return R.filter_points(R.gate_frames(view(spark, sf, "fx_radar")))


@query("P06_F01_F02_F03_radar_filter", "fx_radar", sql=GATED + """
SELECT clip_id, CAST(count(*) AS BIGINT) AS n_kept, round(sum(x), 6) + 0.0 AS sx, round(sum(y), 6) AS sy,
 CAST(count(v) AS BIGINT) AS n_doppler FROM kept GROUP BY clip_id""")
def radar_filter(spark, sf):
    return _kept(spark, sf).groupBy("clip_id").agg(
        F.count("*").alias("n_kept"), (F.round(F.sum("x"), 6) + F.lit(0.0)).alias("sx"),
        F.round(F.sum("y"), 6).alias("sy"), F.count("v").alias("n_doppler"))


@query("P06_radar_mount_rotation", "fx_radar", sql="""
, rot AS (SELECT clip_id, frame_index, point_id, x*cos(radians(-3.5e0)) + y*sin(radians(-3.5e0)) AS x, y*cos(radians(-3.5e0)) - x*sin(radians(-3.5e0)) AS y, v FROM fx_radar)
SELECT clip_id, frame_index, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM rot
 WHERE y BETWEEN 0.5 AND 9.0 AND NOT (x BETWEEN -1.0 AND 0.25 AND y BETWEEN 0.0 AND 1.3)""")
def radar_rotation(spark, sf):
    pts = R.filter_points(view(spark, sf, "fx_radar"), RadarGate(mount_yaw_deg=3.5, has_doppler=False))
    return pts.select("clip_id", "frame_index", "point_id", r6("x"), r6("y"))


@query("P07_P08_P10_P12_radar_polar", "fx_radar", sql=GATED + """
SELECT clip_id, frame_index, point_id, round(ang, 6) + 0.0 AS angle_deg, y AS range_m,
 CASE WHEN ang >= -52.5 AND ang < 52.5 THEN CAST(floor((ang + 52.5) / 15) AS BIGINT) END AS bin_index,
 round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy, round(-vy, 6) + 0.0 AS closing_mps FROM pol""")
def radar_polar(spark, sf):
    p = R.with_polar(_kept(spark, sf)).withColumn("closing_mps", M.closing_speed(F.col("vy")))
    return p.select("clip_id", "frame_index", "point_id", r6("angle_deg"), "range_m", "bin_index",
                    r6("vx"), r6("vy"), r6("closing_mps"))


@query("A02_A03_A04_P11_radar_bins", "fx_radar", sql=GATED + """,
c AS (SELECT *, -vy AS c, row_number() OVER (PARTITION BY clip_id, frame_index, b ORDER BY vy IS NULL, abs(vy), -vy) AS rn,
  count(vy) OVER (PARTITION BY clip_id, frame_index, b) AS nv FROM pb),
a AS (SELECT clip_id, frame_index, b AS bin_index, CAST(count(*) AS BIGINT) AS radar_n_points, min(y) AS mr, median(y) AS med,
  max(snr) AS mx, avg(snr) AS av, median(noise) AS no, CAST(count(vy) AS BIGINT) AS radar_n_velocity,
  max(CASE WHEN rn = nv // 2 + 1 AND vy IS NOT NULL THEN c END) AS closing FROM c GROUP BY ALL)
SELECT clip_id, frame_index, bin_index, radar_n_points, round(mr, 6) AS radar_min_range_m, round(med, 6) AS radar_median_range_m,
 round(mx, 6) AS radar_max_snr_db, round(av, 6) AS radar_mean_snr_db, round(no, 6) AS radar_median_noise_db, radar_n_velocity,
 round(closing, 6) + 0.0 AS closing_mps, round(CASE WHEN closing > 0.15 THEN least(mr / closing, 60e0) END, 6) AS ttc_s FROM a""")
def radar_bins(spark, sf):
    return tidy(R.radar_bins(R.with_polar(_kept(spark, sf))))


HITS = GATED + """,
det AS (SELECT clip_id, frame_index, sensor, CASE WHEN sensor = 'fisheye' THEN degrees(atan2(u - 444.11, 418.51)) ELSE (u / 5.4 - 77) / 2.82 END AS a FROM fx_det),
hits AS (SELECT clip_id, frame_index, b, 'mmwave' AS sensor FROM pb UNION ALL
  SELECT clip_id, frame_index, CAST(floor((a + 52.5) / 15) AS BIGINT), sensor FROM det WHERE a >= -52.5 AND a < 52.5),
fr AS (SELECT DISTINCT clip_id, frame_index FROM fx_radar UNION SELECT DISTINCT clip_id, frame_index FROM fx_det),
hb AS (SELECT clip_id, frame_index, b, max(CAST(sensor = 'fisheye' AS BIGINT)) hf, max(CAST(sensor = 'thermal' AS BIGINT)) ht, max(CAST(sensor = 'mmwave' AS BIGINT)) hm FROM hits GROUP BY ALL)"""


@query("A01_vote_fusion", "fx_radar", "fx_det", sql=HITS + """
SELECT f.clip_id, f.frame_index, g.b AS bin_index, CAST(-45e0 + 15e0 * g.b AS DOUBLE) AS bin_center_deg, coalesce(hf, 0) AS hit_fisheye, coalesce(ht, 0) AS hit_thermal,
 coalesce(hm, 0) AS hit_mmwave, round((coalesce(hf, 0) + coalesce(ht, 0) + coalesce(hm, 0)) / 3e0, 6) AS score
FROM fr f CROSS JOIN (SELECT unnest(range(7)) AS b) g LEFT JOIN hb ON hb.clip_id = f.clip_id AND hb.frame_index = f.frame_index AND hb.b = g.b""")
def vote_fusion(spark, sf):
    polar = R.with_polar(_kept(spark, sf))
    det = view(spark, sf, "fx_det")
    ang = F.when(F.col("sensor") == "fisheye", F.degrees(F.atan2(F.col("u") - 444.11, F.lit(418.51)))).otherwise(
        (F.col("u") / 5.4 - 77) / 2.82)
    dh = det.select(*R.FRAME, M.bin_of(ang).alias("bin_index"), "sensor")
    hits = polar.select(*R.FRAME, "bin_index", F.lit("mmwave").alias("sensor")).unionByName(dh)
    frames = view(spark, sf, "fx_radar").select(*R.FRAME).unionByName(det.select(*R.FRAME)).distinct()
    out = R.fuse_votes(frames, hits)
    return out.withColumn("score", F.round("score", 6))


def sector_fusion(spark, sf):
    """Flagship: filtered radar into dense bearing bins with range, closing speed,
    time to collision and vote score."""
    raw = view(spark, sf, "fx_radar")
    bins = R.radar_bins(R.with_polar(R.filter_points(R.gate_frames(raw))))
    frames = R.frame_counts(raw)
    out = R.dense_bins(frames).join(bins, R.FRAME + ["bin_index"], "left")
    n = F.coalesce(F.col("radar_n_points"), F.lit(0)).cast("bigint")
    hit = (n > 0).cast("bigint")
    return out.select(
        *R.FRAME, "bin_index", "bin_center_deg", "t_ms", n.alias("radar_n_points"), hit.alias("hit_mmwave"),
        F.round("radar_min_range_m", 6).alias("min_range_m"), r6("closing_mps"), r6("ttc_s"),
        F.round(hit / F.lit(3.0), 6).alias("score"))


query("flagship_sector_fusion", "fx_radar", sql=GATED + """,
c AS (SELECT *, -vy AS c, row_number() OVER (PARTITION BY clip_id, frame_index, b ORDER BY vy IS NULL, abs(vy), -vy) AS rn,
  count(vy) OVER (PARTITION BY clip_id, frame_index, b) AS nv FROM pb),
a AS (SELECT clip_id, frame_index, b, count(*) AS n, min(y) AS mr, max(CASE WHEN rn = nv // 2 + 1 AND vy IS NOT NULL THEN c END) AS closing FROM c GROUP BY ALL),
fr AS (SELECT clip_id, frame_index, min(t_ms) AS t_ms FROM fx_radar GROUP BY ALL)
SELECT f.clip_id, f.frame_index, g.b AS bin_index, CAST(-45e0 + 15e0 * g.b AS DOUBLE) AS bin_center_deg, f.t_ms, CAST(coalesce(n, 0) AS BIGINT) AS radar_n_points,
 CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS BIGINT) AS hit_mmwave, round(mr, 6) AS min_range_m, round(closing, 6) + 0.0 AS closing_mps,
 round(CASE WHEN closing > 0.15 THEN least(mr / closing, 60e0) END, 6) + 0.0 AS ttc_s, round(CASE WHEN n > 0 THEN 1 ELSE 0 END / 3e0, 6) AS score
FROM fr f CROSS JOIN (SELECT unnest(range(7)) AS b) g LEFT JOIN a ON a.clip_id = f.clip_id AND a.frame_index = f.frame_index AND a.b = g.b""")(sector_fusion)


@query("J14_frame_point_matching", "fx_radar", sql=GATED + """,
k2 AS (SELECT *, CAST(floor(x/0.5e0) AS BIGINT) cx, CAST(floor(y/0.5e0) AS BIGINT) cy FROM kept),
pr AS (SELECT c.clip_id, c.frame_index, c.point_id, p.point_id AS p_id, sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)) AS d,
  (c.x-p.x)/((c.t_ms-p.t_ms)/1000e0) AS vx, (c.y-p.y)/((c.t_ms-p.t_ms)/1000e0) AS vy
  FROM kept c JOIN kept p ON p.clip_id = c.clip_id AND p.frame_index + 1 = c.frame_index
  WHERE sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)) <= 0.5e0 AND c.t_ms > p.t_ms AND c.t_ms - p.t_ms <= 500),
ls AS (SELECT clip_id, frame_index, list(struct_pack(d := d, l := point_id, r := p_id) ORDER BY d, point_id, p_id) AS ps FROM pr GROUP BY ALL),
m AS (SELECT clip_id, frame_index, list_reduce(list_transform(ps, lambda q: [q]), lambda a, q: CASE WHEN len(list_filter(a, lambda z: z.l = q[1].l OR z.r = q[1].r)) = 0 THEN list_concat(a, q) ELSE a END) AS won FROM ls),
u AS (SELECT clip_id, frame_index, unnest(won) AS w FROM m)
SELECT pr.clip_id, pr.frame_index, pr.point_id, pr.p_id, round(d, 6) AS dist, round(vx, 6) + 0.0 AS trk_vx, round(vy, 6) + 0.0 AS trk_vy
FROM pr JOIN u ON pr.clip_id = u.clip_id AND pr.frame_index = u.frame_index AND pr.point_id = u.w.l AND pr.p_id = u.w.r""")
def point_matching(spark, sf):
    m = R.match_consecutive(_kept(spark, sf))
    return m.select(*R.FRAME, "point_id", "p_id", F.round("dist", 6).alias("dist"), r6("trk_vx"), r6("trk_vy"))


@query("P09_velocity_provenance", "fx_radar", sql=GATED + ", mt AS (" + CATALOG["J14_frame_point_matching"].sql + """),
fs AS (SELECT p.clip_id, p.frame_index, bool_or(vy IS NOT NULL) AS d, bool_or(vy IS NULL AND mt.point_id IS NOT NULL) AS t FROM pol p LEFT JOIN mt ON mt.clip_id = p.clip_id AND mt.frame_index = p.frame_index AND mt.point_id = p.point_id GROUP BY 1, 2)
SELECT CASE WHEN d AND t THEN 'mixed' WHEN d THEN 'doppler' ELSE 'tracker' END AS velocity_source, count(*) AS n_frames FROM fs GROUP BY 1""")
def velocity_provenance(spark, sf):
    kept = _kept(spark, sf)
    polar = R.with_polar(kept)
    both = R.coalesce_velocity(polar, R.match_consecutive(kept))
    src = R.velocity_source(both)
    return src.groupBy("velocity_source").agg(F.count("*").alias("n_frames"))
