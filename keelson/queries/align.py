"""Clock, alignment, session and curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.fixtures import load, view
from keelson.functions import clock, sun
from keelson.functions.rounding import r6, tidy
from keelson.operators import align as A
from keelson.operators import curation as C
from keelson.queries.catalog import query

STAMP = "strftime(o_orderdate, '%Y-%m-%d')"


@query("P01_P02_P04_clock_keys", sql="""
SELECT event_id, substr(strftime(ts, '%H:%M:%S.%f'), 1, 10) AS rounded_time,
 round(extract(hour FROM ts) * 3600e0 + extract(minute FROM ts) * 60 + CAST(floor(extract(microseconds FROM ts) / 100000e0) AS BIGINT) / 10e0, 6) AS sod,
 CASE WHEN event_type = 'error' THEN 0e0 ELSE extract(hour FROM ts) * 3600e0 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) END AS stamp_s
FROM events""")
def clock_keys(spark, sf):
    e = load(spark, sf, "events")
    rt = clock.rounded_time(F.col("ts"))
    stamp = F.when(F.col("event_type") == "error", F.lit("clip_without_time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"))
    return e.select("event_id", rt.alias("rounded_time"), r6(clock.seconds_of_day(rt), "sod"),
                    r6(clock.stamp_seconds(stamp), "stamp_s"))


@query("P03_local_to_utc", sql="""
WITH b AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, (o_orderkey * 7919) % 864000 AS ds, (o_orderkey * 104729) % 86400 AS cs FROM orders),
t AS (SELECT *, CAST(d AS TIMESTAMP) + to_milliseconds(ds * 100) + CASE WHEN cs - ds / 10e0 > 43200 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS l FROM b)
SELECT o_orderkey, strftime(l - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS utc_second FROM t""")
def local_to_utc(spark, sf):
    o = load(spark, sf, "orders")
    hms = clock.hms_tenths((F.col("o_orderkey") * 7919 % 864000) / 10.0)
    cs = (F.col("o_orderkey") * 104729) % 86400
    chunk = F.format_string("%02d-%02d-%02d", F.floor(cs / 3600).cast("int"), F.floor(cs % 3600 / 60).cast("int"), (cs % 60).cast("int"))
    utc = clock.to_utc(F.date_format("o_orderdate", "yyyy-MM-dd"), hms, "Etc/GMT-1", chunk)
    return o.select("o_orderkey", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("utc_second"))


@query("P05_frame_keys", "fx_det", sql="""
SELECT clip_id, frame_index, replace(clip_id, '/', '__') AS clip_key, clip_id AS back,
 concat(clip_id, '/', lpad(CAST(frame_index AS VARCHAR), 6, '0')) AS by_index, frame_index AS idx,
 concat(clip_id, '/ts=00-00-', lpad(CAST(frame_index % 60 AS VARCHAR), 2, '0'), '.5') AS by_time, concat('00:00:', lpad(CAST(frame_index % 60 AS VARCHAR), 2, '0'), '.5') AS frame_ts, split_part(clip_id, '/', 1) AS scene
FROM fx_det GROUP BY ALL""")
def frame_keys(spark, sf):
    d = view(spark, sf, "fx_det").select("clip_id", "frame_index").distinct()
    p = F.split("clip_id", "/")
    by_index = F.concat("clip_id", F.lit("/"), F.lpad(F.col("frame_index").cast("string"), 6, "0"))
    ts = F.format_string("00:00:%02d.5", (F.col("frame_index") % 60).cast("int"))
    by_time = clock.frame_id(p[0], p[1], ts)
    return d.select(
        "clip_id", "frame_index", clock.clip_key(F.col("clip_id")).alias("clip_key"),
        clock.clip_id(clock.clip_key(F.col("clip_id"))).alias("back"), by_index.alias("by_index"),
        clock.parse_frame_id(by_index)["frame_idx"].alias("idx"), by_time.alias("by_time"),
        clock.parse_frame_id(by_time)["frame_ts"].alias("frame_ts"), clock.parse_frame_id(by_time)["scene"].alias("scene"))


SUN_SQL = """WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS s, 40e0 + event_id % 15 AS lat, 5e0 + event_id % 12 AS lon FROM events),
a AS (SELECT *, (s / 86400 + 2440587.5e0 - 2451545e0) / 36525e0 AS t, s - floor(s / 86400) * 86400 AS sod FROM e),
b AS (SELECT *, 280.46646e0 + t * (36000.76983e0 + t * 0.0003032e0) AS l0, radians(357.52911e0 + t * (35999.05029e0 - 0.0001537e0 * t)) AS m,
 0.016708634e0 - t * (0.000042037e0 + 0.0000001267e0 * t) AS ec, radians(125.04e0 - 1934.136e0 * t) AS nd,
 23e0 + (26e0 + (21.448e0 - t * (46.815e0 + t * (0.00059e0 - t * 0.001813e0))) / 60e0) / 60e0 AS t0 FROM a),
c AS (SELECT *, radians(l0 - floor(l0 / 360) * 360) AS lr, radians(t0 + 0.00256e0 * cos(nd)) AS ti,
 sin(m) * (1.914602e0 - t * (0.004817e0 + 0.000014e0 * t)) + sin(2 * m) * (0.019993e0 - 0.000101e0 * t) + sin(3 * m) * 0.000289e0 AS ce FROM b),
d AS (SELECT *, asin(sin(ti) * sin(radians(degrees(lr) + ce - 0.00569e0 - 0.00478e0 * sin(nd)))) AS de, tan(ti / 2) * tan(ti / 2) AS y FROM c),
f AS (SELECT *, sod / 60 + 4 * degrees(y * sin(2 * lr) - 2 * ec * sin(m) + 4 * ec * y * sin(m) * cos(2 * lr) - 0.5e0 * y * y * sin(4 * lr) - 1.25e0 * ec * ec * sin(2 * m)) + 4 * lon AS tst FROM d),
g AS (SELECT *, radians((tst - floor(tst / 1440) * 1440) / 4 - 180) AS h, radians(lat) AS la FROM f),
z AS (SELECT *, acos(greatest(-1e0, least(1e0, sin(la) * sin(de) + cos(la) * cos(de) * cos(h)))) AS ze FROM g),
az AS (SELECT *, degrees(acos(greatest(-1e0, least(1e0, (sin(la) * cos(ze) - sin(de)) / (cos(la) * sin(ze)))))) AS br FROM z),
dd AS (SELECT event_id, t * 36525 AS d, lat, lon FROM a),
s1 AS (SELECT *, radians(357.529e0 + 0.98560028e0 * d) AS g, 280.459e0 + 0.98564736e0 * d AS q, radians(23.439e0 - 0.00000036e0 * d) AS e2 FROM dd),
s2 AS (SELECT *, radians(q + 1.915e0 * sin(g) + 0.020e0 * sin(2 * g)) AS lam FROM s1),
s3 AS (SELECT *, degrees(atan2(cos(e2) * sin(lam), cos(lam))) AS ra, asin(sin(e2) * sin(lam)) AS dec2, (18.697374558e0 + 24.06570982441908e0 * d) * 15 + lon AS lst FROM s2),
s4 AS (SELECT event_id, degrees(asin(sin(radians(lat)) * sin(dec2) + cos(radians(lat)) * cos(dec2) * cos(radians(lst - ra)))) AS el2 FROM s3)
SELECT event_id, round(90 - degrees(ze), 4) AS elevation, round(CASE WHEN h > 0 THEN (br + 180) - floor((br + 180) / 360) * 360 ELSE (540 - br) - floor((540 - br) / 360) * 360 END, 3) AS azimuth,
 round(el2, 3) AS elevation_short,
 CASE WHEN 90 - degrees(ze) > 6 THEN 'day' WHEN 90 - degrees(ze) < -6 THEN 'night' ELSE 'dusk' END AS part_eval,
 CASE WHEN 90 - degrees(ze) < -6 THEN 'night' WHEN 90 - degrees(ze) < 0 THEN 'twilight' WHEN 90 - degrees(ze) < 10 THEN 'golden' ELSE 'day' END AS part_footage,
 CASE WHEN 90 - degrees(ze) >= 10 THEN 'day' WHEN 90 - degrees(ze) < -6 THEN 'night' ELSE 'twilight' END AS part_thermal
FROM az JOIN s4 USING (event_id)"""


@query("P24_P25_sun_dayparts", sql=SUN_SQL)
def sun_dayparts(spark, sf):
    e = load(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"),
                                         (40.0 + F.col("event_id") % 15).alias("lat"), (5.0 + F.col("event_id") % 12).alias("lon"))
    e = e.withColumn("p", sun.position(F.col("lat"), F.col("lon"), F.col("s"))).withColumn(
        "q", sun.position_short(F.col("lat"), F.col("lon"), F.col("s")))
    el = F.col("p.elevation")
    return e.select("event_id", F.round(el, 4).alias("elevation"), F.round("p.azimuth", 3).alias("azimuth"),
                    F.round("q.elevation", 3).alias("elevation_short"), sun.daypart_eval(el).alias("part_eval"),
                    sun.daypart_footage(el).alias("part_footage"), sun.daypart_thermal(el).alias("part_thermal"))


@query("P36_split_assignment", sql="""WITH c AS (SELECT o_orderkey, concat('Scene', o_custkey % 9) AS sc, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
h AS (SELECT *, CAST(concat('0x', substr(sha256(concat(sc, '/', d)), 1, 8)) AS BIGINT) % 10000 / 10000e0 AS b FROM c)
SELECT o_orderkey, concat(sc, '/', d) AS group_key, CASE WHEN concat(sc, '/', d) = 'Scene1/1995-01-01' THEN 'test' WHEN d >= '1999-06-01' THEN 'test' WHEN b < 0.70e0 THEN 'train' WHEN b < 0.70e0 + 0.15e0 THEN 'val' ELSE 'test' END AS split FROM h""")
def split_assignment(spark, sf):
    o = load(spark, sf, "orders")
    clip = F.concat(F.lit("Scene"), (F.col("o_custkey") % 9).cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    s = clock.assign_split(clip, test_after="1999-06-01", test=["Scene1/1995-01-01"])
    return o.select("o_orderkey", s["group_key"].alias("group_key"), s["split"].alias("split"))


@query("J01_lockstep_align", "fx_radar", "fx_det", "fx_scores", sql="""
, rt AS (SELECT clip_id, t_ms, CAST(count(x) AS BIGINT) AS n_points, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY t_ms) - 1 AS BIGINT) AS frame_index FROM fx_radar GROUP BY clip_id, t_ms),
cl AS (SELECT clip_id, CAST(max(frame_index) AS BIGINT) - 5 AS n FROM fx_det GROUP BY 1 UNION ALL SELECT clip_id, CAST(max(frame_index) + 1 AS BIGINT) FROM fx_scores GROUP BY 1),
f AS (SELECT clip_id, frame_index, t_ms / 1000e0 AS t_s, n_points, 'radar' AS clock FROM rt JOIN cl USING (clip_id) WHERE frame_index < n
 UNION ALL SELECT clip_id, unnest(range(n)), 43200e0 + unnest(range(n)) / 3e0, 0, 'nominal' FROM cl WHERE n > 0 AND clip_id NOT IN (SELECT clip_id FROM rt))
SELECT clip_id, frame_index, round(t_s, 6) AS t_s, n_points, clock FROM f""")
def lockstep(spark, sf):
    det = view(spark, sf, "fx_det").groupBy("clip_id").agg((F.max("frame_index") - 5).alias("n_frames"))
    sil = view(spark, sf, "fx_scores").groupBy("clip_id").agg((F.max("frame_index") + 1).alias("n_frames"))
    clips = det.unionByName(sil).withColumn("base_s", F.lit(43200.0))
    out = A.lockstep(A.radar_ordinals(view(spark, sf, "fx_radar")), clips)
    return tidy(out.drop("rounded_time"))


@query("J02_attitude_nearest", "fx_radar", "fx_imu", sql="""
, f AS (SELECT clip_id, frame_index, min(t_ms) AS t_ms FROM fx_radar GROUP BY 1, 2),
p AS (SELECT f.clip_id, f.frame_index, f.t_ms, yaw, pitch, roll, f.t_ms - i.t_ms AS gap, row_number() OVER (PARTITION BY f.clip_id, f.frame_index ORDER BY abs(f.t_ms - i.t_ms), i.t_ms) AS rn
 FROM f JOIN fx_imu i ON i.clip_id = f.clip_id AND abs(f.t_ms - i.t_ms) <= 1000)
SELECT f.clip_id, f.frame_index, f.t_ms, round(yaw, 6) AS yaw, round(pitch, 6) AS pitch, round(roll, 6) AS roll, CAST(gap AS DOUBLE) AS asof_gap
FROM f LEFT JOIN (SELECT * FROM p WHERE rn = 1) q ON q.clip_id = f.clip_id AND q.frame_index = f.frame_index""")
def attitude(spark, sf):
    f = view(spark, sf, "fx_radar").groupBy("clip_id", "frame_index").agg(F.min("t_ms").alias("t_ms"))
    return tidy(A.attach_attitude(f, view(spark, sf, "fx_imu")))


@query("J03_exposure_lookup", "fx_radar", "fx_scores", sql="""
, f AS (SELECT DISTINCT clip_id, frame_index FROM fx_scores),
s AS (SELECT clip_id, CASE WHEN frame_index % 17 = 0 THEN NULL ELSE frame_index END AS frame_index, 1000e0 + max(row_id) % 777 AS exposure_time_us FROM fx_scores GROUP BY clip_id, fx_scores.frame_index)
SELECT f.clip_id, f.frame_index, exposure_time_us FROM f LEFT JOIN s USING (clip_id, frame_index)""")
def exposure(spark, sf):
    sc = view(spark, sf, "fx_scores")
    side = sc.groupBy("clip_id", "frame_index").agg(F.max("row_id").alias("row_id")).select(
        "clip_id", F.expr("CASE WHEN frame_index % 17 = 0 THEN NULL ELSE frame_index END").alias("frame_index"),
        (F.lit(1000.0) + F.col("row_id") % 777).alias("exposure_time_us"))
    return A.attach_exposure(sc.select("clip_id", "frame_index").distinct(), side)


@query("J08_radar_health_trail", "fx_radar", "fx_imu", sql="""
, g AS (SELECT DISTINCT clip_id, t_ms FROM fx_radar), f AS (SELECT clip_id, t_ms, row_no AS frame_index FROM fx_imu),
h AS (SELECT f.clip_id, f.frame_index, f.t_ms, max(g.t_ms) FILTER (g.t_ms <= f.t_ms + 50) AS last_g,
  count(g.t_ms) FILTER (g.t_ms <= f.t_ms AND f.t_ms - g.t_ms <= 2000) AS n_in, max(g.t_ms) FILTER (g.t_ms <= f.t_ms AND f.t_ms - g.t_ms <= 2000) AS newest
 FROM f LEFT JOIN g ON g.clip_id = f.clip_id GROUP BY 1, 2, 3)
SELECT clip_id, frame_index, CASE WHEN t_ms - last_g <= 2000 THEN last_g END AS group_ms, coalesce(t_ms - last_g <= 2000, false) AS radar_ok, CAST(least(n_in, 5) AS BIGINT) AS trail_len, newest AS trail_newest FROM h""")
def health_trail(spark, sf):
    g = view(spark, sf, "fx_radar").select("clip_id", "t_ms").distinct()
    f = view(spark, sf, "fx_imu").select("clip_id", "t_ms", F.col("row_no").alias("frame_index"))
    h = A.radar_health(f, g)
    t = A.radar_trail(f, g).select("clip_id", "frame_index", F.size("trail").cast("bigint").alias("trail_len"),
                                   F.array_max("trail").alias("trail_newest"))
    return h.select("clip_id", "frame_index", "group_ms", "radar_ok").join(t, ["clip_id", "frame_index"])


CUTS = """, cuts AS (SELECT concat('Lake', c_custkey % 4, '/c', CAST(floor(c_custkey / 400e0) AS BIGINT)) AS clip_id, (c_custkey * 53) % 40000 AS start_ms, (c_custkey * 53) % 40000 + (c_custkey % 7) * 100 - 200 AS end_ms FROM customer),
f AS (SELECT clip_id, frame_index, min(t_ms) AS t_ms FROM fx_radar GROUP BY 1, 2),
m AS (SELECT f.*, EXISTS (SELECT 1 FROM cuts c WHERE c.clip_id = f.clip_id AND f.t_ms BETWEEN least(start_ms, end_ms) AND greatest(start_ms, end_ms)) AS cut FROM f)"""


def _cuts(spark, sf):
    return load(spark, sf, "customer").selectExpr(
        "concat('Lake', c_custkey % 4, '/c', CAST(floor(c_custkey / 400e0) AS BIGINT)) AS clip_id",
        "(c_custkey * 53) % 40000 AS start_ms", "(c_custkey * 53) % 40000 + (c_custkey % 7) * 100 - 200 AS end_ms")


def _frames(spark, sf):
    return view(spark, sf, "fx_radar").groupBy("clip_id", "frame_index").agg(F.min("t_ms").alias("t_ms"))


@query("F06_J13_curation_cuts", "fx_radar", sql=CUTS + " SELECT clip_id, frame_index, t_ms FROM m WHERE NOT cut")
def curation_cuts(spark, sf):
    return C.drop_cut(_frames(spark, sf), _cuts(spark, sf))


@query("A43_cut_stats", "fx_radar", sql=CUTS + """,
n AS (SELECT *, lead(t_ms) OVER (PARTITION BY clip_id ORDER BY frame_index) AS nx FROM m),
d AS (SELECT *, CASE WHEN nx IS NULL THEN 1e0 / 3e0 ELSE least(greatest((nx - t_ms) / 1000e0, 0e0), 2.5e0) END AS dur FROM n),
r AS (SELECT clip_id, round(sum(abs(end_ms - start_ms) / 1000e0 + 1e0 / 3e0), 6) AS range_s FROM cuts GROUP BY 1)
SELECT d.clip_id, CAST(count(*) FILTER (NOT cut) AS BIGINT) AS kept, CAST(count(*) FILTER (cut) AS BIGINT) AS cut_frames,
 round(coalesce(sum(dur) FILTER (NOT cut), 0), 6) AS kept_s, round(coalesce(sum(dur) FILTER (cut), 0), 6) AS cut_s, max(range_s) AS range_s FROM d LEFT JOIN r USING (clip_id) GROUP BY 1""")
def cut_stats(spark, sf):
    cuts = _cuts(spark, sf)
    return tidy(C.cut_stats(_frames(spark, sf), cuts).join(C.cut_range_seconds(cuts), "clip_id", "left"))


SETS = """WITH sets AS (SELECT concat('Scene', o_custkey % 9, '__', o_orderkey) AS clip_key, concat('Scene', o_custkey % 9) AS scene, o_orderkey AS k,
 CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS deleted_at,
 CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + to_days(CAST(o_custkey % 5 - 2 AS INTEGER)), '%Y-%m-%d') END AS restored_at,
 CASE WHEN o_orderkey % 23 = 0 THEN '2001-01-01' END AS purged_at FROM orders),
dl AS (SELECT * FROM sets WHERE purged_at IS NOT NULL OR (deleted_at IS NOT NULL AND (restored_at IS NULL OR restored_at < deleted_at)))"""


def _sets(spark, sf):
    return load(spark, sf, "orders").selectExpr(
        "concat('Scene', o_custkey % 9, '__', o_orderkey) AS clip_key", "concat('Scene', o_custkey % 9) AS scene",
        "array(cast(o_orderkey + 1 as string)) AS chunks",
        "CASE WHEN o_orderstatus = 'F' THEN date_format(o_orderdate, 'yyyy-MM-dd') END AS deleted_at",
        "CASE WHEN o_orderkey % 3 = 0 THEN date_format(date_add(o_orderdate, cast(o_custkey % 5 - 2 as int)), 'yyyy-MM-dd') END AS restored_at",
        "CASE WHEN o_orderkey % 23 = 0 THEN '2001-01-01' END AS purged_at")


@query("F07_S10_chunk_selection", sql=SETS + """,
dk AS (SELECT clip_key FROM dl UNION SELECT concat(scene, '__', k + 1) FROM dl)
SELECT concat('Scene', o_custkey % 9, '/', o_orderkey) AS clip_id FROM orders WHERE o_custkey % 9 <> 3 AND extract(year FROM o_orderdate) >= 1996
 AND concat('Scene', o_custkey % 9, '__', o_orderkey) NOT IN (SELECT clip_key FROM dk)""")
def chunk_selection(spark, sf):
    clips = load(spark, sf, "orders").selectExpr(
        "concat('Scene', o_custkey % 9, '/', o_orderkey) AS clip_id", "concat('Scene', o_custkey % 9) AS scene",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS stamp")
    return C.select_chunks(clips, _sets(spark, sf), ["Scene3"], 1996).select("clip_id")


@query("F10_purge_candidates", sql=SETS + """
SELECT clip_key, CAST(0 AS BIGINT) AS days_left FROM dl WHERE purged_at IS NULL AND deleted_at IS NOT NULL
 AND ceil((epoch(CAST(deleted_at AS TIMESTAMP)) + 30 * 86400 - 900000000) / 86400e0) <= 0""")
def purge(spark, sf):
    return C.purge_candidates(_sets(spark, sf), 900000000).select("clip_key", "days_left")


@query("W01_W13_steps_and_runs", "fx_radar", sql="""
, f AS (SELECT clip_id, frame_index, min(t_ms) / 1000e0 * 1500 % 86400 AS t_s FROM fx_radar GROUP BY 1, 2),
l AS (SELECT *, t_s - lag(t_s) OVER w AS raw, lead(t_s) OVER w - t_s AS nx FROM f WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index)),
d AS (SELECT *, CASE WHEN raw < -80000 THEN raw + 86400 ELSE raw END AS dt, coalesce((CASE WHEN nx < 0 THEN nx + 86400 ELSE nx END) <= 150, true) AS ok FROM l),
e AS (SELECT *, CASE WHEN ok IS DISTINCT FROM lag(ok) OVER (PARTITION BY clip_id ORDER BY frame_index) THEN 1 ELSE 0 END AS nw FROM d),
r AS (SELECT *, sum(nw) OVER (PARTITION BY clip_id ORDER BY frame_index) AS run FROM e)
SELECT clip_id, CAST(run AS BIGINT) AS run, min(frame_index) AS start_pos, CAST(count(*) AS BIGINT) AS length, CASE WHEN ok THEN 'ok' ELSE 'down' END AS state,
 CAST(count(CASE WHEN dt > 0 AND dt <= 200 THEN 1 END) AS BIGINT) AS n_steps FROM r GROUP BY clip_id, run, ok""")
def steps_runs(spark, sf):
    f = _frames(spark, sf).withColumn("t_s", F.col("t_ms") / 1000.0 * 1500 % 86400)
    d = A.frame_steps(A.loop_health(f, 150.0), max_gap_s=200.0)
    d = d.withColumn("state", F.when(F.col("ok"), "ok").otherwise("down"))
    return A.number_runs(d, ["clip_id"], "frame_index", "state").groupBy("clip_id", "run").agg(
        F.min("frame_index").alias("start_pos"), F.count("*").alias("length"), F.first("state").alias("state"),
        F.count("dt_s").alias("n_steps"))


@query("W12_activity_sessions", "fx_clips", sql="""
, l AS (SELECT *, lag(start_s + duration_s) OVER (PARTITION BY scene ORDER BY start_s, chunk_no) AS pe FROM fx_clips),
s AS (SELECT *, sum(CASE WHEN start_s - pe <= 45 THEN 0 ELSE 1 END) OVER (PARTITION BY scene ORDER BY start_s, chunk_no) AS a FROM l)
SELECT scene, CAST(a AS BIGINT) AS activity, CAST(count(*) AS BIGINT) AS n_chunks, min(chunk_no) AS first_chunk, CAST(sum(duration_s) AS BIGINT) AS total_s FROM s GROUP BY 1, 2""")
def activity_sessions(spark, sf):
    return A.sessions(view(spark, sf, "fx_clips")).groupBy("scene", "activity").agg(
        F.count("*").alias("n_chunks"), F.min("chunk_no").alias("first_chunk"), F.sum("duration_s").alias("total_s"))


@query("W15_latest_per_key", "fx_review_log", sql="""
, r AS (SELECT *, row_number() OVER (PARTITION BY crop_no ORDER BY created_at DESC, id DESC) AS rn FROM fx_review_log)
SELECT crop_no, id, label FROM r WHERE rn = 1""")
def latest(spark, sf):
    return C.latest_per_key(view(spark, sf, "fx_review_log"), ["crop_no"], "created_at", "id").select("crop_no", "id", "label")


@query("W17_new_fixes", "fx_gps", sql="""
, l AS (SELECT *, lag(fix_ms) OVER w AS pf, lag(source) OVER w AS ps, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo, row_number() OVER w AS rn FROM fx_gps
 WINDOW w AS (PARTITION BY clip_id ORDER BY t_ms, row_no))
SELECT clip_id, row_no FROM l WHERE rn = 1 OR pf IS DISTINCT FROM fix_ms OR ps IS DISTINCT FROM source OR pla IS DISTINCT FROM lat OR plo IS DISTINCT FROM lon""")
def fixes(spark, sf):
    g = view(spark, sf, "fx_gps")
    return A.new_fixes(g, ["t_ms", "row_no"]).select("clip_id", "row_no")


@query("U01_U02_label_store", "fx_det", sql="""
, a AS (SELECT concat(clip_id, '/', frame_index) AS frame_id, split_part(clip_id, '/', 1) AS scene, det_id FROM fx_det WHERE sensor = 'fisheye'),
b AS (SELECT concat(clip_id, '/', frame_index) AS frame_id, split_part(clip_id, '/', 1) AS scene, det_id FROM fx_det WHERE sensor = 'thermal'),
seed AS (SELECT * FROM b WHERE scene = 'Lake2'),
st AS (SELECT * FROM a WHERE scene NOT IN (SELECT scene FROM seed) UNION ALL SELECT * FROM seed)
SELECT frame_id, CAST(count(*) AS BIGINT) AS n_boxes, CAST(sum(det_id) AS BIGINT) AS id_sum FROM st GROUP BY 1""")
def label_store(spark, sf):
    d = view(spark, sf, "fx_det").select(
        F.concat_ws("/", "clip_id", "frame_index").alias("frame_id"), F.split("clip_id", "/")[0].alias("scene"), "det_id", "sensor")
    boxes = F.array("det_id").alias("boxes")
    a = d.filter("sensor = 'fisheye'").select("frame_id", "scene", boxes, F.lit(True).alias("audited"))
    b = d.filter("sensor = 'thermal' AND scene = 'Lake2'").select("frame_id", "scene", boxes, F.lit(False).alias("audited"))
    m = C.merge_label_files(C.replace_scene(a, b).drop("scene"))
    return m.select("frame_id", F.size("boxes").cast("bigint").alias("n_boxes"),
                    F.aggregate("boxes", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("id_sum"))
