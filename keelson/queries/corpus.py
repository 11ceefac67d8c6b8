"""Source, sink, link, coverage and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.fixtures import load, view
from keelson.functions.rounding import r6, tidy
from keelson.operators import coverage as C
from keelson.operators import link as L
from keelson.queries.catalog import query
from keelson.queries.sectors import SC, scored
from keelson.sources import scans as S
from keelson.sources import sinks as K

RAW = """CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN 1e30 ELSE (l_partkey * 37 % 1200 - 600) / 100e0 END"""


@query("S01_radar_scan", sql=f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {RAW} AS x, l_suppkey % 3 AS gen, (l_partkey % 300 - 150) / 10e0 AS v, l_tax * 100 AS nz, (l_orderkey * 7919 % 864000) AS ds FROM lineitem)
SELECT l_orderkey AS k, substr(strftime(TIMESTAMP '2024-06-01' + to_milliseconds(ds * 100 + 57), '%H:%M:%S.%f'), 1, 10) AS rounded_time, count(*) AS n_rows, count(x) AS n_points, round(sum(x), 4) + 0.0 AS sx, count(CASE WHEN gen > 0 AND abs(v) <= 10 THEN 1 END) AS n_v, count(CASE WHEN gen = 2 THEN 1 END) AS n_snr
FROM r WHERE x IS NULL OR abs(x) < 50 GROUP BY 1, 2""")
def radar_scan(spark, sf):
    d = load(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_suppkey % 3 AS gen", f"{RAW} AS x", "(l_partkey % 300 - 150) / 10e0 AS v", "l_tax * 100 AS nz", "(l_orderkey * 7919 % 864000) * 100 + 57 AS ms")
    t = F.date_format(F.timestamp_millis(F.col("ms")), "HH:mm:ss.SSS")
    xyz = F.coalesce(F.concat_ws(",", F.col("x").cast("string"), F.lit("1.5"), F.lit("0")), F.lit(",,"))
    xyz = F.when(F.col("x").isNull(), F.lit(",,")).otherwise(xyz)
    line = F.concat_ws(",", F.lit("2024-06-01"), t, xyz, F.when(F.col("gen") > 0, F.col("v").cast("string")), F.when(F.col("gen") == 2, F.concat_ws(",", F.lit("12.5"), F.col("nz").cast("string"))))
    r = S.radar_rows(d.select("k", line.alias("line")))
    return r.groupBy("k", "rounded_time").agg(F.count("*").alias("n_rows"), F.count("x").alias("n_points"), (F.round(F.sum("x"), 4) + F.lit(0.0)).alias("sx"),
                                              F.count("v").alias("n_v"), F.count("snr").alias("n_snr"))


@query("S02_attitude_scan", "fx_imu", sql=""" SELECT row_no, CASE WHEN row_no % 3 = 1 THEN 'quaternion' ELSE 'euler' END AS layout, CASE WHEN row_no % 3 <> 1 THEN yaw + 0.0 END AS yaw, CASE WHEN row_no % 3 = 2 THEN 0.5e0 END AS ax, CASE WHEN row_no % 3 = 1 THEN pitch + 0.0 END AS qx FROM fx_imu WHERE roll > -10""")
def imu_scan(spark, sf):
    d = view(spark, sf, "fx_imu")
    r = F.when(F.col("roll") > -10, F.col("roll").cast("string")).otherwise("")
    body = (F.when(F.col("row_no") % 3 == 1, F.concat_ws(",", F.lit("0.5"), F.col("pitch").cast("string"), r, F.lit("0.1")))
            .when(F.col("row_no") % 3 == 2, F.concat_ws(",", F.col("yaw").cast("string"), F.col("pitch").cast("string"), r, F.lit("0.5,0,9.8")))
            .otherwise(F.concat_ws(",", F.col("yaw").cast("string"), F.col("pitch").cast("string"), r)))
    x = S.imu_rows(d.select("row_no", F.concat(F.lit("2024-06-01,12:00:00.100,"), body).alias("line")))
    return x.select("row_no", "layout", (F.col("yaw") + F.lit(0.0)).alias("yaw"), "ax", (F.col("qx") + F.lit(0.0)).alias("qx"))


@query("S03_S11_position_scans", "fx_gps", sql=""", g AS (SELECT clip_id, count(*) AS n, count(fix) AS n_fix, count(*) FILTER (source = 'fallback') AS n_fallback FROM fx_gps WHERE lat IS NOT NULL GROUP BY 1),
b AS (SELECT clip_id, arg_max(lat, row_no) AS lat, arg_max(fix, row_no) AS f1, max(row_no) AS rn FROM fx_gps WHERE lat IS NOT NULL AND lat <> 0 GROUP BY 1), f AS (SELECT clip_id, fix FROM fx_gps JOIN b USING (clip_id) WHERE row_no = rn)
SELECT g.clip_id, n, n_fix, n_fallback, round(b.lat, 6) AS boat_lat, CAST(f.fix AS BIGINT) AS boat_fix, CASE WHEN rn % 2 = 0 THEN 'stale' ELSE 'ok' END AS note FROM g LEFT JOIN b USING (clip_id) LEFT JOIN f USING (clip_id)""")
def position_scans(spark, sf):
    d = view(spark, sf, "fx_gps")
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    g = S.gps_rows(d.select("clip_id", F.concat_ws(",", F.lit("2024-06-01,12:00:00.100"), s("lat"), s("lon"), s("fix"), F.col("source"), F.lit("2024-06-01T10:00:00")).alias("line")))
    g = g.groupBy("clip_id").agg(F.count("*").alias("n"), F.count("fix").alias("n_fix"), F.count_if(F.col("source") == "fallback").alias("n_fallback"))
    iso = F.when(F.col("row_no") % 2 == 0, "2024-06-01 09:00:00").otherwise("2024-06-01 11:59:00")
    b = S.boat_fixes(d.select(F.col("clip_id").alias("log"), "row_no", s("lat").alias("lat"), s("lon").alias("lon"), s("fix").alias("fix"), iso.alias("ts_iso")), 3600, 1717243200)
    return tidy(g.join(b.select(F.col("log").alias("clip_id"), F.col("lat").alias("boat_lat"), F.col("fix_q").cast("bigint").alias("boat_fix"), "note"), "clip_id", "left"))


@query("S04_frame_clock", "fx_det", "fx_scores", sql=""", a AS (SELECT clip_id, frame_index, substr(strftime(TIMESTAMP '2024-06-01 12:00:00' + to_milliseconds(min(t_ms)), '%H:%M:%S.%f'), 1, 10) AS rounded_time, 1000e0 + frame_index AS exposure_time_us FROM fx_det GROUP BY 1, 2),
c AS (SELECT clip_id, max(frame_index) + 1 AS n FROM fx_scores GROUP BY 1), s AS (SELECT clip_id, unnest(range(n)) AS frame_index FROM c)
SELECT * FROM a UNION ALL SELECT clip_id, frame_index, substr(strftime(TIMESTAMP '2024-06-01 23:59:30' + to_microseconds(CAST(round(frame_index * 1e6 / 3) AS BIGINT)), '%H:%M:%S.%f'), 1, 10), NULL FROM s""")
def frame_clock(spark, sf):
    d = view(spark, sf, "fx_det").groupBy("clip_id", "frame_index").agg(F.min("t_ms").alias("t"))
    t = F.date_format(F.timestamp_millis(F.lit(43200000) + F.col("t")), "HH:mm:ss.SSS")
    side = S.frame_clock_rows(d.select("clip_id", F.concat_ws(",", F.col("frame_index").cast("string"), F.lit("2024-06-01"), t, (1000 + F.col("frame_index")).cast("string"), F.lit(",,")).alias("line")))
    clips = view(spark, sf, "fx_scores").groupBy("clip_id").agg((F.max("frame_index") + 1).alias("n_frames")).withColumn("chunk_start", F.expr("TIMESTAMP_NTZ'2024-06-01 23:59:30'"))
    return S.frame_clock(side, clips).select("clip_id", "frame_index", "rounded_time", "exposure_time_us")


@query("S05_label_scan", "fx_det", sql=""" SELECT det_id, clip_id, CASE WHEN det_id % 2 = 0 THEN frame_index ELSE -1 END AS frame_idx, det_id % 3 > 0 AS heading_labelled, CASE WHEN det_id % 3 = 1 THEN det_id % 45 * 1e0 END AS heading_deg, CAST(CASE WHEN det_id % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_boxes FROM fx_det WHERE det_id % 5 > 0""")
def label_scan(spark, sf):
    d = view(spark, sf, "fx_det")
    tail = F.when(F.col("det_id") % 2 == 0, F.lpad(F.col("frame_index").cast("string"), 6, "0")).otherwise("ts=12-00-01.5")
    head = F.when(F.col("det_id") % 3 == 0, "").when(F.col("det_id") % 3 == 1, F.concat(F.lit(',"safe_heading_deg":'), (F.col("det_id") % 45).cast("string"))).otherwise(',"safe_heading_deg":null')
    box = F.when(F.col("det_id") % 4 == 0, "").otherwise(',"fisheye_bboxes":[{"cls":"boat","xyxy":[0.1,0.2,0.3,0.4],"confidence":0.5}]')
    line = F.concat(F.lit('{"frame_id":"'), "clip_id", F.lit("/"), tail, F.lit('","source":"'), F.col("det_id").cast("string"), F.lit('","audited":'), (F.col("det_id") % 5 > 0).cast("string"), head, box, F.lit("}"))
    r = S.label_rows(d.select(line.alias("line")))
    return r.select(F.col("source").cast("bigint").alias("det_id"), "clip_id", "frame_idx", "heading_labelled", "heading_deg", F.size("boxes").cast("bigint").alias("n_boxes"))


@query("S06_detection_scan", "fx_det", sql=""", r AS (SELECT concat(clip_id, '/', frame_index) AS frame_id, det_id AS pos, row_number() OVER (PARTITION BY clip_id, frame_index ORDER BY det_id DESC) AS rn FROM fx_det WHERE det_id % 7 > 0)
SELECT frame_id, CAST(CASE WHEN pos % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n FROM r WHERE rn = 1""")
def detection_scan(spark, sf):
    d = view(spark, sf, "fx_det")
    body = F.when(F.col("det_id") % 3 == 0, "[]").otherwise('[{"cls":"boat","xyxy":[0,0,1,1],"confidence":0.9}]')
    ok = F.concat(F.lit('{"frame_id":"'), "clip_id", F.lit("/"), F.col("frame_index").cast("string"), F.lit('","boxes":'), body, F.lit("}"))
    r = S.detection_rows(d.select(F.col("det_id").alias("pos"), F.when(F.col("det_id") % 7 > 0, ok).otherwise('{"frame_id": "torn').alias("line")))
    return r.select("frame_id", F.size("boxes").cast("bigint").alias("n"))


@query("S07_K02_sector_records", "fx_scores", sql=SC + """ SELECT clip_id, frame_index, bin_index, CAST(1 AS BIGINT) AS protocol, round(p, 6) AS p, round(min_range_m, 6) AS min_range_m, round(score, 6) AS score FROM sc""")
def sector_records(spark, sf):
    rec = K.sector_json(scored(spark, sf).withColumn("timestamp", F.col("t_ms").cast("string")), {"timestamp": "timestamp"},
                        {"bin_centers_deg": "bin_center_deg", "scores": "score", "min_range_m": "min_range_m", "p_obstacle": "p"})
    rows = S.sector_rows(rec.withColumnRenamed("value", "line"))
    z = rows.select("clip_id", "frame_index", "protocol", F.posexplode(F.arrays_zip("p_obstacle", "min_range_m", "scores")).alias("bin_index", "z"))
    return tidy(z.select("clip_id", "frame_index", "bin_index", "protocol", F.col("z.p_obstacle").alias("p"), F.col("z.min_range_m").alias("min_range_m"), F.col("z.scores").alias("score")))


LISTING = """concat('root/m', o_custkey % 3, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/s1' WHEN 2 THEN '/_old' ELSE '/s2' END"""


@query("S09_capture_catalogue", sql="""WITH f AS (SELECT o_orderkey, o_custkey, o_orderstatus AS st, unnest(['fisheye', 'thermal', 'mmwave', 'imu']) AS s FROM orders),
k AS (SELECT concat('m', o_custkey % 3, CASE o_custkey % 4 WHEN 1 THEN '_s1' WHEN 3 THEN '_s2' ELSE '' END, '/', o_orderkey) AS clip_id, CASE WHEN o_orderkey % 5 = 0 THEN 'trimmed' WHEN o_orderkey % 5 = 1 THEN 'recovered' ELSE 'primary' END AS fisheye_kind, o_orderkey % 3 > 0 AS has_imu FROM orders WHERE o_custkey % 4 <> 2 AND o_orderstatus <> 'P')
SELECT * FROM k""")
def catalogue(spark, sf):
    o = load(spark, sf, "orders")
    folder = F.expr(LISTING + ")")
    k = F.col("o_orderkey").cast("string")
    v = lambda s: F.concat(folder, F.lit(f"/{s}_"), k)
    files = F.array(
        F.concat(v("fisheye"), F.lit(".mp4")), F.concat(v("thermal"), F.lit(".mp4")), F.when(F.col("o_orderstatus") != "P", F.concat(v("mmwave"), F.lit(".csv"))),
        F.when(F.col("o_orderkey") % 3 > 0, F.concat(v("imu"), F.lit(".csv"))),
        F.when(F.col("o_orderkey") % 5 < 2, F.concat(folder, F.lit("/recovered/fisheye_"), k, F.lit(".mp4"))),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(folder, F.lit("/recovered/fisheye_"), k, F.lit("_trimmed.mp4"))))
    listing = o.select(F.explode(F.filter(files, lambda x: x.isNotNull())).alias("path"), F.lit(1).cast("bigint").alias("length"))
    c = S.capture_catalogue(listing, "root")
    kind = F.when(F.col("fisheye").contains("_trimmed"), "trimmed").when(F.col("fisheye").contains("/recovered/"), "recovered").otherwise("primary")
    return c.select("clip_id", kind.alias("fisheye_kind"), F.col("imu").isNotNull().alias("has_imu"))


@query("S13_J23_gt_windows", "fx_scores", sql=""", w AS (SELECT DISTINCT clip_id FROM fx_scores), x AS (SELECT clip_id, unnest([0, 1, 2]) AS i FROM w),
g AS (SELECT clip_id, i AS window_no, i * 30e0 AS t0, i * 30e0 + 35 AS t1, CASE i WHEN 0 THEN 'closing' WHEN 1 THEN 'static' ELSE 'crossing' END AS state FROM x),
f AS (SELECT clip_id, frame_index, t_ms / 1000e0 AS t FROM fx_scores WHERE bin_index = 0), m AS (SELECT f.clip_id, frame_index, window_no, state, row_number() OVER (PARTITION BY f.clip_id, frame_index ORDER BY window_no) AS rn FROM f JOIN g ON g.clip_id = f.clip_id AND t BETWEEN t0 AND t1),
c AS (SELECT clip_id, frame_index, bin_index, bin_center_deg, min_range_m, row_id FROM fx_scores WHERE min_range_m IS NOT NULL AND bin_center_deg BETWEEN -20 AND 30), p AS (SELECT m.clip_id, m.frame_index, state, c.bin_index, row_number() OVER (PARTITION BY m.clip_id, m.frame_index ORDER BY min_range_m, c.row_id) AS rn FROM m LEFT JOIN c ON c.clip_id = m.clip_id AND c.frame_index = m.frame_index WHERE m.rn = 1)
SELECT clip_id, frame_index, state, bin_index AS picked_bin FROM p WHERE rn = 1""")
def gt_windows(spark, sf):
    from keelson.operators import motion_eval as ME
    d = scored(spark, sf)
    spec = d.select("clip_id").distinct().select("clip_id", F.lit(0.0).alias("t0_clip"), F.lit(
        '{"windows":[{"t0":"0","t1":"35","state":"closing","bearing_min":-20,"bearing_max":30},{"t0":"30","t1":"65","state":"static","bearing_min":-20,"bearing_max":30},'
        '{"t0":"00:01:00.0","t1":"00:01:35.0","state":"crossing","bearing_min":-20,"bearing_max":30}]}').alias("line"))
    frames = d.filter("bin_index = 0").select("clip_id", "frame_index", "t_s")
    tgt = d.filter("min_range_m IS NOT NULL").select("clip_id", "frame_index", F.col("row_id").alias("track_id"), F.col("bin_center_deg").alias("bearing_deg"), F.col("min_range_m").alias("range_m"), "bin_index")
    p = ME.pick_targets(ME.window_of_frame(frames, S.gt_windows(spec)), tgt)
    return p.select("clip_id", "frame_index", "state", F.col("bin_index").alias("picked_bin"))


@query("S14_log_constraints", "fx_review_log", sql=""" SELECT 'audits' AS log, count(*) FILTER (id % 4 > 0 AND label <> 'skip' AND label <> 'junk') AS good, count(*) FILTER (NOT (id % 4 > 0 AND label <> 'skip' AND label <> 'junk')) AS rejected FROM fx_review_log
 UNION ALL SELECT 'crops', count(*) FILTER (crop_no % 3 > 0), count(*) FILTER (crop_no % 3 = 0) FROM fx_review_log""")
def log_constraints(spark, sf):
    d = view(spark, sf, "fx_review_log")
    verdict = F.when(F.col("label") == "deny", "reject").otherwise(F.col("label"))
    boxes = F.when(F.col("label") == "junk", '"none"').otherwise("[]")
    key = F.when(F.col("id") % 4 > 0, "c1").otherwise("other")
    rec = F.concat(F.lit('{"id":"'), F.col("id").cast("string"), F.lit('","clip_key":"'), key, F.lit('","frame_ts":"t","frame_id":"f","verdict":"'), verdict,
                   F.lit('","boxes":'), boxes, F.lit(',"source":"web","created_at":"2024-01-01"}'))
    good, bad = S.split_audits(d.select(F.col("id").cast("string").alias("id"), F.lit("c1").alias("clip_key"), F.lit("t").alias("frame_ts"), rec.alias("record"), "created_at"))
    cg, cb = S.split_enum(d.withColumn("label", F.when(F.col("crop_no") % 3 > 0, F.col("label")).otherwise("maybe")), "label", S.CROP_VERDICTS)

    def n(df, log, side):
        return df.agg(F.count("*").alias("n")).select(F.lit(log).alias("log"), F.lit(side).alias("side"), "n")

    u = n(good, "audits", "good").unionByName(n(bad, "audits", "rejected")).unionByName(n(cg, "crops", "good")).unionByName(n(cb, "crops", "rejected"))
    return u.groupBy("log").agg(F.sum(F.when(F.col("side") == "good", F.col("n"))).alias("good"), F.sum(F.when(F.col("side") == "rejected", F.col("n"))).alias("rejected"))


@query("K03_release_manifest", "fx_clips", sql=""", s AS (SELECT CAST(concat('0x', substr(sha256(concat(scene, '/', substr('2024-06-0' || (chunk_no % 9 + 1), 1, 10))), 1, 8)) AS BIGINT) % 10000 / 10000e0 AS b, scene, status FROM fx_clips),
l AS (SELECT scene, count(*) FILTER (status = 'F') AS a, count(*) AS t FROM fx_clips GROUP BY ROLLUP (scene))
SELECT 'split' AS section, CASE WHEN b < 0.7e0 THEN 'train' WHEN b < 0.7e0 + 0.15e0 THEN 'val' ELSE 'test' END AS item, CAST(count(*) AS VARCHAR) AS value FROM s GROUP BY 2
UNION ALL SELECT 'labels', coalesce(scene, '(all)'), concat(a, '/', t) FROM l UNION ALL SELECT 'config', n_name, substr(sha256(concat('step: ', n_nationkey)), 1, 16) FROM nation""")
def manifest(spark, sf):
    c = view(spark, sf, "fx_clips")
    clips = c.select(F.concat("scene", F.lit("/2024-06-0"), (F.col("chunk_no") % 9 + 1).cast("string"), F.lit("_12-00-00")).alias("clip_id"))
    labels = c.select("scene", (F.col("status") == "F").alias("audited"))
    configs = load(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("step: "), F.col("n_nationkey").cast("string")).alias("content"))
    return K.release_manifest(clips, labels, configs)


OBJ = """WITH o AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey % 50 AS s, l_suppkey % 5 AS kind, concat('Lake', l_orderkey % 40) AS ck FROM lineitem),
c AS (SELECT concat('Lake', c_custkey % 40) AS ck, (c_custkey * 7) % 3000 AS a, (c_custkey * 7) % 3000 + c_custkey % 3 AS b FROM customer)"""


@query("K06_export_listing", sql=OBJ + """ SELECT ck AS clip_key, count(*) AS kept FROM o WHERE ck NOT IN (SELECT concat('Lake', n_nationkey) FROM nation WHERE n_nationkey % 6 = 4) AND (kind > 2 OR NOT EXISTS (SELECT 1 FROM c WHERE c.ck = o.ck AND o.s + 0.5 BETWEEN a AND b + 0.5)) GROUP BY 1""")
def export_listing(spark, sf):
    li = load(spark, sf, "lineitem")
    ts = F.format_string("ts=00-00-%02d.5", (F.col("l_partkey") % 50).cast("int"))
    kind = F.col("l_suppkey") % 5
    name = (F.when(kind == 0, F.concat(F.lit("/frames/"), ts, F.lit(".jpg"))).when(kind == 1, F.concat(F.lit("/thermal/"), ts, F.lit(".jpg")))
            .when(kind == 2, F.concat(F.lit("/seg/"), ts, F.lit(".png"))).when(kind == 3, F.lit("/meta.json")).otherwise(F.concat(F.lit("/other/"), ts, F.lit(".jpg"))))
    objs = li.select(F.concat(F.lit("Lake"), (F.col("l_orderkey") % 40).cast("string"), name).alias("key"))
    hms = lambda a, f: F.format_string("00:%02d:%02d." + f, F.floor(a / 60).cast("int"), (a % 60).cast("int"))
    cu = load(spark, sf, "customer")
    a = (F.col("c_custkey") * 7) % 3000
    b = a + F.col("c_custkey") % 3
    cuts = cu.select(F.concat(F.lit("Lake"), (F.col("c_custkey") % 40).cast("string")).alias("clip_key"), hms(F.least(a, b), "0").alias("start_ts"), hms(F.greatest(a, b), "5").alias("end_ts"))
    sets = load(spark, sf, "nation").select(
        F.concat(F.lit("Lake"), F.col("n_nationkey").cast("string")).alias("clip_key"), F.lit("Lake").alias("scene"), F.array().cast("array<string>").alias("chunks"),
        F.expr("CASE WHEN n_nationkey % 3 = 1 THEN '2024-01-01' END").alias("deleted_at"), F.expr("CASE WHEN n_nationkey % 6 = 1 THEN '2024-02-01' END").alias("restored_at"), F.lit(None).cast("string").alias("purged_at"))
    return K.export_listing(objs, cuts, sets).groupBy(F.regexp_extract("key", "^([^/]+)/", 1).alias("clip_key")).agg(F.count("*").alias("kept"))


@query("K07_ingest_report", "fx_clips", sql=""" SELECT scene AS mission, CAST(chunk_no AS VARCHAR) AS stamp, concat_ws(',', CASE WHEN duration_s % 11 > 0 THEN 'fisheye' END, CASE WHEN duration_s % 3 > 0 THEN 'mmwave' END, 'thermal') AS streams,
 duration_s % 11 > 0 AND (duration_s % 3 = 0 OR n_frames % 6 > 0) AS ok, CASE WHEN duration_s % 11 = 0 THEN 'fisheye missing' WHEN NOT (duration_s % 3 = 0 OR n_frames % 6 > 0) THEN 'radar columns missing' ELSE '' END AS error FROM fx_clips""")
def ingest(spark, sf):
    c = view(spark, sf, "fx_clips").withColumn("stamp", F.col("chunk_no").cast("string"))
    s = F.array(F.when(F.col("duration_s") % 11 > 0, "fisheye"), F.when(F.col("duration_s") % 3 > 0, "mmwave"), F.lit("thermal"))
    lst = c.select(F.col("scene").alias("mission"), "stamp", F.explode(F.filter(s, lambda x: x.isNotNull())).alias("stream"))
    hdr = c.filter("duration_s % 3 > 0").select(F.col("scene").alias("mission"), "stamp", F.when(F.col("n_frames") % 6 > 0, "Date,Time,X,Y,Z,V").otherwise("Date,Time,X,Y").alias("header"))
    return K.ingest_report(lst, hdr)


@query("A38_stream_statistics", "fx_radar", sql=""", r AS (SELECT clip_id, count(*) AS radar_rows, CAST(0 AS BIGINT) AS heartbeats, count(x) AS points, count(v) AS doppler, count(snr) AS snr_rows FROM fx_radar GROUP BY 1),
f AS (SELECT clip_id, count(*) AS frames, count(*) / (max(t) - min(t)) AS fps FROM (SELECT clip_id, frame_index, min(t_ms) / 1000e0 * 4 AS t FROM fx_radar GROUP BY 1, 2) GROUP BY 1)
SELECT clip_id, radar_rows, heartbeats, points, doppler, snr_rows, frames, round(fps, 6) AS loop_fps, fps < 1.5 AS degraded, false AS no_doppler FROM r JOIN f USING (clip_id)""")
def stream_stats(spark, sf):
    d = view(spark, sf, "fx_radar")
    f = d.groupBy("clip_id", "frame_index").agg((F.min("t_ms") / 1000.0 * 4).alias("t_s"))
    return tidy(K.stream_statistics(d, f))


# -- link ---------------------------------------------------------------------

def packets(spark, sf):
    """Packets encoded from score records, one in eleven corrupted."""
    d = view(spark, sf, "fx_scores")
    item = F.struct("bin_index", F.round(F.col("p") * 200).cast("int").alias("q"), F.when(F.col("min_range_m").isNull(), 65535).otherwise(F.round(F.col("min_range_m") * 100)).cast("int").alias("r"))
    g = d.groupBy("clip_id", "frame_index").agg(F.array_sort(F.collect_list(item)).alias("b"), F.min("t_ms").alias("t"), F.min("row_id").alias("rid"))
    n = F.size("b")
    h = lambda c, w: F.lpad(F.hex(c.cast("bigint")), w, "0")
    le16 = lambda c: F.concat(h(F.pmod(c, F.lit(256)), 2), h(F.floor(c / 256), 2))
    ds = F.floor(F.col("t") / 100)
    head = F.concat(F.lit("534201"), le16(F.pmod(F.col("frame_index"), F.lit(65536))), F.lit("0B"), le16(F.pmod(ds, F.lit(65536))), le16(F.floor(ds / 65536)), h(n, 2), F.lit("D3"), F.lit("0F"),
                    le16(F.col("rid") % 500), le16(F.col("rid") % 300))
    arr = lambda f: F.array_join(F.transform("b", f), "")
    le = lambda x: F.concat(F.lpad(F.hex(x["r"].cast("bigint") % 256), 2, "0"), F.lpad(F.hex(F.floor(x["r"] / 256)), 2, "0"))
    q = lambda x: F.lpad(F.hex(x["q"].cast("bigint")), 2, "0")
    body = F.concat(head, arr(q), arr(le), arr(q))
    g = g.withColumn("body", F.unhex(body)).withColumn("sum", F.aggregate(L.payload_bytes(F.col("body")), F.lit(0), lambda s, x: s + x))
    check = F.pmod(-F.col("sum") + F.when(F.col("rid") % 11 == 0, 1).otherwise(0), F.lit(256))
    return g.select("clip_id", "frame_index", "rid", F.concat("body", F.unhex(h(check, 2))).alias("payload"))


@query("P42_packet_decode", "fx_scores", sql=""", f AS (SELECT clip_id, frame_index, min(t_ms) AS t, min(row_id) AS rid FROM fx_scores GROUP BY 1, 2)
SELECT s.clip_id, s.frame_index, bin_index, bin_center_deg AS center_deg, round(round(p * 200) / 200e0, 6) AS p, round(round(min_range_m * 100) / 100e0, 6) AS min_range_m, CAST(floor(t / 100e0) AS BIGINT) AS deciseconds, round(rid % 300 / 100e0, 6) AS latency_s FROM fx_scores s JOIN f USING (clip_id, frame_index) WHERE rid % 11 > 0""")
def decode(spark, sf):
    d = L.decode(packets(spark, sf))
    return tidy(L.decoded_bins(d, ["clip_id", "frame_index", "deciseconds", "latency_s"]).drop("score"))


@query("W16_link_sequence", sql="""WITH p AS (SELECT concat('link', floor(event_id / 3000e0)) AS link, event_id AS pos, (65000 + event_id) % 65536 AS seq, value / 100 AS lat FROM events WHERE event_type <> 'error'),
g AS (SELECT *, seq - lag(seq) OVER (PARTITION BY link ORDER BY pos) AS d FROM p), h AS (SELECT *, CASE WHEN d < 0 THEN d + 65536 ELSE d END AS gap FROM g)
SELECT link, count(*) AS received, CAST(sum(coalesce(greatest(gap - 1, 0), 0)) AS BIGINT) AS missing, count(*) FILTER (gap > 1) AS gaps, count(*) FILTER (gap = 0) AS repeats, round(quantile_cont(lat, 0.5), 6) AS latency_p50, round(quantile_cont(lat, 0.95), 6) AS latency_p95 FROM h GROUP BY 1""")
def link_sequence(spark, sf):
    e = load(spark, sf, "events").filter("event_type <> 'error'").selectExpr("concat('link', CAST(floor(event_id / 3000e0) AS STRING)) AS link0", "event_id AS pos", "(65000 + event_id) % 65536 AS seq", "value / 100 AS latency_s")
    e = e.withColumn("link", F.concat("link0", F.lit(".0"))).drop("link0")
    return tidy(L.sequence_audit(e, ["link"]))


@query("W16_fragment_audit", sql="""WITH f AS (SELECT CAST(floor(event_id / 3000e0) AS BIGINT) AS link, event_id AS pos, CASE WHEN value > 300 THEN 7 ELSE CAST(floor(event_id / 4e0) AS BIGINT) % 256 END AS tag, event_id % 4 AS idx, event_id % 4 = 3 AS final FROM events WHERE event_type <> 'signup'),
n AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY pos) AS n, sum(CASE WHEN idx = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY link ORDER BY pos) AS g FROM f),
s AS (SELECT link, g, min(n) AS n0, arg_min(tag, n) AS t0 FROM n WHERE g > 0 GROUP BY 1, 2), j AS (SELECT n.*, n0, tag = t0 AND idx = n - n0 AS good FROM n JOIN s USING (link, g)),
x AS (SELECT link, g, min(n) FILTER (NOT good) AS bad, min(n) FILTER (good AND final) AS fin FROM j GROUP BY 1, 2), l AS (SELECT link, max(g) AS lg FROM x GROUP BY 1)
SELECT link, count(*) FILTER (fin IS NOT NULL AND (bad IS NULL OR fin < bad)) AS completed, count(*) FILTER (NOT (fin IS NOT NULL AND (bad IS NULL OR fin < bad)) AND (bad IS NOT NULL OR g < lg)) AS dropped_partials FROM x JOIN l USING (link) GROUP BY 1""")
def fragments(spark, sf):
    e = load(spark, sf, "events").filter("event_type <> 'signup'").selectExpr("CAST(floor(event_id / 3000e0) AS BIGINT) AS link", "event_id AS pos", "CASE WHEN value > 300 THEN 7 ELSE CAST(floor(event_id / 4e0) AS BIGINT) % 256 END AS tag", "event_id % 4 AS idx", "event_id % 4 = 3 AS final")
    return L.fragment_audit(e, ["link"])


# -- coverage -----------------------------------------------------------------

CV = """, cl AS (SELECT chunk_no AS clip_id, n_frames, CASE WHEN status = 'F' THEN NULL ELSE (cust * 7 % 1010) / 10e0 END AS cloud, CASE WHEN status = 'F' THEN NULL ELSE (cust * 3 % 430) / 10e0 END AS wind, CASE WHEN status = 'F' THEN NULL ELSE (cust * 11 % 45) / 10e0 END AS rain, (cust * 13 % 2560) / 10e0 AS lum,
 CASE chunk_no % 5 WHEN 0 THEN 'night' WHEN 1 THEN 'golden' ELSE 'day' END AS part, start_s, duration_s FROM fx_clips),
en AS (SELECT clip_id, unnest([{'c': 'boat_ship', 's': 'typed', 'n': clip_id % 7, 'f': clip_id % 4}, {'c': 'boat', 's': 'labels', 'n': clip_id % 5, 'f': clip_id % 3}, {'c': 'swimmer', 's': 'typed', 'n': CASE WHEN clip_id % 5 = 0 THEN 2 ELSE 0 END, 'f': 1}]) AS e FROM cl),
pc AS (SELECT clip_id, CASE e.c WHEN 'boat_ship' THEN 'boat' WHEN 'swimmer' THEN 'person' ELSE e.c END AS cls, max(e.n) AS n FROM en GROUP BY 1, 2)"""


def clip_cover(spark, sf):
    return view(spark, sf, "fx_clips").selectExpr(
        "chunk_no AS clip_id", "n_frames", "CASE WHEN status = 'F' THEN NULL ELSE (cust * 7 % 1010) / 10e0 END AS cloud_cover_pct", "CASE WHEN status = 'F' THEN NULL ELSE (cust * 3 % 430) / 10e0 END AS wind_speed_kmh",
        "CASE WHEN status = 'F' THEN NULL ELSE (cust * 11 % 45) / 10e0 END AS precipitation_mm", "(cust * 13 % 2560) / 10e0 AS lum_mean", "CASE chunk_no % 5 WHEN 0 THEN 'night' WHEN 1 THEN 'golden' ELSE 'day' END AS part", "start_s", "duration_s")


def entity_rows(spark, sf):
    c = clip_cover(spark, sf)
    e = F.expr("array(named_struct('cls','boat_ship','stream','typed','instances',clip_id % 7,'frames',clip_id % 4), named_struct('cls','boat','stream','labels','instances',clip_id % 5,'frames',clip_id % 3), named_struct('cls','swimmer','stream','typed','instances',CASE WHEN clip_id % 5 = 0 THEN 2L ELSE 0L END,'frames',1L))")
    return c.select("clip_id", F.explode(e).alias("e")).select("clip_id", "e.*")


@query("A34_hourly_coverage", "fx_clips", sql=CV + """, s AS (SELECT clip_id, n_frames, 1 + clip_id % 5 AS k, (CAST(floor(start_s / 3600e0) AS BIGINT) + unnest(range(1 + clip_id % 5))) % 24 AS hour FROM cl), g AS (SELECT clip_id, hour, floor(sum(n_frames / k) + 0.5) AS v FROM s GROUP BY 1, 2)
SELECT hour, CAST(sum(v) AS BIGINT) AS frames, count(*) AS n_clips FROM g WHERE v > 0 GROUP BY 1""")
def hourly(spark, sf):
    return tidy(C.hourly_frames(hour_samples(spark, sf))).withColumn("frames", F.col("frames").cast("bigint"))


def hour_samples(spark, sf):
    c = clip_cover(spark, sf)
    k = 1 + F.col("clip_id") % 5
    c = c.select("clip_id", "n_frames", "start_s", k.alias("n_samples"), F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)).alias("i"))
    return c.select("clip_id", "n_frames", "n_samples", ((F.floor(F.col("start_s") / 3600) + F.col("i")) % 24).alias("hour"))


@query("A34_weather_bands", "fx_clips", sql=CV + """, b AS (SELECT 'cloud_cover_pct' AS dimension, CASE WHEN cloud < 20 THEN 0 WHEN cloud < 40 THEN 1 WHEN cloud < 60 THEN 2 WHEN cloud < 80 THEN 3 ELSE 4 END AS band, n_frames FROM cl WHERE cloud IS NOT NULL
 UNION ALL SELECT 'wind_speed_kmh', CASE WHEN wind < 10 THEN 0 WHEN wind < 20 THEN 1 WHEN wind < 30 THEN 2 ELSE 3 END, n_frames FROM cl WHERE wind IS NOT NULL)
SELECT dimension, CAST(band AS BIGINT) AS band, CAST(sum(n_frames) AS BIGINT) AS frames, count(*) AS n_clips FROM b GROUP BY 1, 2""")
def weather_bands(spark, sf):
    return tidy(all_bands(spark, sf))


def all_bands(spark, sf):
    c = clip_cover(spark, sf)
    return C.weather_bands(c, "cloud_cover_pct", C.BANDS["cloud_cover_pct"]).unionByName(C.weather_bands(c, "wind_speed_kmh", C.BANDS["wind_speed_kmh"]))


TG = ", tg AS (SELECT * FROM (VALUES ('boat', 5000), ('person', 1500), ('duck', 1000), ('animal', 500), ('buoy', 500), ('structure', 2000), ('float', 300), ('other', 300)) t(cls, target))"


@query("A34_entity_coverage", "fx_clips", sql=CV + TG + """ SELECT coalesce(p.cls, tg.cls) AS cls, CAST(coalesce(n, 0) AS BIGINT) AS instances, CAST(coalesce(target, 0) AS BIGINT) AS target FROM (SELECT cls, sum(n) AS n FROM pc GROUP BY 1) p FULL JOIN tg ON tg.cls = p.cls""")
def entity_cov(spark, sf):
    return C.entity_coverage(entity_rows(spark, sf)).select("cls", "instances", "target")


@query("A35_coverage_gaps", "fx_clips", sql=CV + TG + """, e AS (SELECT tg.cls, coalesce(n, 0) AS n, target FROM tg LEFT JOIN (SELECT cls, sum(n) AS n FROM pc GROUP BY 1) p USING (cls)),
h0 AS (SELECT CASE WHEN part = 'night' THEN n_frames ELSE 0 END AS nf, least(15, floor(lum / 256 * 16)) AS lb FROM cl), r AS (SELECT max(rain) AS rain, max(wind) AS wind, max(cloud) AS cloud FROM cl)
SELECT 'warn' AS severity, 'no twilight footage' AS item UNION ALL SELECT 'serious', 'no night footage' FROM h0 HAVING sum(nf) = 0 UNION ALL SELECT 'serious', 'no rain footage' FROM r WHERE rain < 0.1 UNION ALL SELECT 'warn', 'no strong wind footage' FROM r WHERE wind < 20
 UNION ALL SELECT 'warn', 'no overcast footage' FROM r WHERE cloud < 80 UNION ALL SELECT 'warn', 'no low-luminance frames' FROM h0 HAVING count(*) FILTER (lb < 4) = 0 UNION ALL SELECT CASE WHEN n = 0 THEN 'serious' ELSE 'warn' END, concat('few ', cls) FROM e WHERE n = 0 OR n < target / 2""")
def gaps(spark, sf):
    c = clip_cover(spark, sf)
    parts = c.groupBy("part").agg(F.sum("n_frames").alias("frames"))
    hist = C.luminance_histogram(c.withColumnRenamed("lum_mean", "luminance_mean"))
    return C.heuristic_gaps(parts, c.filter("cloud_cover_pct IS NOT NULL"), hist, C.entity_coverage(entity_rows(spark, sf)))


@query("A35_goal_gaps", "fx_clips", sql=CV + """, s AS (SELECT clip_id, n_frames, 1 + clip_id % 5 AS k, (CAST(floor(start_s / 3600e0) AS BIGINT) + unnest(range(1 + clip_id % 5))) % 24 AS hour FROM cl), g AS (SELECT clip_id, hour, floor(sum(n_frames / k) + 0.5) AS v FROM s GROUP BY 1, 2), hf AS (SELECT hour, sum(v) AS f FROM g GROUP BY 1),
hg AS (SELECT h AS hour, CASE WHEN h BETWEEN 6 AND 21 THEN 30e0 ELSE 15e0 END AS goal FROM (SELECT unnest(range(24)) AS h)),
wb AS (SELECT CASE WHEN wind < 10 THEN 0 WHEN wind < 20 THEN 1 WHEN wind < 30 THEN 2 ELSE 3 END AS band, sum(n_frames) AS f FROM cl WHERE wind IS NOT NULL GROUP BY 1), wg AS (SELECT * FROM (VALUES (0, 3e0), (1, 3e0), (2, 2e0), (3, 1e0)) t(band, goal))
SELECT 'hour' AS dimension, hour AS item, CASE WHEN coalesce(f, 0) = 0 THEN 'serious' ELSE 'warn' END AS severity, round(coalesce(f, 0) / 10800, 6) AS have_h, goal AS goal_h FROM hg LEFT JOIN hf USING (hour) WHERE goal > coalesce(f, 0) / 10800
UNION ALL SELECT 'wind_speed_kmh', band, CASE WHEN coalesce(f, 0) = 0 THEN 'serious' ELSE 'warn' END, round(coalesce(f, 0) / 10800, 6), goal FROM wg LEFT JOIN wb USING (band) WHERE coalesce(f, 0) / 10800 < goal""")
def goal_gaps(spark, sf):
    h = C.hourly_frames(hour_samples(spark, sf))
    g = C.hour_goal_gaps(h, {k: v * 15 for k, v in C.HOUR_GOALS.items()}).unionByName(C.band_goal_gaps(all_bands(spark, sf), "wind_speed_kmh"))
    return tidy(g)


@query("A36_condition_matrix", "fx_clips", sql=CV + """, cd AS (SELECT clip_id, concat('part:', part) AS condition FROM cl UNION ALL SELECT clip_id, concat('cloud:', CASE WHEN cloud < 20 THEN 0 WHEN cloud < 40 THEN 1 WHEN cloud < 60 THEN 2 WHEN cloud < 80 THEN 3 ELSE 4 END) FROM cl WHERE cloud IS NOT NULL
 UNION ALL SELECT clip_id, concat('wind:', CASE WHEN wind < 10 THEN 0 WHEN wind < 20 THEN 1 WHEN wind < 30 THEN 2 ELSE 3 END) FROM cl WHERE wind IS NOT NULL UNION ALL SELECT clip_id, concat('precip:', CASE WHEN rain < 0.1 THEN 0 WHEN rain < 1 THEN 1 ELSE 2 END) FROM cl WHERE rain IS NOT NULL UNION ALL SELECT clip_id, concat('luma:', CASE WHEN lum < 85 THEN 0 WHEN lum < 170 THEN 1 ELSE 2 END) FROM cl),
al AS (SELECT unnest(['part:night', 'part:twilight', 'part:golden', 'part:day', 'cloud:0', 'cloud:1', 'cloud:2', 'cloud:3', 'cloud:4', 'wind:0', 'wind:1', 'wind:2', 'wind:3', 'precip:0', 'precip:1', 'precip:2', 'luma:0', 'luma:1', 'luma:2']) AS condition),
hv AS (SELECT cls, condition, sum(n) AS n FROM pc JOIN cd USING (clip_id) GROUP BY 1, 2), ft AS (SELECT condition, count(*) AS k FROM cd GROUP BY 1), cs AS (SELECT cls FROM pc GROUP BY 1 HAVING sum(n) > 0)
SELECT cs.cls, al.condition, CAST(coalesce(n, 0) AS BIGINT) AS instances, coalesce(n, 0) = 0 AND coalesce(k, 0) > 0 AS gap FROM cs CROSS JOIN al LEFT JOIN hv ON hv.cls = cs.cls AND hv.condition = al.condition LEFT JOIN ft ON ft.condition = al.condition""")
def matrix(spark, sf):
    c = clip_cover(spark, sf)
    parts = c.select("clip_id", "part", F.col("n_frames").alias("frames"))
    return C.condition_matrix(entity_rows(spark, sf), C.clip_conditions(c, parts))


@query("A37_J22_clip_weather", "fx_clips", sql=""", h AS (SELECT CAST(floor(event_id / 24e0) AS BIGINT) AS day, event_id % 24 AS hour, value / 5 AS cc, value / 400 AS pr, value / 12 AS ws, (event_id * 47 % 360) * 0.97e0 AS wd, value / 20 AS te FROM events),
c AS (SELECT chunk_no AS clip_id, chunk_no % 400 AS day, chunk_no % 20 AS sh, least(23, chunk_no % 20 + chunk_no % 4) AS eh FROM fx_clips)
SELECT clip_id, round(avg(cc) / 10, 9) AS cloud10, round(sum(pr) / 10, 9) AS rain10, round(degrees(atan2(sum(sin(radians(wd))), sum(cos(radians(wd))))) - 360 * floor(degrees(atan2(sum(sin(radians(wd))), sum(cos(radians(wd))))) / 360), 0) + 0.0 AS wind_dir_deg, count(*) AS hours FROM c JOIN h ON h.day = c.day AND h.hour BETWEEN sh AND eh GROUP BY 1""")
def clip_weather(spark, sf):
    h = load(spark, sf, "events").selectExpr("CAST(floor(event_id / 24e0) AS BIGINT) AS day", "event_id % 24 AS hour", "value / 5 AS cloud_cover", "value / 400 AS precipitation", "value / 12 AS wind_speed", "(event_id * 47 % 360) * 0.97e0 AS wind_dir", "value / 20 AS temperature")
    c = view(spark, sf, "fx_clips").selectExpr("chunk_no AS clip_id", "chunk_no % 400 AS day", "chunk_no % 20 AS start_hour", "least(23, chunk_no % 20 + chunk_no % 4) AS end_hour")
    w = C.clip_weather(c, h)
    raw = c.withColumn("hour", F.explode(F.sequence("start_hour", "end_hour"))).join(h, ["day", "hour"]).groupBy("clip_id").agg(
        F.round(F.avg("cloud_cover") / 10, 9).alias("cloud10"), F.round(F.sum("precipitation") / 10, 9).alias("rain10"), F.count("*").alias("hours"))
    return w.select("clip_id", (F.col("wind_dir_deg") + F.lit(0.0)).alias("wind_dir_deg")).join(raw, "clip_id")


@query("A37_dayparts_entities", "fx_det", sql=""", e AS (SELECT clip_id, sensor AS stream, cls, count(*) AS instances, count(DISTINCT frame_index) AS frames FROM fx_det GROUP BY 1, 2, 3) SELECT * FROM e""")
def entities(spark, sf):
    return C.entity_counts(view(spark, sf, "fx_det").withColumnRenamed("sensor", "stream"))


@query("A37_luminance_histogram", "fx_levels", sql=""", m AS (SELECT clip_id, frame_index, sum(n * level) / sum(n) AS lm FROM fx_levels GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) - 1 AS rn FROM m)
SELECT clip_id, CAST(least(15, floor(lm / 256 * 16)) AS BIGINT) AS bin, count(*) AS n FROM r WHERE rn % 3 = 0 GROUP BY 1, 2""")
def lum_hist(spark, sf):
    from keelson.operators.masks import frame_levels
    from keelson.operators.review import every_nth
    f = frame_levels(view(spark, sf, "fx_levels"), {}).withColumnRenamed("mean", "luminance_mean")
    return C.luminance_histogram(every_nth(f, ["clip_id"], "frame_index", 3)).select("clip_id", "bin", "n")


@query("A37_frame_dayparts")
def frame_parts(spark, sf):
    e = load(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("clip_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch_s"))
    return C.frame_dayparts(e, 46.0, 9.0)
