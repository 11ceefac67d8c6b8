"""Tables written in the recorder's formats and read back, and joins that need them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelson.fixtures import view
from keelson.functions.rounding import r6, tidy
from keelson.operators import align as A
from keelson.operators import coverage as C
from keelson.operators import masks as MK
from keelson.operators import motion_eval as ME
from keelson.operators import tracking as K
from keelson.queries.catalog import query
from keelson.queries.tracks import TARGETS, targets
from keelson.session import ensure_checkpoint_dir
from keelson.sources import scans as S
from keelson.sources import sinks as W


def folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("K01_S08_feature_tables", "fx_scores", sql=""", n AS (SELECT *, CAST(split_part(clip_id, '/s', 2) AS BIGINT) AS no FROM fx_scores)
SELECT clip_id, frame_index, bin_index, round(p, 6) AS p, round(min_range_m, 6) AS min_range_m, round(sun_elevation_deg, 6) + 0.0 AS sun_elevation_deg, y FROM n WHERE no % 4 <> 3 AND no % 5 <> 1 AND frame_index % 3 > 0""")
def feature_tables(spark, sf):
    """Bins, frames and targets by clip; clips without meta and without targets are left out."""
    d = view(spark, sf, "fx_scores").withColumn("no", F.split("clip_id", "/s")[1].cast("long"))
    root = folder(spark, "features")
    bins = d.select("clip_id", "frame_index", "bin_index", "p", F.coalesce("min_range_m", F.lit(float("nan"))).alias("min_range_m"))
    frames = d.filter("bin_index = 0").select("clip_id", "frame_index", "sun_elevation_deg")
    meta = d.filter("no % 4 <> 3").select("clip_id").distinct()
    W.write_features(bins, frames, meta, root, d.filter("no % 5 <> 1 AND frame_index % 3 > 0").select("clip_id", "frame_index", "bin_index", "y"))
    r = S.read_dataset(spark, root)
    return tidy(r.select("clip_id", "frame_index", "bin_index", "p", "min_range_m", "sun_elevation_deg", F.col("y").cast("int").alias("y"))).withColumn("y", F.col("y").cast("int"))


@query("S10_curation_scan", "fx_clips", sql=""", g AS (SELECT scene, min(chunk_no) AS a, max(chunk_no) AS b, count(*) AS n FROM fx_clips GROUP BY 1)
SELECT concat(scene, '__', a) AS clip_key, scene, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS n_chunks, n % 3 = 0 AS deleted, CASE WHEN n % 5 = 0 THEN 0 ELSE 1 END AS n_cuts FROM g""")
def curation_scan(spark, sf):
    """A curation file in the shared folder, read by Spark."""
    g = view(spark, sf, "fx_clips").groupBy("scene").agg(F.min("chunk_no").alias("a"), F.max("chunk_no").alias("b"), F.count("*").alias("n"))
    text = lambda c: F.col(c).cast("string")
    one = F.struct(F.when(F.col("n") % 2 == 0, F.array(text("a"), text("b"))).alias("chunks"), F.when(F.col("n") % 3 == 0, F.lit("2024-06-02")).alias("deleted_at"),
                   F.when(F.col("n") % 5 == 0, F.array(F.struct(F.lit(None).cast("string").alias("start_ts"), F.lit("9").alias("end_ts")))).otherwise(F.array(F.struct(F.lit("1").alias("start_ts"), F.lit("9").alias("end_ts")))).alias("cuts"))
    data = g.select(F.struct(F.concat_ws("/", "scene", "a").alias("k"), one.alias("v")).alias("e")).agg(F.map_from_entries(F.collect_list("e")).alias("sets"))
    path = folder(spark, "curation") + ".json"
    data.select(F.to_json(F.struct(F.lit(1).alias("version"), "sets")).alias("value")).coalesce(1).write.text(path)
    sets, cuts = S.read_curation(spark, path)
    n = cuts.groupBy("clip_key").agg(F.count("*").cast("int").alias("n_cuts"))
    return sets.join(n, "clip_key", "left").select("clip_key", "scene", F.size("chunks").alias("n_chunks"), F.col("deleted_at").isNotNull().alias("deleted"), F.coalesce("n_cuts", F.lit(0)).alias("n_cuts"))


@query("S12_trial_scan", "fx_review_log", sql=""" SELECT id, CASE id % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'checkpoint' WHEN 2 THEN 'station' ELSE 'sectors' END AS kind, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE id % 5 END AS INTEGER) AS trial,
 CASE WHEN id % 4 = 1 THEN round(id % 97 / 2e0, 6) END AS distance_m, CAST(CASE WHEN id % 4 = 3 THEN 2 ELSE 0 END AS INTEGER) AS n_bins FROM fx_review_log WHERE id % 11 > 0""")
def trial_scan(spark, sf):
    i = F.col("id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("start", "checkpoint", "station", "sectors")]), (i % 4 + 1).cast("int"))
    more = F.when(i % 4 == 1, F.concat(F.lit(',"distance_m":'), (i % 97 / 2.0).cast("string"))).when(i % 4 == 3, ',"p":[0.25,0.5]').otherwise("")
    trial = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(',"trial":'), (i % 5).cast("string")))
    line = F.when(i % 11 == 0, F.lit('{"kind":"cut off')).otherwise(F.concat(F.lit('{"name":"'), i.cast("string"), F.lit('","kind":"'), kind, F.lit('"'), trial, more, F.lit("}")))
    r = S.trial_rows(view(spark, sf, "fx_review_log").select(line.alias("line")))
    return r.select(F.col("name").cast("long").alias("id"), "kind", "trial", r6("distance_m"), F.coalesce(F.size("p"), F.lit(0)).alias("n_bins"))


@query("J22_nearest_sun_sample", "fx_scores", sql=""", f AS (SELECT clip_id, frame_index, t_ms / 1000e0 AS t FROM fx_scores WHERE bin_index = 0), s AS (SELECT clip_id, t_ms / 1000e0 AS t, sun_elevation_deg AS e FROM fx_scores WHERE bin_index = 0 AND frame_index % 90 = 7 AND frame_index < 200),
j AS (SELECT f.*, s.e, f.t - s.t AS gap, row_number() OVER (PARTITION BY f.clip_id, f.frame_index ORDER BY abs(f.t - s.t), s.t) AS rn FROM f LEFT JOIN s ON s.clip_id = f.clip_id AND abs(f.t - s.t) <= 20)
SELECT clip_id, frame_index, round(e, 6) + 0.0 AS sun_elevation_deg, round(gap, 6) + 0.0 AS sun_gap_s FROM j WHERE rn = 1""")
def nearest_sun(spark, sf):
    d = view(spark, sf, "fx_scores").filter("bin_index = 0").withColumn("t_s", F.col("t_ms") / 1000.0)
    samples = d.filter("frame_index % 90 = 7 AND frame_index < 200").select("clip_id", "t_s", "sun_elevation_deg")
    return tidy(C.frame_sun(d.select("clip_id", "frame_index", "t_s"), samples, ["clip_id"], 20.0).drop("t_s"))


@query("J23_dominant_target", "fx_radar", sql=TARGETS + """,
dm AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_index ORDER BY n_points DESC, track_id) AS rn FROM tr)
SELECT sg.clip_id, sg.frame_index, track_id, n_points FROM sg LEFT JOIN dm ON dm.clip_id = sg.clip_id AND dm.frame_index = sg.frame_index AND rn = 1""")
def dominant(spark, sf):
    frames = view(spark, sf, "fx_radar").select("clip_id", "frame_index").distinct()
    t = targets(spark, sf).filter(F.col("cluster_id") != K.NO_CLUSTER).select("clip_id", "frame_index", "track_id", "n_points")
    return ME.dominant_target(frames, t)


@query("A46_component_intervals", "fx_det", sql=""" SELECT det_id, round((u % 150 - 77) / 2.82e0, 6) + 0.0 AS lo_deg, round((u % 150 + size / 4 - 77) / 2.82e0, 6) + 0.0 AS hi_deg, size * 2 AS area FROM fx_det WHERE sensor = 'thermal' AND size * 2 >= 40""")
def component_intervals(spark, sf):
    d = view(spark, sf, "fx_det").filter("sensor = 'thermal'")
    c = d.select("clip_id", F.col("det_id").alias("frame_index"), (F.col("u") % 150).alias("x"), (F.col("size") / 4).alias("w"), (F.col("size") * 2).alias("area"))
    return MK.component_intervals(c, min_area=40).select(F.col("frame_index").alias("det_id"), r6("lo_deg"), r6("hi_deg"), "area")


@query("W13_thermal_runs", "fx_scores", sql=""", s AS (SELECT clip_id, frame_index, CASE WHEN hit_thermal = 0 AND p < 0.4 THEN 'down' WHEN p < 0.6 THEN 'degraded' ELSE 'ok' END AS state FROM fx_scores WHERE bin_index = 0),
n AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY clip_id ORDER BY frame_index) THEN 1 ELSE 0 END AS nw FROM s), r AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY clip_id ORDER BY frame_index) AS BIGINT) AS run FROM n)
SELECT clip_id, run, min(frame_index) AS start_pos, count(*) AS length, any_value(state) AS state FROM r GROUP BY 1, 2""")
def thermal_runs(spark, sf):
    d = view(spark, sf, "fx_scores").filter("bin_index = 0")
    state = A.thermal_state((F.col("hit_thermal") == 1) | (F.col("p") >= 0.4), F.when(F.col("p") < 0.6, "low"))
    return A.compress_runs(d.withColumn("state", state), ["clip_id"], "frame_index", "state")
