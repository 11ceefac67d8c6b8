"""Views that read the star-schema test tables as sensor tables.

Each view is one SQL text valid in Spark and in the checking engine alike
(integer arithmetic and ``e0`` double literals only).  All views use every row of
their table.  A recording (clip) holds a bounded number of frames, as in the field
where capture is cut into chunks of a few minutes, so clips grow in number, not in
size, with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, tuple[str, str]] = {
    "fx_radar": ("lineitem", """
SELECT concat('Lake', CAST(l_orderkey % 4 AS STRING), '/c', CAST(CAST(floor(l_orderkey / 4000e0) AS BIGINT) AS STRING)) AS clip_id,
 CAST(floor((l_orderkey % 4000) / 20e0) AS BIGINT) AS frame_index,
 CAST(floor((l_orderkey % 4000) / 20e0) AS BIGINT) * 100 + CAST(floor((l_orderkey % 4000) / 1000e0) AS BIGINT) * 6000 AS t_ms,
 ((l_orderkey % 20) * 8 + l_linenumber) * 10000000000000000 + l_partkey * 10000000 + l_suppkey AS point_id,
 ((l_partkey * 37 + l_linenumber * 101) % 1200 - 600) / 100e0 AS x,
 ((l_partkey * 53 + l_suppkey * 17) % 1150) / 100e0 AS y,
 ((l_suppkey * 7) % 40 - 20) / 100e0 AS z,
 CASE WHEN l_returnflag = 'N' THEN NULL ELSE ((l_partkey + l_linenumber) % 41 - 20) / 20e0 END AS v,
 5e0 + l_quantity / 2e0 AS snr, l_tax * 100e0 AS noise FROM lineitem"""),
    "fx_det": ("orders", """
SELECT concat('Lake', CAST(o_orderkey % 4 AS STRING), '/c', CAST(CAST(floor(o_orderkey / 4000e0) AS BIGINT) AS STRING)) AS clip_id,
 CAST(floor((o_orderkey % 4000) / 20e0) AS BIGINT) AS frame_index,
 CAST(floor((o_orderkey % 4000) / 20e0) AS BIGINT) * 100 + CAST(floor((o_orderkey % 4000) / 1000e0) AS BIGINT) * 6000 AS t_ms,
 CASE WHEN o_orderstatus = 'F' THEN 'thermal' ELSE 'fisheye' END AS sensor,
 o_orderkey AS det_id, (o_custkey * 31 + o_orderkey * 7) % 864 AS u, 300 + (o_custkey * 13 + o_orderkey) % 348 AS v,
 8 + o_orderkey % 40 AS size,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'person' WHEN '2' THEN 'boat' WHEN '3' THEN 'buoy' WHEN '4' THEN 'duck' ELSE 'structure' END AS cls,
 (o_orderkey * 7919 % 1000) / 1000e0 AS confidence, o_custkey AS cust FROM orders"""),
    "fx_imu": ("events", """
SELECT concat('Lake', CAST(event_id % 4 AS STRING), '/c', CAST(CAST(floor(event_id / 1600e0) AS BIGINT) AS STRING)) AS clip_id,
 CAST(floor((event_id % 1600) / 4e0) AS BIGINT) * 130 + (event_id * 31) % 60 AS t_ms,
 ((event_id * 17) % 3600) / 10e0 - 180e0 AS yaw, ((event_id * 7) % 200) / 10e0 - 10e0 AS pitch, ((event_id * 11) % 300) / 10e0 - 15e0 AS roll,
 event_id AS row_no FROM events"""),
    "fx_scores": ("events", """
SELECT concat('Lake', CAST(CAST(floor(event_id / 2100e0) AS BIGINT) % 4 AS STRING), '/s', CAST(CAST(floor(event_id / 2100e0) AS BIGINT) AS STRING)) AS clip_id,
 concat('Lake', CAST(CAST(floor(event_id / 2100e0) AS BIGINT) % 4 AS STRING)) AS scene,
 CAST(floor((event_id % 2100) / 7e0) AS BIGINT) AS frame_index, event_id % 7 AS bin_index, (event_id % 7) * 15e0 - 45e0 AS bin_center_deg,
 CAST(floor((event_id % 2100) / 7e0) AS BIGINT) * 333 + CAST(floor((event_id % 2100) / 420e0) AS BIGINT) * 6000 AS t_ms,
 (event_id * 7919 % 1000) / 1000e0 AS p, CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y,
 CASE WHEN value < 200e0 THEN value / 10e0 ELSE NULL END AS min_range_m,
 CASE WHEN event_type = 'signup' THEN NULL ELSE ((event_id * 13) % 41 - 20) / 10e0 END AS closing_mps,
 CASE WHEN event_id * 11 % 10 < 4 THEN 1 ELSE 0 END AS hit_fisheye, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS hit_thermal,
 CASE WHEN event_id * 5 % 9 < 4 THEN 1 ELSE 0 END AS hit_mmwave,
 CASE WHEN user_id % 3 = 0 THEN NULL ELSE ((event_id * 29) % 150) / 10e0 END AS free_m,
 ((CAST(floor(event_id / 7e0) AS BIGINT) * 37) % 600) / 10e0 - 20e0 AS sun_elevation_deg, event_id AS row_id FROM events"""),
    "fx_clips": ("orders", """
SELECT concat('Scene', CAST(o_custkey % 9 AS STRING)) AS scene, o_orderkey AS chunk_no,
 o_orderkey * 40 + (o_orderkey * 13) % 70 AS start_s, 20 + o_orderkey % 300 AS duration_s,
 10 + o_orderkey % 890 AS n_frames, o_orderstatus AS status, o_custkey AS cust FROM orders"""),
    "fx_review_log": ("events", """
SELECT event_id AS id, CAST(user_id AS BIGINT) AS crop_no, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'deny' WHEN 'error' THEN 'junk' ELSE 'skip' END AS label, ts AS created_at FROM events"""),
    "fx_gps": ("events", """
SELECT concat('Lake', CAST(event_id % 4 AS STRING), '/g', CAST(CAST(floor(event_id / 1600e0) AS BIGINT) AS STRING)) AS clip_id,
 CAST(floor((event_id % 1600) / 4e0) AS BIGINT) * 500 AS t_ms,
 CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 0e0 ELSE 46e0 + ((event_id * 7) % 1000) / 10000e0 END AS lat,
 CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 0e0 ELSE 9e0 + ((event_id * 13) % 1000) / 10000e0 END AS lon,
 CASE WHEN value < 100e0 THEN NULL WHEN value < 150e0 THEN 0 ELSE 1 END AS fix,
 CASE WHEN user_id % 3 = 0 THEN 'fallback' WHEN user_id % 3 = 1 THEN 'ble' ELSE 'boat_log' END AS source,
 CAST(floor((event_id % 1600) / 12e0) AS BIGINT) * 1000 AS fix_ms, event_id AS row_no FROM events"""),
    "fx_masks": ("lineitem", """
SELECT concat('Lake', CAST(l_orderkey % 4 AS STRING), '/c', CAST(CAST(floor(l_orderkey / 4000e0) AS BIGINT) AS STRING)) AS clip_id,
 CAST(floor((l_orderkey % 4000) / 20e0) AS BIGINT) AS frame_index, (l_partkey * 7 + l_linenumber * 29) % 864 AS col, 648 AS height,
 min(200 + (l_partkey * 3 + l_suppkey) % 120) AS r0, min(200 + (l_partkey * 3 + l_suppkey) % 120) + min((l_suppkey * 13 + l_linenumber * 17) % 80) AS r1,
 min((l_partkey + l_suppkey) % 13) AS wet, min((l_partkey + l_linenumber) % 19) AS open FROM lineitem GROUP BY 1, 2, 3, 4"""),
    "fx_levels": ("lineitem", """
SELECT concat('Lake', CAST(l_orderkey % 4 AS STRING), '/c', CAST(CAST(floor(l_orderkey / 4000e0) AS BIGINT) AS STRING)) AS clip_id,
 CAST(floor((l_orderkey % 4000) / 20e0) AS BIGINT) AS frame_index,
 (l_partkey * 11 + l_suppkey * 3 + l_linenumber) % (20 + (l_orderkey % 4000) % 200) AS level, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3"""),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    return spark.sql(sql.replace(f"FROM {table}", "FROM {src}"), src=load(spark, sf_dir, table))


def with_views(body: str, *names: str) -> str:
    """Checking SQL with the named views as common table expressions.  ``body``
    starts with SELECT, or with a comma to add further expressions."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    return f"WITH RECURSIVE {ctes}\n{body}" if names else body
