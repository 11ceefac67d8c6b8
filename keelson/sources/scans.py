"""Scans of recordings and logs.

Every scan has two halves: ``read_*`` lists files, ``*_rows`` turns raw lines into a typed
table, so the same rules serve batch files, streams and tables of lines.  A sensor line
tells its layout by its number of fields, so one pass reads all capture generations.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import clock
from keelson.sources import schemas as S

# fixed values: physically possible bounds of radar returns
COORD_BOUND_M = 50.0
DOPPLER_BOUND_MPS = 10.0


def clip_of(path: Column) -> Column:
    """``scene/stamp`` from ``.../scene/<stream>_<stamp>.<ext>``."""
    return F.concat_ws("/", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.regexp_extract(path, r"/[a-z]+_([^/]+?)\.[a-z0-9]+$", 1))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(clip_id, line) of text files."""
    d = spark.read.text(paths)
    return d.select(clip_of(F.col("_metadata.file_path")).alias("clip_id"), F.col("value").alias("line"))


def read_numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(clip_id, pos, line) of per-clip files, with the line number."""
    d = spark.read.text(paths, wholetext=True)
    return d.select(clip_of(F.col("_metadata.file_path")).alias("clip_id"), F.posexplode(F.split("value", "\n")).alias("pos", "line")).filter("trim(line) <> ''")


def _fields(lines: DataFrame) -> DataFrame:
    d = lines.filter((F.trim("line") != "") & ~F.col("line").startswith("Date") & ~F.col("line").startswith("frame_index"))
    return d.withColumn("__f", F.transform(F.split("line", ",", -1), lambda x: F.trim(x))).withColumn("__k", F.size("__f"))


def _num(i: int) -> Column:
    """Field as a number; blank, NaN and junk give null."""
    v = F.get("__f", F.lit(i)).try_cast("double")
    return F.when(~F.isnan(v), v)


def _stamp(d: int, t: int) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.get("__f", F.lit(d)), F.get("__f", F.lit(t)))).cast("timestamp_ntz")


def radar_rows(lines: DataFrame) -> DataFrame:
    """Radar points.  Rows with a coordinate out of bounds drop; an impossible Doppler is
    nulled; a row without coordinates is a heartbeat and stays."""
    d = _fields(lines).filter("__k >= 5")
    v = _num(5)
    d = d.select(*[c for c in lines.columns if c != "line"], _stamp(0, 1).alias("ts"), _num(2).alias("x"), _num(3).alias("y"), _num(4).alias("z"),
                 F.when(F.abs(v) <= DOPPLER_BOUND_MPS, v).alias("v"), F.when(F.col("__k") >= 8, _num(6)).alias("snr"), F.when(F.col("__k") >= 8, _num(7)).alias("noise"))
    full = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    wild = F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) >= COORD_BOUND_M
    return d.filter(~(full & F.coalesce(wild, F.lit(False)))).withColumn("rounded_time", clock.rounded_time(F.col("ts")))


def imu_rows(lines: DataFrame) -> DataFrame:
    """Attitude in either layout: Euler (5 or 8 fields) or quaternion (6 fields); rows with
    a missing value drop."""
    d = _fields(lines)
    euler, quat = F.col("__k").isin(5, 8), F.col("__k") == 6
    cols = {n: F.when(euler, _num(i)) for n, i in (("yaw", 2), ("pitch", 3), ("roll", 4))}
    cols |= {n: F.when(F.col("__k") == 8, _num(i)) for n, i in (("ax", 5), ("ay", 6), ("az", 7))}
    cols |= {n: F.when(quat, _num(i)) for n, i in (("qw", 2), ("qx", 3), ("qy", 4), ("qz", 5))}
    d = d.select(*[c for c in lines.columns if c != "line"], _stamp(0, 1).alias("ts"), *[c.alias(n) for n, c in cols.items()],
                 F.when(euler, "euler").when(quat, "quaternion").alias("layout"))
    ok = F.when(F.col("layout") == "euler", F.col("yaw").isNotNull() & F.col("pitch").isNotNull() & F.col("roll").isNotNull()).otherwise(
        F.col("qw").isNotNull() & F.col("qx").isNotNull() & F.col("qy").isNotNull() & F.col("qz").isNotNull())
    return d.filter(F.col("layout").isNotNull() & ok).withColumn("rounded_time", clock.rounded_time(F.col("ts")))


def gps_rows(lines: DataFrame) -> DataFrame:
    """Own position; rows without a place drop; a blank fix stays null; the source is kept."""
    d = _fields(lines).filter("__k >= 4")
    d = d.select(*[c for c in lines.columns if c != "line"], _stamp(0, 1).alias("ts"), _num(2).alias("lat"), _num(3).alias("lon"), _num(4).cast("int").alias("fix"),
                 F.nullif(F.get("__f", F.lit(5)), F.lit("")).alias("source"), F.get("__f", F.lit(6)).try_cast("timestamp").alias("fix_time"))
    return d.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumn("rounded_time", clock.rounded_time(F.col("ts")))


def frame_clock_rows(lines: DataFrame) -> DataFrame:
    """Frame clock with optional exposure fields."""
    d = _fields(lines).filter("__k >= 3")
    names = ("exposure_time_us", "analogue_gain", "digital_gain", "lux_est")
    return d.select(*[c for c in lines.columns if c != "line"], _num(0).cast("bigint").alias("frame_index"), _stamp(1, 2).alias("ts"),
                    *[_num(3 + i).alias(n) for i, n in enumerate(names)]).withColumn("rounded_time", clock.rounded_time(F.col("ts")))


def frame_clock(sidecar: DataFrame, clips: DataFrame, fps: float = 3.0) -> DataFrame:
    """Sidecar rows; clips without a sidecar get ``chunk_start + i / fps``.
    ``clips``: clip_id, n_frames, chunk_start."""
    bare = clips.join(sidecar.select("clip_id").distinct(), "clip_id", "left_anti").filter("n_frames > 0")
    i = F.col("frame_index")
    synth = bare.withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)))
    us = F.round(i * F.lit(1e6 / fps)).cast("bigint")
    ts = F.timestamp_micros(F.unix_micros(F.col("chunk_start").cast("timestamp")) + us).cast("timestamp_ntz")
    synth = synth.select("clip_id", "frame_index", ts.alias("ts")).withColumn("rounded_time", clock.rounded_time(F.col("ts")))
    return sidecar.unionByName(synth, allowMissingColumns=True)


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines to columns; malformed lines drop."""
    d = lines.withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    return d.filter(F.json_object_keys("line").isNotNull())


def label_rows(lines: DataFrame, include_unaudited: bool = False) -> DataFrame:
    """Labels.  A heading key that is present but null means "no safe way" and differs from
    an absent key; missing lists are empty."""
    d = _parsed(lines, S.LABEL)
    key = clock.parse_frame_id(F.col("r.frame_id"))
    empty = F.expr(f"cast(array() as array<{S.BOX}>)")
    d = d.select(
        F.col("r.frame_id"), key["scene"].alias("scene"), key["clip_id"].alias("clip_id"), key["frame_idx"].alias("frame_idx"), key["frame_ts"].alias("frame_ts"),
        F.coalesce("r.source", F.lit("unknown")).alias("source"), F.coalesce("r.audited", F.lit(False)).alias("audited"),
        F.coalesce("r.fisheye_bboxes", empty).alias("boxes"), F.coalesce("r.thermal_bboxes", empty).alias("thermal_boxes"),
        F.coalesce("r.obstacle_bins_fisheye", F.expr("cast(array() as array<int>)")).alias("obstacle_bins"),
        F.array_contains(F.json_object_keys("line"), "safe_heading_deg").alias("heading_labelled"), F.col("r.safe_heading_deg").alias("heading_deg"))
    return d if include_unaudited else d.filter("audited")


def detection_rows(lines: DataFrame, field: str = "boxes") -> DataFrame:
    """Per-frame detections or instances; the last record of a frame wins.  An empty list
    (ran, saw nothing) differs from no record.  ``lines`` has ``pos``."""
    d = _parsed(lines, S.DETECTIONS if field == "boxes" else S.INSTANCES).filter("r.frame_id IS NOT NULL")
    return d.groupBy(F.col("r.frame_id").alias("frame_id")).agg(F.max_by(f"r.{field}", "pos").alias(field))


def sector_rows(lines: DataFrame, complete: bool = False) -> DataFrame:
    """Sector records of any protocol (absent version is 0); ``complete`` keeps those with a
    time, scores and hits."""
    d = _parsed(lines, S.SECTOR)
    d = d.select(*[c for c in lines.columns if c != "line"], "r.*").withColumn("protocol", F.coalesce("protocol", F.lit(0)))
    return d.filter("timestamp IS NOT NULL AND p_obstacle IS NOT NULL AND sensor_hits IS NOT NULL") if complete else d


def read_features(spark: SparkSession, root: str, table: str, clips: list[str] | None = None) -> DataFrame:
    """Feature tables written by clip; the clip filter prunes partitions."""
    d = spark.read.option("basePath", root).parquet(f"{root}/{table}")
    d = d.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
    return d.filter(F.col("clip_id").isin(list(clips))) if clips else d


def read_dataset(spark: SparkSession, root: str, require_targets: bool = True, clips: list[str] | None = None) -> DataFrame:
    """Bins with their frame's columns and, where there are any, their targets, of the clips that
    have meta.  ``require_targets`` leaves out clips and bins without a target."""
    bins, frames, meta, targets = (read_features(spark, root, t, clips) for t in ("bins", "frames", "meta", "targets"))
    frame, place = ["clip_id", "frame_index"], ["clip_id", "frame_index", "bin_index"]
    d = bins.join(meta.select("clip_id").distinct(), "clip_id", "left_semi")
    d = d.join(frames.drop(*[c for c in frames.columns if c in bins.columns and c not in frame]), frame, "left")
    rest = targets.drop(*[c for c in targets.columns if c in d.columns and c not in place])
    return d.join(rest, place, "inner" if require_targets else "left")


STREAMS = ("fisheye", "thermal", "mmwave", "imu", "frames", "gps")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of a tree; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def capture_catalogue(listing: DataFrame, root: str, require: tuple[str, ...] = ("fisheye", "thermal", "mmwave")) -> DataFrame:
    """One row per (scene, stamp) with the best file of each stream.  A trimmed recovered
    video wins over a recovered one, which wins over the primary; one level of session
    folders flattens into the scene name; folders starting with ``_`` or ``.`` are skipped."""
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/") + "/", "")
    d = listing.withColumn("rel", rel)
    folder = F.regexp_extract("rel", r"^(.*)/[^/]+$", 1)
    name = F.regexp_extract("rel", r"([^/]+)$", 1)
    rec = folder.rlike(r"(^|/)recovered$")
    dirs = F.split(F.regexp_replace(folder, r"/?recovered$", ""), "/")
    pat = r"^(" + "|".join(STREAMS) + r")_(.+?)(_trimmed)?\.(mp4|csv)$"
    d = d.select("path", "length", F.regexp_extract(name, pat, 1).alias("stream"), F.regexp_extract(name, pat, 2).alias("stamp"), rec.alias("rec"),
                 (F.regexp_extract(name, pat, 3) != "").alias("trim"), dirs.alias("dirs"))
    hidden = F.exists("dirs", lambda x: x.startswith("_") | x.startswith("."))
    d = d.filter((F.col("stream") != "") & F.size("dirs").between(1, 2) & ~hidden & (F.col("rec") | ~F.col("trim")))
    video = F.col("stream").isin("fisheye", "thermal")
    d = d.filter(video | ~F.col("rec")).withColumn("rank", F.when(F.col("rec") & F.col("trim"), 0).when(F.col("rec"), 1).otherwise(2))
    g = d.groupBy(F.array_join("dirs", "_").alias("scene"), "stamp").agg(
        *[F.min_by("path", F.when(F.col("stream") == s, F.struct("rank", "path"))).alias(s) for s in STREAMS])
    for s in require:
        g = g.filter(F.col(s).isNotNull())
    return g.withColumn("clip_id", F.concat_ws("/", "scene", "stamp"))


def curation_tables(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """(sets, cuts) from the curation mapping; only version 1 is understood."""
    if int(data.get("version", 1)) != 1:
        raise ValueError(f"unsupported curation version {data.get('version')}")
    sets, cuts = [], []
    for key, raw in (data.get("sets") or {}).items():
        raw, key = raw or {}, str(key).replace("/", "__")
        scene, _, first = key.partition("__")
        stamps = [str(raw[k]) if raw.get(k) not in (None, "") else None for k in ("deleted_at", "restored_at", "purged_at")]
        sets.append((key, scene, [str(c) for c in (raw.get("chunks") or [first])], *stamps))
        cuts += [(key, str(c["start_ts"]), str(c["end_ts"])) for c in (raw.get("cuts") or []) if c and c.get("start_ts") is not None and c.get("end_ts") is not None]
    return (spark.createDataFrame(sets, "clip_key string, scene string, chunks array<string>, deleted_at string, restored_at string, purged_at string"),
            spark.createDataFrame(cuts, "clip_key string, start_ts string, end_ts string"))


def read_curation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Curation file from any store Spark reads: JSON where the name ends in ``.json``, else
    YAML, for which a parser must be installed.  A missing file is empty."""
    try:
        text = (spark.read.option("wholetext", True).text(path).first() or [""])[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return curation_tables(spark, {})
    if path.endswith(".json"):
        return curation_tables(spark, json.loads(text or "{}"))
    import yaml

    return curation_tables(spark, yaml.safe_load(text) or {})


def boat_fixes(rows: DataFrame, max_age_s: float | None = None, now_epoch_s: float | None = None) -> DataFrame:
    """Newest usable fix of each log: rows without a place or at (0, 0) are skipped; a fix
    older than the limit by its own stamp is refused.  ``rows``: log, row_no, lat, lon, fix,
    ts_iso (text)."""
    d = rows.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon")})
    d = d.filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)")
    g = d.groupBy("log").agg(F.max_by(F.struct("lat", "lon", F.col("fix").try_cast("int").alias("fix_q"), F.col("ts_iso").try_cast("timestamp").alias("fix_time")), "row_no").alias("z")).select("log", "z.*")
    if max_age_s is None:
        return g.withColumn("note", F.lit("ok"))
    age = F.lit(float(now_epoch_s)) - F.unix_micros("fix_time") / 1e6
    stale = age > max_age_s
    return g.withColumn("note", F.when(F.coalesce(stale, F.lit(False)), "stale").otherwise("ok"))


def trial_rows(lines: DataFrame) -> DataFrame:
    """Trial log lines of every kind in one superset table; bad lines drop."""
    d = _parsed(lines, S.TRIAL)
    return d.select(*[c for c in lines.columns if c != "line"], "r.*").withColumn("trial", F.coalesce("trial", F.lit(1)))


def gt_windows(specs: DataFrame) -> DataFrame:
    """Ground-truth windows: times as clip seconds or as absolute clock text.
    ``specs``: clip_id, t0_clip, line (JSON)."""
    d = _parsed(specs, S.WINDOWS).select("clip_id", "t0_clip", F.posexplode("r.windows").alias("window_no", "w"))

    def at(c):
        return F.when(c.contains(":"), clock.seconds_of_day(c)).otherwise(F.col("t0_clip") + c.try_cast("double"))

    return d.select("clip_id", "window_no", at(F.col("w.t0")).alias("t0_s"), at(F.col("w.t1")).alias("t1_s"), F.col("w.state").alias("state"),
                    F.col("w.bearing_min").alias("bearing_min"), F.col("w.bearing_max").alias("bearing_max"))


def split_audits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) audit records by their constraints: an object with all keys, a known
    verdict, a list of boxes, and promoted columns that agree with the payload."""
    need = ("id", "clip_key", "frame_ts", "frame_id", "verdict", "boxes", "source", "created_at")
    keys = F.json_object_keys("record")
    r = F.from_json("record", S.RECORD)
    ok = keys.isNotNull() & (F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in need]))) == len(need))
    ok = ok & r["verdict"].isin("accept", "reject", "edit") & r["boxes"].startswith("[")
    ok = ok & (F.lower(r["id"]) == F.lower("id")) & (r["clip_key"] == F.col("clip_key")) & (r["frame_ts"] == F.col("frame_ts"))
    d = rows.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    return d.filter("__ok").drop("__ok"), d.filter("NOT __ok").drop("__ok")


# fixed values: allowed values of the review logs
CROP_VERDICTS = ("accept", "deny", "skip", "junk")
INGEST_STATES = ("uploaded", "processing", "ready", "failed")


def split_enum(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) by a closed set of values."""
    ok = F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)
