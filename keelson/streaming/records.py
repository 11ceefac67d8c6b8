"""Live sector records: one per frame, from streams of frames, radar returns and attitude.

Radar returns become groups by stamp (an aggregate per recording and stamp), detections become
frames in the same way, and each frame is joined with the samples of the last seconds by a
stream-stream join in a time range.  A frame takes the newest complete radar group: the group
before the newest one in reach, since the newest may be mid-write.  Persistence and confirmation
are state per (recording, bin); the sink gathers the bins of a frame, which leave in one batch.
All state is keyed by recording and stamp or bin, and held for the delay and the age in reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import motion as M
from keelson.functions import scoring as Q
from keelson.operators import radar as R
from keelson.operators import sectors as S
from keelson.params import GATE, GRID, MOTION
from keelson.streaming.ordered import both, confirmed, in_order, persisted

FRAME = ["clip_id", "frame_index"]


@dataclass(frozen=True)
class Live:
    delay: str = "10 seconds"        # how late a row may be
    reach_s: float = 2.0             # oldest radar group or mask that counts
    attitude_s: float = 1.0          # oldest attitude that counts
    idle_s: float = 600.0


def newest_within(frames: DataFrame, samples: DataFrame, picks: list[Column], keys: list[str], *, reach_s: float, sample_time: str = "sample_ts") -> DataFrame:
    """Frames with aggregates (``picks``) of the samples of the same recording that are at most
    ``reach_s`` old; a frame without any is kept.  ``samples``: s_clip, ``sample_time`` and a
    payload.  Both sides have a watermark on their times; ``keys`` identify a frame beside ts."""
    # state is looked up by recording and slice of time, so a row meets what is near it and not its whole
    # recording; a sample is in reach of frames of its slice and of the next
    width = round(reach_s * 1e6)
    frame_slice, first = F.floor(F.unix_micros("ts") / width), F.floor(F.unix_micros(sample_time) / width)
    left = frames.withColumn("__slice", frame_slice)
    right = samples.withColumn("__s_slice", F.explode(F.array(first, first + 1)))
    near = F.expr(f"s_clip = clip_id AND __s_slice = __slice AND {sample_time} <= ts AND {sample_time} >= ts - INTERVAL {reach_s} SECONDS")
    joined = left.join(right, near, "left_outer").drop("__slice", "__s_slice")
    # as plain numbers the sample times carry no second watermark into the aggregate
    age = (F.unix_micros("ts") - F.unix_micros(sample_time)) / 1e6
    plain = joined.withColumn("age_s", age).withColumn("sample_ms", F.unix_millis(sample_time)).drop("s_clip", sample_time)
    rest = [c for c in frames.columns if c not in keys and c != "ts"]
    return plain.groupBy(*keys, "ts").agg(*[F.first(c).alias(c) for c in rest], *picks)


def freshest(frames: DataFrame, results: DataFrame, keys: list[str], reach_s: float = 2.0) -> DataFrame:
    """Newest result id, its age and whether there is one (``results``: s_clip, sample_ts, result_id)."""
    at = F.when(F.col("result_id").isNotNull(), F.col("sample_ms"))
    return newest_within(frames, results, [F.max_by("result_id", at).alias("result_id"), F.max_by("age_s", at).alias("age_s"), F.coalesce(F.max(at).isNotNull(), F.lit(False)).alias("fresh")], keys, reach_s=reach_s)


def camera_frames(detections: DataFrame, angle: Column, live: Live) -> DataFrame:
    """One row per frame-clock stamp with its detections (bin, sensor, confidence)."""
    box = F.when(F.col("det_id").isNotNull(), F.struct(M.bin_of(angle).alias("bin_index"), "sensor", "confidence"))
    return detections.withWatermark("ts", live.delay).groupBy(*FRAME, "ts").agg(F.collect_list(box).alias("boxes"))


def return_groups(points: DataFrame, live: Live) -> DataFrame:
    """One row per radar stamp with the filtered returns (bin, range, closing speed); a group
    outside the count gate has none.  The gate bounds what a good group holds."""
    p = points.withWatermark("ts", live.delay)
    raw = F.col("x").isNotNull()
    y, zone = F.col("y"), F.col("x").between(*GATE.clutter_x) & F.col("y").between(*GATE.clutter_y) & (F.abs(F.coalesce("v", F.lit(0.0))) <= GATE.keep_if_doppler_above)
    bin_index = M.bin_of(M.azimuth(F.col("x"), y))
    kept = raw & y.between(GATE.y_min, GATE.y_max) & ~zone & bin_index.isNotNull()
    ret = F.when(kept, F.struct(bin_index.alias("bin_index"), y.alias("range_m"), M.closing_speed(M.doppler_velocity(F.col("x"), y, F.col("v"))["vy"]).alias("closing")))
    g = p.groupBy(F.col("clip_id").alias("s_clip"), F.col("ts").alias("sample_ts")).agg(F.count_if(raw).alias("n"), F.collect_list(ret).alias("returns"))
    ok = F.col("n").between(GATE.min_points, GATE.max_points)
    return g.select("s_clip", "sample_ts", F.when(ok, F.col("returns")).otherwise(F.slice("returns", 1, 0)).alias("returns"))


def frame_evidence(frames: DataFrame, groups: DataFrame, attitude: DataFrame, live: Live) -> DataFrame:
    """Frames with the newest complete radar group and the newest attitude in reach."""
    none = F.lit(None)
    kind = dict(groups.dtypes)["returns"]
    samples = groups.withColumn("attitude", none.cast("struct<roll:double,pitch:double,yaw:double>")).unionByName(
        attitude.withWatermark("ts", live.delay).select(F.col("clip_id").alias("s_clip"), F.col("ts").alias("sample_ts"), none.cast(kind).alias("returns"), F.struct("roll", "pitch", "yaw").alias("attitude")))
    seen = F.sort_array(F.collect_list(F.when(F.col("returns").isNotNull(), F.struct("sample_ms", "returns"))), asc=False)
    near = F.when(F.col("attitude").isNotNull() & (F.col("age_s") <= live.attitude_s), F.col("sample_ms"))
    d = newest_within(frames, samples, [seen.alias("groups"), F.max_by("attitude", near).alias("attitude")], FRAME, reach_s=live.reach_s)
    # the newest group may be mid-write: the one before it is complete
    return d.withColumn("returns", F.get("groups", F.lit(1))["returns"]).withColumn("group_ms", F.get("groups", F.lit(1))["sample_ms"]).drop("groups")


def sector_bins(evidence: DataFrame, model: Q.GatedMixture) -> DataFrame:
    """One row per frame and bin: hits, vote score, range, closing speed, time to collision,
    obstacle probability and threat."""
    b = F.col("bin_index")
    d = evidence.withColumn("bin_index", M.all_bins(GRID))
    d = d.withColumns({"__r": F.filter(F.coalesce("returns", F.array().cast(dict(evidence.dtypes)["returns"])), lambda r: r["bin_index"] == b), "__b": F.filter("boxes", lambda x: x["bin_index"] == b)})
    speeds = F.array_sort(F.transform(F.filter("__r", lambda r: r["closing"].isNotNull()), lambda r: F.struct(F.abs(r["closing"]).alias("a"), r["closing"].alias("c"))))
    seen = lambda sensor: F.exists("__b", lambda x: x["sensor"] == sensor).cast("int")
    d = d.withColumns({
        "bin_center_deg": M.bin_center(b), "hit_fisheye": seen("fisheye"), "hit_thermal": seen("thermal"), "hit_mmwave": (F.size("__r") > 0).cast("int"),
        "radar_n_points": F.size("__r"), "min_range_m": F.array_min(F.transform("__r", lambda r: r["range_m"])),
        "closing_mps": F.get(speeds, F.floor(F.size(speeds) / 2).cast("int"))["c"],
        "thermal_det_count": F.size(F.filter("__b", lambda x: x["sensor"] == "thermal")), "yolo_max_conf": F.array_max(F.transform("__b", lambda x: x["confidence"])),
    })
    d = d.withColumns({
        "score": (F.col("hit_fisheye") + F.col("hit_thermal") + F.col("hit_mmwave")) / F.lit(3.0), "radar_min_range_m": F.col("min_range_m"),
        "ttc_s": M.time_to_collision(F.col("min_range_m"), F.col("closing_mps"), MOTION.ttc_eps_mps, MOTION.ttc_cap_s), "imu_available": F.col("attitude").isNotNull(),
    })
    for absent, kind in {"seg_obstacle_frac": "double", "luminance_mean": "double", "sun_elevation_deg": "double", "is_dark": "boolean", "thermal_quality_ok": "boolean", "seg_available": "boolean"}.items():
        if absent not in d.columns:
            d = d.withColumn(absent, F.lit(None).cast(kind))
    d = d.select("*", *Q.evidence(model.sensors), *Q.context(model.contexts))
    d = d.select("*", *model.gates())
    p = model.probability()
    d = d.withColumn("p", p)
    d = d.withColumn("threat", Q.threat(F.col("p"), F.col("min_range_m"), F.col("ttc_s"), F.lit(1.0)))
    return d.select(*FRAME, "ts", b, "bin_center_deg", "hit_fisheye", "hit_thermal", "hit_mmwave", "score", "radar_n_points", "min_range_m", "closing_mps", "ttc_s", "p", "threat", "attitude", "group_ms")


CARRIED = {
    "frame_index": "long", "t_ms": "long", "bin_center_deg": "double", "hit_fisheye": "int", "hit_thermal": "int", "hit_mmwave": "int", "score": "double", "radar_n_points": "int", "min_range_m": "double",
    "closing_mps": "double", "ttc_s": "double", "p": "double", "threat": "double", "roll": "double", "pitch": "double", "yaw": "double", "group_ms": "long"}


def live_bins(detections: DataFrame, points: DataFrame, attitude: DataFrame, angle: Column, model: Q.GatedMixture, live: Live = Live()) -> DataFrame:
    """Scored bins of every frame with the persistent score and the confirmation of each bin."""
    evidence = frame_evidence(camera_frames(detections, angle, live), return_groups(points, live), attitude, live)
    bins = sector_bins(evidence, model).withColumn("t_ms", F.unix_millis("ts"))
    bins = bins.select("clip_id", *[c for c in CARRIED if c not in ("roll", "pitch", "yaw")], *[F.col(f"attitude.{c}").alias(c) for c in ("roll", "pitch", "yaw")], "bin_index", "ts",
                       (F.col("hit_fisheye") + F.col("hit_thermal") + F.col("hit_mmwave") > 1).alias("hit"))
    out = "clip_id string, bin_index long, " + ", ".join(f"{c} {t}" for c, t in CARRIED.items()) + ", p_smooth double, confirmed boolean"
    return in_order(bins, ["clip_id", "bin_index"], ["frame_index"], both(persisted(), confirmed(), carry=list(CARRIED)), out, within=1, idle_s=live.idle_s)


RECORD = {"centers": "bin_center_deg", "scores": "score", "min_range_m": "min_range_m", "closing_mps": "closing_mps", "ttc_s": "ttc_s", "hit_fisheye": "hit_fisheye", "hit_thermal": "hit_thermal",
          "hit_mmwave": "hit_mmwave", "p_obstacle": "p", "p_smooth": "p_smooth", "confirmed": "confirmed", "threat": "threat"}


def to_live_records(bins: DataFrame) -> DataFrame:
    """For the sink: the bins of a batch as one record per frame, with the recommended heading."""
    rows = S.to_records(bins, RECORD, {c: c for c in ("t_ms", "roll", "pitch", "yaw", "group_ms")})
    return S.recommend_heading(rows).withColumn("radar_age_s", (F.col("t_ms") - F.col("group_ms")) / 1000.0).drop("group_ms")
