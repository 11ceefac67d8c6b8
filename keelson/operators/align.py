"""Stream alignment: lockstep frames, attitude, exposure, radar health and trails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keelson.functions import clock
from keelson.plans.ordered import SLICE, haloed, nearest_asof, scan, time_slices

NOMINAL_FPS = 3.0


def radar_ordinals(points: DataFrame, slice_ms: float = 60_000) -> DataFrame:
    """One row per distinct radar time of a clip with its ordinal from 0.  Heartbeat
    rows (no coordinates) count, with an empty cloud."""
    t = points.groupBy("clip_id", "t_ms").agg(F.count("x").alias("n_points"))
    t = scan(time_slices(t, "t_ms", slice_ms), ["clip_id"], ["t_ms"], run_sum={"k": F.lit(1)})
    return t.select("clip_id", (F.col("k") - 1).cast("bigint").alias("frame_index"), "t_ms", "n_points")


def lockstep(radar_times: DataFrame, clips: DataFrame) -> DataFrame:
    """Frames of every clip: the k-th radar time meets the k-th video frame and the
    shorter stream ends the clip; clips without radar run on the nominal clock.

    ``clips``: clip_id, n_frames, base_s.
    """
    both = radar_times.join(clips, "clip_id").filter(F.col("frame_index") < F.col("n_frames")).select(
        "clip_id", "frame_index", (F.col("t_ms") / 1000.0).alias("t_s"), "n_points", F.lit("radar").alias("clock"))
    silent = clips.filter("n_frames > 0").join(radar_times.select("clip_id").distinct(), "clip_id", "left_anti")
    synth = silent.withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)))
    synth = synth.select("clip_id", "frame_index", (F.col("base_s") + F.col("frame_index") / F.lit(NOMINAL_FPS)).alias("t_s"),
                         F.lit(0).cast("bigint").alias("n_points"), F.lit("nominal").alias("clock"))
    return both.unionByName(synth).withColumn("rounded_time", clock.hms_tenths(F.col("t_s")))


def attach_attitude(frames: DataFrame, imu: DataFrame, max_age_ms: float = 1000) -> DataFrame:
    """Nearest attitude sample, earlier one on a tie, null beyond ``max_age_ms``."""
    return nearest_asof(frames, imu, ["clip_id"], t="t_ms", payload=["yaw", "pitch", "roll"], max_age=max_age_ms)


def attach_exposure(frames: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Camera exposure by frame index; torn sidecar rows without an index are dropped."""
    return frames.join(sidecar.filter(F.col("frame_index").isNotNull()), ["clip_id", "frame_index"], "left")


def radar_health(frames: DataFrame, groups: DataFrame, tolerance_ms: float = 2000, slack_ms: float = 50) -> DataFrame:
    """Whether a radar group lies at or shortly before each frame."""
    g = groups.withColumn("group_ms", F.col("t_ms"))
    out = nearest_asof(frames, g, ["clip_id"], t="t_ms", payload=["group_ms"], max_age=tolerance_ms,
                       side="backward", slack=slack_ms)
    return out.withColumn("radar_ok", F.col("group_ms").isNotNull()).drop("asof_gap")


def radar_trail(frames: DataFrame, groups: DataFrame, max_groups: int = 5, max_age_ms: int = 2000,
                slice_ms: float = 60_000) -> DataFrame:
    """The newest ``max_groups`` radar groups no older than ``max_age_ms`` per frame."""
    f = frames.select("clip_id", "frame_index", "t_ms", F.lit(1).alias("__f"), F.lit(None).cast("bigint").alias("g"))
    g = groups.select("clip_id", F.lit(None).cast("bigint").alias("frame_index"), "t_ms", F.lit(0).alias("__f"),
                      F.col("t_ms").alias("g"))
    both = haloed(f.unionByName(g), "t_ms", slice_ms, before=max_age_ms)
    w = W.partitionBy("clip_id", SLICE).orderBy("t_ms").rangeBetween(-max_age_ms, 0)
    seen = F.array_sort(F.collect_list("g").over(w))
    n = F.least(F.size("__s"), F.lit(max_groups))
    return both.withColumn("__s", seen).filter("__f = 1 AND __own").select(
        "clip_id", "frame_index", "t_ms", F.slice("__s", F.size("__s") - n + 1, n).alias("trail"))


def frame_steps(frames: DataFrame, t: str = "t_s", max_gap_s: float = 5.0) -> DataFrame:
    """Seconds since the previous frame (midnight roll, gap rule)."""
    d = scan(time_slices(frames, "frame_index", 1000), ["clip_id"], ["frame_index"], lag={"prev": F.col(t)})
    return d.withColumn("dt_s", clock.step_seconds(F.col(t), F.col("prev"), max_gap_s)).drop("prev", SLICE)


def loop_health(frames: DataFrame, max_gap_s: float = 2.5) -> DataFrame:
    """Camera loop health: the gap to the next frame (wrapping midnight); the last
    frame is healthy."""
    d = scan(time_slices(frames, "frame_index", 1000), ["clip_id"], ["frame_index"], lead={"nxt": F.col("t_s")})
    gap = F.col("nxt") - F.col("t_s")
    gap = F.when(gap < 0, gap + clock.DAY_S).otherwise(gap)
    return d.withColumn("ok", F.coalesce(gap <= max_gap_s, F.lit(True))).drop("nxt", SLICE)


def thermal_state(present, quality):
    """Absent is down; present with a low contrast mark is degraded."""
    return F.when(~present, "down").when(quality == "low", "degraded").otherwise("ok")


def number_runs(df: DataFrame, keys: list[str], pos: str, state: str, slice_len: float = 1000) -> DataFrame:
    """Adds ``run``: 1, 2, ... for each stretch of equal state, per key in position order."""
    d = scan(time_slices(df, pos, slice_len), keys, [pos], lag={"__p": F.col(state)})
    new = F.when(F.col("__p").isNull() | (F.col("__p") != F.col(state)), 1).otherwise(0)
    d = scan(d.withColumn("__new", new), keys, [pos], run_sum={"run": F.col("__new")})
    return d.withColumn("run", F.col("run").cast("bigint")).drop("__p", "__new", SLICE)


def compress_runs(df: DataFrame, keys: list[str], pos: str, state: str, slice_len: float = 1000) -> DataFrame:
    """Runs of equal state: start position and length."""
    return number_runs(df, keys, pos, state, slice_len).groupBy(*keys, "run").agg(
        F.min(pos).alias("start_pos"), F.count("*").alias("length"), F.first(state).alias("state"))


def new_fixes(gps: DataFrame, order: list[str], slice_ms: float = 600_000) -> DataFrame:
    """Position rows that differ from the row before in source, place or fix time."""
    key = F.struct("source", "lat", "lon", "fix_ms")
    d = scan(time_slices(gps, order[0], slice_ms), ["clip_id"], order, lag={"__prev": key})
    return d.filter(F.col("__prev").isNull() | (F.col("__prev") != key)).drop("__prev", SLICE)


def sessions(clips: DataFrame, gap_s: float = 45.0, slice_s: float = 86_400.0) -> DataFrame:
    """Activities: chunks of one scene whose start follows the previous chunk's end by at
    most ``gap_s`` (the previous chunk's end, not the latest end so far)."""
    order = ["start_s", "chunk_no"]
    d = scan(time_slices(clips, "start_s", slice_s), ["scene"], order, lag={"__end": F.col("start_s") + F.col("duration_s")})
    new = F.when(F.col("start_s") - F.col("__end") <= gap_s, 0).otherwise(1)
    d = scan(d.withColumn("__new", new), ["scene"], order, run_sum={"activity": F.col("__new")})
    return d.withColumn("activity", F.col("activity").cast("bigint")).drop("__end", "__new", SLICE)
