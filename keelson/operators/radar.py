"""Radar frames: gating, filtering, velocities, bearing bins and vote fusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import motion as M
from keelson.params import GATE, GRID, MOTION, BinGrid, Motion, RadarGate
from keelson.plans.joins import checked_join
from keelson.plans.stateful import ordered_map

FRAME = ["clip_id", "frame_index"]


def frame_counts(points: DataFrame) -> DataFrame:
    """Raw returns per frame (heartbeats count as a frame with no returns)."""
    return points.groupBy(*FRAME).agg(
        F.count(F.when(F.col("x").isNotNull(), 1)).alias("n_raw"), F.min("t_ms").alias("t_ms"))


def gate_frames(points: DataFrame, gate: RadarGate = GATE) -> DataFrame:
    """Drops every return of frames whose raw count is out of range.

    Over-full frames are few or none; their ids are joined after a size check, so
    the points are not shuffled for this gate.
    """
    p = points.filter(F.col("x").isNotNull())
    n = p.groupBy(*FRAME).count()
    bad = n.filter((F.col("count") > gate.max_points) | (F.col("count") < gate.min_points)).select(*FRAME)
    return checked_join(p, bad, FRAME, "left_anti", spread="point_id")


def filter_points(points: DataFrame, gate: RadarGate = GATE) -> DataFrame:
    """Mount rotation, forward window, own-hull clutter zone."""
    p = points
    if gate.mount_yaw_deg:
        x, y = M.rotate_mount(F.col("x"), F.col("y"), gate.mount_yaw_deg)
        p = p.withColumns({"x": x, "y": y})
    p = p.filter(F.col("y").between(gate.y_min, gate.y_max))
    zone = F.col("x").between(*gate.clutter_x) & F.col("y").between(*gate.clutter_y)
    if gate.has_doppler:
        zone = zone & (F.abs(F.coalesce(F.col("v"), F.lit(0.0))) <= gate.keep_if_doppler_above)
    return p.filter(~zone)


def with_polar(points: DataFrame, grid: BinGrid = GRID) -> DataFrame:
    """Azimuth, forward range, bin, and line-of-sight velocity."""
    p = points.filter(F.col("y") != 0)
    az = M.azimuth(F.col("x"), F.col("y"))
    vel = M.doppler_velocity(F.col("x"), F.col("y"), F.col("v"))
    return p.withColumns({
        "angle_deg": az, "range_m": F.col("y"), "bin_index": M.bin_of(az, grid),
        "vx": vel["vx"], "vy": vel["vy"],
    })


class _NearestMatch:
    """Greedy one-to-one matching of each frame with the one before it, for one block."""

    def __init__(self, motion: Motion):
        self.motion, self.last = motion, None

    def step(self, rows: dict) -> list[tuple]:
        frame, prev = rows["frame_index"][0], self.last
        self.last = rows
        if prev is None or prev["frame_index"][0] + 1 != frame:
            return []
        dt = (rows["t_ms"][:, None] - prev["t_ms"][None, :]) / 1000.0
        dx, dy = rows["x"][:, None] - prev["x"][None, :], rows["y"][:, None] - prev["y"][None, :]
        dist = np.sqrt(dx * dx + dy * dy)
        i, j = np.nonzero((dist <= self.motion.gate_m) & (dt > 0) & (dt <= self.motion.max_dt_s))
        left, right, near = rows["point_id"][i], prev["point_id"][j], dist[i, j]
        used, taken, out = set(), set(), []
        for k in np.lexsort((right, left, near)).tolist():
            a, b = int(left[k]), int(right[k])
            if a not in used and b not in taken:
                used.add(a)
                taken.add(b)
                at = i[k], j[k]
                out.append((rows["clip_id"][0], int(frame), a, b, float(near[k]), float(dx[at] / dt[at]), float(dy[at] / dt[at])))
        return out


def match_consecutive(points: DataFrame, motion: Motion = MOTION, block: int = 256) -> DataFrame:
    """Velocity by one-to-one nearest matching with the previous frame.

    A point later than ``max_dt_s`` after its partner starts afresh.  Greedy, cheapest pair
    first, ties by point ids.  Points are shuffled once, by blocks of frames; the last frame of a
    block goes along with the next one too.  Frames are bounded by the count gate."""
    f = F.col("frame_index")
    own = F.floor(f / block)
    at = F.when(F.pmod(f, F.lit(block)) == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    p = points.select(*FRAME, "point_id", "x", "y", "t_ms", F.explode(at).alias("__block"))
    return ordered_map(p, ["clip_id", "__block"], "frame_index", ["point_id"], lambda: _NearestMatch(motion),
                       "clip_id string, frame_index long, point_id long, p_id long, dist double, trk_vx double, trk_vy double")


def coalesce_velocity(points: DataFrame, tracked: DataFrame) -> DataFrame:
    """Doppler wins per point, the frame-to-frame match fills the rest."""
    return points.join(tracked.drop("p_id", "dist"), FRAME + ["point_id"], "left").withColumns({
        "from_doppler": F.col("vy").isNotNull(),
        "from_tracker": F.col("vy").isNull() & F.col("trk_vy").isNotNull(),
    }).withColumns({
        "vx": F.coalesce("vx", "trk_vx"), "vy": F.coalesce("vy", "trk_vy"),
    }).drop("trk_vx", "trk_vy")


def velocity_source(points: DataFrame) -> DataFrame:
    """Per frame: doppler, tracker or mixed."""
    d, t = F.bool_or("from_doppler"), F.bool_or("from_tracker")
    return points.groupBy(*FRAME).agg(
        F.when(d & t, "mixed").when(d, "doppler").otherwise("tracker").alias("velocity_source"))


def upper_median_signed(closing):
    """Element n div 2 of the speeds ranked by magnitude (sign kept)."""
    ranked = F.array_sort(F.collect_list(F.when(closing.isNotNull(), F.struct(F.abs(closing).alias("a"), closing.alias("c")))))
    return F.when(F.size(ranked) > 0, F.element_at(ranked, (F.floor(F.size(ranked) / 2) + 1).cast("int"))["c"])


def radar_bins(polar: DataFrame, motion: Motion = MOTION) -> DataFrame:
    """Per occupied bin: returns, ranges, signal, closing speed and time to collision."""
    closing = M.closing_speed(F.col("vy"))
    b = polar.filter(F.col("bin_index").isNotNull()).groupBy(*FRAME, "bin_index").agg(
        F.count("*").alias("radar_n_points"),
        F.min("range_m").alias("radar_min_range_m"),
        F.median("range_m").alias("radar_median_range_m"),
        F.max("snr").alias("radar_max_snr_db"),
        F.avg("snr").alias("radar_mean_snr_db"),
        F.median("noise").alias("radar_median_noise_db"),
        F.count("vy").alias("radar_n_velocity"),
        upper_median_signed(closing).alias("closing_mps"),
    )
    return b.withColumn("ttc_s", M.time_to_collision(
        F.col("radar_min_range_m"), F.col("closing_mps"), motion.ttc_eps_mps, motion.ttc_cap_s))


def dense_bins(frames: DataFrame, grid: BinGrid = GRID) -> DataFrame:
    """Every bin of every frame, by a generator (no join)."""
    return frames.withColumn("bin_index", M.all_bins(grid)).withColumn(
        "bin_center_deg", M.bin_center(F.col("bin_index"), grid))


def fuse_votes(frames: DataFrame, hits: DataFrame, grid: BinGrid = GRID, sensors: int = 3) -> DataFrame:
    """Vote score per (frame, bin): distinct sensors hit / sensors, dense.

    ``hits`` has (clip, frame, bin_index, sensor).
    """
    f = hits.filter(F.col("bin_index").isNotNull()).groupBy(*FRAME, "bin_index").agg(
        *[F.bool_or(F.col("sensor") == s).alias(f"hit_{s}") for s in ("fisheye", "thermal", "mmwave")])
    out = dense_bins(frames, grid).join(f, FRAME + ["bin_index"], "left")
    cols = [F.coalesce(F.col(f"hit_{s}"), F.lit(False)).cast("bigint") for s in ("fisheye", "thermal", "mmwave")]
    return out.withColumns(dict(zip(["hit_fisheye", "hit_thermal", "hit_mmwave"], cols))).withColumn(
        "score", (F.col("hit_fisheye") + F.col("hit_thermal") + F.col("hit_mmwave")) / F.lit(float(sensors)))
