"""Curation: soft deletes, time cuts, review-log folds, store updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import clock
from keelson.plans.joins import checked_join
from keelson.plans.ordered import SLICE, inside_intervals, scan, time_slices


def is_deleted(deleted_at: Column, restored_at: Column, purged_at: Column) -> Column:
    """Purged, or deleted and not restored at or after the deletion (text order)."""
    return purged_at.isNotNull() | (
        deleted_at.isNotNull() & (restored_at.isNull() | (restored_at < deleted_at)))


def deleted_clip_keys(sets: DataFrame) -> DataFrame:
    """Keys of deleted sets and of the chunks they list."""
    d = sets.filter(is_deleted(F.col("deleted_at"), F.col("restored_at"), F.col("purged_at")))
    own = d.select("clip_key")
    members = d.select("scene", F.explode("chunks").alias("chunk")).select(
        F.concat_ws("__", "scene", "chunk").alias("clip_key"))
    return own.unionByName(members).distinct()


def drop_deleted(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows whose clip is not deleted, directly or through its set."""
    keyed = rows.withColumn("clip_key", clock.clip_key(F.col("clip_id")))
    # deleted keys can be as many as the clips: few salts, as each repeats all of them
    return checked_join(keyed, deleted_clip_keys(sets), ["clip_key"], "left_anti", salts=4).drop("clip_key")


def mark_cut(frames: DataFrame, cuts: DataFrame, t: str = "t_ms", width: float = 60_000) -> DataFrame:
    """Adds ``cut``; frame numbers keep their raw value."""
    return inside_intervals(frames, cuts, ["clip_id"], t=t, start="start_ms", end="end_ms", width=width, flag="cut")


def drop_cut(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    return mark_cut(frames, cuts).filter(~F.col("cut")).drop("cut")


def cut_stats(frames: DataFrame, cuts: DataFrame, max_gap_s: float = 2.5) -> DataFrame:
    """Kept and cut frames and seconds; a frame lasts until the next one, capped; the
    last frame lasts a third of a second."""
    m = mark_cut(frames, cuts)
    m = scan(time_slices(m, "frame_index", 1000), ["clip_id"], ["frame_index"], lead={"nxt": F.col("t_ms")})
    d = (F.col("nxt") - F.col("t_ms")) / 1000.0
    d = F.when(d < 0, d + clock.DAY_S).otherwise(d)
    dur = F.when(F.col("nxt").isNull(), F.lit(1.0 / 3.0)).otherwise(F.least(F.greatest(d, F.lit(0.0)), F.lit(max_gap_s)))
    m = m.withColumn("dur", dur)
    return m.groupBy("clip_id").agg(
        F.count_if(~F.col("cut")).alias("kept"), F.count_if("cut").alias("cut_frames"),
        F.sum(F.when(~F.col("cut"), F.col("dur")).otherwise(0.0)).alias("kept_s"),
        F.sum(F.when(F.col("cut"), F.col("dur")).otherwise(0.0)).alias("cut_s"))


def cut_range_seconds(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy("clip_id").agg(
        F.sum(F.abs(F.col("end_ms") - F.col("start_ms")) / 1000.0 + F.lit(1.0 / 3.0)).alias("range_s"))


def purge_candidates(sets: DataFrame, now_epoch_s: float, retention_days: int = 30) -> DataFrame:
    """Deleted, unpurged, and past the retention window (whole days left = 0)."""
    gone = is_deleted(F.col("deleted_at"), F.col("restored_at"), F.col("purged_at"))
    at = F.unix_timestamp(F.to_timestamp("deleted_at"))
    left = F.greatest(F.lit(0), F.ceil((at + retention_days * 86400 - F.lit(now_epoch_s)) / 86400.0))
    return sets.filter(gone & F.col("purged_at").isNull() & F.col("deleted_at").isNotNull()).withColumn(
        "days_left", left.cast("bigint")).filter("days_left = 0")


def select_chunks(clips: DataFrame, sets: DataFrame, skip_prefixes: list[str], min_year: int) -> DataFrame:
    """Scene policy, campaign year, and curation."""
    keep = F.substring("stamp", 1, 4).try_cast("int") >= min_year
    for p in skip_prefixes:
        keep = keep & ~F.col("scene").startswith(p)
    return drop_deleted(clips.filter(keep), sets)


def latest_per_key(log: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Newest record per key; among equal times the later log position wins.  One
    aggregate with map-side combine, so a hot key costs no more than a cold one."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(
        *keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def replace_scene(store: DataFrame, seed: DataFrame, scene: str = "scene") -> DataFrame:
    """Label upsert: scenes present in the seed are replaced as a whole."""
    fresh = seed.select(scene).distinct()
    return checked_join(store, fresh, [scene], "left_anti").unionByName(seed)


def merge_label_files(*files: DataFrame) -> DataFrame:
    """Union of label files; boxes of a frame id that occurs several times are joined."""
    u = files[0]
    for f in files[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.groupBy("frame_id").agg(
        F.flatten(F.array_sort(F.collect_list("boxes"))).alias("boxes"), F.bool_or("audited").alias("audited"))
