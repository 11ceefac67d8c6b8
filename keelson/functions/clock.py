"""Capture clocks: truncated keys, seconds of day, local-to-UTC, clip and frame keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86400.0


def rounded_time(ts: Column) -> Column:
    """``HH:MM:SS.f`` truncated (never rounded) to 100 ms."""
    return F.substring(F.date_format(ts, "HH:mm:ss.SSS"), 1, 10)


def seconds_of_day(text: Column) -> Column:
    """``HH:MM:SS[.f]`` or its dash form to seconds; null when malformed."""
    p = F.split(F.translate(text, "-", ":"), ":")
    h, m, s = p[0].try_cast("int"), p[1].try_cast("int"), p[2].try_cast("double")
    return F.when(F.size(p) == 3, h * 3600.0 + m * 60.0 + s)


def hms_tenths(seconds: Column) -> Column:
    """Seconds to ``HH:MM:SS.f`` (wraps at midnight)."""
    s = F.pmod(seconds, F.lit(DAY_S))
    rem = F.pmod(s, F.lit(3600.0))
    return F.format_string("%02d:%02d:%04.1f", F.floor(s / 3600).cast("int"), F.floor(rem / 60).cast("int"),
                           F.pmod(rem, F.lit(60.0)))


def stamp_seconds(stamp: Column) -> Column:
    """Seconds of day of a ``date_HH-MM-SS`` clip stamp; 0 when it has another form."""
    g = [F.regexp_extract(stamp, r"_(\d+)-(\d+)-(\d+)$", i).try_cast("int") for i in (1, 2, 3)]
    return F.coalesce(g[0] * 3600.0 + g[1] * 60.0 + g[2], F.lit(0.0))


def to_utc(clip_date: Column, frame_time: Column, zone: str, chunk_start: Column) -> Column:
    """Local wall clock to UTC.  A frame more than 12 h before its chunk start belongs
    to the next day (the clip crossed midnight)."""
    local = F.to_timestamp_ntz(F.concat_ws(" ", clip_date, frame_time))
    behind = seconds_of_day(chunk_start) - seconds_of_day(frame_time)
    local = F.when(behind > 12 * 3600, local + F.expr("INTERVAL 1 DAY")).otherwise(local)
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def frame_id(scene: Column, stamp: Column, frame_time: Column) -> Column:
    return F.concat(scene, F.lit("/"), stamp, F.lit("/ts="), F.translate(frame_time, ":", "-"))


def parse_frame_id(fid: Column) -> Column:
    """struct(scene, stamp, clip_id, frame_idx, frame_ts) of both key forms; any other
    shape fails the job."""
    p = F.split(fid, "/")
    ok = F.when(F.size(p) == 3, fid).otherwise(F.raise_error(F.concat(F.lit("unexpected frame id: "), fid)))
    q = F.split(ok, "/")
    timed = q[2].startswith("ts=")
    return F.struct(
        q[0].alias("scene"), q[1].alias("stamp"), F.concat(q[0], F.lit("/"), q[1]).alias("clip_id"),
        F.when(timed, F.lit(-1)).otherwise(q[2].try_cast("bigint")).cast("bigint").alias("frame_idx"),
        F.when(timed, F.translate(F.substring(q[2], 4, 32), "-", ":")).alias("frame_ts"),
    )


def clip_key(clip_id: Column) -> Column:
    return F.regexp_replace(clip_id, "/", "__")


def clip_id(key: Column) -> Column:
    return F.regexp_replace(key, "__", "/")


def step_seconds(cur: Column, prev: Column, max_gap: float = 5.0) -> Column:
    """Seconds since the previous sample; rolls over midnight; null for a step that is
    not positive or longer than ``max_gap``."""
    raw = cur - prev
    dt = F.when(raw < -80000.0, raw + DAY_S).otherwise(raw)
    return F.when((dt > 0) & (dt <= max_gap), dt)


def hash_bucket(key: Column) -> Column:
    """Deterministic bucket in [0, 1) from the first 32 bits of SHA-256."""
    head = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return (head % 10000) / F.lit(10000.0)


def assign_split(
    clip: Column, *, test: list[str] = (), val: list[str] = (), test_after: str | None = None,
    by_outing: bool = True, train_share: float = 0.70, val_share: float = 0.15,
) -> Column:
    """struct(split, group_key): explicit lists, then a date cut-off, then the hash."""
    stamp = F.element_at(F.split(clip, "/"), -1)
    day = F.substring(stamp, 1, 10)
    scene = F.regexp_extract(clip, r"^(.*)/[^/]*$", 1)
    group = F.when(scene != "", F.concat(scene, F.lit("/"), day)).otherwise(day)
    b = hash_bucket(group if by_outing else clip)
    split = F.when(b < train_share, "train").when(b < train_share + val_share, "val").otherwise("test")
    if test_after:
        valid = day.try_cast("date").isNotNull()
        split = F.when(valid & (day >= F.lit(test_after)), "test").otherwise(split)
    if val:
        split = F.when(clip.isin(list(val)), "val").otherwise(split)
    if test:
        split = F.when(clip.isin(list(test)), "test").otherwise(split)
    return F.struct(split.alias("split"), group.alias("group_key"))
