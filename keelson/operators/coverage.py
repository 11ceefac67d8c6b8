"""Coverage of the recorded corpus: enrichment, coverage tables, gaps, condition matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.sun import daypart_footage, position_short
from keelson.operators.boxes import canonical
from keelson.plans.ordered import nearest_asof

# fixed values: band edges, instance targets and goal hours
BANDS: dict[str, tuple[float, ...]] = {
    "cloud_cover_pct": (0, 20, 40, 60, 80, 100.1),
    "wind_speed_kmh": (0, 10, 20, 30, 40.1),
    "precipitation_mm": (0, 0.1, 1, 2, 4.1),
    "wind_dir_deg": (0, 45, 90, 135, 180, 225, 270, 315, 360.1),
}
BAND_HOURS: dict[str, tuple[float, ...]] = {
    "cloud_cover_pct": (2, 2, 2, 2, 2),
    "wind_speed_kmh": (3, 3, 2, 1),
    "precipitation_mm": (6, 2, 1, 0.5),
    "wind_dir_deg": (1, 1, 1, 1, 1, 1, 1, 1),
}
TARGETS = {"boat": 5000, "person": 1500, "duck": 1000, "animal": 500, "buoy": 500, "structure": 2000, "float": 300, "other": 300}
HOUR_GOALS = {h: 2.0 if 6 <= h <= 21 else 1.0 for h in range(24)}
MATRIX_EDGES: dict[str, tuple[float, ...]] = {
    "cloud": (0, 20, 40, 60, 80, 100.1), "wind": (0, 10, 20, 30, 40.1), "precip": (0, 0.1, 1, 4.1), "luma": (0, 85, 170, 256),
}
CAPTURE_FPS = 3.0


def band_of(v: Column, edges: Sequence[float]) -> Column:
    """Band index; a value outside every band falls in the last one; null stays null."""
    out = F.when(v.isNull(), None)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        out = out.when((v >= a) & (v < b), i)
    return out.otherwise(len(edges) - 2)


def band_table(edges: Sequence[float]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("band"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))])


def hours_of(frames: Column) -> Column:
    return frames / F.lit(CAPTURE_FPS * 3600.0)


# -- enrichment ---------------------------------------------------------------

def frame_dayparts(frames: DataFrame, lat: float, lon: float) -> DataFrame:
    """Frames per part of the day and clip.  ``frames``: clip_id, epoch_s."""
    e = position_short(F.lit(lat), F.lit(lon), F.col("epoch_s"))["elevation"]
    return frames.withColumn("__e", F.round(e, 1)).groupBy("clip_id", daypart_footage(F.col("__e")).alias("part")).agg(F.count("*").alias("frames"))


def luminance_histogram(frames: DataFrame, bins: int = 16) -> DataFrame:
    """Clip histogram and mean of sampled frame luminance (0..255)."""
    b = F.least(F.floor(F.col("luminance_mean") / 256.0 * bins), F.lit(bins - 1)).cast("bigint")
    return frames.groupBy("clip_id", b.alias("bin")).agg(F.count("*").alias("n"), F.sum("luminance_mean").alias("lum_sum"))


def entity_counts(boxes: DataFrame) -> DataFrame:
    """Instances and frames per clip, class and detection stream.  Frames are counted by a
    first aggregate, not a distinct.  ``boxes``: clip_id, stream, frame_index, cls."""
    f = boxes.groupBy("clip_id", "stream", "cls", "frame_index").agg(F.count("*").alias("i"))
    return f.groupBy("clip_id", "stream", "cls").agg(F.sum("i").alias("instances"), F.count("*").alias("frames"))


def clip_weather(clips: DataFrame, hourly: DataFrame) -> DataFrame:
    """Mean weather over the hours a clip covers: rain is summed, wind direction averaged on
    the circle.  Clips are expanded to their hours, so the join is on (day, hour)."""
    c = clips.withColumn("hour", F.explode(F.sequence("start_hour", "end_hour"))).select("clip_id", "day", "hour")
    r = F.radians("wind_dir")
    g = c.join(hourly, ["day", "hour"]).groupBy("clip_id").agg(
        F.round(F.avg("cloud_cover")).alias("cloud_cover_pct"), F.round(F.sum("precipitation"), 2).alias("precipitation_mm"),
        F.round(F.avg("wind_speed"), 1).alias("wind_speed_kmh"), F.sum(F.sin(r)).alias("__s"), F.sum(F.cos(r)).alias("__c"),
        F.round(F.avg("temperature"), 1).alias("temperature_c"))
    return g.withColumn("wind_dir_deg", F.round(F.pmod(F.degrees(F.atan2("__s", "__c")), F.lit(360.0)))).drop("__s", "__c")


def frame_sun(frames: DataFrame, samples: DataFrame, keys: list[str], max_age_s: float = 60.0) -> DataFrame:
    """Frames with the elevation of the nearest sun sample, null where none is within ``max_age_s``.
    ``samples``: keys, t_s (distinct), sun_elevation_deg; ``frames``: keys, t_s."""
    return nearest_asof(frames, samples, keys, t="t_s", payload=["sun_elevation_deg"], max_age=max_age_s).withColumnRenamed("asof_gap", "sun_gap_s")


# -- coverage -----------------------------------------------------------------

def hourly_frames(samples: DataFrame) -> DataFrame:
    """Frames per clock hour: each clip's frames are spread over its samples, rounded per
    clip and hour.  ``samples``: clip_id, hour, n_frames, n_samples."""
    g = samples.groupBy("clip_id", "hour").agg(F.floor(F.sum(F.col("n_frames") / F.col("n_samples")) + 0.5).alias("v"))
    return g.filter("v > 0").groupBy("hour").agg(F.sum("v").alias("frames"), F.count("*").alias("n_clips"))


def weather_bands(clips: DataFrame, key: str, edges: Sequence[float]) -> DataFrame:
    """Frames per band of a weather value."""
    d = clips.filter(F.col(key).isNotNull()).groupBy(band_of(F.col(key), edges).alias("band")).agg(F.sum("n_frames").alias("frames"), F.count("*").alias("n_clips"))
    return d.select(F.lit(key).alias("dimension"), "band", "frames", "n_clips")


def entity_coverage(entities: DataFrame, targets: Mapping[str, int] = TARGETS) -> DataFrame:
    """Instances per canonical class: the largest stream within a clip, summed over clips,
    with every targeted class present."""
    e = entities.withColumn("cls", canonical(F.col("cls")))
    per = e.groupBy("clip_id", "cls").agg(F.max("instances").alias("instances"), F.max_by("frames", F.struct("instances", "frames")).alias("frames"))
    tot = per.groupBy("cls").agg(F.sum("instances").alias("instances"), F.sum("frames").alias("frames"))
    t = F.array(*[F.struct(F.lit(k).alias("cls"), F.lit(int(v)).cast("bigint").alias("target")) for k, v in targets.items()])
    goal = entities.sparkSession.range(1).select(F.explode(t).alias("t")).select("t.*")
    j = tot.join(goal, "cls", "full_outer")
    zero = F.lit(0).cast("bigint")
    return j.select("cls", *[F.coalesce(c, zero).alias(c) for c in ("instances", "frames", "target")])


def hour_goal_gaps(hourly: DataFrame, goals: Mapping[int, float] = HOUR_GOALS) -> DataFrame:
    """Clock hours short of their goal."""
    t = F.array(*[F.struct(F.lit(h).cast("bigint").alias("hour"), F.lit(float(g)).alias("goal_h")) for h, g in goals.items()])
    base = hourly.sparkSession.range(1).select(F.explode(t).alias("t")).select("t.*")
    d = base.join(hourly.select("hour", "frames"), "hour", "left").withColumn("have_h", hours_of(F.coalesce("frames", F.lit(0))))
    sev = F.when(F.coalesce("frames", F.lit(0)) == 0, "serious").otherwise("warn")
    return d.filter("goal_h > have_h").select(F.lit("hour").alias("dimension"), F.col("hour").alias("item"), sev.alias("severity"), "have_h", "goal_h")


def band_goal_gaps(bands: DataFrame, dimension: str) -> DataFrame:
    """Weather bands short of their goal; nothing captured is serious."""
    goals, edges = BAND_HOURS[dimension], BANDS[dimension]
    t = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(float(g)).alias("goal_h")) for i, g in enumerate(goals[: len(edges) - 1])])
    base = bands.sparkSession.range(1).select(F.explode(t).alias("t")).select("t.*")
    n = F.coalesce("frames", F.lit(0))
    d = base.join(bands.filter(F.col("dimension") == dimension).select("band", "frames"), "band", "left").withColumn("have_h", hours_of(n))
    return d.filter("goal_h > 0 AND have_h < goal_h").select(F.lit(dimension).alias("dimension"), F.col("band").cast("bigint").alias("item"),
                                                             F.when(n == 0, "serious").otherwise("warn").alias("severity"), "have_h", "goal_h")


def heuristic_gaps(dayparts: DataFrame, weather: DataFrame, hist: DataFrame, entities: DataFrame, bins: int = 16) -> DataFrame:
    """(severity, item) coverage gaps from one-row summaries."""
    one = F.lit(1).alias("k")
    p = dayparts.agg(one.alias("k"), F.sum(F.when(F.col("part") == "night", F.col("frames")).otherwise(0)).alias("night"),
                     F.sum(F.when(F.col("part") == "twilight", F.col("frames")).otherwise(0)).alias("twilight"))
    w = weather.agg(one.alias("k"), F.count("*").alias("nw"), F.max("precipitation_mm").alias("rain"), F.max("wind_speed_kmh").alias("wind"), F.max("cloud_cover_pct").alias("cloud"))
    h = hist.agg(one.alias("k"), F.sum("n").alias("nh"), F.sum(F.when(F.col("bin") < bins // 4, F.col("n")).otherwise(0)).alias("dark"))
    j = p.join(w, "k").join(h, "k")

    def gap(cond: Column, sev: str, item: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(item).alias("item")))

    some = F.col("nw") > 0
    rows = F.array(
        gap(F.coalesce("night", F.lit(0)) == 0, "serious", "no night footage"), gap(F.coalesce("twilight", F.lit(0)) == 0, "warn", "no twilight footage"),
        gap(some & (F.col("rain") < 0.1), "serious", "no rain footage"), gap(some & (F.col("wind") < 20), "warn", "no strong wind footage"),
        gap(some & (F.col("cloud") < 80), "warn", "no overcast footage"), gap((F.col("nh") > 0) & (F.col("dark") == 0), "warn", "no low-luminance frames"))
    a = j.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("z")).select("z.*")
    sev = F.when(F.col("instances") == 0, "serious").when(F.col("instances") < F.col("target") / 2, "warn")
    b = entities.filter("target > 0").withColumn("severity", sev).filter("severity IS NOT NULL").select("severity", F.concat(F.lit("few "), "cls").alias("item"))
    return a.unionByName(b)


def clip_conditions(clips: DataFrame, dayparts: DataFrame) -> DataFrame:
    """(clip_id, condition) rows: parts of the day present, and weather and light bands."""
    p = dayparts.filter("frames > 0").select("clip_id", F.concat(F.lit("part:"), "part").alias("condition"))

    def tok(name, col):
        e = MATRIX_EDGES[name]
        i = band_of(F.col(col), e)
        return F.when(i.isNotNull(), F.concat(F.lit(f"{name}:"), i.cast("string")))

    toks = F.array(tok("cloud", "cloud_cover_pct"), tok("wind", "wind_speed_kmh"), tok("precip", "precipitation_mm"), tok("luma", "lum_mean"))
    w = clips.select("clip_id", F.explode(F.filter(toks, lambda x: x.isNotNull())).alias("condition"))
    return p.unionByName(w)


def all_conditions() -> list[str]:
    return [f"part:{p}" for p in ("night", "twilight", "golden", "day")] + [f"{n}:{i}" for n, e in MATRIX_EDGES.items() for i in range(len(e) - 1)]


def condition_matrix(entities: DataFrame, conditions: DataFrame) -> DataFrame:
    """Instances per class and condition; a gap is a class that exists somewhere but never
    under a condition that has footage.  Conditions are a fixed short list, so each
    class row is expanded by a generator."""
    e = entities.withColumn("cls", canonical(F.col("cls"))).groupBy("clip_id", "cls").agg(F.max("instances").alias("instances"))
    have = e.join(conditions, "clip_id").groupBy("cls", "condition").agg(F.sum("instances").alias("instances"))
    footage = conditions.groupBy("condition").agg(F.count("*").alias("clips"))
    classes = e.groupBy("cls").agg(F.sum("instances").alias("t")).filter("t > 0").select("cls", F.explode(F.array(*[F.lit(c) for c in all_conditions()])).alias("condition"))
    j = classes.join(have, ["cls", "condition"], "left").join(footage, "condition", "left")
    n = F.coalesce("instances", F.lit(0)).cast("bigint")
    return j.select("cls", "condition", n.alias("instances"), ((n == 0) & (F.coalesce("clips", F.lit(0)) > 0)).alias("gap"))
