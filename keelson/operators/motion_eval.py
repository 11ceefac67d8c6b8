"""Motion ground truth: windows, target choice, radial truth, confusion, identity honesty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keelson.operators.evaluate import ratio
from keelson.plans.ordered import SLICE, haloed, scan, time_slices
from keelson.plans.quantiles import with_quantiles

FRAME = ["clip_id", "frame_index"]
STATES = ("closing", "crossing", "diverging", "static", "unknown")


def window_of_frame(frames: DataFrame, windows: DataFrame, bucket_s: float = 10.0) -> DataFrame:
    """The first window that contains each frame's time (both ends included); frames outside
    every window drop.  Windows are expanded over time buckets for an equal-key join."""
    def bk(c):
        return F.floor(c / bucket_s).cast("bigint")

    w = windows.withColumn("__k", F.explode(F.sequence(bk(F.col("t0_s")), bk(F.col("t1_s")))))
    j = frames.withColumn("__k", bk(F.col("t_s"))).join(w, ["clip_id", "__k"]).filter(F.col("t_s").between(F.col("t0_s"), F.col("t1_s")))
    z = F.struct("t_s", "window_no", "state", "bearing_min", "bearing_max")
    return j.groupBy(*FRAME).agg(F.min_by(z, "window_no").alias("z")).select(*FRAME, "z.*")


def pick_targets(windowed: DataFrame, targets: DataFrame) -> DataFrame:
    """Nearest reported target inside the window's bearing span; none is kept as null."""
    t = windowed.join(targets, FRAME, "left")
    ok = (F.col("track_id").isNotNull() & (F.col("bearing_min").isNull() | (F.col("bearing_deg") >= F.col("bearing_min")))
          & (F.col("bearing_max").isNull() | (F.col("bearing_deg") <= F.col("bearing_max"))))
    rest = [c for c in targets.columns if c not in FRAME]
    g = t.groupBy(*FRAME, "t_s", "state").agg(F.min_by(F.struct(*rest), F.when(ok, F.struct("range_m", "track_id"))).alias("z"))
    return g.select(*FRAME, "t_s", "state", *[F.col(f"z.{c}").alias(c) for c in rest])


def dominant_target(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """The target with most cluster points per frame (whole-scene truth)."""
    rest = [c for c in targets.columns if c not in FRAME]
    g = targets.groupBy(*FRAME).agg(F.max_by(F.struct(*rest), F.struct("n_points", -F.col("track_id"))).alias("z"))
    return frames.join(g, FRAME, "left").select(*frames.columns, *[F.col(f"z.{c}").alias(c) for c in rest if c not in frames.columns])


def radial_truth(frames: DataFrame, window_ms: int = 2000, slope_min: float = 0.1, guard_ms: int = 1000, slice_ms: float = 60_000) -> DataFrame:
    """Closing / diverging / static from the slope of the median range over a centred
    window (five samples at least); frames near a change of state are blank.
    ``frames``: clip_id, frame_index, t_ms, median_range_m."""
    half = window_ms // 2
    h = haloed(frames, "t_ms", slice_ms, before=half, after=half)
    w = W.partitionBy("clip_id", SLICE).orderBy("t_ms").rangeBetween(-half, half)
    x, y = F.col("t_ms") / 1000.0, F.col("median_range_m")
    d = h.withColumn("__n", F.count(y).over(w)).withColumn("__s", F.regr_slope(y, x).over(w)).filter("__own")
    s = F.when((F.col("__n") < 5) | F.col("__s").isNull(), None).when(F.col("__s") <= -slope_min, "closing").when(F.col("__s") >= slope_min, "diverging").otherwise("static")
    d = d.select(*frames.columns, s.alias("raw_state"))
    if guard_ms <= 0:
        return d.withColumn("state", F.col("raw_state"))
    g = haloed(d, "t_ms", slice_ms, before=guard_ms, after=guard_ms)
    wg = W.partitionBy("clip_id", SLICE).orderBy("t_ms").rangeBetween(-guard_ms, guard_ms)
    g = g.withColumn("__lo", F.min("raw_state").over(wg)).withColumn("__hi", F.max("raw_state").over(wg)).filter("__own")
    return g.select(*frames.columns, "raw_state", F.when(F.col("__lo") == F.col("__hi"), F.col("raw_state")).alias("state"))


def confusion(scored: DataFrame) -> DataFrame:
    """Truth by predicted counts, dense.  ``scored``: truth, predicted (null: missed)."""
    return scored.filter("truth IS NOT NULL").groupBy("truth").agg(
        F.count_if(F.col("predicted").isNull()).alias("missed"), *[F.count_if(F.col("predicted") == s).alias(s) for s in STATES])


def state_scores(scored: DataFrame) -> DataFrame:
    """Precision and recall per state."""
    s = scored.filter("truth IS NOT NULL AND predicted IS NOT NULL")
    e = s.withColumn("state", F.explode(F.array_distinct(F.array("truth", "predicted"))))
    t, p = F.col("truth") == F.col("state"), F.col("predicted") == F.col("state")
    g = e.groupBy("state").agg(F.count_if(t & p).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return g.select("state", "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def tangential_spread(scored: DataFrame) -> DataFrame:
    """|tangential speed| percentiles over radial and crossing truth."""
    v = F.abs("v_tangential_mps")
    rad = F.when(F.col("truth").isin("static", "closing", "diverging"), v)
    crs = F.when(F.col("truth") == "crossing", v)
    g = scored.agg(F.count(rad).alias("n_radial"), F.count(crs).alias("n_crossing"))
    return with_quantiles(g, scored, [], {"radial_p50": (rad, 0.5), "radial_p95": (rad, 0.95), "crossing_p50": (crs, 0.5)})


def detrended_correlation(df: DataFrame, keys: list[str], t: str, a: str, b: str, min_n: int = 8) -> DataFrame:
    """Correlation of two series after removing their straight lines in time: a closed form
    of the pairwise correlations."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(a, b).alias("ab"), F.corr(t, a).alias("ta"), F.corr(t, b).alias("tb"))
    r = (F.col("ab") - F.col("ta") * F.col("tb")) / F.sqrt((1 - F.col("ta") * F.col("ta")) * (1 - F.col("tb") * F.col("tb")))
    return g.select(*keys, "n", F.when(F.col("n") >= min_n, r).alias("r"))


def switches(df: DataFrame, keys: list[str], pos: str, ident: str, slice_len: float = 1000) -> DataFrame:
    """Observations whose identity differs from the observation before."""
    d = scan(time_slices(df.filter(F.col(ident).isNotNull()), pos, slice_len), keys, [pos], lag={"__p": F.col(ident)})
    return d.groupBy(*keys).agg(F.count("*").alias("observations"), F.count_if(F.col("__p").isNotNull() & (F.col("__p") != F.col(ident))).alias("switches"))
