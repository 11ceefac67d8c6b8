"""Per-bin state over time: confirmation, persistence, averages, flicker measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keelson.plans.ordered import SLICE, haloed, linear_recurrence, scan, time_slices

BIN = ["clip_id", "bin_index"]
POS = "frame_index"
SLICE_FRAMES = 1000


def _sliced(df: DataFrame) -> DataFrame:
    return time_slices(df, POS, SLICE_FRAMES)


def confirm_sectors(bins: DataFrame, hit: str = "hit", min_hits: int = 3, max_age: int = 5) -> DataFrame:
    """Confirmation gate per bin: an island of hits ends after ``max_age`` misses; a bin
    is confirmed from the ``min_hits``-th hit of its island until ``max_age`` misses."""
    h, pos = F.col(hit).cast("boolean"), F.col(POS)
    d = scan(_sliced(bins), BIN, [POS], fill={"__last": F.when(h, pos)}, run_sum={"__n": h.cast("bigint")})
    d = scan(d, BIN, [POS], lag={"__before": F.col("__last")})
    first = h & (F.col("__before").isNull() | (pos - F.col("__before") - 1 >= max_age))
    d = scan(d, BIN, [POS], fill={"__base": F.when(first, F.col("__n") - 1)})
    live = (F.col("__n") - F.col("__base") >= min_hits) & (pos - F.col("__last") < max_age)
    return d.withColumn("confirmed", F.coalesce(live, F.lit(False))).drop("__last", "__n", "__before", "__base", SLICE)


def gated_score(score, confirmed):
    return F.when(confirmed, score).otherwise(F.lit(0.0))


def smooth_heading(frames: DataFrame, heading: str = "heading_deg", window: int = 9, min_samples: int = 3) -> DataFrame:
    """Mean of the last ``window`` known headings once ``min_samples`` were seen; frames
    without a heading keep the last value."""
    h = F.col(heading)
    d = scan(_sliced(frames), ["clip_id"], [POS], run_sum={"__r": h.isNotNull().cast("bigint")}).drop(SLICE)
    known = haloed(d.filter(h.isNotNull()).select("clip_id", POS, "__r", heading), "__r", SLICE_FRAMES, before=window - 1)
    w = W.partitionBy("clip_id", SLICE).orderBy("__r").rowsBetween(-(window - 1), 0)
    known = known.withColumn("__m", F.avg(heading).over(w)).filter("__own").select(
        "clip_id", POS, F.when(F.col("__r") >= min_samples, F.col("__m")).alias("__m"))
    out = scan(_sliced(d.join(known, ["clip_id", POS], "left")), ["clip_id"], [POS], fill={"smoothed_heading_deg": F.col("__m")})
    return out.drop("__r", "__m", SLICE)


def steps(bins: DataFrame, t: str = "t_s", gap_s: float = 5.0) -> DataFrame:
    """Adds ``dt`` (null at a stream start, a backward step or a gap) and ``seg``, the
    number of the unbroken stretch.  Rows that already carry both pass through."""
    if {"dt", "seg"} <= set(bins.columns):
        return _sliced(bins)
    d = scan(_sliced(bins), BIN, [POS], lag={"__pt": F.col(t)})
    dt = F.col(t) - F.col("__pt")
    d = d.withColumn("dt", F.when((dt > 0) & (dt <= gap_s), dt)).drop("__pt")
    return scan(d, BIN, [POS], run_sum={"seg": F.col("dt").isNull().cast("bigint")})


def _with_previous(bins: DataFrame, p: str, t: str) -> DataFrame:
    return scan(steps(bins, t), BIN + ["seg"], [POS], lag={"__pp": F.col(p)})


def persist_score(bins: DataFrame, p: str = "p", t: str = "t_s", tau: float = 2.0, gap_s: float = 5.0,
                  out: str = "p_smooth") -> DataFrame:
    """max(p, decayed previous): a running maximum of ln p + t/tau per stretch."""
    d = steps(bins, t, gap_s)
    d = scan(d, BIN + ["seg"], [POS], run_max={"__m": F.when(F.col(p) > 0, F.ln(p)) + F.col(t) / F.lit(tau)})
    y = F.coalesce(F.exp(F.col("__m") - F.col(t) / F.lit(tau)), F.lit(0.0))
    return d.withColumn(out, F.greatest(y, F.col(p))).drop("__m", SLICE)


def ema_score(bins: DataFrame, p: str = "p", t: str = "t_s", tau: float = 2.0, gap_s: float = 5.0,
              out: str = "p_ema") -> DataFrame:
    """Exponential average with time constant ``tau`` and the same restarts."""
    d = steps(bins, t, gap_s).drop(SLICE)
    k = F.coalesce(F.exp(-F.col("dt") / F.lit(tau)), F.lit(0.0))
    return linear_recurrence(d, BIN, POS, k, (F.lit(1.0) - k) * F.col(p), out)


def smooth_free_space(bins: DataFrame, free: str = "free_m", alpha: float = 0.5, cap: float = 15.0) -> DataFrame:
    """Average of free distance; unknown counts as the cap and an average at the cap is
    reported as open (null)."""
    v = F.coalesce(F.col(free), F.lit(cap))
    d = scan(_sliced(bins), BIN, [POS], lag={"__p": F.lit(1)})
    start = F.col("__p").isNull()
    a = F.when(start, 0.0).otherwise(1.0 - alpha)
    b = F.when(start, v).otherwise(v * alpha)
    d = linear_recurrence(d.drop(SLICE), BIN, POS, a, b, "__y")
    return d.withColumn("free_smooth_m", F.when(F.col("__y") < 0.999 * cap, F.col("__y"))).drop("__y", "__p")


def flicker(bins: DataFrame, p: str = "p", t: str = "t_s") -> DataFrame:
    """Mean absolute step of the score per clip."""
    d = _with_previous(bins, p, t)
    return d.groupBy("clip_id").agg(
        F.coalesce(F.avg(F.when(F.col("dt").isNotNull(), F.abs(F.col(p) - F.col("__pp")))), F.lit(0.0)).alias("flicker"))


def onsets(bins: DataFrame, thr: float, p: str = "p", smooth: str = "p_smooth", t: str = "t_s") -> DataFrame:
    """Upward crossings (a stretch that starts above counts) and those where the smoothed
    score is still below."""
    d = _with_previous(bins, p, t)
    on = (F.col(p) >= thr) & (F.col("dt").isNull() | (F.col("__pp") < thr))
    return d.groupBy("clip_id").agg(F.count_if(on).alias("onsets"), F.count_if(on & (F.col(smooth) < thr)).alias("delayed"))


def dropouts(bins: DataFrame, thr: float, max_len: int = 2, p: str = "p", t: str = "t_s") -> DataFrame:
    """Dips of at most ``max_len`` frames between frames above, inside one stretch."""
    d = steps(bins, t)
    up = F.col(p) >= thr
    d = scan(d, BIN + ["seg"], [POS], fill={"__u": F.when(up, F.col(POS))})
    d = scan(d, BIN + ["seg"], [POS], lag={"__pu": F.col("__u")})
    gap = F.col(POS) - F.col("__pu") - 1
    return d.groupBy("clip_id").agg(F.count_if(up & (gap >= 1) & (gap <= max_len)).alias("dropouts"))


def decay_tail(bins: DataFrame, thr: float = 0.5, p: str = "p", smooth: str = "p_smooth", t: str = "t_s") -> DataFrame:
    """Mean number of extra frames the smoothed score holds after the raw one fell."""
    d = steps(bins, t).withColumn("__h", (F.col(p) < thr) & (F.col(smooth) >= thr))
    d = scan(d, BIN + ["seg"], [POS], lag={"__ph": F.col("__h")})
    new = F.when(F.col("__ph").isNull() | (F.col("__ph") != F.col("__h")), 1).otherwise(0)
    d = scan(d.withColumn("__n", new), BIN + ["seg"], [POS], run_sum={"__run": F.col("__n")})
    runs = d.filter("__h").groupBy(*BIN, "seg", "__run").count()
    return runs.groupBy("clip_id").agg(F.avg("count").alias("mean_tail"), F.count("*").alias("n_tails"))
