"""Sector records: arrays per frame, heading recommendation, decisions, regridding."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.params import GRID, BinGrid

FRAME = ["clip_id", "frame_index"]


def to_records(bins: DataFrame, cols: dict[str, str], carry: dict[str, str] | None = None) -> DataFrame:
    """One row per frame with parallel arrays in bin order.  ``cols``: array name to
    column; ``carry``: frame-level columns."""
    item = F.struct("bin_index", *[F.col(c).alias(n) for n, c in cols.items()])
    g = bins.groupBy(*FRAME).agg(
        F.array_sort(F.collect_list(item)).alias("b"),
        *[F.first(c).alias(n) for n, c in (carry or {}).items()])
    return g.select(*FRAME, *(carry or {}), *[F.col("b")[n].alias(n) for n in cols])


def explode_records(records: DataFrame, arrays: list[str]) -> DataFrame:
    """Arrays back to one row per bin."""
    rest = [c for c in records.columns if c not in arrays]
    z = records.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("bin_index", "z"))
    return z.select(*rest, F.col("bin_index").cast("bigint").alias("bin_index"), *[F.col(f"z.{a}").alias(a) for a in arrays])


@dataclass(frozen=True)
class HeadingPolicy:
    # fixed values: cost weights and thresholds of the recommendation
    alert: float = 0.33
    blocked: float = 0.66
    range_eps: float = 0.5
    ttc_eps: float = 0.5
    range_scale: float = 5.0
    ttc_scale: float = 5.0
    sigma_deg: float = 12.0
    max_swing_deg: float = 30.0
    w_block: float = 1.0
    w_close: float = 0.3
    w_ttc: float = 0.6
    w_course: float = 0.2
    step_deg: float = 1.0
    tied_frac: float = 0.05
    tied_sep_deg: float = 30.0
    abstain: float = 0.3
    free_max_m: float = 15.0


def amplitudes(score: Column, rng: Column, ttc: Column, free: Column | None, hp: HeadingPolicy = HeadingPolicy()) -> Column:
    """struct(block, close, ttc): graded threat amplitudes of one bin."""
    low = 0.5 * (score - hp.alert) / max(hp.blocked - hp.alert, 1e-6)
    high = 0.5 + 0.5 * (score - hp.blocked) / max(1 - hp.blocked, 1e-6)
    block = F.when(score < hp.alert, 0.0).when(score < hp.blocked, low).otherwise(high)
    block = F.greatest(F.lit(0.0), F.least(block, F.lit(1.0)))
    if free is not None:
        fs = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - free / hp.free_max_m)), F.lit(0.0))
        block = F.greatest(block, fs)

    def near(x: Column, eps: float, scale: float) -> Column:
        v = scale / (F.greatest(x, F.lit(eps)) + scale)
        return F.when((score < hp.alert) | x.isNull(), 0.0).otherwise(v)

    return F.struct(block.alias("block"), near(rng, hp.range_eps, hp.range_scale).alias("close"),
                    near(ttc, hp.ttc_eps, hp.ttc_scale).alias("ttc"))


def recommend_heading(records: DataFrame, hp: HeadingPolicy = HeadingPolicy(), *, free: str | None = None,
                      course: Column | None = None) -> DataFrame:
    """Adds ``heading_deg`` (null when abstaining), ``heading_reason`` and ``best_cost``.

    ``records`` holds arrays ``centers, scores, min_range_m, ttc_s`` (and the free-space
    array).  Every candidate heading of a batch of records is costed with arrays, so nothing is
    shuffled.
    """
    zipped = F.arrays_zip("centers", "scores", "min_range_m", "ttc_s", *([free] if free else []))
    amps = F.transform(zipped, lambda b: F.struct(
        b["centers"].cast("double").alias("c"),
        amplitudes(b["scores"], b["min_range_m"], b["ttc_s"], b[free] if free else None, hp).alias("a")))
    ref = course if course is not None else F.lit(0.0)

    def costed(bins: pa.Array, course_deg: pa.Array) -> pa.Array:
        refs = course_deg.to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(bins), 0).to_numpy(zero_copy_only=False)
        heading, cost, reason = np.full(len(bins), np.nan), np.empty(len(bins)), np.empty(len(bins), object)
        for m in np.unique(size):
            same = np.flatnonzero(size == m)
            for at in np.split(same, range(HEADING_ROWS, len(same), HEADING_ROWS)):
                flat = bins.take(pa.array(at)).flatten()
                c = flat.field("c").to_numpy(zero_copy_only=False).astype(float).reshape(len(at), m)
                a = [flat.field("a").field(t).to_numpy(zero_copy_only=False).astype(float).reshape(len(at), m) for t in ("block", "close", "ttc")]
                heading[at], cost[at], reason[at] = _headings(c, a, refs[at].astype(float), hp)
        return pa.StructArray.from_arrays([pa.array(heading, from_pandas=True), pa.array(cost), pa.array(reason, pa.string())], ["th", "cost", "reason"])

    found = F.arrow_udf(costed, "th double, cost double, reason string")(amps, ref.cast("double"))
    d = records.withColumn("__best", found)
    d = d.withColumn("heading_reason", F.col("__best.reason")).withColumn("heading_deg", F.col("__best.th"))
    return d.withColumn("best_cost", F.col("__best.cost")).drop("__best")


#: records costed at a time
HEADING_ROWS = 1024


def _headings(c: np.ndarray, amps: list[np.ndarray], ref: np.ndarray, hp: HeadingPolicy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heading (NaN when abstaining), cost and reason of records with centres ``c`` and amplitudes
    (block, close, ttc), all records x bins."""
    if not c.shape[1]:
        # nothing is known of a record without bins: each term is at its most
        c, amps = np.full((len(c), 1), np.nan), [np.ones((len(c), 1))] * 3
    rows, m = c.shape
    lo, hi = c[:, 0], c[:, -1]
    n = np.nan_to_num(np.maximum(0, np.floor((hi - lo) / hp.step_deg + 0.5)))
    i = np.arange(int(n.max(initial=0)) + 1)
    th = lo[:, None] + i * hp.step_deg
    # centres are those of a grid: few different rows, whose kernel is worked out once
    grids, which = np.unique(c, axis=0, return_inverse=True)
    off = grids[:, :1] + i * hp.step_deg
    square = (-((off[:, :, None] - grids[:, None, :]) ** 2) / (2.0 * hp.sigma_deg ** 2)).ravel().tolist()
    kernel = np.array([math.exp(x) for x in square]).reshape(len(grids), len(i), m)[which.ravel()]
    # missing values: the least of one and nothing is one
    parts = [w * np.fmin((a[:, None, :] * kernel).max(2, initial=0.0), 1.0)
             for a, w in zip(amps, (hp.w_block, hp.w_close, hp.w_ttc))]
    parts.append(hp.w_course * np.fmin(np.abs(th - ref[:, None]) / hp.max_swing_deg, 1.0))
    cost = parts[0] + parts[1] + parts[2] + parts[3]
    cost[i > n[:, None]] = np.inf
    k, row = cost.argmin(1), np.arange(rows)
    best, at = cost[row, k], th[row, k]
    limit = np.where(best == 0, 1e-9, best * (1 + hp.tied_frac))
    flat = (best == 0) & ((cost == 0) | np.isinf(cost)).all(1)
    rival = ((i != k[:, None]) & (cost <= limit[:, None]) & (np.abs(th - at[:, None]) >= hp.tied_sep_deg)).any(1)
    b, close, ttc, course = (p[row, k] for p in parts)
    top = np.maximum(np.maximum(b, close), np.maximum(ttc, course))
    blocked, tied = (b >= hp.abstain) & (hp.abstain > 0), ~flat & rival
    reason = np.select([blocked, tied, best == 0, b == top, close == top, ttc == top], ["all_blocked", "ambiguous", "clear", "block", "close", "ttc"], "course")
    return np.where(blocked | tied, np.nan, at), best, reason.astype(object)


def decide(records: DataFrame, blocked: float = 0.66, alert: float = 0.33, hard_stop_m: float | None = 2.0) -> DataFrame:
    """Simple consumer policy over the arrays of a record."""
    z = F.arrays_zip("centers", "scores", "min_range_m", "closing_mps", "ttc_s")
    d = records.withColumn("__z", z)
    live = F.filter("__z", lambda b: b["scores"] >= alert)

    def nearest(field, name):
        cand = F.transform(F.filter(live, lambda b: b[field].isNotNull()),
                           lambda b: F.struct(b[field].alias("v"), b["centers"].alias("c")))
        m = F.array_min(cand)
        return [m["v"].alias(name), m["c"].alias(f"{name}_bin")]

    fast = F.array_min(F.transform(F.filter(live, lambda b: b["closing_mps"].isNotNull()),
                                   lambda b: F.struct((-b["closing_mps"]).alias("v"), b["centers"].alias("c"))))
    keep = [c for c in records.columns if c in FRAME + ["t_ms"]]
    out = d.select(
        *keep,
        F.transform(F.filter("__z", lambda b: b["scores"] >= blocked), lambda b: b["centers"]).alias("blocked_bins"),
        F.transform(F.filter("__z", lambda b: (b["scores"] >= alert) & (b["scores"] < blocked)), lambda b: b["centers"]).alias("alert_bins"),
        *nearest("min_range_m", "closest"), *nearest("ttc_s", "closest_ttc"),
        (-fast["v"]).alias("fastest_closing"), fast["c"].alias("fastest_bin"))
    stop = F.coalesce(F.col("closest") <= hard_stop_m, F.lit(False)) if hard_stop_m is not None else F.lit(False)
    return out.withColumn("hard_stop", stop)


def wrap_deg(a: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def absolute_heading(yaw: Column, steer: Column, sign: float = 1.0) -> Column:
    return wrap_deg(yaw + sign * steer)


def local_metric(lat: Column, lon: Column, lat0: Column, lon0: Column, heading_deg: Column) -> Column:
    """struct(east, north, right, ahead) in metres; right/ahead are bow-up."""
    # fixed value: metres per degree
    per_deg = 111320.0
    e = (lon - lon0) * per_deg * F.cos(F.radians(lat0))
    n = (lat - lat0) * per_deg
    h = F.radians(heading_deg)
    return F.struct(e.alias("east"), n.alias("north"), (e * F.cos(h) - n * F.sin(h)).alias("right"),
                    (e * F.sin(h) + n * F.cos(h)).alias("ahead"))


def pick_evidence(learned: Column, fused: Column, mode: str = "max") -> Column:
    """Per-bin evidence array: the larger of both, or learned before fused."""
    if mode == "max":
        both = F.zip_with(learned, fused, lambda a, b: F.greatest(a, b))
        return F.coalesce(F.when(learned.isNotNull() & fused.isNotNull(), both), learned, fused)
    return F.coalesce(learned, fused)


def sector_grid(width: float, grid: BinGrid = GRID) -> list[tuple[int, float, float]]:
    """Sectors of a width centred on the bow, clipped to the bin span."""
    w = min(max(5.0, width), grid.hi - grid.lo)
    top = math.ceil((grid.hi - w / 2) / w)
    spans = [(k, max(grid.lo, k * w - w / 2), min(grid.hi, k * w + w / 2)) for k in range(-top, top + 1)]
    return [s for s in spans if s[2] - s[1] >= 1e-6]


def regrid(bins: DataFrame, width: float, grid: BinGrid = GRID) -> DataFrame:
    """Conservative regrid: each sector takes the worst value of every bin it overlaps;
    a missing score counts as 0."""
    sectors = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                        for k, a, b in sector_grid(width, grid)])
    half = grid.step / 2
    lo, hi = F.col("bin_center_deg") - half, F.col("bin_center_deg") + half
    d = bins.withColumn("__s", F.explode(F.filter(sectors, lambda s: F.least(s["b"], hi) - F.greatest(s["a"], lo) > 1e-6)))
    return d.groupBy(*FRAME, F.col("__s.k").alias("sector"), ((F.col("__s.a") + F.col("__s.b")) / 2).alias("center_deg")).agg(
        *[F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("score", "p", "threat")],
        F.min("min_range_m").alias("min_range_m"), F.min("ttc_s").alias("ttc_s"), F.max("closing_mps").alias("closing_mps"),
        F.bool_or("confirmed").alias("confirmed"), F.max("hit_fisheye").alias("hit_fisheye"),
        F.max("hit_thermal").alias("hit_thermal"), F.max("hit_mmwave").alias("hit_mmwave"))
