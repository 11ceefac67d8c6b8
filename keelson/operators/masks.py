"""Segmentation tables: column profiles, runs and components to ranges and evidence.

Inputs are tables derived from masks: ``runs`` (frame, col, row0, row1, cls; 0 obstacle,
1 water, 2 sky) and per-column summaries.  Windows here run over the columns of one
frame, which the image width bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keelson.functions import geometry as G
from keelson.functions import motion as M
from keelson.params import FISHEYE, GRID, MAX_RANGE_M, THERMAL, BinGrid, Camera

FRAME = ["clip_id", "frame_index"]
DET = FRAME + ["det_id"]
OBSTACLE, WATER, SKY = 0, 1, 2


def class_fractions(runs: DataFrame) -> DataFrame:
    """Share of each class per frame over labelled pixels."""
    n = F.col("row1") - F.col("row0") + 1
    g = runs.groupBy(*FRAME).agg(*[F.sum(F.when(F.col("cls") == c, n).otherwise(0)).alias(f"n{c}") for c in (0, 1, 2)])
    tot = F.col("n0") + F.col("n1") + F.col("n2")
    return g.select(*FRAME, *[(F.col(f"n{c}") / tot).alias(name) for c, name in ((0, "obstacle_frac"), (1, "water_frac"), (2, "sky_frac"))])


def column_profile(runs: DataFrame, height: int) -> DataFrame:
    """Per column: top water row, water run from the bottom, obstacle pixels."""
    w = F.col("cls") == WATER
    return runs.groupBy(*FRAME, "col").agg(
        F.min(F.when(w, F.col("row0"))).alias("top_water_row"),
        F.coalesce(F.max(F.when(w & (F.col("row1") == height - 1), F.col("row1") - F.col("row0") + 1)), F.lit(0)).alias("bottom_run"),
        F.sum(F.when(F.col("cls") == OBSTACLE, F.col("row1") - F.col("row0") + 1).otherwise(0)).alias("obstacle_px"))


def _line(pts, prefix: str) -> dict:
    """Least-squares line through an array of points (x, y), as columns."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy")])
    sums = F.aggregate(pts, zero, lambda s, p: F.struct(
        (s["n"] + 1.0).alias("n"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"),
        (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["xy"] + p["x"] * p["y"]).alias("xy")))
    return {f"{prefix}m": sums}


def _slope(m):
    den = m["n"] * m["xx"] - m["x"] * m["x"]
    return F.when(den != 0, (m["n"] * m["xy"] - m["x"] * m["y"]) / den)


def _rms(pts, slope, intercept):
    ss = F.aggregate(pts, F.lit(0.0), lambda s, p: s + F.pow(p["y"] - slope * p["x"] - intercept, 2))
    return F.sqrt(ss / F.size(pts))


def water_edge(cols: DataFrame, height: int, min_share: float = 0.3, sigma: float = 2.0) -> DataFrame:
    """Line through the top water rows with one trimmed refit; confidence is coverage
    times straightness, 0 when too few columns hold water.  The image width bounds a
    frame's columns, so each frame is fitted inside one row: a single shuffle."""
    pt = F.when(F.col("top_water_row").isNotNull(), F.struct(F.col("col").cast("double").alias("x"), F.col("top_water_row").cast("double").alias("y")))
    d = cols.groupBy(*FRAME).agg(F.count("*").alias("w"), F.collect_list(pt).alias("pts")).withColumn("nv", F.size("pts"))
    d = d.withColumns(_line(F.col("pts"), "a"))
    d = d.withColumn("s1", _slope(F.col("am"))).withColumn("b1", (F.col("am.y") - F.col("s1") * F.col("am.x")) / F.col("nv"))
    # residual spread around the first line (its mean is zero)
    d = d.withColumn("sd", _rms(F.col("pts"), F.col("s1"), F.col("b1")))
    spread = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    d = d.withColumn("kept", F.filter("pts", lambda p: F.abs(p["y"] - F.col("s1") * p["x"] - F.col("b1")) < sigma * spread))
    refit = (F.size("kept") >= 2) & (F.size("kept") < F.col("nv"))
    d = d.withColumn("used", F.when(refit, F.col("kept")).otherwise(F.col("pts"))).withColumns(_line(F.col("used"), "u"))
    d = d.withColumn("s2", _slope(F.col("um"))).withColumn("b2", (F.col("um.y") - F.col("s2") * F.col("um.x")) / F.size("used"))
    few = F.col("nv") < F.greatest(F.lit(2), F.floor(F.lit(min_share) * F.col("w")))
    conf = F.col("nv") / F.col("w") / (1.0 + _rms(F.col("used"), F.col("s2"), F.col("b2")) / max(1.0, 0.02 * height))
    return d.select(*FRAME, F.when(few, 0.0).otherwise(F.col("s2")).alias("slope"), F.when(few, 0.0).otherwise(F.col("b2")).alias("intercept"),
                    F.when(few, 0.0).otherwise(conf).alias("conf"))


def free_space(cols: DataFrame, ups: DataFrame | None = None, cam: Camera = FISHEYE, grid: BinGrid = GRID,
               max_range_m: float = MAX_RANGE_M) -> DataFrame:
    """Per bin: nearest end of the water run from the bottom edge; a column without near
    water blocks its bin at 0 m; open bins are null.  ``ups``: frame, up."""
    c = cols if ups is None else cols.join(ups, FRAME)
    upv = G.up_level() if ups is None else F.col("up")
    run, h = F.col("bottom_run"), cam.height
    d = G.water_range(F.col("col").cast("double"), (h - run).cast("double"), cam, upv, max_range_m)
    dist = F.when(run == 0, 0.0).when(run >= h, None).otherwise(d)
    b = M.bin_of(G.bearing_linear(F.col("col"), cam), grid)
    return c.withColumn("bin_index", b).filter("bin_index IS NOT NULL").groupBy(*FRAME, "bin_index").agg(
        F.min(dist).alias("free_space_m"), F.bool_or(run == 0).alias("free_space_blocked"))


def mask_bins(cols: DataFrame, comps: DataFrame, cam: Camera = FISHEYE, grid: BinGrid = GRID) -> DataFrame:
    """Obstacle share of each bin's column band, components per bin and the largest."""
    bands = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), G.column_band(F.lit(grid.lo + i * grid.step), F.lit(grid.lo + (i + 1) * grid.step), cam).alias("b"))
                      for i in range(grid.n)])
    c = cols.withColumn("__b", F.explode(F.filter(bands, lambda s: (F.col("col") >= s["b"]["u0"]) & (F.col("col") < s["b"]["u1"]))))
    frac = c.groupBy(*FRAME, F.col("__b.i").alias("bin_index")).agg((F.sum("obstacle_px") / F.sum(F.lit(float(cam.height)))).alias("seg_obstacle_frac"))
    k = comps.withColumn("bin_index", M.bin_of(G.bearing_pinhole(F.col("cx"), cam), grid)).filter("bin_index IS NOT NULL")
    k = k.groupBy(*FRAME, "bin_index").agg(F.count("*").alias("n"), F.max("size_px").alias("seg_comp_max_size_px"))
    frames = cols.select(*FRAME).distinct().withColumn("bin_index", M.all_bins(grid))
    return frames.join(frac, FRAME + ["bin_index"], "left").join(k, FRAME + ["bin_index"], "left").select(
        *FRAME, "bin_index", "seg_obstacle_frac", F.coalesce("n", F.lit(0)).cast("bigint").alias("seg_comp_count"), "seg_comp_max_size_px")


def _box_runs(dets: DataFrame, runs: DataFrame, pad: int, cell: int = 64) -> DataFrame:
    """Runs in the columns of each detection box (integer window c0..c1, w0..w1)."""
    d = dets.withColumn("__k", F.explode(F.sequence(F.floor(F.col("c0") / cell), F.floor(F.col("c1") / cell))))
    r = runs.withColumn("__k", F.floor(F.col("col") / cell))
    return d.join(r, FRAME + ["__k"]).filter(F.col("col").between(F.col("c0"), F.col("c1"))).drop("__k")


def waterline_contact(dets: DataFrame, runs: DataFrame, cam: Camera = FISHEYE, *, pad_px: int = 40, below_px: int = 3,
                      min_columns: int = 5, pct: float = 0.8) -> DataFrame:
    """Contact pixel of each detection: per column the deepest obstacle row with water at
    most ``below_px`` beneath it inside the padded box; high percentile of rows, median
    of columns."""
    h, w = cam.height, cam.width
    r = F.col("size") / 2.0
    d = dets.select(
        *DET, F.greatest(F.lit(0), F.floor(F.col("u") - r)).alias("c0"), F.least(F.lit(w - 1), F.ceil(F.col("u") + r)).alias("c1"),
        F.greatest(F.lit(0), F.floor(F.col("v") - r) - pad_px).alias("w0"), F.least(F.lit(h - 1), F.ceil(F.col("v") + r) + pad_px).alias("w1"))
    d = d.filter("c1 >= c0 AND w1 > w0")
    hit = _box_runs(d, runs, pad_px)
    obs = hit.filter(F.col("cls") == OBSTACLE).select(*DET, "col", "w0", "w1", F.col("row0").alias("a"), F.col("row1").alias("b"))
    wat = hit.filter(F.col("cls") == WATER).select(*DET, "col", F.col("row0").alias("c"), F.col("row1").alias("d"))
    j = obs.join(wat, DET + ["col"])
    row = F.least(F.col("b"), F.least("d", "w1") - 1)
    ok = (row >= F.greatest(F.col("a"), F.col("w0"), F.col("c") - below_px)) & (F.col("c") <= F.col("w1"))
    deep = j.filter(ok).groupBy(*DET, "col").agg(F.max(row).alias("row"))
    g = deep.groupBy(*DET).agg(F.count("*").alias("n"), F.percentile("row", pct).alias("contact_v"), F.median("col").alias("contact_u"))
    return g.filter(F.col("n") >= min_columns).select(*DET, "contact_u", "contact_v")


def obstacle_share(dets: DataFrame, runs: DataFrame, cam: Camera = FISHEYE) -> DataFrame:
    """Share of obstacle pixels inside each detection box."""
    r = F.col("size") / 2.0
    d = dets.select(
        *DET, F.greatest(F.lit(0), F.floor(F.col("u") - r)).alias("c0"), (F.least(F.lit(cam.width), F.ceil(F.col("u") + r)) - 1).alias("c1"),
        F.greatest(F.lit(0), F.floor(F.col("v") - r)).alias("w0"), (F.least(F.lit(cam.height), F.ceil(F.col("v") + r)) - 1).alias("w1"))
    hit = _box_runs(d.filter("c1 >= c0 AND w1 >= w0"), runs.filter(F.col("cls") == OBSTACLE), 0)
    px = F.greatest(F.lit(0), F.least("row1", "w1") - F.greatest("row0", "w0") + 1)
    g = hit.groupBy(*DET).agg(F.sum(px).alias("px"))
    area = (F.col("c1") - F.col("c0") + 1) * (F.col("w1") - F.col("w0") + 1)
    share = F.when((F.col("c1") >= F.col("c0")) & (F.col("w1") >= F.col("w0")), F.coalesce("px", F.lit(0)) / area).otherwise(0.0)
    return d.join(g, DET, "left").select(*DET, share.alias("obstacle_frac"))


def drop_glints(dets: DataFrame, runs: DataFrame, min_share: float = 0.1) -> DataFrame:
    good = obstacle_share(dets, runs).filter(F.col("obstacle_frac") >= min_share)
    return dets.join(good.select(*DET), DET, "left_semi")


def frame_levels(hist: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Mean, spread and exact linear percentiles from a level histogram (256 levels bound
    each frame's window)."""
    w = W.partitionBy(*FRAME)
    h = hist.withColumn("cum", F.sum("n").over(w.orderBy("level").rowsBetween(W.unboundedPreceding, 0))).withColumn("tot", F.sum("n").over(w))
    aggs = []
    for name, q in quantiles.items():
        pos = (F.col("tot") - 1) * F.lit(q)
        lo = F.min(F.when(F.col("cum") > F.floor(pos), F.col("level")))
        hi = F.min(F.when(F.col("cum") > F.ceil(pos), F.col("level")))
        aggs.append((lo + (hi - lo) * (F.max(pos) - F.floor(F.max(pos)))).alias(name))
    m = F.sum(F.col("n") * F.col("level")) / F.max("tot")
    var = F.sum(F.col("n") * F.col("level") * F.col("level")) / F.max("tot") - m * m
    return h.groupBy(*FRAME).agg(m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("std"), *aggs)


def frame_flags(levels: DataFrame, dark_below: float = 25.0, std_min: float = 25.0, range_min: float = 120.0) -> DataFrame:
    """Darkness gate and thermal contrast guard."""
    dyn = F.col("p99") - F.col("p01")
    return levels.withColumns({"is_dark": F.col("mean") < dark_below, "dyn_range": dyn,
                               "quality_low": (F.col("std") < std_min) | (dyn < range_min)})


def intrusions(runs: DataFrame, edges: DataFrame, cam: Camera = THERMAL, *, margin: float = 1.0, min_depth: int = 2,
               min_width: int = 2, height: int | None = None, native_width: int | None = None) -> DataFrame:
    """Bearing intervals where obstacles reach below the water edge: stretches of deep
    columns (one shallow column inside is bridged) at least ``min_width`` wide."""
    h = height or cam.height
    edge = F.when(F.col("conf") > 0, F.col("slope") * F.col("col") + F.col("intercept") + margin).otherwise(F.lit(h * 0.5))
    o = runs.filter(F.col("cls") == OBSTACLE).join(edges, FRAME)
    dep = F.greatest(F.lit(0), F.col("row1") - F.greatest(F.col("row0"), F.ceil(edge)) + 1)
    c = o.groupBy(*FRAME, "col").agg(F.sum(dep).alias("depth"))
    w = W.partitionBy(*FRAME).orderBy("col")
    deep = F.when(F.col("depth") >= min_depth, F.col("col"))
    c = c.withColumn("pa", F.last(deep, True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn(
        "na", F.first(deep, True).over(w.rowsBetween(1, W.unboundedFollowing)))
    act = F.col("depth") >= min_depth
    bridge = ~act & (F.col("pa") == F.col("col") - 1) & (F.col("na") == F.col("col") + 1)
    c = c.filter(act | F.coalesce(bridge, F.lit(False)))
    new = F.when(F.col("pa").isNull() | (F.col("col") - F.col("pa") > 2), 1).otherwise(0)
    c = c.withColumn("run", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = c.groupBy(*FRAME, "run").agg(F.min("col").alias("x0"), (F.max("col") + 1).alias("x1"), F.sum("depth").alias("depth"))
    sx = (native_width or cam.width) / cam.width
    return g.filter(F.col("x1") - F.col("x0") >= min_width).select(
        *FRAME, ((F.col("x0") * sx - cam.lin_cx) / cam.px_per_deg).alias("lo_deg"), ((F.col("x1") * sx - cam.lin_cx) / cam.px_per_deg).alias("hi_deg"), "depth")


def component_intervals(comps: DataFrame, cam: Camera = THERMAL, min_area: int = 4) -> DataFrame:
    """Bearing intervals of obstacle components."""
    return comps.filter(F.col("area") >= min_area).select(
        *FRAME, ((F.col("x") - cam.lin_cx) / cam.px_per_deg).alias("lo_deg"),
        ((F.col("x") + F.col("w") - cam.lin_cx) / cam.px_per_deg).alias("hi_deg"), "area")
