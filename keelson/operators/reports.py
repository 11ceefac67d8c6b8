"""Evaluation reports: ranges, association, clutter, bearing ground truth, handover,
trials, service timing, sweeps, attitude mapping."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import motion as M
from keelson.operators import evaluate as E
from keelson.operators.sectors import wrap_deg
from keelson.params import GRID, THERMAL, BinGrid
from keelson.plans.ordered import SLICE, nearest_asof, scan, time_slices
from keelson.plans.quantiles import exact_quantiles, with_quantiles
from keelson.session import cut_lineage

FRAME = ["clip_id", "frame_index"]
DOPPLER_BIN = 0.1217


# -- ranges -------------------------------------------------------------------

def range_errors(df: DataFrame, keys: Sequence[str], measured: str, truth: str) -> DataFrame:
    """n, median |relative|, mean signed, share within 20 %."""
    e = (F.col(measured) - F.col(truth)) / F.col(truth)
    d = df.filter(F.col(measured).isNotNull() & (F.col(truth) > 0)).withColumn("__e", e)
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__e").alias("mean_signed_rel"), F.avg((F.abs("__e") <= 0.2).cast("double")).alias("within_20pct"))
    return with_quantiles(g, d, keys, {"median_abs_rel": (F.abs("__e"), 0.5)}).select(*keys, "n", "median_abs_rel", "mean_signed_rel", "within_20pct")


def range_change(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Range A/B of the same detections: pairs, changed, mean/median change, share farther."""
    d = df.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).withColumn("__d", F.col(after) - F.col(before))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.abs("__d") > 1e-9).alias("changed"), F.avg("__d").alias("mean_delta_m"), F.avg((F.col("__d") > 0).cast("double")).alias("share_farther"))
    return with_quantiles(g, d, keys, {"median_delta_m": (F.col("__d"), 0.5)}).select(*keys, "n", "changed", "mean_delta_m", "median_delta_m", "share_farther")


def spread(c: Column, name: str) -> dict[str, tuple[Column, float]]:
    return {f"{name}_median": (c, 0.5), f"{name}_p5": (c, 0.05), f"{name}_p95": (c, 0.95)}


def association_report(dets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections, matches, bearing residual and mono-versus-radar error."""
    hit = F.col("radar_range_m").isNotNull()
    res = F.when(hit, F.col("angle_deg") - F.col("radar_bearing_deg"))
    rel = F.when(hit & F.col("mono_range_m").isNotNull(), (F.col("mono_range_m") - F.col("radar_range_m")) / F.col("radar_range_m"))
    g = dets.groupBy(*keys).agg(F.count("*").alias("n_det"), F.count_if(hit).alias("n_matched"), F.avg(res).alias("resid_mean"), F.avg(rel).alias("rel_mean"), F.avg((F.abs(rel) <= 0.2).cast("double")).alias("within_20pct"))
    figures = [f"{n}_{q}" for n in ("resid", "rel") for q in ("median", "mean", "p5", "p95")]
    return with_quantiles(g, dets, keys, spread(res, "resid") | spread(rel, "rel")).select(*keys, "n_det", "n_matched", *figures, "within_20pct")


def gate_report(dets: DataFrame, keys: Sequence[str], near: tuple[float, float] = (1.0, 8.0)) -> DataFrame:
    """Box-versus-instance A/B of one pass: gated, matched, ranged, rejected, vetoed, near."""
    rr, hits = F.col("radar_range_m"), F.col("radar_hits")
    g = dets.groupBy(*keys).agg(
        F.count("*").alias("n_det"), F.count_if(hits > 0).alias("n_matched"), F.count_if(rr.isNotNull()).alias("n_radar_ranged"),
        F.count_if(rr.isNull() & (hits > 0)).alias("n_compat_rejected"),
        F.count_if(F.col("range_m").isNull() & rr.isNull() & (hits == 0) & F.col("mono_range_m").between(*near)).alias("n_vetoed"),
        F.count_if(F.col("range_m") < 3.0).alias("n_near"))
    return with_quantiles(g, dets, keys, {"median_radar_m": (rr, 0.5)})


def margin_sweep(points: DataFrame, margins: Sequence[float]) -> DataFrame:
    """Share of on-object and foreground returns kept per polygon margin: one aggregate
    per margin in a single pass.  ``sd``: signed pixel distance; ``own``: on the object."""
    own = F.col("own")
    g = points.agg(F.count_if(own).alias("no"), F.count_if(~own).alias("nf"), *[
        x for i, m in enumerate(margins) for x in (F.count_if(own & (F.col("sd") >= -m)).alias(f"o{i}"), F.count_if(~own & (F.col("sd") >= -m)).alias(f"f{i}"))])
    rows = F.array(*[F.struct(F.lit(float(m)).alias("margin_px"), (F.col(f"o{i}") / F.col("no")).alias("own_kept"), (F.col(f"f{i}") / F.col("nf")).alias("foreground_kept"))
                     for i, m in enumerate(margins)])
    return g.select(F.explode(rows).alias("z")).select("z.*")


def survey_ranges(samples: DataFrame, cam_range: Column) -> DataFrame:
    """Monocular range against surveyed distance per sample."""
    d = samples.withColumn("estimate_m", cam_range)
    return d.withColumn("error_m", F.col("estimate_m") - F.col("true_m")).withColumn("rel_error", F.col("error_m") / F.col("true_m"))


# -- clutter ------------------------------------------------------------------

def clutter_map(points: DataFrame, frames: DataFrame, cell: float = 0.25, r_max: float = 2.0, y_min: float = 0.5, x_span: float = 1.5) -> DataFrame:
    """Near dead-Doppler returns per frame on a dense grid."""
    v = F.abs(F.coalesce(F.col("v"), F.lit(0.0)))
    near = (F.col("y") >= y_min) & (F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < r_max) & (v <= DOPPLER_BIN * 1.05)
    p = points.filter(near & F.col("x").between(-x_span, x_span)).select(
        F.floor((F.col("x") + x_span) / cell).cast("bigint").alias("ix"), F.floor((F.col("y") - y_min) / cell).cast("bigint").alias("iy"))
    nx, ny = int(round(2 * x_span / cell)), int(math.ceil((r_max - y_min) / cell))
    p = p.withColumn("ix", F.least("ix", F.lit(nx - 1))).groupBy("ix", "iy").agg(F.count("*").alias("n"))
    grid = frames.agg(F.count("*").alias("n_frames")).withColumn("ix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nx - 1).cast("bigint")))).withColumn(
        "iy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ny - 1).cast("bigint"))))
    return grid.join(p, ["ix", "iy"], "left").select("ix", "iy", (F.coalesce("n", F.lit(0)) / F.col("n_frames")).alias("per_frame"))


def near_bearing_rows(points: DataFrame, r_max: float = 1.3) -> DataFrame:
    """Near returns keyed by frame and nearest 15-degree centre."""
    b = F.greatest(F.lit(-45.0), F.least(F.lit(45.0), F.bround(F.degrees(F.atan2("x", "y")) / 15) * 15))
    return points.withColumn("bin_center_deg", b).filter(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < r_max)


def clutter_what_if(points: DataFrame, targets: DataFrame, zones: Sequence[dict], y_min: float, y_max: float) -> DataFrame:
    """Zone parameter sets applied to the same points: surviving near-return rows (one per
    frame and bearing), by label and by origin.  ``targets``: frame, bin_center_deg, y_nav."""
    spec = F.array(*[F.struct(F.lit(i).alias("zone"), *[F.lit(float(z[k])).alias(k) for k in ("keep_above", "x_min", "x_max", "y_lo", "y_hi")]) for i, z in enumerate(zones)])
    p = near_bearing_rows(points.filter(F.col("y").between(y_min, y_max)))
    z = p.withColumn("z", F.explode(spec))
    v = F.abs(F.coalesce(F.col("v"), F.lit(0.0)))
    inside = F.col("x").between(F.col("z.x_min"), F.col("z.x_max")) & F.col("y").between(F.col("z.y_lo"), F.col("z.y_hi"))
    z = z.filter(~(inside & (v <= F.col("z.keep_above"))))
    in_box = F.col("x").between(-0.75, 0.25) & (F.col("y") <= 1.2)
    origin = (F.when(in_box & (v < 2.2 * DOPPLER_BIN), "in_box_noise").when(in_box, "in_box_doppler")
              .when((F.col("x") < -0.75) & (F.col("y") < 1.3), "port_fringe").otherwise("other"))
    first = z.withColumn("o", origin).groupBy(F.col("z.zone").alias("zone"), *FRAME, "bin_center_deg").agg(F.min_by("o", "point_id").alias("origin"))
    j = first.join(targets, FRAME + ["bin_center_deg"], "left")
    y = F.col("y_nav")
    return j.groupBy("zone").agg(
        F.count("*").alias("rows"), F.count_if(y >= 0.5).alias("label_pos"), F.count_if(y < 0.5).alias("label_neg"), F.count_if(y.isNull()).alias("unlabelled"),
        *[F.count_if(F.col("origin") == o).alias(o) for o in ("in_box_noise", "in_box_doppler", "port_fringe", "other")])


# -- bearing ground truth -----------------------------------------------------

def gt_intervals(boxes: DataFrame, lo: Column, hi: Column, fov: tuple[float, float], classes: Sequence[str] | None = None, max_width: float = 35.0) -> DataFrame:
    """Label boxes as bearing intervals clipped to the field of view; too wide ones drop."""
    d = boxes if not classes else boxes.filter(F.col("cls").isin(list(classes)))
    d = d.withColumns({"lo_deg": F.least(lo, hi), "hi_deg": F.greatest(lo, hi)})
    d = d.filter((F.col("hi_deg") >= fov[0]) & (F.col("lo_deg") <= fov[1]))
    d = d.withColumns({"lo_deg": F.greatest("lo_deg", F.lit(fov[0])), "hi_deg": F.least("hi_deg", F.lit(fov[1]))})
    return d.filter(F.col("hi_deg") - F.col("lo_deg") <= max_width)


def mark_static(intervals: DataFrame, frames: DataFrame, fov: tuple[float, float], cell: float = 2.0, share: float = 0.15) -> DataFrame:
    """Per clip: bearing cells occupied in enough labelled frames are static; an interval is
    static when at least half of its cells are."""
    n = max(1, math.ceil((fov[1] - fov[0]) / cell))

    def idx(c):
        q = (c - fov[0]) / cell
        return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))

    a = F.greatest(F.lit(0), idx(F.col("lo_deg"))).cast("int")
    b = F.least(F.lit(n - 1), idx(F.col("hi_deg"))).cast("int")
    d = intervals.withColumn("__a", a).withColumn("__b", b)
    e = d.filter("__b >= __a").withColumn("cell", F.explode(F.sequence("__a", "__b")))
    occ = e.select("clip_id", "cell", "frame_index").distinct().groupBy("clip_id", "cell").agg(F.count("*").alias("k"))
    tot = frames.groupBy("clip_id").agg(F.count("*").alias("nf"))
    st = occ.join(tot, "clip_id").filter(F.col("k") >= share * F.col("nf")).select("clip_id", "cell", F.lit(1).alias("s"))
    m = e.join(st, ["clip_id", "cell"], "left").groupBy(*FRAME, "gt_id").agg((F.sum(F.coalesce("s", F.lit(0))) / F.count("*") >= 0.5).alias("static"))
    return d.join(m, FRAME + ["gt_id"], "left").withColumn("static", F.coalesce("static", F.lit(False))).drop("__a", "__b")


def _cells(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width)).cast("bigint")


def dilated(intervals: DataFrame, frames: DataFrame, k: int, slice_len: float = 1000) -> DataFrame:
    """Intervals of the ``k`` labelled frames before and after (by labelled-frame rank),
    keyed to the frame they serve."""
    if k <= 0:
        return intervals
    r = scan(time_slices(frames.select(*FRAME).distinct(), "frame_index", slice_len), ["clip_id"], ["frame_index"], run_sum={"rank": F.lit(1)}).drop(SLICE)
    g = intervals.join(r, FRAME).withColumn("__r", F.explode(F.sequence(F.col("rank") - k, F.col("rank") + k))).drop("frame_index", "rank")
    return g.join(r.withColumnRenamed("rank", "__r"), ["clip_id", "__r"]).drop("__r")


def bearing_matches(dets: DataFrame, gt: DataFrame, radar: DataFrame, tol: float, dilation: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(gt with ``hit``, detections with ``tp``, ``by_radar`` and bearing error).

    Joins are on frame and bearing cell.  ``dilation`` replaces the truth on the precision
    side."""
    w = max(tol, 1.0)

    def spread_iv(d):
        return d.withColumn("__c", F.explode(F.sequence(_cells(F.col("lo_deg") - tol, w), _cells(F.col("hi_deg") + tol, w))))

    dc = dets.select(*FRAME, "det_id", "angle_deg", _cells(F.col("angle_deg"), w).alias("__c"))
    in_iv = F.col("angle_deg").between(F.col("lo_deg") - tol, F.col("hi_deg") + tol)
    hit = spread_iv(gt).join(dc, FRAME + ["__c"]).filter(in_iv).select(*FRAME, "gt_id").distinct().withColumn("hit", F.lit(True))
    g = gt.join(hit, FRAME + ["gt_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    src = dilation if dilation is not None else gt
    dist = F.when(F.col("angle_deg").between(F.col("lo_deg"), F.col("hi_deg")), 0.0).otherwise(F.least(F.abs(F.col("angle_deg") - F.col("lo_deg")), F.abs(F.col("angle_deg") - F.col("hi_deg"))))
    tp = spread_iv(src.select(*FRAME, "lo_deg", "hi_deg")).join(dc, FRAME + ["__c"]).filter(in_iv).groupBy(*FRAME, "det_id").agg(F.min(dist).alias("bearing_err"))
    rc = radar.select(*FRAME, F.col("angle_deg").alias("ra")).withColumn("__c", F.explode(F.sequence(_cells(F.col("ra"), w) - 1, _cells(F.col("ra"), w) + 1)))
    near = dc.join(rc, FRAME + ["__c"]).filter(F.abs(F.col("ra") - F.col("angle_deg")) <= tol).select(*FRAME, "det_id").distinct().withColumn("by_radar", F.lit(True))
    d = dets.join(tp, FRAME + ["det_id"], "left").join(near, FRAME + ["det_id"], "left")
    return g, d.withColumns({"tp": F.col("bearing_err").isNotNull(), "by_radar": F.coalesce("by_radar", F.lit(False))})


def bearing_report(gt: DataFrame, dets: DataFrame, frames: DataFrame) -> DataFrame:
    """Recall (all, static, moving), strict and lenient precision, F1, bearing error and
    false positives per frame (one row)."""
    st = F.col("static")
    a = gt.agg(F.count("*").alias("n_gt"), F.count_if("hit").alias("n_rec"), F.count_if(st).alias("n_st"), F.count_if(st & F.col("hit")).alias("r_st"),
               F.count_if(~st).alias("n_mv"), F.count_if(~st & F.col("hit")).alias("r_mv"))
    t, r = F.col("tp"), F.col("by_radar")
    b = dets.agg(F.count("*").alias("n_det"), F.count_if(t).alias("n_tp"), F.count_if(~t & r).alias("n_radar"), F.count_if(~t & ~r).alias("n_fp"), F.avg("bearing_err").alias("bearing_mae"))
    c = frames.agg(F.count("*").alias("n_frames"))
    one = F.lit(1).alias("k")
    j = a.select("*", one).join(b.select("*", one), "k").join(c.select("*", one), "k")
    p, rec = E.ratio(F.col("n_tp"), F.col("n_tp") + F.col("n_fp")), E.ratio(F.col("n_rec"), F.col("n_gt"))
    return j.select(
        "n_frames", "n_gt", "n_det", "n_tp", "n_radar", "n_fp", rec.alias("recall"), E.ratio(F.col("r_st"), F.col("n_st")).alias("recall_static"),
        E.ratio(F.col("r_mv"), F.col("n_mv")).alias("recall_moving"), E.ratio(F.col("n_tp"), F.col("n_det")).alias("precision_strict"), p.alias("precision_lenient"),
        F.when(p + rec > 0, 2 * p * rec / (p + rec)).alias("f1"), "bearing_mae", (F.col("n_fp") / F.col("n_frames")).alias("fp_per_frame"))


def bearing_bins(gt: DataFrame, dets: DataFrame, fov: tuple[float, float], grid: BinGrid = GRID) -> DataFrame:
    """Bin-grain tp/fp/fn inside the field of view."""
    vis = [i for i in range(grid.n) if grid.lo + (i + 1) * grid.step > fov[0] and grid.lo + i * grid.step < fov[1]]
    cells = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(grid.lo + i * grid.step).alias("a"), F.lit(grid.lo + (i + 1) * grid.step).alias("b")) for i in vis])
    g = gt.withColumn("z", F.explode(F.filter(cells, lambda c: (F.col("lo_deg") < c["b"]) & (F.col("hi_deg") >= c["a"])))).select(*FRAME, F.col("z.i").alias("bin_index")).distinct()
    d = dets.withColumn("bin_index", M.bin_of(F.col("angle_deg"), grid)).filter(F.col("bin_index").isin(vis)).select(*FRAME, "bin_index").distinct()
    j = g.withColumn("g", F.lit(True)).join(d.withColumn("d", F.lit(True)), FRAME + ["bin_index"], "full_outer")
    tp, fp, fn = F.count_if(F.col("g") & F.col("d")), F.count_if(F.col("g").isNull()), F.count_if(F.col("d").isNull())
    return j.agg(tp.alias("bin_tp"), fp.alias("bin_fp"), fn.alias("bin_fn"))


def interval_overlap(pred: DataFrame, gt: DataFrame, tol: float, max_width: float = 35.0) -> tuple[DataFrame, DataFrame]:
    """(gt with ``hit``, predictions with ``tp``) by overlap within the tolerance; wide
    predictions are dropped."""
    w = max(tol, 5.0)
    p = pred.filter(F.col("hi_deg") - F.col("lo_deg") <= max_width)
    pc = p.select(*FRAME, "pred_id", F.col("lo_deg").alias("pl"), F.col("hi_deg").alias("ph")).withColumn("__c", F.explode(F.sequence(_cells(F.col("pl"), w), _cells(F.col("ph"), w))))
    gc = gt.withColumn("__c", F.explode(F.sequence(_cells(F.col("lo_deg") - tol, w), _cells(F.col("hi_deg") + tol, w))))
    m = gc.join(pc, FRAME + ["__c"]).filter((F.col("pl") <= F.col("hi_deg") + tol) & (F.col("ph") >= F.col("lo_deg") - tol))
    hg = m.select(*FRAME, "gt_id").distinct().withColumn("hit", F.lit(True))
    hp = m.select(*FRAME, "pred_id").distinct().withColumn("tp", F.lit(True))
    return (gt.join(hg, FRAME + ["gt_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))),
            p.join(hp, FRAME + ["pred_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(False))))


# -- handover -----------------------------------------------------------------

def handover_table(bins: DataFrame, min_n: int = 20) -> DataFrame:
    """Mean score per light band and sensor combination with enough rows."""
    h = ["hit_fisheye", "hit_thermal", "hit_mmwave"]
    return bins.groupBy("band", *h).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p")).filter(F.col("n") >= min_n)


def handover_fit(bins: DataFrame, min_n: int = 50) -> DataFrame:
    """Least squares of the score on the three hits per band."""
    xs = [F.lit(1.0), *[F.col(h).cast("double") for h in ("hit_fisheye", "hit_thermal", "hit_mmwave")]]
    s = E.moment_sums(bins, ["band"], xs, F.col("p")).filter(F.col("n") >= min_n)
    return E.solve_normal(s, ["bias", "fisheye", "thermal", "radar"], "w", ["band"]).join(s.select("band", "n"), "band")


def bucket_medians(df: DataFrame, keys: Sequence[str], t: str, v: str, width: float, min_n: int = 3) -> DataFrame:
    """Median time and value in buckets counted from the first sample of the key."""
    t0 = df.groupBy(*keys).agg(F.min(t).alias("__t0"))
    d = df.join(t0, list(keys)).withColumn("bucket", F.floor((F.col(t) - F.col("__t0")) / width).cast("bigint"))
    return d.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.median(t).alias("t_mid"), F.median(v).alias("value")).filter(F.col("n") >= min_n)


def per_minute(df: DataFrame, keys: Sequence[str], t: str, v: str) -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(t) / 60.0).cast("bigint").alias("minute")).agg(F.avg(v).alias("mean_value"), F.count("*").alias("n"))


# -- trials and service -------------------------------------------------------

TRIAL = ["launch", "trial"]


def normalise_trials(events: DataFrame) -> DataFrame:
    """A missing trial number means 1."""
    return events.withColumn("trial", F.coalesce("trial", F.lit(1)))


def trial_summary(events: DataFrame, half_deg: float = 15.0) -> DataFrame:
    """One row per trial: name, note, whether it was armed, decisions, refusals, the accepted
    choice, leg and station seconds, outcome, nearest range with its bearing and highest score
    near the course.  A station event without a pattern keeps the one before it, or holds."""
    pos = F.col("pos")

    def last(c: str, cond: Column) -> Column:
        return F.max_by(c, F.when(cond, pos))

    kind = F.col("kind")
    ph = lambda p: (kind == "phase") & (F.col("phase") == p)
    ok = (kind == "decide") & F.col("result").isin("ok", "fixed")
    base = events.groupBy(*TRIAL).agg(
        F.count_if(kind == "decide").alias("decisions"),
        F.count_if((kind == "decide") & F.col("result").isin("blocked", "insufficient", "no_heading_or_fix")).alias("refused"),
        last("rel_heading_deg", ok).alias("rel_heading_deg"), last("abs_heading_deg", kind == "checkpoint").alias("abs_heading_deg"),
        last("distance_m", kind == "checkpoint").alias("checkpoint_m"), last("t_s", kind == "checkpoint").alias("t_decide_s"),
        last("t_s", ph("GO")).alias("__go"), last("t_s", ph("STATION")).alias("__st"), last("t_s", ph("DONE")).alias("__done"),
        last("why", ph("DONE")).alias("__why"), F.bool_or(ph("DONE")).alias("__ended"),
        last("name", kind == "start").alias("name"), last("note", kind == "start").alias("note"),
        F.max_by(~F.coalesce("dry_run", F.lit(True)), F.when(kind == "hardware", pos)).alias("armed"),
        last("field_p", ok).alias("field_p"), last("n_records", ok).alias("n_records_hold"),
        F.max_by("pattern", F.when((kind.isin("station", "station_pattern")) & F.col("pattern").isNotNull(), pos)).alias("__pattern"),
        F.max(F.when(kind == "station_pattern", pos)).alias("__named"), F.max(F.when(kind == "station", pos)).alias("__held"),
        last("pattern", kind == "station_pattern").alias("__last_named"))
    why = F.coalesce("__why", F.lit(""))
    outcome = (F.when(~F.col("__ended"), "no log").when(why.startswith("checkpoint reached") | why.startswith("station keeping done"), "reached")
               .when(why.startswith("abort"), "abort").when(why.contains("stale"), "stale link").when(why.contains("timeout"), "timeout")
               .when(why.contains("decide-only"), "decide-only").when(why == "", "done").otherwise(why))
    base = base.withColumns({
        "outcome": outcome, "go_s": F.round(F.coalesce("__st", "__done") - F.col("__go"), 1), "station_s": F.round(F.col("__done") - F.col("__st"), 1)})
    d = scan(time_slices(events, "pos", 10_000), TRIAL, ["pos"], fill={"__abs": F.when(kind == "checkpoint", F.col("abs_heading_deg"))})
    s = d.filter((kind == "sectors") & (F.col("phase") == "GO") & F.col("__abs").isNotNull() & F.col("heading").isNotNull())
    s = s.select(*TRIAL, "pos", wrap_deg(F.col("__abs") - F.col("heading")).alias("course"), F.explode(F.arrays_zip("bins", "p", "min_range_m")).alias("b"))
    s = s.filter(F.abs(F.col("b.bins") - F.col("course")) <= half_deg).groupBy(*TRIAL).agg(
        F.round(F.max("b.p"), 2).alias("max_p_course"), F.round(F.min("b.min_range_m"), 1).alias("closest_m"),
        F.min(F.when(F.col("b.min_range_m").isNotNull(), F.struct("b.min_range_m", "pos", "b.bins")))["bins"].alias("closest_deg"))
    # a pattern event after the last station event stands as it is, even without a name
    pattern = F.when(F.coalesce(F.col("__named") > F.col("__held"), F.col("__held").isNull()), F.col("__last_named")).otherwise(F.coalesce("__pattern", F.lit("hold")))
    base = base.withColumn("station_pattern", pattern)
    return base.drop("__go", "__st", "__done", "__why", "__ended", "__pattern", "__named", "__held", "__last_named").join(s, TRIAL, "left")


def trial_geometry(events: DataFrame) -> DataFrame:
    """Metres moved between the first and last position, and the highest bin at the accepted
    decision when it reaches 0.6."""
    k = F.col("kind")
    fix = F.when((k == "cycle") & F.col("lat").isNotNull(), F.col("pos"))
    here = F.struct("lat", "lon")
    ok = F.when((k == "decide") & F.col("result").isin("ok", "fixed"), F.col("pos"))
    g = events.groupBy(*TRIAL).agg(F.min_by(here, fix).alias("a"), F.max_by(here, fix).alias("b"), F.max_by(F.struct("bins", "p"), ok).alias("d"), F.count_if(k == "cycle").alias("__n"))
    e = (F.col("b.lon") - F.col("a.lon")) * 111320.0 * F.cos(F.radians("a.lat"))
    n = (F.col("b.lat") - F.col("a.lat")) * 111320.0
    top = F.array_max(F.transform(F.arrays_zip("d.p", "d.bins"), lambda z: F.struct(z["p"].alias("p"), (-z["bins"]).alias("nb"))))
    return g.select(*TRIAL, F.sqrt(e * e + n * n).alias("moved_m"), F.when(top["p"] >= 0.6, -top["nb"]).alias("obstacle_bin_deg"), (F.col("__n") / 10.0).alias("leg_s"))


def hold_window(decisions: DataFrame, bins: DataFrame, hold_s: float = 10.0, after_s: float = 0.6, bucket_s: float = 60.0) -> DataFrame:
    """Median score per bin over the records held before each decision
    ([t - hold, t + after)); equi-join on time buckets."""
    def bk(c):
        return F.floor(c / bucket_s).cast("bigint")

    d = decisions.select("clip_id", "decision_id", F.col("t_s").alias("td")).withColumn("__k", F.explode(F.sequence(bk(F.col("td") - hold_s), bk(F.col("td") + after_s))))
    b = bins.withColumn("__k", bk(F.col("t_s")))
    m = d.join(b, ["clip_id", "__k"]).filter((F.col("t_s") >= F.col("td") - hold_s) & (F.col("t_s") < F.col("td") + after_s))
    return m.groupBy("clip_id", "decision_id", "bin_index").agg(F.count("*").alias("n"), F.median("p").alias("median_p"))


def frame_at(instants: DataFrame, frames: DataFrame, chunk_ms: float = 360_000) -> DataFrame:
    """First frame at or after each instant within its chunk, else the chunk's last frame.
    ``instants``: clip_id, instant_id, t_ms; a clip is one chunk."""
    f = frames.select("clip_id", F.col("frame_index").alias("next_frame"), F.col("t_ms"))
    d = nearest_asof(instants, f, ["clip_id"], t="t_ms", payload=["next_frame"], max_age=chunk_ms, side="forward", slice_factor=2)
    last = frames.groupBy("clip_id").agg(F.max_by("frame_index", "t_ms").alias("last_frame"))
    return d.join(last, "clip_id").select("clip_id", "instant_id", F.coalesce("next_frame", "last_frame").alias("frame_index"))


def service_timing(records: DataFrame, keys: Sequence[str], budget_ms: float = 333.3) -> DataFrame:
    """Rate, tick percentiles, over-budget share, latency, freshness shares, board extremes."""
    span = F.max("t_s") - F.min("t_s")
    return records.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(span > 0, (F.count("*") - 1) / span).alias("rate_hz"), F.percentile("tick_ms", 0.5).alias("tick_p50"),
        F.percentile("tick_ms", 0.95).alias("tick_p95"), F.avg((F.col("tick_ms") > budget_ms).cast("double")).alias("over_budget"),
        F.median("source_latency_s").alias("latency_p50"), F.avg(F.col("seg_fresh").cast("double")).alias("seg_fresh"),
        F.avg(F.col("yolo_fresh").cast("double")).alias("yolo_fresh"), F.avg(F.col("scorer_ok").cast("double")).alias("scorer_ok"),
        F.max("skipped_rows").alias("skipped_rows"), F.median("clock_mhz").alias("clock_mhz"), F.min("clock_mhz").alias("clock_min"),
        F.max("temp_c").alias("temp_max"), F.bool_or(~F.col("throttled").isin("0x0", "0")).alias("throttled_any"))


# -- sweeps and mapping -------------------------------------------------------

def sweep(points: DataFrame, frames: DataFrame, combos: Sequence[dict], thr: float = 0.33) -> DataFrame:
    """Radar/fusion parameter combinations over the same points, per frame.  The combos are
    an array generator; each point is tested once per combo."""
    spec = F.array(*[F.struct(F.lit(i).cast("bigint").alias("combo"), *[F.lit(float(c[k])).alias(k) for k in ("y_min", "y_max", "keep_above", "step")]) for i, c in enumerate(combos)])
    v = F.abs(F.coalesce(F.col("v"), F.lit(0.0)))
    p = points.withColumn("c", F.explode(spec)).filter(F.col("y").between(F.col("c.y_min"), F.col("c.y_max")))
    zone = F.col("x").between(-1.0, 0.25) & F.col("y").between(0.0, 1.3) & (v <= F.col("c.keep_above"))
    p = p.filter(~zone)
    b = F.floor((M.azimuth(F.col("x"), F.col("y")) + 52.5) / F.col("c.step"))
    n = F.round(105.0 / F.col("c.step"))
    p = p.withColumn("b", b).filter((F.col("b") >= 0) & (F.col("b") < n))
    g = p.groupBy(F.col("c.combo").alias("combo"), "scene", *FRAME).agg(F.count_distinct("b").alias("bins_hit"), F.min("y").alias("min_range_m"))
    f = frames.withColumn("c", F.explode(spec)).select("scene", *FRAME, F.col("c.combo").alias("combo"))
    d = f.join(g, ["combo", "scene", *FRAME], "left")
    score = F.when(F.col("bins_hit") > 0, 1.0 / 3.0).otherwise(0.0)
    return d.select("combo", "scene", *FRAME, score.alias("max_score"), (score >= thr).cast("bigint").alias("any_hit"), "min_range_m")


def sweep_summary(per_frame: DataFrame, empty_scene: str) -> DataFrame:
    """Hit rate, mean score, false-alarm proxy and mean range per combo and scene."""
    g = per_frame.groupBy("combo", "scene").agg(F.count("*").alias("n_frames"), F.avg(F.col("any_hit").cast("double")).alias("hit_rate"),
                                                F.avg("max_score").alias("mean_max_score"), F.avg("min_range_m").alias("mean_min_range"))
    return g.withColumn("fp_proxy", F.when(F.col("scene") == empty_scene, F.col("hit_rate")).otherwise(0.0))


def sweep_ranking(summary: DataFrame, weights: dict[str, float], empty_scene: str) -> DataFrame:
    """Combos by scene-weighted proxy (the empty scene counts as one minus its hit rate)."""
    w = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("scene")), F.lit(0.0))
    val = F.when(F.col("scene") == empty_scene, 1.0 - F.col("hit_rate")).otherwise(F.col("hit_rate"))
    return summary.groupBy("combo").agg(F.sum(w * val).alias("proxy")).orderBy(F.desc("proxy"), "combo")


def attitude_mapping(pairs: DataFrame) -> DataFrame:
    """The eight axis-swap and sign mappings of sensor pitch/roll against a reference:
    correlations about the medians, offsets and residual spread.  ``pairs``: ref_pitch,
    ref_roll, imu_pitch, imu_roll (radians)."""
    refs, imus, signs = ("ref_pitch", "ref_roll"), ("imu_pitch", "imu_roll"), (1.0, -1.0)
    axes = [(a, b) for a in refs for b in imus]
    # a sign only turns a median, a covariance or a residual's partner round: the rows are not copied for the eight
    rest = {(a, b, s): F.col(a) - s * F.col(b) for a, b in axes for s in signs}
    label = lambda kind, a, b, s=0.0: f"{kind}_{a}_{b}_{int(s)}"
    med = cut_lineage(exact_quantiles(pairs, [], {f"{c}_m": (F.col(c), 0.5) for c in refs + imus} | {label("offset", *k): (c, 0.5) for k, c in rest.items()}))
    j = pairs.join(F.broadcast(med.select(*[f"{c}_m" for c in refs + imus])))      # one row
    one = j.agg(
        F.count("*").alias("n"), *[F.stddev_pop(c).alias(f"{c}_s") for c in refs + imus],
        *[F.avg((F.col(a) - F.col(f"{a}_m")) * (F.col(b) - F.col(f"{b}_m"))).alias(label("cov", a, b)) for a, b in axes],
        *[F.stddev_pop(c).alias(label("resid", *k)) for k, c in rest.items()]).filter("n > 0").join(F.broadcast(med))

    def corr(a, b, s):
        sa, sb = F.col(f"{a}_s"), F.col(f"{b}_s")
        return F.when((sa < 1e-9) | (sb < 1e-9), 0.0).otherwise(s * F.col(label("cov", a, b)) / (sa * sb))

    def mapped(swap, sp, sr):
        pitch, roll = ("ref_pitch", imus[swap], sp), ("ref_roll", imus[not swap], sr)
        return F.struct(
            F.lit(swap).alias("swap"), F.lit(sp).alias("sign_pitch"), F.lit(sr).alias("sign_roll"), F.col("n").alias("n"), corr(*pitch).alias("corr_pitch"), corr(*roll).alias("corr_roll"),
            F.col(label("resid", *pitch)).alias("resid_pitch"), F.col(label("resid", *roll)).alias("resid_roll"), (corr(*pitch) + corr(*roll)).alias("score"),
            F.col(label("offset", *pitch)).alias("offset_pitch"), F.col(label("offset", *roll)).alias("offset_roll"))

    return one.select(F.explode(F.array(*[mapped(sw, sp, sr) for sw in (False, True) for sp in signs for sr in signs])).alias("c")).select("c.*")


THERMAL_FOV = ((0 - THERMAL.lin_cx) / THERMAL.px_per_deg, (THERMAL.width - 1 - THERMAL.lin_cx) / THERMAL.px_per_deg)
