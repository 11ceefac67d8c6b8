"""Label geometry, label-to-frame resolution, target tables, feature merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import clock
from keelson.functions import geometry as G
from keelson.functions import motion as M
from keelson.params import FISHEYE, GRID, THERMAL, BinGrid, Camera

FRAME = ["clip_id", "frame_index"]


def tidy_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners sorted and clamped to [0, 1]; null for an empty box."""
    def c(v):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    a, b, p, q = c(F.least(x0, x1)), c(F.greatest(x0, x1)), c(F.least(y0, y1)), c(F.greatest(y0, y1))
    return F.when((b > a) & (q > p), F.struct(a.alias("x0"), p.alias("y0"), b.alias("x1"), q.alias("y1")))


def box_bearing(x0: Column, x1: Column, cam: Camera = FISHEYE) -> Column:
    return G.bearing_pinhole((x0 + x1) / 2.0 * cam.width, cam)


def thermal_box_bearing(x0: Column, x1: Column, cam: Camera = THERMAL) -> Column:
    return G.bearing_linear((x0 + x1) / 2.0 * cam.width, cam)


def box_bins(bearings: Column, grid: BinGrid = GRID) -> Column:
    """Distinct bin centres (whole degrees) of an array of bearings, sorted."""
    b = F.filter(F.transform(bearings, lambda a: M.bin_center(M.bin_of(a, grid), grid).cast("int")), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(b))


def resolve_labels(labels: DataFrame, frames: DataFrame, clips: DataFrame) -> DataFrame:
    """Frame index of every label: the given index, else the frame with the label's time;
    clips without radar invert the nominal clock with a round-trip check.  Labels that
    resolve to nothing or lie beyond the last frame are dropped.

    ``labels``: clip_id, frame_idx (-1 when keyed by time), frame_ts.
    ``frames``: clip_id, frame_index, rounded_time.  ``clips``: clip_id, base_s, silent, max_index.
    """
    t = frames.select("clip_id", F.col("rounded_time").alias("frame_ts"), F.col("frame_index").alias("__by_time"))
    t = t.groupBy("clip_id", "frame_ts").agg(F.max("__by_time").alias("__by_time"))
    d = labels.join(t, ["clip_id", "frame_ts"], "left").join(clips, "clip_id")
    inv = F.bround((clock.seconds_of_day(F.col("frame_ts")) - F.col("base_s")) * 3.0).cast("bigint")
    same = clock.hms_tenths(F.col("base_s") + inv / F.lit(3.0)) == F.col("frame_ts")
    nominal = F.when(F.col("silent") & (inv >= 0) & same, inv)
    idx = F.when(F.col("frame_idx") >= 0, F.col("frame_idx")).otherwise(F.coalesce("__by_time", nominal))
    return d.withColumn("frame_index", idx).filter(F.col("frame_index") <= F.col("max_index")).drop(
        "__by_time", "base_s", "silent", "max_index")


def target_table(boxes: DataFrame, labelled: DataFrame, grid: BinGrid = GRID, *, dilation: int = 7,
                 tolerance_deg: float | None = None, max_relevant_m: float = 0.0) -> DataFrame:
    """Targets per labelled frame and bin.

    ``boxes``: frame, bearing_deg, cls, range_m (null: no monocular range).
    ``labelled``: frame, audited (frames with a label, boxes or not).
    A label supports a bin of any labelled frame within ``dilation`` frames when its
    bearing lies within half a bin plus the tolerance of the centre.  Labels are expanded
    over those frames and the few bins they reach, so the join is on equal keys.
    """
    tol = grid.step / 2 if tolerance_deg is None else tolerance_deg
    reach = grid.step / 2 + tol
    rel = F.lit(True) if max_relevant_m <= 0 else F.coalesce(F.col("range_m") <= max_relevant_m, F.lit(False))
    centers = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(grid.center(i)).alias("c")) for i in range(grid.n)])
    hit = F.filter(centers, lambda c: F.abs(c["c"] - F.col("bearing_deg")) <= reach)
    b = boxes.withColumn("rel", rel).withColumn("__h", F.explode(hit)).withColumn(
        "__f", F.explode(F.sequence(F.col("frame_index") - dilation, F.col("frame_index") + dilation)))
    same = F.col("__f") == F.col("frame_index")
    sup = b.groupBy("clip_id", F.col("__f").alias("frame_index"), F.col("__h.i").alias("bin_index")).agg(
        F.lit(True).alias("any"), F.bool_or("rel").alias("rel"), F.bool_or(same).alias("same"),
        F.array_sort(F.collect_set(F.when(same & (F.col("cls") != ""), F.col("cls")))).alias("classes"),
        F.min(F.when(same, F.col("range_m"))).alias("near"))
    n = boxes.groupBy(*FRAME).agg(F.count("*").alias("n"))
    f = labelled.groupBy(*FRAME).agg(F.bool_or("audited").alias("audited")).join(n, FRAME, "left")
    d = f.withColumn("bin_index", M.all_bins(grid)).join(sup, FRAME + ["bin_index"], "left")
    y, r, s = (F.coalesce(c, F.lit(v)) for c, v in (("any", False), ("rel", True), ("same", False)))
    y = F.col("any").isNotNull()
    r = F.coalesce(F.col("rel"), F.lit(True))
    s = F.coalesce(F.col("same"), F.lit(False))
    return d.select(
        *FRAME, "bin_index", M.bin_center(F.col("bin_index"), grid).alias("bin_center_deg"), y.cast("bigint").alias("y_obstacle"),
        r.cast("bigint").alias("y_relevant"), (y & r).cast("bigint").alias("y_nav"), (y & ~s).cast("bigint").alias("from_dilation"),
        F.coalesce(F.array_join("classes", "|"), F.lit("")).alias("label_classes"), F.col("near").alias("label_min_range_m"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_labels_frame"), F.col("audited").cast("bigint").alias("audited"))


def merge_features(bins: DataFrame, frames: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Bins with their frame context (colliding names get ``_frame``), and with targets."""
    ren = {c: f"{c}_frame" for c in frames.columns if c in bins.columns and c not in FRAME}
    f = frames.select(*[F.col(c).alias(ren.get(c, c)) for c in frames.columns])
    d = bins.join(f, FRAME, "left")
    if targets is None:
        return d
    keep = [c for c in targets.columns if c in FRAME + ["bin_index"] or c not in d.columns]
    return d.join(targets.select(*keep), FRAME + ["bin_index"], "inner")


def targets_by_bin(targets: DataFrame, grid: BinGrid = GRID) -> DataFrame:
    """Nearest tracked target of each bin."""
    t = targets.withColumn("bin_index", M.bin_of(F.col("bearing_deg"), grid)).filter("bin_index IS NOT NULL")
    rest = [c for c in t.columns if c not in FRAME + ["bin_index"]]
    return t.groupBy(*FRAME, "bin_index").agg(F.min_by(F.struct(*rest), F.struct("range_m", "track_id")).alias("t")).select(
        *FRAME, "bin_index", *[F.col(f"t.{c}").alias(c) for c in rest])


def frame_context(frames: DataFrame, *, points: DataFrame, raw: DataFrame, levels: DataFrame, attitude: DataFrame,
                  velocity: DataFrame) -> DataFrame:
    """One context row per frame.  A missing modality stays null with its flag false."""
    p = points.groupBy(*FRAME).agg(F.count("*").alias("radar_n_points"), F.count_if(F.col("vx").isNotNull()).alias("__nv"),
                                   F.count("snr").alias("__ns"), F.median("snr").alias("radar_median_snr_db"))
    d = (frames.join(raw.select(*FRAME, F.col("n_raw").alias("radar_n_points_raw")), FRAME, "left").join(p, FRAME, "left")
         .join(levels, FRAME, "left").join(attitude, FRAME, "left").join(velocity, FRAME, "left"))
    zero = F.lit(0).cast("bigint")
    return d.withColumns({
        "mmwave_available": F.col("radar_n_points_raw").isNotNull(), "fisheye_available": F.col("luminance_mean").isNotNull(),
        "imu_available": F.col("attitude_roll_deg").isNotNull(), "radar_n_points": F.coalesce("radar_n_points", zero),
        "radar_n_points_raw": F.coalesce("radar_n_points_raw", zero), "radar_has_doppler": F.coalesce(F.col("__nv") > 0, F.lit(False)),
        "radar_has_snr": F.coalesce(F.col("__ns") > 0, F.lit(False)),
        "is_dark": F.coalesce(F.col("luminance_mean") < 25.0, F.lit(False))}).drop("__nv", "__ns")
