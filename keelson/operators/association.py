"""Radar evidence for camera detections: pixel gates, arbitration, veto, confirmation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import geometry as G
from keelson.functions import motion as M
from keelson.params import FISHEYE, GRID, RADAR_TO_FISHEYE, BinGrid, Camera
from keelson.plans.joins import box_pairs

FRAME = ["clip_id", "frame_index"]
DET = FRAME + ["det_id"]
CELL_PX = 64.0


def projected(points: DataFrame, cam: Camera = FISHEYE, t=RADAR_TO_FISHEYE) -> DataFrame:
    """Points with their pixel (pu, pv); points behind the camera are dropped."""
    d = points.withColumn("__ray", G.camera_ray(F.col("x"), F.col("y"), F.col("z"), t)).filter("__ray IS NOT NULL")
    px = G.project(F.col("__ray"), cam)
    return d.withColumns({"pu": px["u"], "pv": px["v"]}).drop("__ray")


def _point_box(points: DataFrame) -> DataFrame:
    return points.select(*FRAME, "point_id", "x", "y", "pu", "pv",
                         F.col("pu").alias("qx0"), F.col("pv").alias("qy0"), F.col("pu").alias("qx1"), F.col("pv").alias("qy1"))


def box_gate(dets: DataFrame, points: DataFrame, cam: Camera = FISHEYE) -> DataFrame:
    """(det, point) pairs whose pixel lies in the padded detection box.  Pixel cells keep
    the join to near pairs even in a crowded frame."""
    r = F.col("size") / 2.0 + cam.pad_px
    d = dets.withColumns({"bx0": F.col("u") - r, "by0": F.col("v") - r, "bx1": F.col("u") + r, "by1": F.col("v") + r})
    return box_pairs(d, _point_box(points), FRAME, cell=CELL_PX, lbox=["bx0", "by0", "bx1", "by1"],
                     rbox=["qx0", "qy0", "qx1", "qy1"]).drop("bx0", "by0", "bx1", "by1", "qx0", "qy0", "qx1", "qy1")


def polygon_table(instances: DataFrame, cam: Camera = FISHEYE) -> DataFrame:
    """Instances (flat normalised ``polygon``) in pixels with area and bounds."""
    p = instances.withColumn("poly", G.polygon_pixels(F.col("polygon"), cam.width, cam.height)).filter("poly IS NOT NULL")
    xs, ys = F.col("poly.x"), F.col("poly.y")
    return p.withColumns({"area": G.polygon_area(F.col("poly")), "px0": F.array_min(xs), "py0": F.array_min(ys),
                          "px1": F.array_max(xs), "py1": F.array_max(ys)}).drop("polygon")


def cover_polygon(dets: DataFrame, polys: DataFrame) -> DataFrame:
    """The polygon that covers each detection: the smallest one containing its centre,
    else the nearest within its radius."""
    r = F.col("size") / 2.0
    d = dets.select(*DET, "u", "v", "size", (F.col("u") - r).alias("ex0"), (F.col("v") - r).alias("ey0"),
                    (F.col("u") + r).alias("ex1"), (F.col("v") + r).alias("ey1"))
    c = box_pairs(d, polys, FRAME, cell=CELL_PX, lbox=["ex0", "ey0", "ex1", "ey1"], rbox=["px0", "py0", "px1", "py1"])
    c = c.withColumn("sd", G.signed_distance(F.col("u"), F.col("v"), F.col("poly"))).filter(F.col("sd") >= -F.col("size") / 2.0)
    rank = F.when(F.col("sd") >= 0, F.struct(F.lit(0).alias("k"), F.col("area").alias("m"), F.col("poly_id").alias("i"))).otherwise(
        F.struct(F.lit(1).alias("k"), (-F.col("sd")).alias("m"), F.col("poly_id").alias("i")))
    return c.groupBy(*DET).agg(F.min_by(F.struct("poly_id", "poly", "px0", "py0", "px1", "py1"), rank).alias("p")).select(
        *DET, "p.*")


def instance_gate(dets: DataFrame, points: DataFrame, polys: DataFrame, cam: Camera = FISHEYE, margin_px: float = 12.0) -> DataFrame:
    """Pairs by the covering polygon dilated by ``margin_px``; detections without one use
    the padded box.  Adds ``gate``."""
    cover = cover_polygon(dets, polys)
    boxed = box_gate(dets.join(cover.select(*DET), DET, "left_anti"), points, cam).withColumn("gate", F.lit("box"))
    m = F.lit(margin_px)
    c = cover.withColumns({"px0": F.col("px0") - m, "py0": F.col("py0") - m, "px1": F.col("px1") + m, "py1": F.col("py1") + m})
    inst = box_pairs(c, _point_box(points), FRAME, cell=CELL_PX, lbox=["px0", "py0", "px1", "py1"],
                     rbox=["qx0", "qy0", "qx1", "qy1"])
    inst = inst.filter(G.signed_distance(F.col("pu"), F.col("pv"), F.col("poly")) >= -m)
    cols = [*DET, "point_id", "x", "y", "pu", "pv"]
    inst = inst.select(*cols).join(dets, DET).withColumn("gate", F.lit("instance"))
    return boxed.unionByName(inst.select(*boxed.columns))


def aggregate_matches(dets: DataFrame, pairs: DataFrame, min_points: int = 1, how: str = "min") -> DataFrame:
    """Per detection: matched returns, forward range and median bearing."""
    rng = F.median("y") if how == "median" else F.min("y")
    g = pairs.groupBy(*DET).agg(F.count("*").alias("n"), rng.alias("r"), F.degrees(F.median(F.atan2("x", "y"))).alias("b"))
    ok = F.col("n") >= min_points
    return dets.join(g, DET, "left").withColumns({
        "radar_hits": F.coalesce("n", F.lit(0)).cast("bigint"), "radar_range_m": F.when(ok, F.col("r")),
        "radar_bearing_deg": F.when(ok, F.col("b"))}).drop("n", "r", "b")


def arbitrate_ranges(matched: DataFrame, pairs: DataFrame, runs: DataFrame, *, compat: float = 0.5, how: str = "min",
                     override: bool = True) -> DataFrame:
    """Returns on the object's own obstacle pixels re-aggregate the range; otherwise a
    radar range far below the camera's raw range is a foreground return and is dropped.
    ``runs``: obstacle runs (frame, col, row0, row1)."""
    p = pairs.select(*DET, "point_id", "y", F.bround("pu").cast("bigint").alias("col"), F.bround("pv").cast("bigint").alias("__row"))
    on = p.join(runs, FRAME + ["col"]).filter(F.col("__row").between(F.col("row0"), F.col("row1")))
    on = on.select(*DET, "point_id", "y").distinct()
    agg = F.median("y") if how == "median" else F.min("y")
    on = on.groupBy(*DET).agg(agg.alias("own_range_m"))
    raw, rr = F.col("raw_range_m"), F.col("radar_range_m")
    kept = (F.when(rr.isNull(), None).when(F.col("own_range_m").isNotNull(), F.col("own_range_m"))
            .when(F.lit(compat > 0) & (raw.isNull() | (rr < compat * raw)), None).otherwise(rr))
    out = matched.join(on, DET, "left").withColumn("radar_range_m", kept).drop("own_range_m").withColumn("mono_range_m", F.col("range_m"))
    return out.withColumn("range_m", F.coalesce("radar_range_m", "range_m")) if override else out


def radar_veto(dets: DataFrame, radar_frames: DataFrame, lo: float = 1.0, hi: float = 8.0, max_bearing: float = 50.0) -> DataFrame:
    """A near camera range with no radar return in its box is dropped, in frames where the
    radar reported points.  ``radar_frames``: distinct frames with filtered points."""
    d = dets.join(radar_frames.select(*FRAME, F.lit(True).alias("__live")), FRAME, "left")
    bad = (F.col("__live") & (F.col("radar_hits") == 0) & F.col("range_m").between(lo, hi) & (F.abs("angle_deg") <= max_bearing))
    return d.withColumn("range_m", F.when(~F.coalesce(bad, F.lit(False)), F.col("range_m"))).drop("__live")


def confirmed_bins(dets: DataFrame, pairs: DataFrame, grid: BinGrid = GRID, same_bin: bool = True) -> DataFrame:
    """Bins that hold the returns of a ranged detection, given that the detection's own bin
    is among them; with the nearest such return."""
    live = dets.filter(F.col("radar_range_m").isNotNull()).select(*DET, M.bin_of(F.col("angle_deg"), grid).alias("det_bin"))
    occ = pairs.withColumn("bin_index", M.bin_of(M.azimuth(F.col("x"), F.col("y")), grid)).filter("bin_index IS NOT NULL")
    occ = occ.groupBy(*DET, "bin_index").agg(F.min("y").alias("r"))
    if same_bin:
        own = occ.join(live, DET).filter("bin_index = det_bin").select(*DET)
        occ = occ.join(own, DET, "left_semi")
    else:
        occ = occ.join(live, DET, "left_semi")
    return occ.groupBy(*FRAME, "bin_index").agg(F.min("r").alias("confirmed_range_m"))


def angular_association(dets: DataFrame, polar: DataFrame, tol_deg: float) -> DataFrame:
    """Per detection: radar bearings within the tolerance, their number and nearest range."""
    def cell(c):
        return F.floor(c / F.lit(tol_deg)).cast("bigint")

    d = dets.withColumn("__c", F.explode(F.sequence(cell(F.col("angle_deg")) - 1, cell(F.col("angle_deg")) + 1)))
    p = polar.select(*FRAME, F.col("angle_deg").alias("pa"), "range_m", cell(F.col("angle_deg")).alias("__c"))
    m = d.select(*DET, "angle_deg", "__c").join(p, FRAME + ["__c"]).filter(F.abs(F.col("pa") - F.col("angle_deg")) <= tol_deg)
    g = m.groupBy(*DET).agg(F.count("*").alias("n"), F.min("range_m").alias("near"))
    return dets.join(g, DET, "left").withColumns({"n_radar": F.coalesce("n", F.lit(0)).cast("bigint"), "near_radar_m": F.col("near")}).drop("n", "near")


def detection_bins(dets: DataFrame, prefix: str, grid: BinGrid = GRID) -> DataFrame:
    """Per-bin evidence of a camera's detections."""
    d = dets.withColumn("bin_index", M.bin_of(F.col("angle_deg"), grid)).filter("bin_index IS NOT NULL")
    return d.groupBy(*FRAME, "bin_index").agg(
        F.count("*").alias(f"{prefix}_det_count"), F.max("size").alias(f"{prefix}_det_max_size_px"),
        F.min("range_m").alias(f"{prefix}_det_min_range_m"), F.min("raw_range_m").alias(f"{prefix}_det_min_raw_range_m"),
        F.count_if("vote").alias(f"{prefix}_det_votes"), F.sum("radar_hits").alias(f"{prefix}_det_radar_hits"),
        F.min("radar_range_m").alias(f"{prefix}_det_min_radar_range_m"))


def typed_bins(boxes: DataFrame, frames: DataFrame, cam: Camera = FISHEYE, grid: BinGrid = GRID) -> DataFrame:
    """Per-bin typed detections: highest confidence and its class (first wins a tie).
    ``boxes`` holds null (no record) or an array per frame; presence is kept apart."""
    b = boxes.filter(F.col("boxes").isNotNull())
    e = b.select(*FRAME, F.posexplode("boxes").alias("pos", "b"))
    mid = (F.col("b.x0") + F.col("b.x1")) / 2.0 * cam.width
    e = e.withColumn("bin_index", M.bin_of(G.bearing_pinhole(mid, cam), grid)).filter("bin_index IS NOT NULL")
    top = F.struct(F.col("b.confidence").alias("c"), (-F.col("pos")).alias("p"))
    g = e.groupBy(*FRAME, "bin_index").agg(F.max("b.confidence").alias("yolo_max_conf"), F.max_by("b.cls", top).alias("yolo_top_cls"))
    ran = b.select(*FRAME, F.lit(True).alias("ran")).distinct()
    return frames.join(ran, FRAME, "left").withColumn("bin_index", M.all_bins(grid)).join(g, FRAME + ["bin_index"], "left").select(
        *FRAME, "bin_index", F.coalesce("ran", F.lit(False)).alias("yolo_available"), "yolo_max_conf", "yolo_top_cls")
