"""Detection boxes: scoring, merging of teachers, suppression, crops, training export.

Box tables hold (clip_id, frame_index, box_id, cls, confidence, x0, y0, x1, y1).  All pair
work goes through grid cells, so only overlapping boxes meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.params import FISHEYE
from keelson.plans.joins import box_area, box_pairs, checked_join, iou, overlap_area
from keelson.plans.matching import greedy_match, suppress_chain

FRAME = ["clip_id", "frame_index"]
BOX = ["x0", "y0", "x1", "y1"]
RBOX = ["rx0", "ry0", "rx1", "ry1"]

# fixed values: canonical class folds
CANONICAL = {"boat_ship": "boat", "row_boats": "boat", "swimmer": "person", "paddle_board": "float"}


def _right(boxes: DataFrame, *extra: str) -> DataFrame:
    return boxes.select(*FRAME, F.col("box_id").alias("r_id"), F.col("cls").alias("r_cls"), F.col("confidence").alias("r_conf"),
                        *[F.col(a).alias(b) for a, b in zip(BOX, RBOX)], *[F.col(e).alias(f"r_{e}") for e in extra])


def remap_ids(boxes: DataFrame, mapping: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Original frame ids to evaluation ids; unmapped ids stay."""
    m = mapping.select(F.col("original").alias(frame), F.col("mapped").alias("__m"))
    return checked_join(boxes, m, [frame], "left").withColumn(frame, F.coalesce("__m", frame)).drop("__m")


def exclude_ids(rows: DataFrame, ids: DataFrame, on: str = "frame_id") -> DataFrame:
    return checked_join(rows, ids.select(on).distinct(), [on], "left_anti")


def score_boxes(pred: DataFrame, truth: DataFrame, *, thr: float = 0.5, agnostic: bool = False, cell: float = 128.0) -> DataFrame:
    """tp/fp/fn and precision/recall/F1 per class over annotated frames.  Predictions by
    confidence take the best unused truth of their class with enough overlap."""
    if agnostic:
        pred, truth = (d.withColumn("cls", F.lit("obstacle")) for d in (pred, truth))
    annotated = truth.select(*FRAME).distinct()
    pred = pred.join(annotated, FRAME, "left_semi")
    p = box_pairs(pred, _right(truth), FRAME, cell=cell, lbox=BOX, rbox=RBOX).filter("cls = r_cls")
    p = p.withColumn("iou", iou(BOX, RBOX)).filter(F.col("iou") >= thr)
    won = greedy_match(p, FRAME + ["cls"], "box_id", "r_id",
                       [-F.col("confidence"), F.col("box_id"), -F.col("iou"), -F.col("r_id")])
    tp = won.groupBy("cls").agg(F.count("*").alias("tp"))
    n = pred.groupBy("cls").agg(F.count("*").alias("np")).join(truth.groupBy("cls").agg(F.count("*").alias("nt")), "cls", "full_outer")
    d = n.join(tp, "cls", "left").select("cls", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("np", "nt", "tp")])
    pr = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)
    rc = F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).otherwise(0.0)
    return d.select("cls", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"),
                    pr.alias("precision"), rc.alias("recall"), F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0).alias("f1"))


def merge_teachers(a: DataFrame, b: DataFrame, *, thr: float = 0.5, cell: float = 128.0) -> DataFrame:
    """Union of two teachers' boxes: per class, each box of the first (in order) pairs with
    the best unused box of the second; a pair collapses to the more confident box."""
    p = box_pairs(a, _right(b), FRAME, cell=cell, lbox=BOX, rbox=RBOX).filter("cls = r_cls")
    p = p.withColumn("iou", iou(BOX, RBOX)).filter((F.col("iou") >= thr) & (F.col("iou") > 0))
    won = greedy_match(p, FRAME, "box_id", "r_id", [F.col("box_id"), -F.col("iou"), F.col("r_id")])
    both = p.join(won, FRAME + ["box_id", "r_id"])
    keep_a = F.col("confidence") >= F.col("r_conf")
    merged = both.select(
        *FRAME, F.when(keep_a, F.col("box_id")).otherwise(F.col("r_id")).alias("box_id"), "cls",
        F.greatest("confidence", "r_conf").alias("confidence"), F.least("confidence", "r_conf").alias("confidence_other"),
        *[F.when(keep_a, F.col(x)).otherwise(F.col(r)).alias(x) for x, r in zip(BOX, RBOX)],
        F.lit("both").alias("source"), F.lit(True).alias("agree"), F.round("iou", 3).alias("iou_between"))
    none = F.lit(None).cast("double")

    def alone(d: DataFrame, key: str, name: str) -> DataFrame:
        used = won.select(*FRAME, F.col(key).alias("box_id"))
        return d.join(used, FRAME + ["box_id"], "left_anti").select(
            *FRAME, "box_id", "cls", "confidence", none.alias("confidence_other"), *BOX, F.lit(name).alias("source"),
            F.lit(False).alias("agree"), none.alias("iou_between"))

    return merged.unionByName(alone(a, "box_id", "a")).unionByName(alone(b, "r_id", "b"))


def merge_stats(a: DataFrame, b: DataFrame, merged: DataFrame) -> DataFrame:
    """Frames by teacher, boxes in and out, agreements (one row)."""
    fa = a.groupBy(*FRAME).agg(F.count("*").alias("na"))
    fb = b.groupBy(*FRAME).agg(F.count("*").alias("nb"))
    fm = merged.groupBy(*FRAME).agg(F.count("*").alias("nm"), F.count_if("agree").alias("ag"))
    j = fa.join(fb, FRAME, "full_outer").join(fm, FRAME, "left")
    both = F.col("na").isNotNull() & F.col("nb").isNotNull()
    return j.agg(F.count("*").alias("frames"), F.count_if(F.col("nb").isNull()).alias("only_a"), F.count_if(F.col("na").isNull()).alias("only_b"),
                 F.count_if(both).alias("both_frames"), F.sum("na").alias("boxes_a"), F.sum("nb").alias("boxes_b"),
                 F.sum("nm").alias("boxes_out"), F.sum("ag").alias("agreed"))


def nms(boxes: DataFrame, thr: float = 0.6, cell: float = 128.0) -> DataFrame:
    """Per-class suppression: a box falls to a kept, more confident box that overlaps it."""
    p = box_pairs(boxes, _right(boxes), FRAME, cell=cell, lbox=BOX, rbox=RBOX).filter("cls = r_cls AND box_id <> r_id")
    above = F.struct(-F.col("confidence"), F.col("box_id")) < F.struct(-F.col("r_conf"), F.col("r_id"))
    edges = p.filter(above & (iou(BOX, RBOX) >= thr)).select(*FRAME, F.col("box_id").alias("over"), F.col("r_id").alias("box_id"))
    return suppress_chain(boxes, edges, FRAME, "box_id", "over")


def apply_suppressors(boxes: DataFrame, suppressors: DataFrame, thr: float = 0.5, cell: float = 128.0) -> DataFrame:
    """Drops boxes of a suppressor's target classes that it overlaps (intersection over
    the smaller area)."""
    p = box_pairs(boxes, _right(suppressors, "targets"), FRAME, cell=cell, lbox=BOX, rbox=RBOX)
    small = F.least(box_area(BOX), box_area(RBOX))
    ios = F.when(small > 0, overlap_area(BOX, RBOX) / small).otherwise(0.0)
    bad = p.filter(F.array_contains("r_targets", F.col("cls")) & (ios >= thr)).select(*FRAME, "box_id").distinct()
    return boxes.join(bad, FRAME + ["box_id"], "left_anti")


def drop_covered(boxes: DataFrame, inner: str = "structure", outer: str = "boat", thr: float = 0.8, cell: float = 128.0) -> DataFrame:
    """Drops ``inner`` boxes mostly inside one ``outer`` box."""
    p = box_pairs(boxes.filter(F.col("cls") == inner), _right(boxes.filter(F.col("cls") == outer)), FRAME, cell=cell, lbox=BOX, rbox=RBOX)
    bad = p.filter(overlap_area(BOX, RBOX) / F.greatest(F.lit(1e-9), box_area(BOX)) >= thr).select(*FRAME, "box_id").distinct()
    return boxes.join(bad, FRAME + ["box_id"], "left_anti")


def reflections(boxes: DataFrame, water_min: float = 0.85, overlap_min: float = 0.5, strip: float = 64.0, height: float = 648.0) -> DataFrame:
    """Boxes on water under a same-class box that is not: ``water`` is the share of water
    pixels of each box."""
    low = boxes.filter(F.col("water") >= water_min)
    up = _right(boxes.filter(F.col("water") < water_min))
    # the partner may sit anywhere above: compare full-height columns of the image
    tall = ["x0", "__t", "x1", "__b"]
    rtall = ["rx0", "__rt", "rx1", "__rb"]
    low = low.withColumn("__t", F.lit(0.0)).withColumn("__b", F.lit(0.0))
    up = up.withColumn("__rt", F.lit(0.0)).withColumn("__rb", F.lit(0.0))
    p = box_pairs(low, up, FRAME, cell=strip, lbox=tall, rbox=rtall).filter("cls = r_cls")
    inter = F.least("x1", "rx1") - F.greatest("x0", "rx0")
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("rx1") - F.col("rx0"))
    share = F.when((narrow > 0) & (inter > 0), inter / narrow).otherwise(0.0)
    above = F.col("ry1") <= (F.col("y0") + F.col("y1")) / 2
    return p.filter(above & (share >= overlap_min)).select(*FRAME, "box_id").distinct()


def map_class(label: Column, phrases: dict[str, str]) -> Column:
    """Canonical class of a phrase: exact, else the first phrase that contains it or is
    contained in it, else null."""
    s = F.lower(F.trim(label))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in phrases.items()])
    exact = F.filter(table, lambda e: e["k"] == s)
    near = F.filter(table, lambda e: s.contains(e["k"]) | e["k"].contains(s))
    return F.coalesce(F.get(exact, F.lit(0))["v"], F.get(near, F.lit(0))["v"])


def canonical(cls: Column) -> Column:
    out = cls
    for k, v in CANONICAL.items():
        out = F.when(cls == k, v).otherwise(out)
    return out


def crop_rect(x0: Column, y0: Column, x1: Column, y1: Column, *, w: int = FISHEYE.width, h: int = FISHEYE.height,
              pad: float = 0.15, min_side: int = 16) -> Column:
    """Padded pixel rectangle of a normalised box; null when inverted or too small."""
    pw, ph = (x1 - x0) * w * pad, (y1 - y0) * h * pad
    a = F.greatest(F.lit(0), F.bround(x0 * w - pw).cast("int"))
    b = F.greatest(F.lit(0), F.bround(y0 * h - ph).cast("int"))
    c = F.least(F.lit(w), F.bround(x1 * w + pw).cast("int"))
    d = F.least(F.lit(h), F.bround(y1 * h + ph).cast("int"))
    ok = (x1 > x0) & (y1 > y0) & (c - a >= 1) & (d - b >= 1) & (F.greatest(c - a, d - b) >= min_side)
    return F.when(ok, F.struct(a.alias("px0"), b.alias("py0"), c.alias("px1"), d.alias("py1")))


def crop_id(frame_id: Column, box_idx: Column) -> Column:
    return F.sha1(F.concat_ws("|", frame_id, box_idx.cast("string")).cast("binary"))


def yolo_line(cls_index: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls_index.cast("int"), (x0 + x1) / 2.0, (y0 + y1) / 2.0, x1 - x0, y1 - y0)
