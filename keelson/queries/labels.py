"""Box scoring, label merging, suppression, review and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.fixtures import view
from keelson.functions.rounding import r6, tidy
from keelson.operators import boxes as B
from keelson.operators import review as V
from keelson.queries.catalog import query
from keelson.queries.sectors import SC, scored

BX = """, bx AS (SELECT clip_id, CAST(floor(frame_index / 5e0) AS BIGINT) AS frame_index, det_id AS box_id, CASE WHEN det_id % 2 = 0 THEN cls ELSE 'boat' END AS cls, sensor, confidence,
 u - size * 3e0 AS x0, v - size * 2e0 AS y0, u + size * 3e0 AS x1, v + size * 2e0 AS y1, size FROM fx_det)"""
IOU = "(greatest(0e0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0e0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"
AREA = "(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def iou_sql(a, b):
    i = IOU.format(a=a, b=b)
    return f"({i} / ({AREA.format(a=a)} + {AREA.format(a=b)} - {i}))"


def boxes(spark, sf):
    return view(spark, sf, "fx_det").selectExpr(
        "clip_id", "CAST(floor(frame_index / 5e0) AS BIGINT) AS frame_index", "det_id AS box_id",
        "CASE WHEN det_id % 2 = 0 THEN cls ELSE 'boat' END AS cls", "sensor", "confidence",
        "u - size * 3e0 AS x0", "v - size * 2e0 AS y0", "u + size * 3e0 AS x1", "v + size * 2e0 AS y1", "size")


def _pair(spark, sf):
    d = boxes(spark, sf)
    return d.filter("sensor = 'fisheye'"), d.filter("sensor = 'thermal'")


GREEDY = """ls AS (SELECT {g}, list({{'l': box_id, 'r': r_id}} ORDER BY {o}) AS ps FROM pr GROUP BY {g}),
m AS (SELECT {g}, list_reduce(list_transform(ps, lambda q: [q]), lambda a, q: CASE WHEN len(list_filter(a, lambda z: z.l = q[1].l OR z.r = q[1].r)) = 0 THEN list_concat(a, q) ELSE a END) AS won FROM ls),
u AS (SELECT {g}, unnest(won) AS w FROM m)"""


@query("J15_box_scoring", "fx_det", sql=BX + f""", pd AS (SELECT * FROM bx WHERE sensor = 'fisheye' AND (clip_id, frame_index) IN (SELECT (clip_id, frame_index) FROM bx WHERE sensor = 'thermal')), tr AS (SELECT * FROM bx WHERE sensor = 'thermal'),
pr AS (SELECT p.clip_id, p.frame_index, p.cls, p.box_id, p.confidence, t.box_id AS r_id, {iou_sql('p', 't')} AS v FROM pd p JOIN tr t ON p.clip_id = t.clip_id AND p.frame_index = t.frame_index AND p.cls = t.cls WHERE {iou_sql('p', 't')} >= 0.2e0),
""" + GREEDY.format(g="clip_id, frame_index, cls", o="-confidence, box_id, -v, -r_id") + """,
c AS (SELECT cls, CAST(sum(np) AS BIGINT) AS np, CAST(sum(nt) AS BIGINT) AS nt, CAST(sum(tp) AS BIGINT) AS tp FROM (SELECT cls, 1 AS np, 0 AS nt, 0 AS tp FROM pd UNION ALL SELECT cls, 0, 1, 0 FROM tr UNION ALL SELECT cls, 0, 0, 1 FROM u) GROUP BY 1)
SELECT cls, tp, np - tp AS fp, nt - tp AS fn, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 6) AS precision, round(CASE WHEN nt > 0 THEN tp / nt ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (np + nt) ELSE 0 END, 6) AS f1 FROM c""")
def box_scoring(spark, sf):
    p, t = _pair(spark, sf)
    return tidy(B.score_boxes(p, t, thr=0.2))


@query("J15_box_scoring_agnostic_J25_remap", "fx_det", sql=BX + f""", pd AS (SELECT clip_id, CASE WHEN frame_index % 7 = 0 THEN frame_index + 1 ELSE frame_index END AS frame_index, box_id, confidence, x0, y0, x1, y1 FROM bx WHERE sensor = 'fisheye'),
tr AS (SELECT * FROM bx WHERE sensor = 'thermal' AND frame_index % 11 > 0),
pa AS (SELECT * FROM pd WHERE (clip_id, frame_index) IN (SELECT (clip_id, frame_index) FROM tr)),
pr AS (SELECT p.clip_id, p.frame_index, p.box_id, p.confidence, t.box_id AS r_id, {iou_sql('p', 't')} AS v FROM pa p JOIN tr t ON p.clip_id = t.clip_id AND p.frame_index = t.frame_index WHERE {iou_sql('p', 't')} >= 0.2e0),
""" + GREEDY.format(g="clip_id, frame_index", o="-confidence, box_id, -v, -r_id") + """
SELECT 'obstacle' AS cls, (SELECT count(*) FROM u) AS tp, (SELECT count(*) FROM pa) - (SELECT count(*) FROM u) AS fp, (SELECT count(*) FROM tr) - (SELECT count(*) FROM u) AS fn""")
def box_scoring_agnostic(spark, sf):
    p, t = _pair(spark, sf)
    fid = F.concat_ws("|", "clip_id", F.col("frame_index").cast("string"))
    ids = p.select("clip_id", "frame_index").distinct()
    mapping = ids.filter("frame_index % 7 = 0").select(fid.alias("original"), F.concat_ws("|", "clip_id", (F.col("frame_index") + 1).cast("string")).alias("mapped"))
    p = B.remap_ids(p.withColumn("frame_id", fid), mapping)
    p = p.withColumn("frame_index", F.split("frame_id", r"\|")[1].cast("bigint")).drop("frame_id")
    out = t.select("clip_id", "frame_index").distinct().filter("frame_index % 11 = 0").select(fid.alias("frame_id"))
    t = B.exclude_ids(t.withColumn("frame_id", fid), out).drop("frame_id")
    return B.score_boxes(p, t, thr=0.2, agnostic=True).select("cls", "tp", "fp", "fn")


MERGE = BX + f""", a AS (SELECT * FROM bx WHERE sensor = 'fisheye'), b AS (SELECT * FROM bx WHERE sensor = 'thermal'),
pr AS (SELECT p.clip_id, p.frame_index, p.box_id, t.box_id AS r_id, p.confidence AS pc, t.confidence AS tc, {iou_sql('p', 't')} AS v FROM a p JOIN b t ON p.clip_id = t.clip_id AND p.frame_index = t.frame_index AND p.cls = t.cls WHERE {iou_sql('p', 't')} >= 0.3e0),
""" + GREEDY.format(g="clip_id, frame_index", o="box_id, -v, r_id") + """,
mg AS (SELECT CASE WHEN pc >= tc THEN box_id ELSE r_id END AS box_id, greatest(pc, tc) AS confidence, 'both' AS source, true AS agree, round(v, 3) AS iou_between FROM pr JOIN u ON u.clip_id = pr.clip_id AND u.frame_index = pr.frame_index AND u.w.l = box_id AND u.w.r = r_id
 UNION ALL SELECT box_id, confidence, 'a', false, NULL FROM a WHERE box_id NOT IN (SELECT w.l FROM u) UNION ALL SELECT box_id, confidence, 'b', false, NULL FROM b WHERE box_id NOT IN (SELECT w.r FROM u))"""


@query("J16_teacher_merge", "fx_det", sql=MERGE + " SELECT * FROM mg")
def teacher_merge(spark, sf):
    a, b = _pair(spark, sf)
    return B.merge_teachers(a, b, thr=0.3).select("box_id", "confidence", "source", "agree", "iou_between")


@query("J16_teacher_merge_stats", "fx_det", sql=MERGE + """, f AS (SELECT clip_id, frame_index, count(*) FILTER (sensor = 'fisheye') AS na, count(*) FILTER (sensor = 'thermal') AS nb FROM bx GROUP BY 1, 2)
SELECT count(*) AS frames, count(*) FILTER (nb = 0) AS only_a, count(*) FILTER (na = 0) AS only_b, count(*) FILTER (na > 0 AND nb > 0) AS both_frames, CAST(sum(na) AS BIGINT) AS boxes_a, CAST(sum(nb) AS BIGINT) AS boxes_b, (SELECT count(*) FROM mg) AS boxes_out, (SELECT count(*) FROM mg WHERE agree) AS agreed FROM f""")
def teacher_stats(spark, sf):
    a, b = _pair(spark, sf)
    return B.merge_stats(a, b, B.merge_teachers(a, b, thr=0.3))


@query("J17_nms", "fx_det", sql=BX + """, ls AS (SELECT clip_id, frame_index, cls, list({'id': box_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY -confidence, box_id) AS bs FROM bx GROUP BY 1, 2, 3),
k AS (SELECT list_reduce(list_transform(bs, lambda q: [q]), lambda a, q: CASE WHEN len(list_filter(a, lambda z: """ +
       "(greatest(0e0, least(z.x1, q[1].x1) - greatest(z.x0, q[1].x0)) * greatest(0e0, least(z.y1, q[1].y1) - greatest(z.y0, q[1].y0))) / ((z.x1 - z.x0) * (z.y1 - z.y0) + (q[1].x1 - q[1].x0) * (q[1].y1 - q[1].y0) - (greatest(0e0, least(z.x1, q[1].x1) - greatest(z.x0, q[1].x0)) * greatest(0e0, least(z.y1, q[1].y1) - greatest(z.y0, q[1].y0)))) >= 0.15e0" +
       """)) = 0 THEN list_concat(a, q) ELSE a END) AS kept FROM ls)
SELECT unnest(kept).id AS box_id FROM k""")
def nms(spark, sf):
    return B.nms(boxes(spark, sf), 0.15).select("box_id")


@query("J17_suppression_filters", "fx_det", sql=BX + f""", wt AS (SELECT *, (box_id * 7 % 20) / 20e0 AS water FROM bx),
sp AS (SELECT b.box_id FROM wt b JOIN wt s ON s.clip_id = b.clip_id AND s.frame_index = b.frame_index AND s.cls = 'duck' AND b.cls IN ('person', 'buoy') AND {IOU.format(a='b', b='s')} / least({AREA.format(a='b')}, {AREA.format(a='s')}) >= 0.3),
cv AS (SELECT b.box_id FROM wt b JOIN wt s ON s.clip_id = b.clip_id AND s.frame_index = b.frame_index AND s.cls = 'boat' AND b.cls = 'structure' AND {IOU.format(a='b', b='s')} / {AREA.format(a='b')} >= 0.3),
rf AS (SELECT b.box_id FROM wt b JOIN wt s ON s.clip_id = b.clip_id AND s.frame_index = b.frame_index AND s.cls = b.cls AND b.water >= 0.85 AND s.water < 0.85 AND s.y1 <= (b.y0 + b.y1) / 2 AND least(b.x1, s.x1) - greatest(b.x0, s.x0) > 0 AND (least(b.x1, s.x1) - greatest(b.x0, s.x0)) / least(b.x1 - b.x0, s.x1 - s.x0) >= 0.5)
SELECT box_id, box_id IN (SELECT box_id FROM sp) AS suppressed, box_id IN (SELECT box_id FROM cv) AS covered, box_id IN (SELECT box_id FROM rf) AS reflection FROM wt""")
def suppression(spark, sf):
    d = boxes(spark, sf).withColumn("water", F.col("box_id") * 7 % 20 / 20.0)
    sup = d.filter("cls = 'duck'").withColumn("targets", F.array(F.lit("person"), F.lit("buoy")))
    alive = B.apply_suppressors(d, sup, 0.3).select("box_id", F.lit(False).alias("suppressed"))
    uncovered = B.drop_covered(d, thr=0.3).select("box_id", F.lit(False).alias("covered"))
    refl = B.reflections(d).select("box_id", F.lit(True).alias("reflection"))
    j = d.select("box_id").join(alive, "box_id", "left").join(uncovered, "box_id", "left").join(refl, "box_id", "left")
    return j.select("box_id", F.coalesce("suppressed", F.lit(True)).alias("suppressed"), F.coalesce("covered", F.lit(True)).alias("covered"),
                    F.coalesce("reflection", F.lit(False)).alias("reflection"))


PHRASES = {"boat": "boat", "buoy": "buoy", "person in water": "person", "dock": "structure"}


@query("P38_class_mapping", sql="""WITH p AS (SELECT p_partkey, lower(trim(CASE p_partkey % 7 WHEN 0 THEN ' Boat ' WHEN 1 THEN 'sail boat' WHEN 2 THEN 'person' WHEN 3 THEN 'docking pier' WHEN 4 THEN 'swimmer' WHEN 5 THEN 'bu' ELSE p_name END)) AS s FROM part)
SELECT p_partkey, CASE WHEN s = 'boat' THEN 'boat' WHEN s = 'buoy' THEN 'buoy' WHEN s = 'person in water' THEN 'person' WHEN s = 'dock' THEN 'structure' WHEN contains(s, 'boat') OR contains('boat', s) THEN 'boat' WHEN contains(s, 'buoy') OR contains('buoy', s) THEN 'buoy'
 WHEN contains(s, 'person in water') OR contains('person in water', s) THEN 'person' WHEN contains(s, 'dock') OR contains('dock', s) THEN 'structure' END AS cls, CASE s WHEN 'swimmer' THEN 'person' WHEN 'boat_ship' THEN 'boat' ELSE s END AS canon FROM p""")
def class_mapping(spark, sf):
    from keelson.fixtures import load
    s = F.expr("CASE p_partkey % 7 WHEN 0 THEN ' Boat ' WHEN 1 THEN 'sail boat' WHEN 2 THEN 'person' WHEN 3 THEN 'docking pier' WHEN 4 THEN 'swimmer' WHEN 5 THEN 'bu' ELSE p_name END")
    return load(spark, sf, "part").select("p_partkey", B.map_class(s, PHRASES).alias("cls"), B.canonical(F.lower(F.trim(s))).alias("canon"))


CROP = """, nb AS (SELECT det_id, concat(clip_id, '/', frame_index) AS fid, u / 864e0 AS x0, v / 648e0 AS y0, u / 864e0 + (size - 12) / 700e0 AS x1, v / 648e0 + size / 900e0 AS y1 FROM fx_det),
cr AS (SELECT *, greatest(0, CAST(round_even(x0 * 864 - (x1 - x0) * 864 * 0.15e0, 0) AS BIGINT)) AS a, greatest(0, CAST(round_even(y0 * 648 - (y1 - y0) * 648 * 0.15e0, 0) AS BIGINT)) AS b,
 least(864, CAST(round_even(x1 * 864 + (x1 - x0) * 864 * 0.15e0, 0) AS BIGINT)) AS c, least(648, CAST(round_even(y1 * 648 + (y1 - y0) * 648 * 0.15e0, 0) AS BIGINT)) AS d FROM nb),
ok AS (SELECT *, x1 > x0 AND y1 > y0 AND c - a >= 1 AND d - b >= 1 AND greatest(c - a, d - b) >= 16 AS good FROM cr)"""


def crops(spark, sf):
    d = view(spark, sf, "fx_det")
    x0, y0 = F.col("u") / 864.0, F.col("v") / 648.0
    r = B.crop_rect(x0, y0, x0 + (F.col("size") - 12) / 700.0, y0 + F.col("size") / 900.0)
    fid = F.concat_ws("/", "clip_id", F.col("frame_index").cast("string"))
    return d.select("det_id", "clip_id", "cls", "confidence", r.alias("r"), B.crop_id(fid, F.col("det_id")).alias("crop_id"))


@query("P39_crop_rectangles", "fx_det", sql=CROP + """ SELECT det_id, CASE WHEN good THEN a END AS px0, CASE WHEN good THEN b END AS py0, CASE WHEN good THEN c END AS px1, CASE WHEN good THEN d END AS py1, sha1(concat(fid, '|', det_id)) AS crop_id FROM ok""")
def crop_rectangles(spark, sf):
    return tidy(crops(spark, sf).select("det_id", "r.px0", "r.py0", "r.px1", "r.py1", "crop_id"))


@query("A42_crop_manifest_stats", "fx_det", sql=CROP + """, s AS (SELECT good, x1 > x0 AS upright, greatest(c - a, d - b) AS side FROM ok), q AS (SELECT side, row_number() OVER (ORDER BY side) - 1 AS rn, count(*) OVER () AS n FROM s WHERE good)
SELECT (SELECT count(*) FROM s) AS n_boxes, (SELECT count(*) FROM s WHERE good) AS n_crops, (SELECT count(*) FROM s WHERE NOT upright) AS n_inverted, (SELECT count(*) FROM s WHERE upright AND NOT good) AS n_small,
 max(CASE WHEN rn = CAST(floor(n * 0.1) AS BIGINT) THEN side END) AS p10, max(CASE WHEN rn = CAST(floor(n * 0.5) AS BIGINT) THEN side END) AS p50, max(CASE WHEN rn = CAST(floor(n * 0.9) AS BIGINT) THEN side END) AS p90 FROM q""")
def crop_stats(spark, sf):
    d = view(spark, sf, "fx_det").select((F.col("size") > 12).alias("upright"), "det_id").join(crops(spark, sf).select("det_id", "r"), "det_id")
    side = F.greatest(F.col("r.px1") - F.col("r.px0"), F.col("r.py1") - F.col("r.py0"))
    # nearest-rank quantiles from the histogram of sides (bounded by the image size)
    h = d.filter("r IS NOT NULL").groupBy(side.alias("side")).count()
    from pyspark.sql import Window as W
    w = W.orderBy("side").rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumn("cum", F.sum("count").over(w)).withColumn("n", F.sum("count").over(W.partitionBy()))
    qs = h.agg(*[F.min(F.when(F.col("cum") > F.floor(F.col("n") * q), F.col("side"))).cast("bigint").alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)])
    c = d.agg(F.count("*").alias("n_boxes"), F.count("r").alias("n_crops"), F.count_if(~F.col("upright")).alias("n_inverted"),
              F.count_if(F.col("upright") & F.col("r").isNull()).alias("n_small"))
    return c.withColumn("k", F.lit(1)).join(qs.withColumn("k", F.lit(1)), "k").drop("k")


AUD = SC + """, d AS (SELECT clip_id, frame_index, avg(abs(p - y)) + 0.5e0 * max(abs(p - y) * (p * 0.5e0)) AS s, arg_min({'c': bin_center_deg, 'p': p, 'y': y}, [-abs(p - y), bin_center_deg]) AS w FROM sc GROUP BY 1, 2)"""


def label_records(spark, sf):
    from keelson.operators.sectors import to_records
    d = scored(spark, sf).withColumns({"threat": F.col("p") * 0.5, "yd": F.col("y").cast("double")})
    r = to_records(d, {"p": "p", "y": "yd", "threat": "threat", "centers": "bin_center_deg"}, {"t_ms": "t_ms"})
    return r.withColumn("frame_id", F.concat_ws("/", "clip_id", F.col("frame_index").cast("string")))


@query("J19_T01_audit_queue", "fx_scores", sql=AUD + """ SELECT concat(clip_id, '/', frame_index) AS frame_id, round(s, 4) AS disagreement, w.c AS worst_bin_deg, round(w.p, 3) AS p_at_worst, CAST(w.y AS DOUBLE) AS label_at_worst FROM d ORDER BY round(s, 4) DESC, frame_id LIMIT 500""")
def audit_queue(spark, sf):
    return V.audit_queue(label_records(spark, sf), 500).withColumn("p_at_worst", F.round("p_at_worst", 3))


@query("T02_annotation_plan", "fx_scores")
def plan(spark, sf):
    r = label_records(spark, sf)
    y = F.when(F.col("frame_index") % 3 > 0, F.col("y"))
    c = r.select("clip_id", F.col("frame_index").alias("idx"), "frame_id", V.uncertainty(F.col("p"), y).alias("u"),
                 F.expr("CASE WHEN frame_index % 5 = 0 THEN array('duck') WHEN frame_index % 2 = 0 THEN array('boat', 'person') ELSE array() END").alias("classes"),
                 F.expr("array(concat('part:', frame_index % 4), concat('cloud:', frame_index % 3))").alias("cells"), (F.col("frame_index") % 3 > 0).alias("labelled"))
    return V.annotation_plan(c, 60)


@query("T02_uncertainty", "fx_scores", sql=""", f AS (SELECT clip_id, frame_index, avg(1 - abs(2 * p - 1)) AS e, avg(abs(p - y)) AS d FROM fx_scores GROUP BY 1, 2)
SELECT clip_id, frame_index, round(CASE WHEN frame_index % 3 > 0 THEN d + 0.4e0 * e ELSE 0.6e0 * e END, 6) AS u FROM f""")
def plan_uncertainty(spark, sf):
    r = label_records(spark, sf)
    return r.select("clip_id", "frame_index", r6(V.uncertainty(F.col("p"), F.when(F.col("frame_index") % 3 > 0, F.col("y"))), "u"))


@query("P45_condition_builder", "fx_scores", sql=""" SELECT row_id, ((hit_fisheye = 1 AND NOT hit_thermal = 1) OR hit_mmwave = 1) <> (p > 0.5) AS ok FROM fx_scores""")
def conditions(spark, sf):
    c = V.condition_holds([("AND", F.col("hit_fisheye") == 1, False), ("AND", F.col("hit_thermal") == 1, True),
                           ("OR", F.col("hit_mmwave") == 1, False), ("XOR", F.col("p") > 0.5, False)])
    return view(spark, sf, "fx_scores").select("row_id", c.alias("ok"))


@query("T04_review_order", "fx_det", sql=""", w AS (SELECT det_id, clip_id AS chunk, cls, confidence, size * 20e0 AS ww, size * 14e0 AS hh FROM fx_det),
b AS (SELECT *, ww * hh / (864e0 * 648) > 0.55 AS giant, CASE WHEN cls = 'boat' THEN 0 WHEN confidence < 0.8 THEN 1 ELSE 2 END AS bucket FROM w)
SELECT det_id, CAST(bucket AS BIGINT) AS bucket, giant, round(ww * hh, 6) AS area FROM b""")
def review(spark, sf):
    d = view(spark, sf, "fx_det").select("det_id", F.col("clip_id").alias("chunk"), F.col("det_id").alias("pos"), F.struct(
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("size") * 20.0).alias("x1"), (F.col("size") * 14.0).alias("y1")).alias("window"),
        F.when(F.col("cls") == "boat", "accept").otherwise("deny").alias("pred"), F.col("confidence").alias("pred_p"))
    return tidy(V.review_order(d).select("det_id", "bucket", "giant", "area"))


@query("T05_hard_negatives", "fx_scores", sql=SC + """, f AS (SELECT clip_id, frame_index, max(score) AS m, CAST(sum(hit_fisheye) AS BIGINT) AS hf FROM sc WHERE scene = 'Lake1' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS rn FROM f WHERE m >= 0.66)
SELECT clip_id, frame_index, round(m, 6) AS max_score, hf AS hits_fisheye FROM r WHERE rn <= 20""")
def hard_neg(spark, sf):
    return tidy(V.hard_negatives(scored(spark, sf), "Lake1", 0.66, 20).select("clip_id", "frame_index", "max_score", "hits_fisheye"))


@query("T06_every_nth", "fx_radar", sql=""", f AS (SELECT DISTINCT clip_id, frame_index FROM fx_radar), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) - 1 AS rn FROM f) SELECT clip_id, frame_index FROM r WHERE rn % 3 = 0""")
def nth(spark, sf):
    return V.every_nth(view(spark, sf, "fx_radar").select("clip_id", "frame_index").distinct(), ["clip_id"], "frame_index", 3)


@query("K04_U01_training_export", "fx_det", sql=""", fr AS (SELECT concat(clip_id, '/', frame_index) AS frame_id, min(det_id) AS pos, count(*) FILTER (sensor = 'fisheye') AS nh FROM fx_det GROUP BY 1),
h AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS o FROM fr WHERE nh >= 3), p0 AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS o, count(*) OVER () AS n FROM fr WHERE nh < 3 AND pos % 10 > 0),
it AS (SELECT frame_id, 'val' AS split, 0 AS copy FROM h WHERE o % 5 = 0 UNION ALL SELECT frame_id, 'train', unnest([0, 1]) FROM h WHERE o % 5 > 0 UNION ALL SELECT frame_id, 'train', 0 FROM p0 WHERE o % greatest(1, n // 50) = 0 AND o < greatest(1, n // 50) * 50),
ln AS (SELECT concat(clip_id, '/', frame_index) AS frame_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', CASE cls WHEN 'boat' THEN 0 WHEN 'buoy' THEN 1 ELSE 2 END, u / 1000e0, v / 1000e0, size / 500e0, size / 1000e0), chr(10) ORDER BY det_id) AS text FROM fx_det WHERE cls IN ('boat', 'buoy', 'person') GROUP BY 1)
SELECT it.frame_id, split, CAST(copy AS BIGINT) AS copy, coalesce(text, '') AS text FROM it LEFT JOIN ln USING (frame_id)""")
def training_export(spark, sf):
    d = view(spark, sf, "fx_det").withColumn("frame_id", F.concat_ws("/", "clip_id", F.col("frame_index").cast("string")))
    fr = d.groupBy("frame_id").agg(F.min("det_id").alias("pos"), F.count_if(F.col("sensor") == "fisheye").alias("nh"))
    items = V.training_items(fr.filter("nh >= 3"), fr.filter("nh < 3"), pos="pos", slice_len=1000, human_repeat=2, pseudo_count=50,
                             exclude=fr.filter("pos % 10 = 0"))
    u, v, s = F.col("u") / 1000.0, F.col("v") / 1000.0, F.col("size") / 1000.0
    bx = d.select("frame_id", F.col("det_id").alias("box_id"), "cls", (u - s).alias("x0"), (v - s / 2).alias("y0"), (u + s).alias("x1"), (v + s / 2).alias("y1"))
    return V.training_lines(items, bx, ["boat", "buoy", "person"]).select("frame_id", "split", F.col("copy").cast("bigint").alias("copy"), "text")


@query("U04_clip_holdout", "fx_scores", sql=""", c AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT clip_id FROM fx_scores))
SELECT f.clip_id, count(*) AS n, r > c.n - greatest(1, c.n // 5) AS held FROM fx_scores f JOIN c USING (clip_id) GROUP BY 1, 3""")
def clip_holdout(spark, sf):
    d = view(spark, sf, "fx_scores").withColumn("split", F.lit("train"))
    return V.holdout(d).groupBy("clip_id", "held").agg(F.count("*").alias("n"))
