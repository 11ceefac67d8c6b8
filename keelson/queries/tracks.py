"""Clustering, motion and tracking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.fixtures import view
from keelson.functions import motion as M
from keelson.functions.rounding import r6, tidy
from keelson.operators import association as AS
from keelson.operators import motion_eval as ME
from keelson.operators import radar as R
from keelson.operators import targets as T
from keelson.operators import tracking as K
from keelson.plans.ordered import nearest_asof
from keelson.queries.catalog import query
from keelson.queries.radar import GATED, _kept
from keelson.queries.sectors import SC, scored
from keelson.queries.vision import PAIRS, detections
from keelson.session import cut_lineage

CLUSTER = GATED + """, lab AS (SELECT clip_id, frame_index, point_id AS root, point_id FROM kept UNION SELECT l.clip_id, l.frame_index, l.root, q.point_id FROM lab l JOIN kept p ON p.clip_id = l.clip_id AND p.frame_index = l.frame_index AND p.point_id = l.point_id
 JOIN kept q ON q.clip_id = p.clip_id AND q.frame_index = p.frame_index AND sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) <= 1),
cl AS (SELECT clip_id, frame_index, point_id, min(root) AS cluster_id FROM lab GROUP BY 1, 2, 3)"""


def clustered(spark, sf):
    return K.cluster_points(R.with_polar(_kept(spark, sf)))


def observed(spark, sf):
    return K.cluster_observations(R.with_polar(_kept(spark, sf)))


@query("A13_A14_clusters", "fx_radar", sql=CLUSTER + """ SELECT clip_id, frame_index, cluster_id, count(*) AS n_points, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) AS cy, round(median((x * vx + y * vy) / sqrt(x*x + y*y)), 6) + 0.0 AS v_radial FROM cl JOIN pol USING (clip_id, frame_index, point_id) GROUP BY 1, 2, 3""")
def clusters(spark, sf):
    return tidy(observed(spark, sf))


def fold_sql(name: str, source: str, keys: str, order: str, frame: str, state: str, step: str) -> str:
    """A fold in SQL: each frame becomes a one-element list, and ``step`` appends the next state
    (``a[-1]`` is the one before, ``x[1]`` the frame)."""
    return f"""{name}_l AS (SELECT {keys}, list({{{frame}, {state}}} ORDER BY {order}) AS xs FROM {source} GROUP BY {keys}),
{name} AS (SELECT {keys}, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: list_append(a, {step}), xs[1:0])) AS z FROM {name}_l)"""


def let_sql(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def greedy_sql(pairs: str, left: str, right: str) -> str:
    """Sorted pairs taken one to one."""
    free = f"len(list_filter(b, lambda z: z.{left} = q[1].{left} OR z.{right} = q[1].{right})) = 0"
    return let_sql(f"list_sort({pairs})", "ps", f"list_reduce(list_transform(ps, lambda q: [q]), lambda b, q: CASE WHEN {free} THEN list_concat(b, q) ELSE b END, ps[1:0])")


_TR = "STRUCT(id BIGINT, x DOUBLE, y DOUBLE, v DOUBLE, h BIGINT, m BIGINT, c BIGINT, n BIGINT)"
_NEAR = "sqrt((t.x - o.cx) * (t.x - o.cx) + (t.y - o.cy) * (t.y - o.cy))"
_MOVE = (f"""{{'f': x[1].f, 't': x[1].t, 'ob': x[1].ob, 'tr': list_concat(list_filter(list_transform(a[-1].tr, lambda t: """
         + let_sql("list_filter(x[1].ob, lambda o: len(list_filter(w, lambda z: z.t = t.id AND z.o = o.c)) > 0)", "k", """CASE WHEN len(k) > 0
 THEN {'id': t.id, 'x': 0.5e0 * k[1].cx + 0.5e0 * t.x, 'y': 0.5e0 * k[1].cy + 0.5e0 * t.y, 'v': coalesce(0.5e0 * k[1].v + 0.5e0 * t.v, k[1].v, t.v), 'h': t.h + 1, 'm': 0, 'c': k[1].c, 'n': k[1].n}
 ELSE {'id': t.id, 'x': t.x, 'y': t.y, 'v': t.v, 'h': t.h, 'm': t.m + 1, 'c': -1, 'n': 0} END""") + """), lambda t: t.m < 5),
 list_transform(list_filter(x[1].ob, lambda o: len(list_filter(w, lambda z: z.o = o.c)) = 0), lambda o, i: {'id': a[-1].nx + i - 1, 'x': o.cx, 'y': o.cy, 'v': o.v, 'h': 1, 'm': 0, 'c': o.c, 'n': o.n})),
 'nx': a[-1].nx + len(list_filter(x[1].ob, lambda o: len(list_filter(w, lambda z: z.o = o.c)) = 0))}""")
_PAIRED = f"flatten(list_transform(a[-1].tr, lambda t: list_transform(list_filter(x[1].ob, lambda o: {_NEAR} <= 1.5e0), lambda o: {{'d': {_NEAR}, 't': t.id, 'o': o.c}})))"
# the first frame has no state before it: it is reduced against an empty one
TARGETS = CLUSTER + f""", ob AS (SELECT clip_id, frame_index, list({{'c': cluster_id, 'cx': cx, 'cy': cy, 'v': v, 'n': n}} ORDER BY cluster_id) AS ob FROM
 (SELECT clip_id, frame_index, cluster_id, avg(x) AS cx, avg(y) AS cy, median((x * vx + y * vy) / sqrt(x*x + y*y)) AS v, count(*) AS n FROM cl JOIN pol USING (clip_id, frame_index, point_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
ft AS (SELECT clip_id, frame_index, min(t_ms) AS t_ms FROM fx_radar GROUP BY 1, 2), fs AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY clip_id ORDER BY frame_index) AS dt FROM ft),
sg AS (SELECT clip_id, frame_index, t_ms, CAST(sum(CASE WHEN dt > 0 AND dt <= 500 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY frame_index) AS BIGINT) AS stretch FROM fs),
fo AS (SELECT sg.clip_id, stretch, frame_index, t_ms, coalesce(ob, []) AS ob FROM sg LEFT JOIN ob USING (clip_id, frame_index) UNION ALL SELECT clip_id, stretch, -1, 0, [] FROM sg GROUP BY 1, 2),
""" + fold_sql("fw", "fo", "clip_id, stretch", "frame_index", "'f': frame_index, 't': t_ms, 'ob': ob", f"'tr': []::{_TR}[], 'nx': 0::BIGINT",
               let_sql(greedy_sql(_PAIRED, "t", "o"), "w", _MOVE)).replace("list_transform(xs, lambda x: [x])", "list_transform(xs[2:], lambda x: [x])").replace("xs[1:0])) AS z", "xs[1:1])) AS z") + """,
tk AS (SELECT clip_id, stretch, z.f AS frame_index, z.t AS t_ms, unnest(z.tr) AS q FROM fw WHERE z.f >= 0),
tr AS (SELECT clip_id, stretch, frame_index, t_ms, q.id AS track_id, q.x AS x, q.y AS y, q.v AS v, q.h AS hits, q.n AS n_points, degrees(atan2(q.x, q.y)) AS bearing_deg, sqrt(q.x * q.x + q.y * q.y) AS range_m FROM tk WHERE q.m = 0)"""


def motion_sql(bearing: str = "bearing_deg", keys: str = "clip_id, stretch, track_id") -> str:
    """Rates, speeds, closest approach and state of ``tr``."""
    return f""", bd AS (SELECT *, {bearing} - lag({bearing}) OVER (PARTITION BY {keys} ORDER BY t_ms) AS raw FROM tr),
bu AS (SELECT *, sum(CASE WHEN raw IS NULL THEN {bearing} ELSE raw - 360 * ceil((raw - 180) / 360) END) OVER (PARTITION BY {keys} ORDER BY t_ms) AS un FROM bd),
bs AS (SELECT *, count(*) OVER w AS cnt, t_ms - min(t_ms) OVER w AS sp, regr_slope(un, t_ms / 1000e0) OVER w AS sl FROM bu WINDOW w AS (PARTITION BY {keys} ORDER BY t_ms RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW)),
br AS (SELECT *, CASE WHEN cnt >= 5 AND sp >= 1000 THEN sl END AS rate_dps FROM bs), bv AS (SELECT *, range_m * radians(rate_dps) AS vt FROM br),
bw AS (SELECT *, coalesce(v, 0) * sin(atan2(x, y)) + coalesce(vt, 0) * cos(atan2(x, y)) AS vx, coalesce(v, 0) * cos(atan2(x, y)) - coalesce(vt, 0) * sin(atan2(x, y)) AS vy FROM bv),
mo AS (SELECT *, sqrt(vx*vx + vy*vy) AS sq, -(x*vx + y*vy) / nullif(vx*vx + vy*vy, 0) AS tc, v IS NOT NULL OR vt IS NOT NULL AS known,
 CASE WHEN v IS NULL AND vt IS NULL THEN 'unknown' WHEN abs(vt) >= 0.3 THEN 'crossing' WHEN -v >= 0.15 THEN 'closing' WHEN -v <= -0.15 THEN 'diverging' ELSE 'static' END AS motion_state FROM bw)"""


#: speeds are often exactly half way between two fourth decimals: both engines round them up
HALF = "13e-8"
MOTION_COLS = ", ".join(f"round({x} + {HALF}, 4) + 0.0 AS {n}" for x, n in (
    ("range_m", "range_m"), ("bearing_deg", "bearing_deg"), ("rate_dps", "rate_dps"), ("v", "v_radial"), ("vt", "v_tangential"), ("CASE WHEN known THEN sq END", "speed"))) + ", motion_state"


def targets(spark, sf):
    return K.track_targets(observed(spark, sf), R.frame_counts(view(spark, sf, "fx_radar")))


def four(*names):
    return [(F.round(F.col(n) + float(HALF), 4) + F.lit(0.0)).alias(n) for n in names]


@query("W19_P43_target_motion", "fx_radar", sql=TARGETS + motion_sql() + f"""
SELECT clip_id, stretch, frame_index, track_id, hits, {MOTION_COLS}, round(CASE WHEN known AND sq >= 0.15 AND tc > 1e-9 THEN sqrt(pow(x + vx*tc, 2) + pow(y + vy*tc, 2)) END + {HALF}, 4) AS cpa_m, round(CASE WHEN known AND sq >= 0.15 AND tc > 1e-9 THEN least(tc, 60e0) END + {HALF}, 4) AS t_cpa_s
FROM mo WHERE hits >= 3""")
def target_motion(spark, sf):
    t = K.reported(K.motion_fields(targets(spark, sf)))
    # a target that moves across the line of sight is nearest now: the sign of the last bit does not count
    now = F.col("t_cpa_s") <= 1e-9
    t = t.withColumns({c: F.when(~now, F.col(c)) for c in ("cpa_m", "t_cpa_s")})
    return t.select("clip_id", "stretch", "frame_index", "track_id", "hits", *four("range_m", "bearing_deg", "rate_dps", "v_radial", "v_tangential", "speed", "cpa_m", "t_cpa_s"), "motion_state")


@query("T07_targets_by_range", "fx_radar", sql=TARGETS + """
SELECT clip_id, frame_index, CAST(row_number() OVER (PARTITION BY clip_id, frame_index ORDER BY range_m, track_id) AS INTEGER) AS place, track_id, round(range_m + 13e-8, 4) AS range_m FROM tr WHERE hits >= 3""")
def targets_by_range(spark, sf):
    t = K.reported(targets(spark, sf)).withColumn("range_m", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    return t.select("clip_id", "frame_index", "place", "track_id", *four("range_m"))


@query("W19_W10_stabilised_motion", "fx_radar", "fx_imu", sql=TARGETS.replace("tr AS (SELECT clip_id, stretch", "t0 AS (SELECT clip_id, stretch") + """,
ya AS (SELECT t.clip_id, t.frame_index, arg_max(yaw, i.t_ms) AS yaw FROM (SELECT DISTINCT clip_id, frame_index, t_ms FROM t0) t JOIN fx_imu i ON i.clip_id = t.clip_id AND i.t_ms <= t.t_ms AND i.t_ms >= t.t_ms - 300 GROUP BY 1, 2),
yt AS (SELECT t0.*, yaw, coalesce(bearing_deg + yaw, bearing_deg) AS stable, yaw IS NOT NULL AS ego FROM t0 LEFT JOIN ya USING (clip_id, frame_index)),
yf AS (SELECT *, lag(ego) OVER (PARTITION BY clip_id, stretch, track_id ORDER BY t_ms) AS was FROM yt),
tr AS (SELECT *, sum(CASE WHEN was <> ego THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, stretch, track_id ORDER BY t_ms) AS fit FROM yf)""" + motion_sql("stable", "clip_id, stretch, track_id, fit") + f"""
SELECT clip_id, stretch, frame_index, track_id, ego AS ego_corrected, {MOTION_COLS} FROM mo WHERE hits >= 3""")
def stabilised_motion(spark, sf):
    # read twice: once for its frames
    t = cut_lineage(targets(spark, sf))
    yaw = view(spark, sf, "fx_imu").select("clip_id", "t_ms", "yaw")
    near = nearest_asof(t.select("clip_id", "frame_index", "t_ms").distinct(), yaw, ["clip_id"], t="t_ms", payload=["yaw"], max_age=300.0, side="backward")
    d = K.motion_fields(t.join(near.select("clip_id", "frame_index", "yaw"), ["clip_id", "frame_index"]), yaw="yaw")
    d = K.reported(d)
    return d.select("clip_id", "stretch", "frame_index", "track_id", "ego_corrected", *four("range_m", "bearing_deg", "rate_dps", "v_radial", "v_tangential", "speed"), "motion_state")


@query("A07_target_bins", "fx_radar", sql=TARGETS + motion_sql() + """,
tb AS (SELECT *, CAST(floor((bearing_deg + 52.5) / 15) AS BIGINT) AS bin_index FROM mo WHERE hits >= 3 AND bearing_deg >= -52.5 AND bearing_deg < 52.5),
tn AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_index, bin_index ORDER BY range_m, track_id) AS rn FROM tb)
SELECT clip_id, frame_index, bin_index, track_id, round(range_m + 13e-8, 4) AS range_m, round(bearing_deg + 13e-8, 4) + 0.0 AS bearing_deg, round(-v + 13e-8, 4) + 0.0 AS closing_mps, motion_state FROM tn WHERE rn = 1""")
def target_bins(spark, sf):
    t = K.reported(K.motion_fields(targets(spark, sf)))
    b = T.targets_by_bin(t.select("clip_id", "frame_index", "track_id", "range_m", "bearing_deg", "closing_mps", "motion_state"))
    return b.select("clip_id", "frame_index", "bin_index", "track_id", *four("range_m", "bearing_deg", "closing_mps"), "motion_state")


@query("W10_bearing_rate", "fx_imu", sql=""", b AS (SELECT clip_id, t_ms, yaw AS b FROM fx_imu), d AS (SELECT *, b - lag(b) OVER (PARTITION BY clip_id ORDER BY t_ms) AS raw FROM b),
u AS (SELECT clip_id, t_ms, sum(CASE WHEN raw IS NULL THEN b ELSE raw - 360 * ceil((raw - 180) / 360) END) OVER (PARTITION BY clip_id ORDER BY t_ms) AS un FROM d),
s AS (SELECT clip_id, t_ms, count(*) OVER w AS n, t_ms - min(t_ms) OVER w AS sp, regr_slope(un, t_ms / 1000e0) OVER w AS sl FROM u WINDOW w AS (PARTITION BY clip_id ORDER BY t_ms RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW))
SELECT clip_id, t_ms, round(CASE WHEN n >= 5 AND sp >= 1000 THEN sl END, 4) + 0.0 AS rate_dps FROM s""")
def rate(spark, sf):
    d = view(spark, sf, "fx_imu").select("clip_id", "t_ms", F.col("yaw").alias("bearing_deg"))
    return K.bearing_rate(d, ["clip_id"]).select("clip_id", "t_ms", (F.round("rate_dps", 4) + F.lit(0.0)).alias("rate_dps"))


@query("W10_rate_source", "fx_scores", sql=SC + """ SELECT row_id, CASE WHEN closing_mps IS NOT NULL AND p * 3 <= 1 THEN 'radar' WHEN free_m IS NOT NULL THEN 'camera' WHEN closing_mps IS NOT NULL THEN 'radar_stale' END AS source FROM sc""")
def rate_source(spark, sf):
    s = K.rate_source(F.col("closing_mps"), F.col("p") * 3, F.col("free_m"))
    return scored(spark, sf).select("row_id", s["source"].alias("source"))


@query("W11_radial_truth", "fx_radar", sql=GATED + """, f AS (SELECT clip_id, frame_index, min(t_ms) AS t_ms, median(y) AS r FROM kept GROUP BY 1, 2),
s AS (SELECT *, count(r) OVER w AS n, regr_slope(r, t_ms / 1000e0) OVER w AS sl FROM f WINDOW w AS (PARTITION BY clip_id ORDER BY t_ms RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING)),
t AS (SELECT *, CASE WHEN n < 5 OR sl IS NULL THEN NULL WHEN sl <= -0.1 THEN 'closing' WHEN sl >= 0.1 THEN 'diverging' ELSE 'static' END AS raw FROM s),
gd AS (SELECT *, min(raw) OVER w AS lo, max(raw) OVER w AS hi FROM t WINDOW w AS (PARTITION BY clip_id ORDER BY t_ms RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING))
SELECT clip_id, frame_index, raw AS raw_state, CASE WHEN lo = hi THEN raw END AS state FROM gd""")
def radial(spark, sf):
    f = _kept(spark, sf).groupBy("clip_id", "frame_index").agg(F.min("t_ms").alias("t_ms"), F.median("y").alias("median_range_m"))
    return ME.radial_truth(f).select("clip_id", "frame_index", "raw_state", "state")


ST = ["closing", "crossing", "diverging", "static", "unknown"]
MS = SC + f""", m AS (SELECT *, {ST!r}[1 + row_id * 7 % 5] AS truth, CASE WHEN free_m IS NOT NULL THEN {ST!r}[1 + row_id * 11 % 5] END AS pred, closing_mps / 3 AS vt FROM sc)"""


def motion_scored(spark, sf):
    a = F.array(*[F.lit(s) for s in ST])
    return scored(spark, sf).withColumns({
        "truth": F.element_at(a, (F.col("row_id") * 7 % 5 + 1).cast("int")), "predicted": F.when(F.col("free_m").isNotNull(), F.element_at(a, (F.col("row_id") * 11 % 5 + 1).cast("int"))),
        "v_tangential_mps": F.col("closing_mps") / 3})


@query("A41_motion_confusion", "fx_scores", sql=MS + " SELECT truth, count(*) FILTER (pred IS NULL) AS missed, " + ", ".join(f"count(*) FILTER (pred = '{s}') AS {s}" for s in ST) + " FROM m GROUP BY 1")
def motion_confusion(spark, sf):
    return ME.confusion(motion_scored(spark, sf))


@query("A41_motion_scores", "fx_scores", sql=MS + """, s AS (SELECT unnest(['closing', 'crossing', 'diverging', 'static', 'unknown']) AS state), c AS (SELECT state, count(*) FILTER (truth = state AND pred = state) AS tp, count(*) FILTER (truth <> state AND pred = state) AS fp, count(*) FILTER (truth = state AND pred <> state) AS fn FROM s, m GROUP BY 1),
v AS (SELECT count(vt) FILTER (truth IN ('static', 'closing', 'diverging')) AS nr, quantile_cont(abs(vt), 0.95) FILTER (truth IN ('static', 'closing', 'diverging')) AS r95 FROM m)
SELECT state, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, nr AS n_radial, round(r95, 6) AS radial_p95 FROM c, v WHERE tp + fp + fn > 0""")
def motion_scores(spark, sf):
    d = motion_scored(spark, sf)
    t = ME.tangential_spread(d).select(F.lit(1).alias("k"), "n_radial", "radial_p95")
    return tidy(ME.state_scores(d).withColumn("k", F.lit(1)).join(t, "k").drop("k"))


@query("A41_W14_detrend_switches", "fx_imu", sql=""", g AS (SELECT clip_id, count(*) AS n, corr(yaw, roll) AS ab, corr(t_ms, yaw) AS ta, corr(t_ms, roll) AS tb FROM fx_imu GROUP BY 1),
i AS (SELECT clip_id, CAST(floor(pitch / 4) AS BIGINT) AS id, lag(CAST(floor(pitch / 4) AS BIGINT)) OVER (PARTITION BY clip_id ORDER BY t_ms) AS p FROM fx_imu), s AS (SELECT clip_id, count(*) AS observations, count(*) FILTER (p IS NOT NULL AND p <> id) AS switches FROM i GROUP BY 1)
SELECT g.clip_id, n, round(CASE WHEN n >= 8 THEN (ab - ta * tb) / sqrt((1 - ta * ta) * (1 - tb * tb)) END, 5) + 0.0 AS r, observations, switches FROM g JOIN s USING (clip_id)""")
def detrend(spark, sf):
    d = view(spark, sf, "fx_imu").withColumn("t", F.col("t_ms").cast("double")).withColumn("id", F.floor(F.col("pitch") / 4))
    c = ME.detrended_correlation(d, ["clip_id"], "t", "yaw", "roll").withColumn("r", F.round("r", 5) + F.lit(0.0))
    return c.join(ME.switches(d, ["clip_id"], "t_ms", "id", 60_000), "clip_id")


def camera_boxes(spark, sf):
    d = detections(spark, sf)
    h = F.col("size") * 4.0
    return d.select("clip_id", "frame_index", F.col("det_id").alias("box_id"), "confidence", "angle_deg", (F.col("u") - h).alias("x0"), (F.col("v") - h).alias("y0"), (F.col("u") + h).alias("x1"), (F.col("v") + h).alias("y1"))


def _iou_sql(t: str, b: str) -> str:
    w, h = (f"greatest(0e0, least({t}.{p}1, {b}.{p}1) - greatest({t}.{p}0, {b}.{p}0))" for p in "xy")
    area = lambda q: f"({q}.x1 - {q}.x0) * ({q}.y1 - {q}.y0)"
    return f"({w} * {h} / ({area(t)} + {area(b)} - {w} * {h}))"


_BT = "STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, h BIGINT, m BIGINT, b BIGINT)"
_BSTEP = let_sql(
    f"list_filter(list_transform(a[-1].tr, lambda t: {{'id': t.id, 'x0': t.x0, 'y0': t.y0, 'x1': t.x1, 'y1': t.y1, 'h': t.h, 'm': t.m + greatest(0, x[1].f - a[-1].f - 1), 'b': t.b}}), lambda t: t.m < 5)", "tr",
    let_sql(greedy_sql(f"list_filter(flatten(list_transform(x[1].bx, lambda b: list_transform(tr, lambda t: {{'w': b.c < 0.5, 'b': b.b, 's': -{_iou_sql('t', 'b')}, 't': t.id}}))), lambda p: -p.s > CASE WHEN p.w THEN 0.1e0 ELSE 0.3e0 END)", "b", "t"), "w", """{
 'f': x[1].f, 'bx': x[1].bx, 'tr': list_concat(list_filter(list_transform(tr, lambda t: """ + let_sql("list_filter(x[1].bx, lambda b: len(list_filter(w, lambda z: z.t = t.id AND z.b = b.b)) > 0)", "k", """CASE WHEN len(k) > 0
 THEN {'id': t.id, 'x0': k[1].x0, 'y0': k[1].y0, 'x1': k[1].x1, 'y1': k[1].y1, 'h': t.h + 1, 'm': 0, 'b': k[1].b} ELSE {'id': t.id, 'x0': t.x0, 'y0': t.y0, 'x1': t.x1, 'y1': t.y1, 'h': t.h, 'm': t.m + 1, 'b': NULL} END""") + """), lambda t: t.m < 5),
 list_transform(list_filter(x[1].bx, lambda b: b.c >= 0.5 AND len(list_filter(w, lambda z: z.b = b.b)) = 0), lambda b, i: {'id': a[-1].nx + i - 1, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 'h': 1, 'm': 0, 'b': b.b})),
 'nx': a[-1].nx + len(list_filter(x[1].bx, lambda b: b.c >= 0.5 AND len(list_filter(w, lambda z: z.b = b.b)) = 0))}"""))
BOXES = f""", bo AS (SELECT clip_id, frame_index, det_id AS box_id, confidence, u - size * 4e0 AS x0, v - size * 4e0 AS y0, u + size * 4e0 AS x1, v + size * 4e0 AS y1 FROM fx_det WHERE sensor = 'fisheye'),
fb AS (SELECT clip_id, frame_index, list({{'b': box_id, 'c': confidence, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY box_id) AS bx FROM bo GROUP BY 1, 2),
fg AS (SELECT *, frame_index - lag(frame_index) OVER (PARTITION BY clip_id ORDER BY frame_index) AS gap FROM fb),
fh AS (SELECT *, CAST(sum(CASE WHEN gap <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY frame_index) AS BIGINT) AS stretch FROM fg),
fi AS (SELECT clip_id, stretch, frame_index, bx FROM fh UNION ALL SELECT clip_id, stretch, -1, [] FROM fh GROUP BY 1, 2),
""" + fold_sql("bw", "fi", "clip_id, stretch", "frame_index", "'f': frame_index, 'bx': bx", f"'tr': []::{_BT}[], 'nx': 0::BIGINT", _BSTEP).replace("list_transform(xs, lambda x: [x])", "list_transform(xs[2:], lambda x: [x])").replace("xs[1:0])) AS z", "xs[1:1])) AS z") + """,
bk AS (SELECT clip_id, stretch, z.f AS frame_index, unnest(z.tr) AS q FROM bw WHERE z.f >= 0),
bt AS (SELECT clip_id, stretch, frame_index, q.b AS box_id, q.id AS track_id, q.h AS hits, q.h >= 3 AS confirmed FROM bk WHERE q.b IS NOT NULL)"""


@query("W18_box_tracks", "fx_det", sql=BOXES + " SELECT * FROM bt")
def box_tracks(spark, sf):
    return K.track_boxes(camera_boxes(spark, sf))


_T = lambda k: f"list_filter(x[1].t, lambda u: u.k = {k})"
_C = lambda c: f"list_filter(x[1].c, lambda u: u.c = {c})"
_N = lambda k, c: f"coalesce(list_filter(x[1].o, lambda u: u.k = {k} AND u.c = {c})[1].n, 0)"
_HAS = lambda items, field, v: f"len(list_filter({items}, lambda e: e.{field} = {v})) > 0"
_JUDGED = "list_transform(a[-1].pr, lambda p: " + let_sql(_T("p.k"), "tt", let_sql(_C("p.c"), "cc", let_sql(_N("p.k", "p.c"), "nn", """{'k': p.k, 'c': p.c,
 'off': CASE WHEN len(tt) > 0 AND len(cc) > 0 AND nn > 0 THEN 0.3e0 * (tt[1].b - cc[1].b) + 0.7e0 * p.off ELSE p.off END,
 'ap': CASE WHEN len(tt) = 0 OR len(cc) = 0 THEN p.ap WHEN nn > 0 THEN 0 ELSE p.ap + 1 END, 'ab': CASE WHEN len(tt) = 0 THEN p.ab + x[1].f - a[-1].f ELSE 0 END,
 'n': p.n + CASE WHEN len(tt) > 0 AND len(cc) > 0 AND nn > 0 THEN 1 ELSE 0 END}"""))) + ")"
_MET = f"flatten(list_transform(list_filter(x[1].t, lambda u: NOT {_HAS('kept', 'k', 'u.k')}), lambda u: list_transform(list_filter(x[1].c, lambda v: NOT {_HAS('kept', 'c', 'v.c')}), lambda v: {{'k': u.k, 'c': v.c, 'g': CASE WHEN len(list_filter(x[1].o, lambda e: e.k = u.k AND e.c = v.c)) > 0 THEN 1 ELSE 0 END}})))"
_STANDING = "list_filter(list_concat(list_transform(a[-1].cd, lambda q: " + let_sql("list_filter(met, lambda e: e.k = q.k AND e.c = q.c)", "hh", "CASE WHEN len(hh) = 0 THEN q ELSE {'k': q.k, 'c': q.c, 'seen': list_append(q.seen, hh[1].g)[-5:], 'at': x[1].f} END") + f"""),
 list_transform(list_filter(met, lambda m: len(list_filter(a[-1].cd, lambda e: e.k = m.k AND e.c = m.c)) = 0), lambda m: {{'k': m.k, 'c': m.c, 'seen': [m.g], 'at': x[1].f}})),
 lambda q: {_HAS('al', 'c', 'q.c')} AND NOT {_HAS('kept', 'k', 'q.k')} AND NOT {_HAS('kept', 'c', 'q.c')} AND x[1].f - q.at <= 15)"""
_READY = f"list_filter(list_transform(standing, lambda q: {{'v': -list_sum(q.seen), 'n': -{_N('q.k', 'q.c')}, 'nk': -q.k, 'nc': -q.c, 'k': q.k, 'c': q.c}}), lambda e: e.v <= -3)"
_ISTEP = let_sql(f"list_concat(list_filter(a[-1].cm, lambda m: NOT {_HAS('x[1].c', 'c', 'm.c')} AND x[1].f - m.at < 5), list_transform(x[1].c, lambda u: {{'c': u.c, 'at': x[1].f}}))", "al", let_sql(
    _JUDGED, "judged", let_sql(f"list_filter(judged, lambda p: {_HAS('al', 'c', 'p.c')} AND p.ab < 15 AND p.ap < 5)", "kept", let_sql(_MET, "met", let_sql(_STANDING, "standing", let_sql(greedy_sql(_READY, "k", "c"), "won", f"""{{
 'f': x[1].f, 't': x[1].t[1:0], 'c': x[1].c, 'o': x[1].o[1:0], 'pr': list_concat(kept, list_transform(won, lambda w: {{'k': w.k, 'c': w.c, 'off': CASE WHEN w.n < 0 THEN {_T('w.k')}[1].b - {_C('w.c')}[1].b ELSE 0e0 END, 'ap': 0, 'ab': 0, 'n': 0}})),
 'cd': list_filter(standing, lambda q: NOT {_HAS('won', 'k', 'q.k')} AND NOT {_HAS('won', 'c', 'q.c')}), 'cm': al, 'fm': list_transform(won, lambda w: {{'k': w.k, 'c': w.c}}), 'bk': len(judged) - len(kept)}}"""))))))
IDENTITY = TARGETS + BOXES + PAIRS[len(GATED):] + """,
it AS (SELECT clip_id, frame_index, stretch * 1000000 + track_id AS k, bearing_deg AS b FROM tr),
ic AS (SELECT bt.clip_id, bt.frame_index, bt.stretch * 1000000 + bt.track_id AS c, dd.angle_deg AS b, box_id FROM bt JOIN dd ON dd.det_id = bt.box_id),
io AS (SELECT p.clip_id, p.frame_index, tk.stretch * 1000000 + tk.q.id AS k, ic.c, count(*) AS n FROM pr p JOIN cl ON cl.clip_id = p.clip_id AND cl.frame_index = p.frame_index AND cl.point_id = p.point_id
 JOIN tk ON tk.clip_id = cl.clip_id AND tk.frame_index = cl.frame_index AND tk.q.c = cl.cluster_id AND tk.q.m = 0 JOIN ic ON ic.clip_id = p.clip_id AND ic.frame_index = p.frame_index AND ic.box_id = p.det_id GROUP BY 1, 2, 3, 4),
i1 AS (SELECT clip_id, frame_index, list({'k': k, 'b': b} ORDER BY k) AS t FROM it GROUP BY 1, 2), i2 AS (SELECT clip_id, frame_index, list({'c': c, 'b': b} ORDER BY c) AS c FROM ic GROUP BY 1, 2), i3 AS (SELECT clip_id, frame_index, list({'k': k, 'c': c, 'n': n} ORDER BY k, c) AS o FROM io GROUP BY 1, 2),
i4 AS (SELECT clip_id, frame_index FROM i1 UNION SELECT clip_id, frame_index FROM i2 UNION SELECT clip_id, -1 FROM i1 UNION SELECT clip_id, -1 FROM i2),
i5 AS (SELECT i4.clip_id, i4.frame_index, coalesce(t, []) AS t, coalesce(c, []) AS c, coalesce(o, []) AS o FROM i4 LEFT JOIN i1 USING (clip_id, frame_index) LEFT JOIN i2 USING (clip_id, frame_index) LEFT JOIN i3 USING (clip_id, frame_index)),
""" + fold_sql("iw", "i5", "clip_id", "frame_index", "'f': frame_index, 't': t, 'c': c, 'o': o", """'pr': []::STRUCT(k BIGINT, c BIGINT, off DOUBLE, ap BIGINT, ab BIGINT, n BIGINT)[],
 'cd': []::STRUCT(k BIGINT, c BIGINT, seen INTEGER[], "at" BIGINT)[], 'cm': []::STRUCT(c BIGINT, "at" BIGINT)[], 'fm': []::STRUCT(k BIGINT, c BIGINT)[], 'bk': 0::BIGINT""", _ISTEP).replace("list_transform(xs, lambda x: [x])", "list_transform(xs[2:], lambda x: [x])").replace("xs[1:0])) AS z", "xs[1:1])) AS z") + """,
ie AS (SELECT clip_id, z.f AS f, unnest(z.fm) AS e FROM iw), ig AS (SELECT clip_id, f, CAST(coalesce(lag(e.c) OVER (PARTITION BY clip_id, e.k ORDER BY f) <> e.c, false) AS INTEGER) + CAST(coalesce(lag(e.k) OVER (PARTITION BY clip_id, e.c ORDER BY f) <> e.k, false) AS INTEGER) AS sw FROM ie),
ih AS (SELECT clip_id, f, sum(sw) AS sw FROM ig GROUP BY 1, 2),
ii AS (SELECT iw.clip_id, z.f AS f, z.pr AS pr, z.c AS cams, sum(len(z.fm)) OVER w AS formed, sum(z.bk) OVER w AS broken, sum(coalesce(sw, 0)) OVER w AS switches FROM iw LEFT JOIN ih ON ih.clip_id = iw.clip_id AND ih.f = iw.z.f WINDOW w AS (PARTITION BY iw.clip_id ORDER BY iw.z.f)),
ij AS (SELECT clip_id, f, cams, formed, broken, switches, unnest(pr) AS p FROM ii)
SELECT clip_id, f AS frame_index, p.k AS track_id, p.c AS camera_id, round(p.off, 6) + 0.0 AS offset_deg, p.n AS frames_paired, round(list_filter(cams, lambda u: u.c = p.c)[1].b + p.off, 6) + 0.0 AS camera_bearing,
 CAST(formed AS BIGINT) AS formed, CAST(broken AS BIGINT) AS broken, CAST(switches AS BIGINT) AS switches FROM ij"""


@query("J18_W20_track_identity", "fx_radar", "fx_det", sql=IDENTITY)
def identity(spark, sf):
    b = camera_boxes(spark, sf)
    # one camera id per recording: stretch and track together
    cid = (F.col("stretch") * 1_000_000 + F.col("track_id")).cast("bigint")
    # what several steps read is worked out once
    cams = cut_lineage(K.track_boxes(b).select("clip_id", "frame_index", "box_id", cid.alias("camera_id")).join(b.select("clip_id", "frame_index", "box_id", "angle_deg"), ["clip_id", "frame_index", "box_id"]))
    # only what observations read goes through the clusters' shuffle and is kept
    seen = R.with_polar(_kept(spark, sf)).select("clip_id", "frame_index", "point_id", "x", "y", "vx", "vy")
    cl = cut_lineage(K.cluster_points(seen))
    trk = K.track_targets(K.observations(cl), R.frame_counts(view(spark, sf, "fx_radar"))).withColumn("track_id", (F.col("stretch") * 1_000_000 + F.col("track_id")).cast("bigint"))
    trk = cut_lineage(trk)
    pts = cl.select("clip_id", "frame_index", "point_id", "cluster_id").join(trk.select("clip_id", "frame_index", "cluster_id", "track_id"), ["clip_id", "frame_index", "cluster_id"])
    m = AS.box_gate(detections(spark, sf), AS.projected(_kept(spark, sf))).select("clip_id", "frame_index", F.col("det_id").alias("box_id"), "point_id")
    m = m.join(cams.select("clip_id", "frame_index", "box_id", "camera_id"), ["clip_id", "frame_index", "box_id"])
    ev = K.overlap_evidence(pts, m)
    t = trk.select("clip_id", "frame_index", "track_id", M.azimuth(F.col("x"), F.col("y")).alias("bearing"))
    return tidy(K.pair_identities(t, cams.select("clip_id", "frame_index", "camera_id", F.col("angle_deg").alias("bearing")), ev))


@query("P43_motion_fields", "fx_scores", sql=SC + """, k AS (SELECT row_id, min_range_m * sin(radians(bin_center_deg)) AS x, min_range_m * cos(radians(bin_center_deg)) AS y, -(closing_mps + 0.03e0) AS vr, CASE WHEN free_m IS NOT NULL AND closing_mps IS NOT NULL THEN p - 0.5e0 END AS vt FROM sc WHERE min_range_m IS NOT NULL),
v AS (SELECT *, coalesce(vr, 0) * sin(atan2(x, y)) + coalesce(vt, 0) * cos(atan2(x, y)) AS vx, coalesce(vr, 0) * cos(atan2(x, y)) - coalesce(vt, 0) * sin(atan2(x, y)) AS vy FROM k), w AS (SELECT *, sqrt(vx*vx + vy*vy) AS sp, -(x*vx + y*vy) / nullif(vx*vx + vy*vy, 0) AS t FROM v)
SELECT row_id, round(CASE WHEN vr IS NOT NULL OR vt IS NOT NULL THEN sp END, 9) AS speed, round(CASE WHEN (vr IS NOT NULL OR vt IS NOT NULL) AND sp >= 0.15 AND t > 0 THEN sqrt(pow(x + vx*t, 2) + pow(y + vy*t, 2)) END, 9) AS cpa_m, round(CASE WHEN (vr IS NOT NULL OR vt IS NOT NULL) AND sp >= 0.15 AND t > 0 THEN least(t, 60e0) END, 9) AS t_cpa_s,
 CASE WHEN vr IS NULL AND vt IS NULL THEN 'unknown' WHEN abs(vt) >= 0.3 THEN 'crossing' WHEN -vr >= 0.15 THEN 'closing' WHEN -vr <= -0.15 THEN 'diverging' ELSE 'static' END AS motion_state FROM w""")
def motion_fields(spark, sf):
    d = scored(spark, sf).filter("min_range_m IS NOT NULL")
    a = F.radians("bin_center_deg")
    d = d.select("row_id", (F.col("min_range_m") * F.sin(a)).alias("x"), (F.col("min_range_m") * F.cos(a)).alias("y"), (-(F.col("closing_mps") + 0.03)).alias("vr"), F.when(F.col("free_m").isNotNull() & F.col("closing_mps").isNotNull(), F.col("p") - 0.5).alias("vt"))
    c = M.closest_approach(F.col("x"), F.col("y"), F.col("vr"), F.col("vt"), 0.15, 60.0)
    return d.select("row_id", F.round(c["speed"], 9).alias("speed"), F.round(c["cpa_m"], 9).alias("cpa_m"), F.round(c["t_cpa_s"], 9).alias("t_cpa_s"),
                    M.motion_state(F.col("vt"), -F.col("vr"), F.col("vr"), 0.3, 0.15).alias("motion_state"))
