"""Ordered per-bin state, heading and sector-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.fixtures import view
from keelson.functions.motion import time_to_collision
from keelson.functions.rounding import r6, tidy
from keelson.operators import sectors as S
from keelson.operators import smoothing as SM
from keelson.queries.catalog import query


def scored(spark, sf):
    d = view(spark, sf, "fx_scores")
    return d.withColumns({
        "t_s": F.col("t_ms") / 1000.0,
        "ttc_s": time_to_collision(F.col("min_range_m"), F.col("closing_mps"), 0.15, 60.0),
        "score": (F.col("hit_fisheye") + F.col("hit_thermal") + F.col("hit_mmwave")) / F.lit(3.0),
        "hit": (F.col("hit_fisheye") + F.col("hit_thermal") + F.col("hit_mmwave")) > 1,
    })


SC = """, sc AS (SELECT *, t_ms / 1000e0 AS t_s, CASE WHEN closing_mps > 0.15 THEN least(min_range_m / closing_mps, 60e0) END AS ttc_s,
 (hit_fisheye + hit_thermal + hit_mmwave) / 3e0 AS score, hit_fisheye + hit_thermal + hit_mmwave > 1 AS hit FROM fx_scores)"""


@query("W02_sector_confirmation", "fx_scores", sql=SC + """, o AS (SELECT clip_id, bin_index, list(hit ORDER BY frame_index) AS hs, list(frame_index ORDER BY frame_index) AS fs, list(score ORDER BY frame_index) AS ss FROM sc GROUP BY 1, 2),
st AS (SELECT *, list_reduce(list_transform(hs, lambda h: [{'h': 0, 'm': 0, 'c': false, 'hit': h}]), lambda a, x: list_append(a, {
 'h': CASE WHEN x[1].hit THEN a[-1].h + 1 WHEN a[-1].m + 1 >= 5 THEN 0 ELSE a[-1].h END,
 'm': CASE WHEN x[1].hit THEN 0 ELSE a[-1].m + 1 END,
 'c': CASE WHEN x[1].hit THEN a[-1].c OR a[-1].h + 1 >= 3 WHEN a[-1].m + 1 >= 5 THEN false ELSE a[-1].c END, 'hit': x[1].hit}),
 [{'h': 0, 'm': 0, 'c': false, 'hit': false}]) AS z FROM o),
u AS (SELECT clip_id, bin_index, unnest(fs) AS frame_index, unnest(ss) AS s, unnest(z[2:]) AS q FROM st)
SELECT clip_id, bin_index, frame_index, q.c AS confirmed, round(CASE WHEN q.c THEN s ELSE 0 END, 6) AS gated FROM u""")
def confirmation(spark, sf):
    d = SM.confirm_sectors(scored(spark, sf))
    return d.select("clip_id", "bin_index", "frame_index", "confirmed",
                    r6(SM.gated_score(F.col("score"), F.col("confirmed")), "gated"))


@query("W03_heading_smoother", "fx_scores", sql="""
, h AS (SELECT clip_id, frame_index, CASE WHEN max(row_id) % 3 = 0 THEN NULL ELSE max(p) * 90 - 45 END AS heading_deg FROM fx_scores GROUP BY 1, 2),
k AS (SELECT *, avg(heading_deg) OVER w AS m, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS r FROM h WHERE heading_deg IS NOT NULL
 WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
j AS (SELECT h.*, CASE WHEN r >= 3 THEN m END AS m FROM h LEFT JOIN k ON k.clip_id = h.clip_id AND k.frame_index = h.frame_index)
SELECT clip_id, frame_index, round(heading_deg, 6) + 0.0 AS heading_deg, round(last_value(m IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS smoothed_heading_deg FROM j""")
def heading_smoother(spark, sf):
    h = view(spark, sf, "fx_scores").groupBy("clip_id", "frame_index").agg(
        F.expr("CASE WHEN max(row_id) % 3 = 0 THEN NULL ELSE max(p) * 90 - 45 END").alias("heading_deg"))
    return tidy(SM.smooth_heading(h))


FOLD = SC + """, dt AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY clip_id, bin_index ORDER BY frame_index) AS raw FROM sc),
k AS (SELECT *, CASE WHEN raw > 0 AND raw <= 5 THEN exp(-raw / 2e0) ELSE 0e0 END AS d FROM dt),
o AS (SELECT clip_id, bin_index, list(frame_index ORDER BY frame_index) AS fs, list({'d': d, 'p': p, 'y': 0e0} ORDER BY frame_index) AS xs FROM k GROUP BY 1, 2)"""


@query("W05_score_persistence", "fx_scores", sql=FOLD + """,
st AS (SELECT *, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: list_append(a, {'d': x[1].d, 'p': x[1].p, 'y': greatest(x[1].p, x[1].d * a[-1].y)}), [{'d': 0e0, 'p': 0e0, 'y': 0e0}]) AS z FROM o),
u AS (SELECT clip_id, bin_index, unnest(fs) AS frame_index, unnest(z[2:]) AS q FROM st)
SELECT clip_id, bin_index, frame_index, round(q.y, 6) AS p_smooth FROM u""")
def persistence(spark, sf):
    d = SM.persist_score(scored(spark, sf))
    return d.select("clip_id", "bin_index", "frame_index", r6("p_smooth"))


@query("W06_score_ema", "fx_scores", sql=FOLD + """,
st AS (SELECT *, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: list_append(a, {'d': x[1].d, 'p': x[1].p, 'y': (1 - x[1].d) * x[1].p + x[1].d * a[-1].y}), [{'d': 0e0, 'p': 0e0, 'y': 0e0}]) AS z FROM o),
u AS (SELECT clip_id, bin_index, unnest(fs) AS frame_index, unnest(z[2:]) AS q FROM st)
SELECT clip_id, bin_index, frame_index, round(q.y, 6) AS p_ema FROM u""")
def ema(spark, sf):
    return SM.ema_score(scored(spark, sf)).select("clip_id", "bin_index", "frame_index", r6("p_ema"))


@query("W04_free_space_average", "fx_scores", sql="""
, o AS (SELECT clip_id, bin_index, list(frame_index ORDER BY frame_index) AS fs, list(coalesce(free_m, 15e0) ORDER BY frame_index) AS xs FROM fx_scores GROUP BY 1, 2),
st AS (SELECT *, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: list_append(a, 0.5e0 * x[1] + 0.5e0 * a[-1])) AS z FROM o),
u AS (SELECT clip_id, bin_index, unnest(fs) AS frame_index, unnest(z) AS y FROM st)
SELECT clip_id, bin_index, frame_index, round(CASE WHEN y < 0.999e0 * 15 THEN y END, 6) AS free_smooth_m FROM u""")
def free_average(spark, sf):
    return SM.smooth_free_space(view(spark, sf, "fx_scores")).select(
        "clip_id", "bin_index", "frame_index", r6("free_smooth_m"))


PERS = FOLD + """,
st AS (SELECT *, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: list_append(a, {'d': x[1].d, 'p': x[1].p, 'y': greatest(x[1].p, x[1].d * a[-1].y)}), [{'d': 0e0, 'p': 0e0, 'y': 0e0}]) AS z FROM o),
u AS (SELECT clip_id, bin_index, unnest(fs) AS frame_index, unnest(z[2:]) AS q FROM st),
s AS (SELECT clip_id, bin_index, frame_index, q.d AS d, q.p AS p, q.y AS y, sum(CASE WHEN q.d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, bin_index ORDER BY frame_index) AS seg FROM u),
l AS (SELECT *, lag(p) OVER w AS pp, lag(CASE WHEN p >= 0.5 THEN frame_index END) OVER w AS x, max(CASE WHEN p >= 0.5 THEN frame_index END) OVER (PARTITION BY clip_id, bin_index, seg ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pu,
 p < 0.5 AND y >= 0.5 AS held FROM s WINDOW w AS (PARTITION BY clip_id, bin_index, seg ORDER BY frame_index))"""


@query("W07_W08_flicker_onsets", "fx_scores", sql=PERS + """
SELECT clip_id, round(avg(CASE WHEN d > 0 THEN abs(p - pp) END), 6) AS flicker, CAST(count(*) FILTER (p >= 0.5 AND (d = 0 OR pp < 0.5)) AS BIGINT) AS onsets,
 CAST(count(*) FILTER (p >= 0.5 AND (d = 0 OR pp < 0.5) AND y < 0.5) AS BIGINT) AS delayed FROM l GROUP BY 1""")
def flicker_onsets(spark, sf):
    d = SM.persist_score(scored(spark, sf))
    return tidy(SM.flicker(d).join(SM.onsets(d, 0.5), "clip_id"))


@query("W09_dropouts_tails", "fx_scores", sql=PERS + """,
e AS (SELECT *, CASE WHEN held IS DISTINCT FROM lag(held) OVER (PARTITION BY clip_id, bin_index, seg ORDER BY frame_index) THEN 1 ELSE 0 END AS nw FROM l),
r AS (SELECT *, sum(nw) OVER (PARTITION BY clip_id, bin_index, seg ORDER BY frame_index) AS run FROM e),
t AS (SELECT clip_id, count(*) AS n FROM r WHERE held GROUP BY clip_id, bin_index, seg, run)
SELECT a.clip_id, a.dropouts, round(b.m, 6) AS mean_tail, b.c AS n_tails FROM (SELECT clip_id, CAST(count(*) FILTER (p >= 0.5 AND frame_index - pu - 1 BETWEEN 1 AND 2) AS BIGINT) AS dropouts FROM l GROUP BY 1) a
 LEFT JOIN (SELECT clip_id, avg(n) AS m, CAST(count(*) AS BIGINT) AS c FROM t GROUP BY 1) b USING (clip_id)""")
def dropouts_tails(spark, sf):
    d = SM.persist_score(scored(spark, sf))
    return tidy(SM.dropouts(d, 0.5).join(SM.decay_tail(d), "clip_id", "left"))


def records(spark, sf):
    return S.to_records(scored(spark, sf), {
        "centers": "bin_center_deg", "scores": "score", "min_range_m": "min_range_m", "closing_mps": "closing_mps",
        "ttc_s": "ttc_s", "free_m": "free_m", "p": "p"}, {"t_ms": "t_ms"})


@query("P32_amplitudes", "fx_scores", sql=SC + """
SELECT clip_id, frame_index, bin_index, round(greatest(greatest(0e0, least(1e0, CASE WHEN score < 0.33 THEN 0e0 WHEN score < 0.66 THEN 0.5e0 * (score - 0.33e0) / 0.33e0 ELSE 0.5e0 + 0.5e0 * (score - 0.66e0) / 0.34e0 END)),
  coalesce(greatest(0e0, least(1e0, 1 - free_m / 15e0)), 0)), 6) AS block,
 round(CASE WHEN score < 0.33 OR min_range_m IS NULL THEN 0e0 ELSE 5 / (greatest(min_range_m, 0.5e0) + 5e0) END, 6) AS close,
 round(CASE WHEN score < 0.33 OR ttc_s IS NULL THEN 0e0 ELSE 5 / (greatest(ttc_s, 0.5e0) + 5e0) END, 6) AS ttc FROM sc""")
def amps(spark, sf):
    d = scored(spark, sf)
    a = S.amplitudes(F.col("score"), F.col("min_range_m"), F.col("ttc_s"), F.col("free_m"))
    return tidy(d.select("clip_id", "frame_index", "bin_index", a["block"].alias("block"), a["close"].alias("close"), a["ttc"].alias("ttc")))


HEAD = SC + """, am AS (SELECT clip_id, frame_index, bin_center_deg AS c, greatest(0e0, least(1e0, CASE WHEN score < 0.33 THEN 0e0 WHEN score < 0.66 THEN 0.5e0 * (score - 0.33e0) / (0.66e0 - 0.33e0) ELSE 0.5e0 + 0.5e0 * (score - 0.66e0) / (1e0 - 0.66e0) END)) AS b,
 CASE WHEN score < 0.33 OR min_range_m IS NULL THEN 0e0 ELSE 5 / (greatest(min_range_m, 0.5e0) + 5e0) END AS cl, CASE WHEN score < 0.33 OR ttc_s IS NULL THEN 0e0 ELSE 5 / (greatest(ttc_s, 0.5e0) + 5e0) END AS tt FROM sc),
cv AS (SELECT clip_id, frame_index, i, i - 45e0 AS th, least(1e0, max(b * exp(-(i - 45e0 - c) * (i - 45e0 - c) / 288e0))) AS b, 0.3e0 * least(1e0, max(cl * exp(-(i - 45e0 - c) * (i - 45e0 - c) / 288e0))) AS cl,
 0.6e0 * least(1e0, max(tt * exp(-(i - 45e0 - c) * (i - 45e0 - c) / 288e0))) AS tt, 0.2e0 * least(abs(i - 45e0) / 30e0, 1e0) AS co FROM am, (SELECT unnest(range(91)) AS i) GROUP BY clip_id, frame_index, i HAVING i - 45 <= max(c)),
cc AS (SELECT *, b + cl + tt + co AS cost FROM cv),
be AS (SELECT clip_id, frame_index, arg_min({'i': i, 'th': th, 'b': b, 'cl': cl, 'tt': tt, 'co': co, 'cost': cost}, [cost, i]) AS z FROM cc GROUP BY 1, 2),
am2 AS (SELECT cc.clip_id, cc.frame_index, bool_or(cc.i <> z.i AND cost <= CASE WHEN z.cost = 0 THEN 1e-9 ELSE z.cost * 1.05e0 END AND abs(cc.th - z.th) >= 30) AS rival FROM cc JOIN be USING (clip_id, frame_index) GROUP BY 1, 2),
re AS (SELECT be.clip_id, be.frame_index, z, CASE WHEN z.b >= 0.3 THEN 'all_blocked' WHEN rival THEN 'ambiguous' WHEN z.cost = 0 THEN 'clear' WHEN z.b >= greatest(z.cl, z.tt, z.co) THEN 'block'
 WHEN z.cl >= greatest(z.tt, z.co) THEN 'close' WHEN z.tt >= z.co THEN 'ttc' ELSE 'course' END AS heading_reason FROM be JOIN am2 USING (clip_id, frame_index))"""


@query("H01_heading_recommendation", "fx_scores", sql=HEAD + """
SELECT clip_id, frame_index, CASE WHEN heading_reason NOT IN ('all_blocked', 'ambiguous') THEN z.th END AS heading_deg, heading_reason, round(z.cost, 6) AS best_cost FROM re""")
def heading(spark, sf):
    return S.recommend_heading(records(spark, sf)).select(
        "clip_id", "frame_index", "heading_deg", "heading_reason", r6("best_cost"))


@query("P41_sector_decision", "fx_scores", sql=SC + """
SELECT clip_id, frame_index, CAST(count(*) FILTER (score >= 0.66) AS BIGINT) AS n_blocked, CAST(count(*) FILTER (score >= 0.33 AND score < 0.66) AS BIGINT) AS n_alert,
 round(min(min_range_m) FILTER (score >= 0.33), 6) AS closest, arg_min(bin_center_deg, [min_range_m, bin_center_deg]) FILTER (score >= 0.33 AND min_range_m IS NOT NULL) AS closest_bin,
 round(min(ttc_s) FILTER (score >= 0.33), 6) AS closest_ttc, arg_min(bin_center_deg, [ttc_s, bin_center_deg]) FILTER (score >= 0.33 AND ttc_s IS NOT NULL) AS closest_ttc_bin,
 max(closing_mps) FILTER (score >= 0.33) + 0.0 AS fastest_closing, arg_min(bin_center_deg, [-closing_mps, bin_center_deg]) FILTER (score >= 0.33 AND closing_mps IS NOT NULL) AS fastest_bin,
 coalesce(min(min_range_m) FILTER (score >= 0.33) <= 2, false) AS hard_stop FROM sc GROUP BY 1, 2""")
def decision(spark, sf):
    d = S.decide(records(spark, sf))
    return tidy(d.select("clip_id", "frame_index", F.size("blocked_bins").alias("n_blocked"), F.size("alert_bins").alias("n_alert"),
                         "closest", "closest_bin", "closest_ttc", "closest_ttc_bin", "fastest_closing", "fastest_bin", "hard_stop"))


@query("P33_P34_headings_local_metric", "fx_imu", sql="""
SELECT row_no, round((yaw + pitch * 9 + 180) - floor((yaw + pitch * 9 + 180) / 360) * 360 - 180, 4) + 0.0 AS abs_heading,
 round(pitch / 1000 * 111320e0 * cos(radians(46e0)), 4) + 0.0 AS east, round(roll / 1000 * 111320e0, 4) + 0.0 AS north,
 round(pitch / 1000 * 111320e0 * cos(radians(46e0)) * cos(radians(yaw)) - roll / 1000 * 111320e0 * sin(radians(yaw)), 4) + 0.0 AS right_m,
 round(pitch / 1000 * 111320e0 * cos(radians(46e0)) * sin(radians(yaw)) + roll / 1000 * 111320e0 * cos(radians(yaw)), 4) + 0.0 AS ahead_m FROM fx_imu""")
def local_metric(spark, sf):
    d = view(spark, sf, "fx_imu")
    m = S.local_metric(46.0 + F.col("roll") / 1000, 9.0 + F.col("pitch") / 1000, F.lit(46.0), F.lit(9.0), F.col("yaw"))
    return d.select("row_no", *[(F.round(c, 4) + F.lit(0.0)).alias(n) for c, n in ((S.absolute_heading(F.col("yaw"), F.col("pitch") * 9), "abs_heading"), (m["east"], "east"),
                         (m["north"], "north"), (m["right"], "right_m"), (m["ahead"], "ahead_m"))])


@query("P35_evidence_pick_S07", "fx_scores", sql=SC + """
SELECT clip_id, frame_index, bin_index, round(greatest(CASE WHEN frame_index % 5 > 0 THEN p END, score), 6) AS evidence FROM sc""")
def evidence(spark, sf):
    r = records(spark, sf).withColumn("learned", F.expr("CASE WHEN frame_index % 5 > 0 THEN p END"))
    r = r.withColumn("evidence", S.pick_evidence(F.col("learned"), F.col("scores")))
    return S.explode_records(r.select("clip_id", "frame_index", "evidence"), ["evidence"]).withColumn("evidence", F.round("evidence", 6))


@query("A44_conservative_regrid", "fx_scores", sql=SC + """,
g AS (SELECT unnest([{'k': -2, 'a': -52.5e0, 'b': -37.5e0}, {'k': -1, 'a': -37.5e0, 'b': -12.5e0}, {'k': 0, 'a': -12.5e0, 'b': 12.5e0}, {'k': 1, 'a': 12.5e0, 'b': 37.5e0}, {'k': 2, 'a': 37.5e0, 'b': 52.5e0}]) AS s)
SELECT clip_id, frame_index, CAST(s.k AS BIGINT) AS sector, CAST((s.a + s.b) / 2 AS DOUBLE) AS center_deg, round(max(coalesce(CASE WHEN frame_index % 5 > 0 THEN score END, 0)), 6) AS score, max(coalesce(CASE WHEN bin_index <> 2 THEN p END, 0)) AS p, round(max(coalesce(CASE WHEN frame_index % 7 > 0 THEN p * 0.5e0 END, 0)), 6) AS threat, round(min(min_range_m), 6) AS min_range_m,
 round(min(ttc_s), 6) AS ttc_s, max(closing_mps) + 0.0 AS closing_mps, bool_or(hit) AS confirmed, max(hit_fisheye) AS hit_fisheye, max(hit_thermal) AS hit_thermal, max(hit_mmwave) AS hit_mmwave
FROM sc JOIN g ON least(s.b, bin_center_deg + 7.5e0) - greatest(s.a, bin_center_deg - 7.5e0) > 1e-6 GROUP BY 1, 2, 3, 4""")
def regrid(spark, sf):
    d = scored(spark, sf).withColumn("threat", F.expr("CASE WHEN frame_index % 7 > 0 THEN p * 0.5e0 END")).withColumn("confirmed", F.col("hit"))
    d = d.withColumn("score", F.expr("CASE WHEN frame_index % 5 > 0 THEN score END")).withColumn("p", F.expr("CASE WHEN bin_index <> 2 THEN p END"))
    return tidy(S.regrid(d, 25.0))
