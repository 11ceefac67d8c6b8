"""Radar kinematics as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from keelson.params import GRID, BinGrid


def rotate_mount(x: Column, y: Column, yaw_deg: float) -> tuple[Column, Column]:
    """Cloud rotated about the vertical by minus the mount yaw."""
    c, s = math.cos(math.radians(-yaw_deg)), math.sin(math.radians(-yaw_deg))
    return x * F.lit(c) + y * F.lit(s), y * F.lit(c) - x * F.lit(s)


def azimuth(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(x, y))


def doppler_velocity(x: Column, y: Column, v: Column) -> Column:
    """struct(vx, vy) along the line of sight; null without Doppler."""
    r = F.sqrt(x * x + y * y)
    still = r == F.lit(0.0)
    return F.when(
        v.isNotNull(),
        F.struct(F.when(still, F.lit(0.0)).otherwise(v * (x / r)).alias("vx"),
                 F.when(still, v).otherwise(v * (y / r)).alias("vy")),
    )


def closing_speed(vy: Column) -> Column:
    return -vy


def time_to_collision(rng: Column, closing: Column, eps: float, cap: float) -> Column:
    return F.when(closing > F.lit(eps), F.least(rng / closing, F.lit(cap)))


def bin_of(angle: Column, grid: BinGrid = GRID) -> Column:
    """Half-open bins; null outside the grid."""
    inside = (angle >= F.lit(grid.lo)) & (angle < F.lit(grid.hi))
    return F.when(inside, F.floor((angle - F.lit(grid.lo)) / F.lit(grid.step)).cast("bigint"))


def bin_center(i: Column, grid: BinGrid = GRID) -> Column:
    return F.lit(grid.lo) + (i + F.lit(0.5)) * F.lit(grid.step)


def all_bins(grid: BinGrid = GRID) -> Column:
    """Generator column with every bin index."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid.n - 1).cast("bigint")))


def motion_state(v_t: Column, closing: Column, v_r: Column, crossing_min: float, closing_min: float) -> Column:
    return (
        F.when(v_r.isNull() & v_t.isNull(), "unknown")
        .when(F.abs(v_t) >= crossing_min, "crossing")
        .when(closing >= closing_min, "closing")
        .when(closing <= -closing_min, "diverging")
        .otherwise("static")
    )


def _speed(x: pd.Series, y: pd.Series, vr: pd.Series, vt: pd.Series) -> pd.Series:
    """Speed by the C library's functions, where ``x`` is given: SQL engines use them, the JVM
    has its own, and the last bit can differ."""
    out = pd.Series(float("nan"), index=x.index)
    for i in x.index[x.notna()]:
        th = math.atan2(x[i], y[i])
        vx = vr[i] * math.sin(th) + vt[i] * math.cos(th)
        vy = vr[i] * math.cos(th) - vt[i] * math.sin(th)
        out[i] = math.sqrt(vx * vx + vy * vy)
    return out


#: a speed this near to the least one that counts is decided by :func:`_speed`
EDGE = 1e-9


def closest_approach(x: Column, y: Column, v_r: Column, v_t: Column, min_speed: float, cap: float) -> Column:
    """struct(vx, vy, speed, cpa_m, t_cpa_s) from radial and tangential speed."""
    th = F.atan2(x, y)
    vr, vt = F.coalesce(v_r, F.lit(0.0)), F.coalesce(v_t, F.lit(0.0))
    known = v_r.isNotNull() | v_t.isNotNull()
    vx = vr * F.sin(th) + vt * F.cos(th)
    vy = vr * F.cos(th) - vt * F.sin(th)
    speed = F.sqrt(vx * vx + vy * vy)
    t = -(x * vx + y * vy) / (speed * speed)
    at_edge = known & (F.abs(speed - min_speed) < EDGE)
    exact = F.pandas_udf(_speed, DoubleType())(*[F.when(at_edge, c.cast("double")) for c in (x, y, vr, vt)])
    ok = known & F.when(at_edge, exact >= min_speed).otherwise(speed >= min_speed) & (t > 0)
    cpa = F.sqrt(F.pow(x + vx * t, 2) + F.pow(y + vy * t, 2))
    return F.struct(
        F.when(known, vx).alias("vx"), F.when(known, vy).alias("vy"), F.when(known, speed).alias("speed"),
        F.when(ok, cpa).alias("cpa_m"), F.when(ok, F.least(t, F.lit(cap))).alias("t_cpa_s"),
    )
