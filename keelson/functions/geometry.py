"""Camera and water-plane geometry as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.params import Camera


def transform(x: Column, y: Column, z: Column, t: Sequence[Sequence[float]]) -> tuple[Column, Column, Column]:
    """Rigid transform by a 3x4 matrix."""
    return tuple(x * r[0] + y * r[1] + z * r[2] + r[3] for r in t)


def camera_ray(x: Column, y: Column, z: Column, t) -> Column:
    """struct(a, b): direction (X/Z, Y/Z) in the camera frame; null behind the camera.
    Store it as a column before projecting, so that it is computed once."""
    cx, cy, cz = transform(x, y, z, t)
    return F.when(cz > 1e-6, F.struct((cx / cz).alias("a"), (cy / cz).alias("b")))


def project(ray: Column, cam: Camera) -> Column:
    """struct(u, v) in the undistorted image."""
    return F.struct((cam.fx * ray["a"] + cam.cx).alias("u"), (cam.fy * ray["b"] + cam.cy).alias("v"))


def project_raw_pinhole(ray: Column, cam: Camera, d: Sequence[float]) -> Column:
    """struct(u, v) with radial (k1, k2, k3) and tangential (p1, p2) lens distortion."""
    k1, k2, p1, p2, k3 = d
    a, b = ray["a"], ray["b"]
    r2 = a * a + b * b
    radial = 1.0 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    u = a * radial + 2.0 * p1 * a * b + p2 * (r2 + 2.0 * a * a)
    v = b * radial + p1 * (r2 + 2.0 * b * b) + 2.0 * p2 * a * b
    return F.struct((cam.fx * u + cam.cx).alias("u"), (cam.fy * v + cam.cy).alias("v"))


def fisheye_scale(ray: Column, k: Sequence[float]) -> Column:
    """Distorted over undistorted radius of the four-term angular polynomial."""
    r = F.sqrt(ray["a"] * ray["a"] + ray["b"] * ray["b"])
    th = F.atan(r)
    poly = 1.0 + k[0] * F.pow(th, 2) + k[1] * F.pow(th, 4) + k[2] * F.pow(th, 6) + k[3] * F.pow(th, 8)
    return F.when(r > 1e-12, th * poly / r).otherwise(1.0)


def project_raw_fisheye(ray: Column, scale: Column, cam: Camera) -> Column:
    """struct(u, v) in the raw fisheye image; ``scale`` from :func:`fisheye_scale`."""
    return F.struct((cam.fx * ray["a"] * scale + cam.cx).alias("u"), (cam.fy * ray["b"] * scale + cam.cy).alias("v"))


def bearing_pinhole(u: Column, cam: Camera) -> Column:
    return F.degrees(F.atan2(u - cam.cx, F.lit(cam.fx)))


def bearing_linear(u: Column, cam: Camera) -> Column:
    return (u - cam.lin_cx) / cam.px_per_deg


def column_of(bearing_deg: Column, cam: Camera) -> Column:
    return cam.cx + cam.fx * F.tan(F.radians(bearing_deg))


def column_band(left_deg: Column, right_deg: Column, cam: Camera) -> Column:
    """struct(u0, u1): half-open column range of a bearing span inside the image."""
    a, b = F.bround(column_of(left_deg, cam)).cast("int"), F.bround(column_of(right_deg, cam)).cast("int")
    u0, u1 = F.greatest(F.least(a, b), F.lit(0)), F.least(F.greatest(a, b), F.lit(cam.width))
    return F.when(u1 > u0, F.struct(u0.alias("u0"), u1.alias("u1")))


def up(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def up_level() -> Column:
    return up(F.lit(0.0), F.lit(-1.0), F.lit(0.0))


def up_from_pitch_roll(pitch: Column, roll: Column) -> Column:
    """World up in the camera frame (pitch about X, nose up positive; roll about Z)."""
    return up(-F.sin(roll), -F.cos(roll) * F.cos(pitch), F.cos(roll) * F.sin(pitch))


def up_from_horizon(slope: Column, intercept: Column, cam: Camera) -> Column:
    """World up from the horizon line ``row = slope * col + intercept``."""
    x = slope * cam.fx
    y = F.lit(-cam.fy)
    z = slope * cam.cx - cam.cy + intercept
    n = F.sqrt(x * x + y * y + z * z)
    return up(x / n, y / n, z / n)


def pitch_roll_from_up(u: Column) -> Column:
    n = F.sqrt(u["x"] * u["x"] + u["y"] * u["y"] + u["z"] * u["z"])
    roll = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -u["x"] / n)))
    return F.struct(F.when(n == 0, 0.0).otherwise(F.atan2(u["z"], -u["y"])).alias("pitch"),
                    F.when(n == 0, 0.0).otherwise(roll).alias("roll"))


def horizon_from_up(u: Column, cam: Camera) -> Column:
    """struct(slope, intercept); zeros for a vertical horizon."""
    a, b = u["x"] / cam.fx, u["y"] / cam.fy
    c = u["z"] - cam.cx * a - cam.cy * b
    flat = F.abs(b) < 1e-12
    return F.struct(F.when(flat, 0.0).otherwise(-a / b).alias("slope"), F.when(flat, 0.0).otherwise(-c / b).alias("intercept"))


def water_range(u: Column, v: Column, cam: Camera, upv: Column, max_range_m: float | None = None) -> Column:
    """Slant range where the pixel's ray meets the water plane; null at or above the
    horizon or beyond the limit."""
    dx, dy = (u - cam.cx) / cam.fx, (v - cam.cy) / cam.fy
    den = upv["x"] * dx + upv["y"] * dy + upv["z"]
    r = (-cam.mount_height_m / den) * F.sqrt(dx * dx + dy * dy + 1.0)
    ok = den < -1e-9
    if max_range_m is not None:
        ok = ok & (r <= max_range_m)
    return F.when(ok, r)


def reliable_range(u: Column, v: Column, cam: Camera, upv: Column, max_range_m: float, noise_px: float = 3.0) -> Column:
    """struct(range_m, raw_range_m): announced only when the ray shifted up by the pixel
    noise still lands within the limit."""
    raw = water_range(u, v, cam, upv)
    far = water_range(u, v - noise_px, cam, upv)
    ok = (raw <= max_range_m) & (far <= max_range_m) if noise_px > 0 else raw <= max_range_m
    return F.struct(F.when(ok, raw).alias("range_m"), raw.alias("raw_range_m"))


def may_vote(raw_range: Column, gate_m: float | None = 30.0) -> Column:
    return F.lit(True) if not gate_m else raw_range.isNull() | (raw_range <= gate_m)


def arbitrate_attitude(
    cam: Camera, *, water: Column, horizon: Column, imu: Column, order: Sequence[str] = ("water_edge", "imu", "horizon", "level"),
    water_min: float = 0.4, horizon_min: float = 0.5, max_tilt_px: float = 170.0, imu_gate_deg: float = 0.0,
) -> Column:
    """struct(up, source): the first usable attitude source.

    ``water`` and ``horizon`` are struct(slope, intercept, conf); ``imu`` is
    struct(pitch, roll) in radians or null.
    """
    def near_imu(u: Column) -> Column:
        if imu_gate_deg <= 0:
            return F.lit(True)
        pr = pitch_roll_from_up(u)
        off = F.greatest(F.abs(F.degrees(pr["pitch"] - imu["pitch"])), F.abs(F.degrees(pr["roll"] - imu["roll"])))
        return imu.isNull() | (off <= imu_gate_deg)

    wu, hu = (up_from_horizon(s["slope"], s["intercept"], cam) for s in (water, horizon))
    tilt = F.abs(horizon["slope"] * cam.cx + horizon["intercept"] - cam.cy)
    options = {
        "water_edge": (F.coalesce((water["conf"] >= water_min) & near_imu(wu), F.lit(False)), wu),
        "imu": (imu.isNotNull(), up_from_pitch_roll(imu["pitch"], imu["roll"])),
        "horizon": (F.coalesce((horizon["conf"] >= horizon_min) & (tilt <= max_tilt_px) & near_imu(hu), F.lit(False)), hu),
        "level": (F.lit(True), up_level()),
    }
    picks = [F.when(options[s][0], F.struct(options[s][1].alias("up"), F.lit(s).alias("source"))) for s in (*order, "level")]
    return F.coalesce(*picks)


def quaternion_to_euler(w: Column, x: Column, y: Column, z: Column) -> Column:
    """struct(roll, pitch, yaw) in radians; pitch clamped at the poles; zero norm gives zeros."""
    n2 = w * w + x * x + y * y + z * z
    s = 2.0 * (w * y - z * x) / n2
    pitch = F.when(F.abs(s) >= 1, F.signum(s) * (math.pi / 2)).otherwise(F.asin(s))
    none = n2 == 0

    def at(c):
        return F.when(none, 0.0).otherwise(c)

    return F.struct(
        at(F.atan2(2.0 * (w * x + y * z) / n2, 1.0 - 2.0 * (x * x + y * y) / n2)).alias("roll"),
        at(pitch).alias("pitch"),
        at(F.atan2(2.0 * (w * z + x * y) / n2, 1.0 - 2.0 * (y * y + z * z) / n2)).alias("yaw"))


def camera_attitude(yaw: Column, pitch: Column, roll: Column, flip: bool = True) -> Column:
    """struct(pitch, roll, heading) of the camera from sensor Euler angles, by composing
    the rotation (axis order Z, X, Y; yaw negated) and reading it in the camera frame."""
    k = -1.0 if flip else 1.0
    ux, uy, uz = -F.cos(pitch) * F.sin(roll) * k, F.sin(pitch) * k, F.cos(pitch) * F.cos(roll)
    fx = F.cos(yaw) * F.sin(roll) - F.sin(yaw) * F.sin(pitch) * F.cos(roll)
    fy = -F.sin(yaw) * F.sin(roll) - F.cos(yaw) * F.sin(pitch) * F.cos(roll)
    return F.struct(F.atan2(uz, -uy).alias("pitch"),
                    F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -ux))).alias("roll"),
                    F.atan2(fx, fy).alias("heading"))


def euler_mapping(pitch: Column, roll: Column, *, swap: bool = False, sign_pitch: float = 1.0, sign_roll: float = 1.0,
                  mount_pitch: float = 0.0, mount_roll: float = 0.0) -> Column:
    """struct(pitch, roll): axis swap, signs and mount offsets for well-placed sensors."""
    p, r = (roll, pitch) if swap else (pitch, roll)
    return F.struct((sign_pitch * p + mount_pitch).alias("pitch"), (sign_roll * r + mount_roll).alias("roll"))


def polygon_pixels(flat: Column, width: float, height: float) -> Column:
    """Flat normalised list to points; null below three vertices.  Points are taken to a millionth
    of a pixel: the last bits of a quotient would decide between polygons of one size."""
    n = F.floor(F.size(flat) / 2).cast("int")
    pts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.round(F.element_at(flat, i * 2 + 1) * width, 6).alias("x"), F.round(F.element_at(flat, i * 2 + 2) * height, 6).alias("y")))
    return F.when(F.size(flat) >= 6, pts)


def _edges(poly: Column) -> Column:
    nxt = F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))
    return F.zip_with(poly, nxt, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def polygon_area(poly: Column) -> Column:
    return F.abs(F.aggregate(_edges(poly), F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]))) / 2.0


def signed_distance(u: Column, v: Column, poly: Column) -> Column:
    """Distance to the outline, positive inside."""
    def seg(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        ll = dx * dx + dy * dy
        s = F.when(ll > 0, ((u - e["ax"]) * dx + (v - e["ay"]) * dy) / ll).otherwise(0.0)
        s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
        return F.sqrt(F.pow(u - e["ax"] - s * dx, 2) + F.pow(v - e["ay"] - s * dy, 2))

    def crosses(e):
        straddle = (e["ay"] > v) != (e["by"] > v)
        at = e["ax"] + (v - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])
        return F.when(straddle & (u < at), 1).otherwise(0)

    edges = _edges(poly)
    d = F.array_min(F.transform(edges, seg))
    odd = F.aggregate(F.transform(edges, crosses), F.lit(0), lambda s, x: s + x) % 2 == 1
    return F.when(odd, d).otherwise(-d)
