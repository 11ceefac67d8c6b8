"""Parameter sets.  Numbers are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BinGrid:
    lo: float = -52.5
    hi: float = 52.5
    step: float = 15.0

    @property
    def n(self) -> int:
        return round((self.hi - self.lo) / self.step)

    def center(self, i: int) -> float:
        return self.lo + (i + 0.5) * self.step


@dataclass(frozen=True)
class RadarGate:
    min_points: int = 1
    max_points: int = 500
    y_min: float = 0.5
    y_max: float = 9.0
    mount_yaw_deg: float = 0.0
    clutter_x: tuple[float, float] = (-1.0, 0.25)
    clutter_y: tuple[float, float] = (0.0, 1.3)
    keep_if_doppler_above: float = 0.30
    has_doppler: bool = True


@dataclass(frozen=True)
class Motion:
    ttc_eps_mps: float = 0.15
    ttc_cap_s: float = 60.0
    gate_m: float = 0.5
    max_dt_s: float = 0.5
    cluster_gate_m: float = 1.0
    assoc_gate_m: float = 1.5
    min_hits: int = 3
    max_age: int = 5
    ema_alpha: float = 0.5
    rate_window_s: float = 2.0
    rate_min_samples: int = 5
    closing_min_mps: float = 0.15
    crossing_min_mps: float = 0.3
    camera_sustain_max_s: float = 6.0
    camera_fresh_s: float = 1.0


@dataclass(frozen=True)
class Camera:
    """Undistorted pinhole camera with its legacy linear bearing model."""

    fx: float
    fy: float
    cx: float
    cy: float
    lin_cx: float
    px_per_deg: float
    width: int
    height: int
    mount_height_m: float
    pad_px: float


# fixed values: calibration of the two cameras and the radar-to-camera transform
FISHEYE = Camera(418.51, 418.58, 444.11, 300.50, 472.0, 7.2, 864, 648, 0.25, 32.0)
THERMAL = Camera(150.0, 150.0, 80.0, 60.0, 77.0, 2.82, 160, 120, 0.188, 12.0)
RADAR_TO_FISHEYE = ((1.0, 0.0, 0.0, -0.0516), (0.0, 0.0, -1.0, 0.0020), (0.0, 1.0, 0.0, -0.0043))

GRID = BinGrid()
GATE = RadarGate()
MOTION = Motion()
MAX_RANGE_M = 15.0
