"""Joins with a checked broadcast, and proximity joins that emit near pairs only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def checked_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str, *,
    max_rows: int = BROADCAST_ROWS, salts: int = 32, spread: str | None = None,
) -> DataFrame:
    """Joins a dimension-like side.  Its row count is checked (reading at most
    ``max_rows + 1`` rows); small sides are broadcast, larger ones are joined on
    the key plus a salt so that one hot key is spread over many tasks.  A side that was
    counted as large is never broadcast, however small its files make it look."""
    on = list(on)
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    src = F.xxhash64(spread) if spread else F.xxhash64(*big.columns)
    left = big.withColumn("__salt", F.pmod(src, F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), on + ["__salt"], how).drop("__salt")


def near_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, radius: float,
    lxy: tuple[str, str], rxy: tuple[str, str],
) -> DataFrame:
    """Pairs within ``radius`` in the plane.  The plane is cut into square cells of
    that size and the right side is placed in its 3x3 neighbourhood."""
    def cell(c):
        return F.floor(F.col(c) / F.lit(float(radius))).cast("bigint")

    def around(c):
        return F.explode(F.sequence(cell(c) - 1, cell(c) + 1))

    lf = left.withColumn("__cx", cell(lxy[0])).withColumn("__cy", cell(lxy[1]))
    rf = right.withColumn("__cx", around(rxy[0])).withColumn("__cy", around(rxy[1]))
    pairs = lf.join(rf, list(keys) + ["__cx", "__cy"])
    d = F.sqrt(F.pow(F.col(lxy[0]) - F.col(rxy[0]), 2) + F.pow(F.col(lxy[1]) - F.col(rxy[1]), 2))
    return pairs.withColumn("dist", d).filter(F.col("dist") <= F.lit(float(radius))).drop("__cx", "__cy")


def box_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, cell: float,
    lbox: Sequence[str], rbox: Sequence[str],
) -> DataFrame:
    """Pairs of overlapping boxes (x0,y0,x1,y1 column names).  Each box is placed in
    the grid cells it covers; a pair is kept only in the cell holding the upper-left
    corner of the overlap, so it appears once."""
    def cells(df, b):
        fx = lambda c: F.floor(F.col(c) / F.lit(float(cell))).cast("bigint")
        return df.withColumn("__cx", F.explode(F.sequence(fx(b[0]), F.greatest(fx(b[0]), fx(b[2]))))).withColumn(
            "__cy", F.explode(F.sequence(fx(b[1]), F.greatest(fx(b[1]), fx(b[3])))))

    p = cells(left, lbox).join(cells(right, rbox), list(keys) + ["__cx", "__cy"])
    ix, iy = F.greatest(lbox[0], rbox[0]), F.greatest(lbox[1], rbox[1])
    own = (F.floor(ix / F.lit(float(cell))) == F.col("__cx")) & (F.floor(iy / F.lit(float(cell))) == F.col("__cy"))
    hit = (ix <= F.least(lbox[2], rbox[2])) & (iy <= F.least(lbox[3], rbox[3]))
    return p.filter(own & hit).drop("__cx", "__cy")


def overlap_area(a: Sequence[str], b: Sequence[str]):
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def box_area(a: Sequence[str]):
    return F.greatest(F.lit(0.0), F.col(a[2]) - F.col(a[0])) * F.greatest(F.lit(0.0), F.col(a[3]) - F.col(a[1]))


def iou(a: Sequence[str], b: Sequence[str]):
    inter = overlap_area(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
