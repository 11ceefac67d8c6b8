"""Ordered scans that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, which
fails when one recording holds a large share of all rows.  Here each key is cut
into slices (time ranges, or ranges of a sort key).  Windows run inside a slice,
one summary row per slice is carried forward, and the carry is joined back.  The
result equals the unsliced window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLICE = "__slice"


def time_slices(df: DataFrame, t: str, width: float) -> DataFrame:
    """Adds the slice column: ``floor(t / width)``."""
    return df.withColumn(SLICE, F.floor(F.col(t) / F.lit(float(width))).cast("bigint"))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    run_sum: Mapping[str, Column] | None = None,
    run_max: Mapping[str, Column] | None = None,
    fill: Mapping[str, Column] | None = None,
    backfill: Mapping[str, Column] | None = None,
    slice_col: str = SLICE,
) -> DataFrame:
    """Adds, per ``keys`` in ``order``: previous/next value, running sum, running
    max, last value so far and next value from here (both skipping nulls).

    ``slice_col`` must not decrease along ``order``; ``order`` must be total.
    """
    keys = list(keys)
    part = keys + [slice_col]
    # one exchange feeds both the windows and the summaries (it is reused, and dropped when
    # the input already has this partitioning), so the input is computed once
    df = df.repartition(*part)
    w = W.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    onward = w.rowsBetween(0, W.unboundedFollowing)
    pos = F.struct(*order)
    ws = W.partitionBy(*keys).orderBy(slice_col)
    before = ws.rowsBetween(W.unboundedPreceding, -1)
    after = ws.rowsBetween(1, W.unboundedFollowing)

    local, summary, carry, final = {}, [], {}, {}
    tmp: list[str] = []

    def add(name, loc, agg, car, fin):
        a, b = f"__l_{name}", f"__c_{name}"
        local[a] = loc
        summary.append(agg.alias(b))
        carry[b] = car(F.col(b))
        final[name] = fin(F.col(a), F.col(b))
        tmp.extend((a, b))

    for n, c in (lag or {}).items():
        v = F.struct(c.alias("v"))
        add(n, F.lag(v).over(w), F.max_by(v, pos), lambda x: F.lag(x).over(ws),
            lambda a, b: F.coalesce(a, b)["v"])
    for n, c in (lead or {}).items():
        v = F.struct(c.alias("v"))
        add(n, F.lead(v).over(w), F.min_by(v, pos), lambda x: F.lead(x).over(ws),
            lambda a, b: F.coalesce(a, b)["v"])
    for n, c in (run_sum or {}).items():
        add(n, F.sum(c).over(upto), F.sum(c), lambda x: F.sum(x).over(before),
            lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    for n, c in (run_max or {}).items():
        add(n, F.max(c).over(upto), F.max(c), lambda x: F.max(x).over(before),
            lambda a, b: F.greatest(a, b))
    for n, c in (fill or {}).items():
        add(n, F.last(c, ignorenulls=True).over(upto),
            F.max_by(c, F.when(c.isNotNull(), pos)),
            lambda x: F.last(x, ignorenulls=True).over(before), F.coalesce)
    for n, c in (backfill or {}).items():
        add(n, F.first(c, ignorenulls=True).over(onward),
            F.min_by(c, F.when(c.isNotNull(), pos)),
            lambda x: F.first(x, ignorenulls=True).over(after), F.coalesce)

    carried = df.groupBy(*part).agg(*summary).select(*part, *[e.alias(n) for n, e in carry.items()])
    return (
        df.withColumns(local).join(carried, part, "left").withColumns(final).drop(*tmp)
    )


SLICE_ROWS = 200_000
MOST_SLICES = 4096


def _at_most(bounds: list, x: Column, strict: bool = False) -> Column:
    """How many of the sorted ``bounds`` are at most (``strict``: below) ``x``, by halving."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])

    def move(at: Column, step: Column) -> Column:
        b = F.get(table, at + step - 1)
        return F.when((at + step <= len(bounds)) & ((b < x) if strict else (b <= x)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), move)


def order_slices(df: DataFrame, score: str, row_id: str, parts: int | None = None) -> DataFrame:
    """Slices for the global order (score desc, row_id asc), about ``SLICE_ROWS`` rows each
    unless ``parts`` fixes their number.

    Bounds come from one approximate-quantile pass; a score so frequent that it
    fills a whole slice is cut further by ranges of ``row_id``.
    """
    probes = parts or MOST_SLICES
    probs = [i / probes for i in range(1, probes)]
    q = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(score, probs, 4 * probes).alias("s"),
        F.percentile_approx(row_id, probs, 4 * probes).alias("i"),
    ).first()
    wanted = parts or min(MOST_SLICES, max(8, -(-q["n"] // SLICE_ROWS)))
    pick = sorted({round(k * probes / wanted) - 1 for k in range(1, wanted)})
    s_all = [float(q["s"][k]) for k in pick] if q["s"] else []
    ids = sorted({int(q["i"][k]) for k in pick}) if q["i"] else []
    bounds = sorted(set(s_all))
    heavy = sorted({x for x in bounds if s_all.count(x) > 1})
    sc = F.col(score).cast("double")
    # equal-to-a-bound is its own slice
    coarse = F.lit(2 * len(bounds)) - (_at_most(bounds, sc) + _at_most(bounds, sc, strict=True))
    if heavy and ids:
        fine = _at_most(ids, F.col(row_id))
        coarse = coarse * F.lit(len(ids) + 1) + F.when(sc.isin(heavy), fine).otherwise(F.lit(0))
    return df.withColumn(SLICE, coarse.cast("bigint"))


def nearest_asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    payload: Sequence[str],
    max_age: float,
    side: str = "nearest",
    slack: float = 0.0,
    slice_factor: int = 20,
) -> DataFrame:
    """As-of join without a range join.

    Both sides are cut into time slices of ``slice_factor * max_age``; a right row
    within ``max_age`` of a slice edge is also placed in the neighbour, so every
    slice is self-contained.  ``side`` is ``nearest`` (ties go to the earlier
    sample), ``backward`` (at most ``slack`` later) or ``forward`` (at or after).  Adds the payload columns
    and ``asof_gap`` (left time minus right time), null when nothing is in reach.
    Right times must be distinct within a key.
    """
    keys = list(keys)
    age = F.lit(float(max_age))
    width = F.lit(float(max_age) * slice_factor)
    reach = F.lit(float(max_age) + float(slack))
    tc = F.col(t).cast("double")

    def bucket(c):
        return F.floor(c / width).cast("bigint")

    r = right.select(*keys, tc.alias("__t"), F.struct(tc.alias("__rt"), *payload).alias("__p"))
    r = r.withColumn(
        SLICE,
        F.explode(F.array_distinct(F.array(bucket(F.col("__t") - reach), bucket(F.col("__t")),
                                           bucket(F.col("__t") + reach)))),
    ).withColumn("__isl", F.lit(0))
    lt = tc + F.lit(float(slack)) if side == "backward" else tc
    lcols = left.columns
    lf = left.select(
        *keys, lt.alias("__t"), F.struct(*lcols).alias("__row"),
        bucket(lt).alias(SLICE), F.lit(1).alias("__isl"),
    )
    both = lf.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(*keys, SLICE).orderBy("__t", "__isl")
    back = F.last("__p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("__b", back)
    here = F.col(f"__row.{t}").cast("double")
    if side == "forward":
        same = F.when(F.col("__b.__rt") == here, F.col("__b"))
        fwd = F.first("__p", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
        both = both.withColumn("__f", fwd)
        best = F.coalesce(same, F.col("__f"))
        pick = F.when(best["__rt"] - here <= age, best)
    elif side == "backward":
        pick = F.when(here - F.col("__b.__rt") <= age, F.col("__b"))
    else:
        fwd = F.first("__p", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
        both = both.withColumn("__f", fwd)
        gb, gf = here - F.col("__b.__rt"), F.col("__f.__rt") - here
        best = F.when(F.col("__f").isNull() | (gb <= gf), F.col("__b")).otherwise(F.col("__f"))
        pick = F.when(F.abs(here - best["__rt"]) <= age, best)
    out = both.filter("__isl = 1").withColumn("__pick", pick)
    return out.select(
        *[F.col(f"__row.{c}").alias(c) for c in lcols],
        *[F.col(f"__pick.{c}").alias(c) for c in payload],
        (here - F.col("__pick.__rt")).alias("asof_gap"),
    )


def inside_intervals(
    rows: DataFrame, intervals: DataFrame, keys: Sequence[str], *, t: str, start: str, end: str,
    width: float, flag: str = "inside",
) -> DataFrame:
    """Flags rows whose time lies in any interval of the same key (both ends
    inclusive): the running maximum of interval ends started so far covers t.
    Linear in both inputs; no row-interval pairs are formed."""
    keys = list(keys)
    cols = rows.columns
    lo, hi = F.least(start, end).cast("double"), F.greatest(start, end).cast("double")
    iv = intervals.select(*keys, lo.alias("__t"), hi.alias("__end"), F.lit(0).alias("__k"),
                          F.lit(None).cast("bigint").alias("__id"))
    r = rows.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(1).alias("__k"),
                    F.monotonically_increasing_id().alias("__id"), F.struct(*cols).alias("__row"))
    both = r.unionByName(iv, allowMissingColumns=True)
    both = time_slices(both, "__t", width)
    both = scan(both, keys, ["__t", "__k", "__id"], run_max={"__m": F.col("__end")})
    return both.filter("__k = 1").select(
        *[F.col(f"__row.{c}").alias(c) for c in cols],
        F.coalesce(F.col("__m") >= F.col("__t"), F.lit(False)).alias(flag),
    )


def haloed(df: DataFrame, t: str, width: float, before: float, after: float = 0.0) -> DataFrame:
    """Time slices that also hold the rows up to ``before`` earlier and ``after`` later,
    so that a range window of that reach needs only its own slice.  ``__own`` marks the
    rows that belong to the slice; filter on it after the window."""
    tc, w = F.col(t).cast("double"), F.lit(float(width))

    def bucket(c):
        return F.floor(c / w).cast("bigint")

    d = df.withColumn(SLICE, F.explode(F.sequence(bucket(tc - F.lit(float(after))), bucket(tc + F.lit(float(before))))))
    return d.withColumn("__own", F.col(SLICE) == bucket(tc))


def linear_recurrence(
    df: DataFrame, keys: Sequence[str], pos: str, a: Column, b: Column, out: str, *, block: int = 256,
) -> DataFrame:
    """Solves ``y = a * y_prev + b`` along ``pos`` (distinct integers) per key.

    A block of positions is composed into one affine map; block maps are composed the
    same way once more, and only those are folded per key, so work per task stays
    bounded by the block.  ``a = 0`` restarts the recurrence.
    """
    keys = list(keys)

    def prefixes(d: DataFrame, part: list[str], p: str) -> DataFrame:
        item = F.struct(F.col(p).alias("p"), F.col("__a").alias("a"), F.col("__b").alias("b"))
        g = d.groupBy(*part).agg(F.array_sort(F.collect_list(item)).alias("xs"))
        zero = F.expr("named_struct('a', 1.0D, 'b', 0.0D, 'o', cast(array() as array<struct<p:bigint,a:double,b:double>>))")

        def step(acc, x):
            na, nb = acc["a"] * x["a"], x["a"] * acc["b"] + x["b"]
            row = F.struct(x["p"].alias("p"), na.alias("a"), nb.alias("b"))
            return F.struct(na.alias("a"), nb.alias("b"), F.array_append(acc["o"], row).alias("o"))

        return g.select(*part, F.aggregate("xs", zero, step).alias("m"))

    def solve(d: DataFrame, depth: int) -> DataFrame:
        """(keys, __p, __A, __B): prefix maps from the start of the key."""
        if depth == 0:
            m = prefixes(d, keys, "__p")
            return m.select(*keys, F.explode("m.o").alias("z")).select(
                *keys, F.col("z.p").alias("__p"), F.col("z.a").alias("__A"), F.col("z.b").alias("__B"))
        d = d.withColumn("__blk", F.floor(F.col("__p") / F.lit(block)).cast("bigint"))
        m = prefixes(d, keys + ["__blk"], "__p")
        top = solve(m.select(*keys, F.col("__blk").alias("__p"), F.col("m.a").alias("__a"), F.col("m.b").alias("__b")), depth - 1)
        # value entering a block: the prefix of the block before it that exists
        w = W.partitionBy(*keys).orderBy("__p")
        top = top.select(*keys, F.col("__p").alias("__blk"), F.lag("__A").over(w).alias("__iA"), F.lag("__B").over(w).alias("__iB"))
        e = m.select(*keys, "__blk", F.explode("m.o").alias("z")).join(top, keys + ["__blk"])
        ia, ib = F.coalesce("__iA", F.lit(1.0)), F.coalesce("__iB", F.lit(0.0))
        return e.select(*keys, F.col("z.p").alias("__p"), (F.col("z.a") * ia).alias("__A"),
                        (F.col("z.a") * ib + F.col("z.b")).alias("__B"))

    src = df.select(*keys, F.col(pos).cast("bigint").alias("__p"), a.cast("double").alias("__a"), b.cast("double").alias("__b"))
    y = solve(src, 2).select(*keys, F.col("__p").alias(pos), F.col("__B").alias(out))
    return df.withColumn(pos, F.col(pos).cast("bigint")).join(y, keys + [pos])
