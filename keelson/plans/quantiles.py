"""Exact quantiles of groups of any size.

``percentile`` gathers a group's values in one task.  Here each round asks for approximate quantiles a
little below and above the wanted ranks, counts what lies below and keeps only the rows between, so
a group shrinks by orders of magnitude per pass; what is left is counted per value and the wanted
ranks are read off.  Interpolation is that of ``percentile``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keelson.plans.joins import checked_join

#: rows of a group that are few enough to be counted per value
FEW = 1_000_000
ACCURACY = 10_000
MOST_ROUNDS = 6


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """keys and one column per name in ``wanted`` (value, probability); nulls do not count, a group
    without values gives null.  A group is in the result when it has a row."""
    g = _quantiles(df, keys, wanted, few, accuracy)
    if not keys:
        return g.drop("__g")
    groups = df.select(*keys).distinct().withColumn("__g", _group(keys))
    return groups.join(g, "__g", "left").select(*keys, *wanted)


def _group(keys: Sequence[str]) -> Column:
    """A group's keys as one value that is never null, so groups with null keys join too."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")


def _quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], few: int, accuracy: int) -> DataFrame:
    names = list(wanted)
    items = F.array(*[F.struct(F.lit(k).alias("which"), c.cast("double").alias("v")) for k, (c, _) in enumerate(wanted.values())])
    probability = F.element_at(F.array(*[F.lit(float(p)) for _, p in wanted.values()]), F.col("which") + 1)
    part = ["__g", "which"]
    rows = df.select(_group(keys).alias("__g"), F.explode(items).alias("x")).select("__g", "x.which", "x.v").filter("v IS NOT NULL")
    ranks = rows.groupBy(*part).agg(F.count("*").alias("n")).withColumn("at", probability * (F.col("n") - 1))
    ranks = ranks.withColumns({"k0": F.floor("at"), "k1": F.ceil("at"), "skip": F.lit(0).cast("long")})
    most = None
    for _ in range(MOST_ROUNDS):
        left = rows.groupBy(*part).agg(F.count("*").alias("__left"))
        now = left.agg(F.max("__left")).first()[0] or 0
        if now <= few or (most is not None and now > most / 2):      # what does not shrink is one value many times over
            break
        most = now
        here = ranks.join(left, part)
        slack = 2.0 / accuracy
        # the wanted ranks among the rows left, as shares
        low = F.greatest(F.lit(0.0), (F.col("k0") - F.col("skip")) / F.col("__left") - slack)
        high = F.least(F.lit(1.0), (F.col("k1") - F.col("skip") + 1) / F.col("__left") + slack)
        grid = [k / 1000 for k in range(1001)]
        sketch = rows.groupBy(*part).agg(F.percentile_approx("v", grid, accuracy).alias("__q"))
        between = here.join(sketch, part).select(
            *part, F.element_at("__q", (F.floor(low * 1000) + 1).cast("int")).alias("__lo"), F.element_at("__q", (F.least(F.lit(1000), F.ceil(high * 1000)) + 1).cast("int")).alias("__hi"))
        marked = checked_join(rows, between, part, "inner", spread="v")
        below = marked.groupBy(*part).agg(F.count_if(F.col("v") < F.col("__lo")).alias("__below"))
        ranks = ranks.join(below, part).withColumn("skip", F.col("skip") + F.col("__below")).drop("__below")
        rows = marked.filter((F.col("v") >= F.col("__lo")) & (F.col("v") <= F.col("__hi"))).select(*part, "v")
    counted = rows.groupBy(*part, "v").agg(F.count("*").alias("c"))
    upto = W.partitionBy(*part).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("c").over(upto)).join(ranks, part)
    first = lambda k: F.min(F.when(F.col("upto") + F.col("skip") > F.col(k), F.col("v")))
    found = placed.groupBy(*part).agg(first("k0").alias("v0"), first("k1").alias("v1"), F.first("at").alias("at"), F.first("k0").alias("k0"), F.first("k1").alias("k1"))
    value = F.when((F.col("k0") == F.col("k1")) | (F.col("v0") == F.col("v1")), F.col("v0")).otherwise((F.col("k1") - F.col("at")) * F.col("v0") + (F.col("at") - F.col("k0")) * F.col("v1"))
    columns = [F.max(F.when(F.col("which") == k, value)).alias(n) for k, n in enumerate(names)]
    return found.groupBy("__g").agg(*columns) if keys else found.agg(*columns).withColumn("__g", F.lit(""))


def with_quantiles(summary: DataFrame, df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], **kw) -> DataFrame:
    """``summary`` (one row per group of ``df``) with exact quantiles of the group."""
    q = _quantiles(df, keys, wanted, kw.get("few", FEW), kw.get("accuracy", ACCURACY))
    return summary.withColumn("__g", _group(keys)).join(q, "__g", "left").drop("__g")
