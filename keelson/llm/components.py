"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.staging import discard, staged

MAX_ROUNDS = 60


def _smallest(sides: DataFrame) -> DataFrame:
    """Each (node, other) with the smallest id among the node and its others; partial sums
    leave one row per node and task, and a hot node's rows are split by the join."""
    least = sides.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return sides.join(least, "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select(F.col("v"), F.col("u")))
    return _smallest(both).filter("other > node").select(F.col("other").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("other"))
    star = _smallest(down)
    return star.select(F.col("other").alias("u"), F.col("least").alias("v")).union(star.select("node", "least")).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in ``edges`` (u, v).
    Null ends and loops are dropped; no edges give no rows."""
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        after = staged(_small_star(_large_star(now)).repartition("u"), "edges")
        discard(now)
        now = after
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = state
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
