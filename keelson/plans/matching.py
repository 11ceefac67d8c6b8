"""One-to-one greedy matching and suppression chains over candidate pairs.

Greedy matching takes pairs in a total order and skips pairs whose left or right
item is already used.  A pair that is first among all live pairs of both its items
is always taken, so repeated rounds of "take every locally first pair, drop its
items" give the same answer with nothing but aggregates and joins.  Groups whose
size is known and small are folded in one pass instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.session import cut_lineage

FOLD_LIMIT = 20_000


def _fold(pairs: DataFrame, group: Sequence[str], left: str, right: str, rank: Sequence[Column]) -> DataFrame:
    item = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)],
                    F.col(left).alias("l"), F.col(right).alias("r"))
    g = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("ps"))
    lt, rt = pairs.schema[left].dataType.simpleString(), pairs.schema[right].dataType.simpleString()
    zero = F.expr(f"named_struct('ls', cast(array() as array<{lt}>), 'rs', cast(array() as array<{rt}>))")

    def step(acc, p):
        free = ~F.array_contains(acc["ls"], p["l"]) & ~F.array_contains(acc["rs"], p["r"])
        return F.struct(
            F.when(free, F.array_append(acc["ls"], p["l"])).otherwise(acc["ls"]).alias("ls"),
            F.when(free, F.array_append(acc["rs"], p["r"])).otherwise(acc["rs"]).alias("rs"),
        )

    out = g.select(*group, F.aggregate("ps", zero, step).alias("m"))
    return out.select(*group, F.explode(F.arrays_zip("m.ls", "m.rs")).alias("z")).select(
        *group, F.col("z.ls").alias(left), F.col("z.rs").alias(right))


def _rounds(pairs: DataFrame, group: Sequence[str], left: str, right: str, rank: Sequence[Column]) -> DataFrame:
    group = list(group)
    key = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], F.col(left).alias("l"), F.col(right).alias("r"))
    live = cut_lineage(pairs.select(*group, left, right, key.alias("__k")))
    taken = None
    while live.limit(1).count():
        ml = live.groupBy(*group, left).agg(F.min("__k").alias("__kl"))
        mr = live.groupBy(*group, right).agg(F.min("__k").alias("__kr"))
        win = cut_lineage(
            live.join(ml, group + [left]).join(mr, group + [right])
            .filter((F.col("__k") == F.col("__kl")) & (F.col("__k") == F.col("__kr")))
            .select(*group, left, right))
        taken = win if taken is None else taken.unionByName(win)
        live = cut_lineage(
            live.join(win.select(*group, left), group + [left], "left_anti")
            .join(win.select(*group, right), group + [right], "left_anti"))
    return taken if taken is not None else pairs.select(*group, left, right).limit(0)


def greedy_match(
    pairs: DataFrame, group: Sequence[str], left: str, right: str, rank: Sequence[Column], *,
    bounded: bool = False, fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Greedy one-to-one matching of ``pairs`` per ``group`` in ascending ``rank``.

    ``bounded=True`` states that group size has a proven bound upstream; otherwise
    the largest group is measured and oversized inputs use the round-based plan.
    """
    if not bounded:
        top = pairs.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if top > fold_limit:
            return _rounds(pairs, group, left, right, rank)
    return _fold(pairs, group, left, right, rank)


def suppress_chain(
    items: DataFrame, conflicts: DataFrame, keys: Sequence[str], item: str, over: str,
) -> DataFrame:
    """Keep an item unless a *kept* higher-ranked item conflicts with it.

    ``conflicts`` holds (keys, over, item): ``over`` outranks and overlaps ``item``.
    Each round keeps items with no undecided or kept rival and removes what they
    conflict with, until nothing is undecided.
    """
    keys = list(keys)
    undecided = cut_lineage(items.select(*keys, item))
    edges = cut_lineage(conflicts.select(*keys, over, item))
    kept = None
    while undecided.limit(1).count():
        win = cut_lineage(undecided.join(edges.select(*keys, item), keys + [item], "left_anti"))
        kept = win if kept is None else kept.unionByName(win)
        lost = edges.join(win.withColumnRenamed(item, over), keys + [over], "left_semi").select(*keys, item).distinct()
        gone = cut_lineage(win.unionByName(lost).distinct())
        undecided = cut_lineage(undecided.join(gone, keys + [item], "left_anti"))
        edges = cut_lineage(
            edges.join(gone, keys + [item], "left_anti")
            .join(gone.withColumnRenamed(item, over), keys + [over], "left_anti"))
    return items.join(kept, keys + [item], "left_semi") if kept is not None else items.limit(0)
