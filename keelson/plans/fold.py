"""Folds over the frames of a recording, declared with array functions.

A recording is cut into blocks of frames; a block is one array that ``aggregate`` folds inside
the engine.  Only the state after a block goes on to the next one, by a join per round, so the
rows of a task are bounded by the block and all recordings advance together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keelson.session import cut_lineage

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none_of(items: Column) -> Column:
    """An empty array of the same type."""
    return F.slice(items, 1, 0)


def only(items: Column, keep: Callable[[Column], Column]) -> Column:
    """The first item that ``keep`` accepts, or null."""
    return F.get(F.filter(items, keep), F.lit(0))


def one_to_one(pairs: Column, left: str, right: str) -> Column:
    """Of pairs in their order, those whose two sides no earlier taken pair holds."""
    def take(won: Column, p: Column) -> Column:
        used = F.exists(won, lambda w: (w[left] == p[left]) | (w[right] == p[right]))
        return F.when(used, won).otherwise(F.array_append(won, p))

    return F.aggregate(F.array_sort(pairs), none_of(pairs), take)


def fold_frames(frames: DataFrame, keys: Sequence[str], pos: str, zero: str, step: Callable[[Column, Column], Column], block: int = BLOCK) -> DataFrame:
    """Folds ``step(state, frame)`` over the frames (one row per key and ``pos``) of every key.
    ``zero`` is the SQL of the first state, a struct with an array ``out``: its items are the rows
    of the result."""
    keys = list(keys)
    item = F.struct(pos, *[c for c in frames.columns if c not in keys and c != pos])
    blocks = frames.groupBy(*keys, F.floor(F.col(pos) / block).alias("__block")).agg(F.array_sort(F.collect_list(item)).alias("__xs"))
    blocks = blocks.withColumn("__round", F.row_number().over(W.partitionBy(*keys).orderBy("__block"))).drop("__block")
    start = F.expr(zero)
    blocks = cut_lineage(blocks)
    rounds = blocks.agg(F.max("__round")).first()[0] or 1
    out, state = None, None
    for r in range(1, rounds + 1):
        rows = blocks.filter(F.col("__round") == r)
        if state is None:
            done = rows.select(*keys, F.aggregate("__xs", start, step).alias("__s"))
        else:
            done = rows.join(state, keys).select(*keys, F.aggregate("__xs", F.col("__from"), step).alias("__s"))
        if rounds > 1:
            done = cut_lineage(done)
            state = done.select(*keys, F.col("__s").withField("out", none_of(F.col("__s.out"))).alias("__from"))
        made = done.select(*keys, F.explode("__s.out").alias("__o")).select(*keys, "__o.*")
        out = made if out is None else out.unionByName(made)
    return out
