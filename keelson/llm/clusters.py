"""Centroid clustering in exact integers, with a vantage-point tree over the centroids.

Every round the driver builds a tree over the k centroids (k * dim integers, checked) and sends
it to the tasks.  Each vector walks it best first: of the tree nodes that wait for it, the one
with the smallest lower bound comes next, until no bound is within the best distance found.
All vectors of a batch walk together, each with its own queue.  Bounds come from the triangle
inequality in floating point and are widened by their rounding error, and a node whose bound
equals the best distance is still opened, so ties reach the exact integer comparison at the
leaves and go to the smaller centroid number.  No vector moves between tasks: a round shuffles
one row per task, centroid and component.

Cases: a vector with another number of components, or with a null, NaN or infinite one, is left
out, as is a null vector; a null id is kept, and counts as the empty string in the order of the
seeds; repeated ids and vectors are kept row by row; of equal seed keys the smaller vector comes
first; fewer vectors than ``k`` make as many centroids; an empty table gives no rows; other
columns are not read.  Scaled components reach up to 2^27 in size, beyond which squared
distances could leave a long: a larger one raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.staging import discard, staged

LEAF = 2
#: centroid components that may be sent to the tasks
MAX_CENTROID_VALUES = 1 << 22
#: size of a scaled component up to which 64 squared differences of it fit a long
LARGEST = 1 << 27
#: vectors that walk the tree together
TOGETHER = 4096


@dataclass
class Tree:
    """Nodes in build order.  An inner node has a vantage centroid and two children with the
    range of distances of their centroids from it; a leaf has centroid numbers."""

    centroids: np.ndarray            # k x dim integers
    vantage: np.ndarray              # centroid number of each node, -1 for a leaf
    child: np.ndarray                # nodes x 2
    low: np.ndarray                  # nodes x 2: distances of the child's centroids from the vantage
    high: np.ndarray
    members: list[np.ndarray]        # centroid numbers of each leaf


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (one of both may be a single row)."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def build(centroids: np.ndarray, leaf: int = LEAF) -> Tree:
    vantage, child, low, high, members = [], [], [], [], []

    def node(ids: np.ndarray) -> int:
        at = len(vantage)
        vantage.append(-1)
        child.append([-1, -1])
        low.append([0.0, 0.0])
        high.append([0.0, 0.0])
        members.append(ids)
        if len(ids) <= leaf:
            return at
        # the centroid farthest from the first one sees the others at the most different distances
        v = ids[np.argmax(distances(centroids[ids], centroids[ids[0]]))]
        rest = ids[ids != v]
        d = np.sqrt(distances(centroids[rest], centroids[v]).astype(float))
        order = np.argsort(d, kind="stable")
        vantage[at], members[at] = int(v), ids[:0]
        for side, part in enumerate(np.array_split(order, 2)):
            if len(part):
                low[at][side], high[at][side] = d[part].min(), d[part].max()
                child[at][side] = node(rest[part])
        return at

    if len(centroids):
        node(np.arange(len(centroids)))
    return Tree(centroids, np.array(vantage), np.array(child).reshape(-1, 2), np.array(low).reshape(-1, 2), np.array(high).reshape(-1, 2), members)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every vector (the smallest of equal ones), and the
    exact squared distance."""
    n = len(vectors)
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(tree.centroids))
    waiting = np.full((n, len(tree.vantage)), np.inf)     # lower bound of every node in a vector's queue
    waiting[:, 0] = 0.0

    def meet(rows: np.ndarray, c: int) -> np.ndarray:
        d = distances(vectors[rows], tree.centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
        best[rows[better]], number[rows[better]] = d[better], c
        return d

    live = np.arange(n)
    while len(live):
        first = np.argmin(waiting[live], axis=1)
        bound = waiting[live, first]
        go = bound <= np.sqrt(best[live].astype(float)) * (1 + 1e-12)
        live, first = live[go], first[go]
        waiting[live, first] = np.inf
        for at in np.unique(first):
            rows = live[first == at]
            for c in tree.members[at]:
                meet(rows, c)
            if tree.vantage[at] >= 0:
                d = np.sqrt(meet(rows, tree.vantage[at]).astype(float))
                for side in (0, 1):
                    if (to := tree.child[at, side]) >= 0:
                        lo, hi = tree.low[at, side], tree.high[at, side]
                        waiting[rows, to] = np.maximum(np.maximum(d - hi, lo - d) - (d + hi) * 1e-12, 0.0)
    return number, best


def scaled(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """id and the integer components floor(scale * x) of the vectors that are kept."""
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    component = F.transform(v, lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit("a scaled component does not fit the exact distances"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, component).alias("q")).filter("q IS NOT NULL")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("seed"), "q").orderBy("seed", "q").limit(k).collect()
    return np.array([r.q for r in first], np.int64)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the exact floor of every component's mean."""
    k, dim = centroids.shape
    sent = vectors.sparkSession.sparkContext.broadcast(build(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                m = _matrix(b.column("q").slice(lo, TOGETHER), dim)
                number, _ = nearest(sent.value, m)
                for c in np.unique(number):
                    mine = m[number == c]
                    total[c] += mine.sum(axis=0)
                    count[c] += len(mine)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(seen, dim)), pa.array(np.tile(np.arange(dim), len(seen))), pa.array(total[seen].ravel()), pa.array(np.repeat(count[seen], dim))],
            ["cluster", "component", "total", "n"])

    sums = vectors.select("q").mapInArrow(run, "cluster long, component long, total long, n long")
    rows = sums.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.component] = int(r.total) // r.n
    sent.destroy()
    return out


def fit(vectors: DataFrame, dim: int, k: int, rounds: int, salt: str) -> np.ndarray:
    """Centroids of ``vectors`` (id, q as from :func:`scaled`) after ``rounds`` rounds; a round
    returns k * dim rows to the driver."""
    if k * dim > MAX_CENTROID_VALUES:
        raise ValueError(f"{k} centroids of {dim} components are too many to send to the tasks")
    centroids = _seeds(vectors, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and distance of every vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(build(centroids))
    dim = centroids.shape[1] if len(centroids) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                s = b.slice(lo, TOGETHER)
                number, d = nearest(sent.value, _matrix(s.column("q"), dim))
                yield pa.RecordBatch.from_arrays([s.column("id"), pa.array(number.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, "id long, cluster int, distance long")


def clusters(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, salt: str = "3",
) -> DataFrame:
    """The id column, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every
    vector that is kept.  Seeds are the ``k`` vectors with the smallest sha-256 of ``salt:id``."""
    spark = vectors.sparkSession
    held = staged(scaled(vectors, id_col, vector_col, dim, scale), "scaled")
    centroids = fit(held, dim, k, rounds, salt)
    found = staged(assign(held, centroids), "assigned")
    discard(held)
    digest = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    names = spark.createDataFrame(digest, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    whole = sums.agg(F.sum("s").cast("long").alias("inertia"))
    # k rows on the side that is sent to the tasks
    facts = sums.select("cluster", F.col("s").cast("long").alias("cluster_inertia")).join(F.broadcast(names), "cluster").crossJoin(F.broadcast(whole))
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
