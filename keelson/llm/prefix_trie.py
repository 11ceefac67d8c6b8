"""Trie of conversation prefixes as balanced parentheses, one shard of sorted paths at a time.

A path is the turns of a conversation, ``STEP`` bytes each: a digest of role and text, and the
bytes of the text.  Equal conversations become one path with a count.  Paths are sorted by range,
so a shard is a run of neighbours in depth-first order and its trie is written down as
parentheses: an opening one per node.  ``find_close`` (excess minima of blocks and of ranges of
blocks) delimits a subtree; members, leaves (ranks of "()") and savings of a subtree are
differences of cumulative arrays over the opening parentheses, its smallest member a range minimum.

A node on the first or the last path of a shard may go on in the neighbours.  These two spines are
handed to the next level with what hangs from each of their nodes, and are merged there in the same
way, until few enough are left for one shard.  So no node's members meet in one task, however
frequent a turn or a conversation is; only spines, two paths a shard, go on.

Cases: rows without a conv_id belong to no conversation; a null role or text is empty; null turns
come first, equal turns are ordered by their digests; repeated rows are turns of their own; a
conversation without turns is a member of the root; an empty table has no node; other columns are
not read.  What a task holds of a conversation is its path, 20 bytes a turn, whatever its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.staging import discard, staged
from keelson.plans.joins import checked_join

STEP = 20
#: a shard is cut at so many turns, but not below so many paths
SHARD_TURNS, SHARD_PATHS = 100_000, 64
#: spines that end in one shard
LAST_PATHS, LAST_BYTES = 4096, 64 << 20
CHUNK = 1 << 20
BLOCK = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()
HANG = "array<struct<depth:int,n:long,least:long,leaves:long,saved:long,children:long,ends:string>>"
OUT = f"conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, path binary, hangs {HANG}"
NAMES = [x.split()[0] for x in OUT.split(", ")]
_HANG_TYPE = pa.list_(pa.struct([("depth", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("children", pa.int64()), ("ends", pa.string())]))
_TYPES = [*[pa.int64()] * 7, pa.string(), *[pa.binary()] * 3, _HANG_TYPE]


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns (digest, size) in order.  Texts are not shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    turn = F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("size"))
    return conversations.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def with_shared_heads(lists: DataFrame, group: int, most: int) -> DataFrame:
    """Rebuilds every conversation c: the first h turns of conversation c - c % ``group``, then
    its own turns after the first h, with h = crc32(c) % ``most``."""
    heads = lists.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.coalesce(F.slice("head", 1, h), F.slice("turns", 1, 0))
    return lists.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("head_id"), "left").select("conv_id", F.concat(head, own).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """conv_id and path."""
    step = F.transform("turns", lambda t: F.concat(t["digest"], F.lpad(F.hex(t["size"].cast("long")), 8, "0")))
    return lists.select("conv_id", F.unhex(F.array_join(step, "")).alias("path"))


def end_digests(members: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of the comma-joined ascending conv_ids of each key.  The ids of a
    frequent key are joined by many tasks; one task only runs over the joined pieces, in order."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0
        ready: list[tuple] = []
        for b in batches:
            for k, i in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
                if k != key or size >= CHUNK:
                    if ids:
                        ready.append((key, first, ",".join(ids)))
                    key, first, ids, size = k, i, [], 0
                ids.append(str(i))
                size += len(ids[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready) if ready else ((), (), ()), (pa.binary(), pa.int64(), pa.string()))], ["key", "first", "ids"])
            ready = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first]), pa.array([",".join(ids)])], ["key", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])

    pieces = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends string")


def find_close(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Closing positions of the parentheses opened at ``opens``: the first position behind each
    whose excess is one less.  Positions in the same block are read; else the tree of block minima
    leads to the first block that goes so low."""
    n_blocks = 1 << (-(-len(excess) // BLOCK) - 1).bit_length() if len(excess) else 1
    high = np.iinfo(np.int64).max
    padded = np.full(n_blocks * BLOCK, high)
    padded[:len(excess)] = excess
    minima = [padded.reshape(-1, BLOCK).min(axis=1)]
    while len(minima[-1]) > 1:
        minima.append(minima[-1].reshape(-1, 2).min(axis=1))
    target = excess[opens] - 1
    close = np.full(len(opens), -1)

    def read(queries: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Reads on from ``pos`` to the end of the block; queries that found nothing."""
        end, missed = (pos // BLOCK + 1) * BLOCK, []
        while len(queries):
            out = pos >= end
            missed.append(queries[out])
            queries, pos, end = queries[~out], pos[~out], end[~out]
            hit = padded[pos] == target[queries]
            close[queries[hit]] = pos[hit]
            queries, pos, end = queries[~hit], pos[~hit] + 1, end[~hit]
        return np.concatenate(missed) if missed else queries

    # the next position may already be in the next block
    at = opens + 1
    same = at // BLOCK == opens // BLOCK
    rest = np.concatenate([read(np.flatnonzero(same), at[same]), np.flatnonzero(~same)])
    node, level = opens[rest] // BLOCK, np.full(len(rest), -1)
    for k, m in enumerate(minima[:-1]):                 # climb until the sibling behind goes low enough
        up = np.flatnonzero(level < 0)
        sibling = node[up] + 1
        found = (node[up] % 2 == 0) & (m[np.minimum(sibling, len(m) - 1)] <= target[rest[up]])
        level[up[found]], node[up[found]] = k, sibling[found]
        node[up[~found]] //= 2
    for k in range(len(minima) - 1, 0, -1):             # and down to the first such block
        down = np.flatnonzero(level == k)
        node[down] *= 2
        node[down] += minima[k - 1][node[down]] > target[rest[down]]
        level[down] = k - 1
    read(rest, node * BLOCK)
    return close


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    lo, hi = 0, min(len(a), len(b)) // STEP
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * STEP:mid * STEP] == b[lo * STEP:mid * STEP]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _range_minima(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    table = [values]
    while (half := 1 << (len(table) - 1)) * 2 <= len(values):
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    out = np.empty(len(start), np.int64)
    power = np.frexp(size)[1] - 1
    for k in np.unique(power):
        q = power == k
        out[q] = np.minimum(table[k][start[q]], table[k][start[q] + size[q] - (1 << k)])
    return out


def _prefix_keys(path: bytes) -> list[bytes]:
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for k in range(0, len(path), STEP):
        state.update(path[k:k + STEP])
        out.append(state.copy().digest())
    return out


def shard_nodes(rows: list[tuple[bytes, list[dict]]], last: bool, keyed: bool) -> pa.RecordBatch:
    """Nodes of the trie of sorted ``rows`` (path, hangs), and its two spines as rows for the next
    level unless this is the ``last`` one.  ``keyed``: nodes carry the key that children name them by."""
    total = len(rows)
    depth = np.array([len(p) // STEP for p, _ in rows])
    shared = np.array([0] + [_common(a, b) for (a, _), (b, _) in zip(rows, rows[1:])])
    fresh = depth - shared
    # the parentheses: for each path close down to the shared part, then open the rest
    closes = np.concatenate([[0], depth[:-1] - shared[1:]])
    counts = np.concatenate([[1], np.stack([closes, fresh], 1).ravel(), [depth[-1] + 1]])
    signs = np.concatenate([[1], np.tile([-1, 1], total), [-1]])
    bits = np.repeat(signs, counts)
    excess = np.cumsum(bits)
    opens = np.flatnonzero(bits > 0)
    close = find_close(excess, opens)
    n_nodes = len(opens)
    first = 1 + np.cumsum(fresh) - fresh
    level = excess[opens] - 1
    turns = np.frombuffer(b"".join(p[s * STEP:] for (p, _), s in zip(rows, shared.tolist())), np.dtype([("digest", "V16"), ("size", ">u4")]))
    size_of = np.concatenate([[0], turns["size"].astype(np.int64)])

    parent = np.arange(-1, n_nodes - 1)
    spine, at, hung, ends, first_spine = [0], [], [], {}, None
    keys: list[bytes | None] = [None] * n_nodes
    for k, (path, hangs) in enumerate(rows):
        s = int(shared[k])
        del spine[s + 1:]
        if fresh[k]:
            parent[first[k]] = spine[s]
            spine.extend(range(first[k], first[k] + fresh[k]))
        if keyed:
            for node, key in zip(spine[s + (k > 0):], _prefix_keys(path)[s + (k > 0):]):
                keys[node] = key
        for h in hangs:
            at.append(spine[h["depth"]])
            hung.append((h["n"], h["least"], h["leaves"], h["saved"], h["children"]))
            if h["ends"] is not None:
                ends[spine[h["depth"]]] = h["ends"]
        if first_spine is None:
            first_spine = list(spine)
    own = np.zeros((n_nodes, 4), np.int64)                      # members, leaves, savings, children
    least = np.full(n_nodes, np.iinfo(np.int64).max)
    got = np.array(hung, np.int64).reshape(-1, 5)
    np.add.at(own, np.array(at, int), got[:, [0, 2, 3, 4]])
    np.minimum.at(least, np.array(at, int), got[:, 1])

    node = np.arange(n_nodes)
    size = (close - opens + 1) // 2
    complete = np.ones(n_nodes, bool)
    if not last:
        complete[first_spine] = complete[spine] = False

    def below(values: np.ndarray) -> np.ndarray:
        cum = np.concatenate([[0], np.cumsum(values)])
        return cum[node + size] - cum[node]

    n = below(own[:, 0])
    smallest = _range_minima(least, node, size)
    local = np.bincount(parent[1:], minlength=n_nodes)
    children = local + own[:, 3]
    leaf = (close == opens + 1) & (own[:, 3] == 0) & complete
    leaves = below(leaf + own[:, 1])
    saved = below(np.where(complete, (n - 1) * size_of, 0) + own[:, 2])

    done = np.flatnonzero(complete)
    up = parent[done]
    known = (up >= 0) & complete[np.maximum(up, 0)]
    if not keyed and not last:
        for s, path in ((first_spine, rows[0][0]), (spine, rows[-1][0])):
            for i, key in zip(s, _prefix_keys(path)):
                keys[i] = key
    columns: list[list] = [
        smallest[done].tolist(), level[done].tolist(), [int(smallest[u]) if ok else None for u, ok in zip(up.tolist(), known.tolist())], n[done].tolist(), children[done].tolist(),
        leaves[done].tolist(), saved[done].tolist(), [ends.get(i, NO_ENDS) for i in done.tolist()], [keys[i] if keyed else None for i in done.tolist()],
        [None if ok or u < 0 else keys[u] for u, ok in zip(up.tolist(), known.tolist())], [None] * len(done), [None] * len(done)]
    if not last:
        on = np.zeros((n_nodes, 3), np.int64)                   # what the spine below a node holds
        n_on = np.zeros(n_nodes, np.int64)
        figures = np.stack([n, leaves, saved], 1)
        for i in {*first_spine, *spine} - {0}:
            on[parent[i]] += figures[i]
            n_on[parent[i]] += 1

        def hangs(nodes: list[int], lowest: int) -> list[dict]:
            out = []
            for d, i in enumerate(nodes):
                if d >= lowest and n[i] > on[i, 0]:
                    m, lv, sv = (figures[i] - on[i]).tolist()
                    out.append({"depth": d, "n": m, "least": int(smallest[i]), "leaves": lv, "saved": sv, "children": int(children[i] - n_on[i]), "ends": ends.get(i)})
            return out

        spines = [(rows[0][0], hangs(first_spine, 0))]
        if total > 1:
            spines.append((rows[-1][0], hangs(spine, _common(rows[0][0], rows[-1][0]) + 1)))
        for path, h in spines:
            for c, v in zip(columns, [*[None] * 10, path, h]):
                c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], NAMES)


def _level(rows: DataFrame, parts: int | None, last: bool, keyed: bool) -> DataFrame:
    """Nodes, and the spines that go on, of all shards of ``rows`` (path, hangs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for b in batches:
            for path, hangs in zip(b.column("path").to_pylist(), b.column("hangs").to_pylist()):
                held.append((path, hangs))
                turns += len(path) // STEP
                if not last and turns >= SHARD_TURNS and len(held) >= SHARD_PATHS:
                    yield shard_nodes(held, last, keyed)
                    held, turns = [], 0
        if held:
            yield shard_nodes(held, last, keyed)

    rows = rows.select("path", "hangs")
    ranged = rows.repartition(1) if last else rows.repartitionByRange(parts, "path") if parts else rows.repartitionByRange("path")
    return ranged.sortWithinPartitions("path").mapInArrow(run, OUT)


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """Every node of the trie of ``sequences`` (conv_id, path), conv_ids distinct: smallest member,
    depth, the parent's smallest member, members, children, leaves below, savings below and the
    digest of the members that end there."""
    held = staged(sequences.select("conv_id", "path", F.unhex(F.substring(F.sha2("path", 256), 1, 32)).alias("key")), "paths")
    classes = held.groupBy("key", "path").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).join(end_digests(held.select("key", "conv_id")), "key")
    zero = F.lit(0).cast("long")
    hang = F.struct((F.octet_length("path") / STEP).cast("int").alias("depth"), "n", "least", zero.alias("leaves"), zero.alias("saved"), zero.alias("children"), "ends")
    rows, parts, keyed, levels = staged(classes.select("path", F.array(hang).alias("hangs")), "classes"), None, False, []
    discard(held)
    while True:
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
        last = n <= SHARD_PATHS or (keyed and n <= LAST_PATHS and size <= LAST_BYTES)
        levels.append(staged(_level(rows, parts, last, keyed), "level"))
        if last:
            break
        rows, keyed = levels[-1].filter("path IS NOT NULL"), True
        parts = max(1, n // LAST_PATHS)
    nodes = levels[0]
    for other in levels[1:]:
        nodes = nodes.unionByName(other)
    nodes = nodes.filter("path IS NULL").drop("path", "hangs")
    if len(levels) == 1:
        return nodes.drop("key", "parent_key")
    names = nodes.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent"))
    found = checked_join(nodes.filter("parent_key IS NOT NULL").drop("key"), names, ["parent_key"], "left", spread="conv_id")
    found = found.withColumn("parent_conv_id", F.col("__parent")).drop("__parent", "parent_key")
    return nodes.filter("parent_key IS NULL").drop("key", "parent_key").unionByName(found)
