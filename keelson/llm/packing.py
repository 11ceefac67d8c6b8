"""Packs token ids into sequences of a fixed window by non-negative least squares.

A document gives its whole windows and one rest shorter than the window.  The histogram of
the rests has at most ``window`` - 1 counts, however many documents there are.  Against it the
driver solves how often each shallow combination is used: ``i`` rests of one length and at
most one of another that together fill the window exactly.  The counts are rounded down,
raised again where rests are left for it, and each length hands out its rests by rank.  What no
combination takes is laid end to end and cut at the window; the last, partial window is cut at
powers of two.  So no sequence needs padding, and few documents are cut.

Ids are written once, where they were encoded, with a checksum of every whole window and rest.
Ranks come from counts per (written part, length); only rows of counts and places are shuffled,
and ids are read again for the documents that the residual cut.

Cases: a null or empty text is one piece with the end id only (none without an end id, then the
document has no piece); a null doc_id and repeated doc_ids are kept row by row; texts longer
than any window are split into windows; an empty table gives no pieces; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.staging import staged
from keelson.llm.text import list_array, slices, text_bytes
from keelson.llm.token_store import word_encoder
from keelson.llm.workers import tidy
from keelson.plans.joins import checked_join

WINDOW = 4096
#: the histogram and the plan sent to the tasks grow with the window
MAX_WINDOW = 1 << 14
ITERATIONS = 400
SLICE = 1 << 20
#: words and stems that a worker remembers; results do not depend on them
WORDS, STEMS = 150_000, 400_000
ENCODED = "part int, row long, doc_id long, n_tokens long, rest int, rank long, windows_before long, crcs array<long>, ids binary"
PLACED = "part int, row long, doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None, window: int = WINDOW) -> DataFrame:
    """Ids of every document with what its place needs: the written part, the rank of its rest
    among the part's rests of that length and the part's windows before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = word_encoder(tokenizer_path, WORDS, STEMS), TaskContext.get().partitionId()
        row, windows, seen = 0, 0, np.zeros(window, np.int64)
        for b in slices(batches, "text", SLICE):
            ids, cut = encoder.encode(b.column("text"), end_id)
            n = np.diff(cut)
            rest, whole = n % window, n // window
            # ranks inside the slice by a stable sort, continued from the task's counts
            order = np.argsort(rest, kind="stable")
            first = np.searchsorted(rest[order], rest[order])
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - first + seen[rest[order]]
            seen += np.bincount(rest, minlength=window)
            edges = [np.append(np.arange(a, z, window), z) for a, z in zip(cut[:-1], cut[1:])]
            crcs = [[checksum(ids[a:z]) for a, z in zip(e[:-1], e[1:])] for e in edges]
            sizes = np.concatenate([[0], np.cumsum([len(c) for c in crcs])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), b.column("doc_id"), pa.array(n), pa.array(rest.astype(np.int32)), pa.array(rank),
                 pa.array(windows + np.cumsum(whole) - whole), list_array(pa.array(list(chain.from_iterable(crcs)), pa.int64()), sizes),
                 pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((cut * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])],
                ["part", "row", "doc_id", "n_tokens", "rest", "rank", "windows_before", "crcs", "ids"])
            row, windows = row + len(n), windows + int(whole.sum())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), ENCODED)


def combinations(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, times, closing length or 0) of all ways to fill the window with one length
    repeated and at most one rest of another; every way once."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    times = window // lengths
    a = np.repeat(lengths, times)
    i = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + 1
    c = window - a * i
    ok = (c == 0) | (there[c] & (c != a) & ((i > 1) | (a < c)))
    return a[ok], i[ok], c[ok]


def repeats(histogram: np.ndarray, a: np.ndarray, i: np.ndarray, c: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative repeat counts x that minimise the squared difference between the rests
    used and the histogram, by multiplicative updates (each lowers it, none leaves x >= 0)."""
    closes = (c > 0).astype(float)
    use = lambda x: np.bincount(a, i * x, len(histogram)) + np.bincount(c, closes * x, len(histogram))
    back = lambda y: i * y[a] + closes * y[c]
    target = back(histogram.astype(float))
    x = np.minimum(histogram[a] / i, np.where(c > 0, histogram[c], np.inf)) / max(1.0, np.sqrt(len(a)))
    for _ in range(iterations):
        x = x * target / np.maximum(back(use(x)), 1e-12)
    return x


@dataclass
class Plan:
    """Where the rest of a length and rank goes.  Runs of one length follow each other in rank
    order: ``times`` rests of a run share a sequence from ``offset`` on."""

    window: int
    at: np.ndarray           # first run of each length
    rank: np.ndarray         # first rank of each run
    sequence: np.ndarray     # its first sequence
    times: np.ndarray
    offset: np.ndarray
    taken: np.ndarray        # rests of each length that combinations take
    before: np.ndarray       # residual ids in front of each length's residual rests
    edges: np.ndarray        # cuts of the last, partial residual window
    filled: int              # sequences of combinations
    whole: int               # residual ids in whole windows
    first_window: int        # sequence of the first whole window of a document


def solve(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for ``histogram`` (counts of rests by length, 0 to window - 1)."""
    lengths = np.flatnonzero(histogram)
    a, i, c = combinations(lengths, window)
    x = repeats(histogram, a, i, c)
    left = histogram.astype(np.int64).tolist()
    count = [0] * len(a)
    ways = list(zip(a.tolist(), i.tolist(), c.tolist()))

    def use(k: int, most: int) -> None:
        la, n, lc = ways[k]
        m = min(most, left[la] // n, left[lc] if lc else most)
        if m > 0:
            count[k] += m
            left[la] -= m * n
            if lc:
                left[lc] -= m

    order = np.argsort(-x, kind="stable").tolist()
    rounded = np.floor(x).astype(np.int64).tolist()
    for k in order:
        use(k, rounded[k])
    for k in order:                       # rounding down left rests: raise counts again
        use(k, int(histogram[ways[k][0]]))
    runs, given, sequence = [], np.zeros(window, np.int64), 0
    for k, m in enumerate(count):
        if m:
            la, n, lc = ways[k]
            runs.append((la, given[la], sequence, n, 0))
            given[la] += m * n
            if lc:
                runs.append((lc, given[lc], sequence, 1, la * n))
                given[lc] += m
            sequence += m
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    rest = np.arange(window) * np.array(left, np.int64)
    total = int(rest.sum())
    whole = total // window * window
    bits = [1 << b for b in reversed(range(window.bit_length())) if (total - whole) >> b & 1]
    edges = whole + np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
    return Plan(window, np.searchsorted(table[:, 0], np.arange(window + 1)), table[:, 1], table[:, 2], table[:, 3], table[:, 4], given, np.cumsum(rest) - rest, edges,
                sequence, whole, sequence + whole // window + len(bits))


def residual_places(plan: Plan, pos: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces (rest index, start in the rest, length, sequence, offset) of rests that lie at
    ``pos`` of the residual ids."""
    w = plan.window
    end = pos + length
    low = np.minimum(pos, plan.whole) // w
    n_whole = np.maximum(0, -(-np.minimum(end, plan.whole) // w) - low)            # whole windows touched
    k = np.repeat(np.arange(len(pos)), n_whole)
    unit = np.repeat(low, n_whole) + np.arange(len(k)) - np.repeat(np.cumsum(n_whole) - n_whole, n_whole)
    ks, starts, ends, seqs, offs = [k], [np.maximum(pos[k], unit * w)], [np.minimum(end[k], (unit + 1) * w)], [plan.filled + unit], [np.maximum(pos[k], unit * w) - unit * w]
    for j, (lo, hi) in enumerate(zip(plan.edges[:-1], plan.edges[1:])):
        k = np.flatnonzero((pos < hi) & (end > lo))
        ks.append(k)
        starts.append(np.maximum(pos[k], lo))
        ends.append(np.minimum(end[k], hi))
        seqs.append(np.full(len(k), plan.filled + plan.whole // w + j))
        offs.append(np.maximum(pos[k], lo) - lo)
    k, a, z = np.concatenate(ks), np.concatenate(starts), np.concatenate(ends)
    return k, a - pos[k], z - a, np.concatenate(seqs), np.concatenate(offs)


def rest_places(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces (rest index, start in the rest, length, sequence, offset) of rests by length and rank."""
    held = rank < plan.taken[length]
    k = np.flatnonzero(held)
    # the run of a rank: the last one of its length that starts at or before it
    key = plan.rank + np.repeat(np.arange(plan.window), np.diff(plan.at)) * (1 << 44)
    run = np.searchsorted(key, rank[k] + length[k] * (1 << 44), "right") - 1
    nth = rank[k] - plan.rank[run]
    sequence, offset = plan.sequence[run] + nth // plan.times[run], plan.offset[run] + nth % plan.times[run] * length[k]
    r = np.flatnonzero(~held)
    j, start, size, seq, off = residual_places(plan, plan.before[length[r]] + (rank[r] - plan.taken[length[r]]) * length[r], length[r])
    return np.concatenate([k, r[j]]), np.concatenate([np.zeros(len(k), np.int64), start]), np.concatenate([length[k], size]), np.concatenate([sequence, seq]), np.concatenate([offset, off])


def ranked(encoded: DataFrame, window: int) -> tuple[DataFrame, np.ndarray]:
    """Documents with the rank of their rest among all rests of that length and the number of
    whole windows before them, and the histogram of rests (at most ``window`` rows reach the driver)."""
    whole = F.expr(f"n_tokens div {window}")
    counts = staged(encoded.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(whole).alias("windows")), "counts")
    # one row per part and length, and one per part for its whole windows
    items = counts.select("part", F.explode(F.array(F.struct(F.col("rest").alias("size"), "n"), F.struct(F.lit(window).alias("size"), F.col("windows").alias("n")))).alias("x"))
    items = items.groupBy("part", F.col("x.size").alias("size")).agg(F.sum("x.n").alias("n"))
    before = items.select("part", "size", (F.sum("n").over(W.partitionBy("size").orderBy("part")) - F.col("n")).alias("before"))
    histogram = np.zeros(window, np.int64)
    for r in counts.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r.rest] = r.n
    windows = before.filter(F.col("size") == window).select("part", F.col("before").alias("part_windows"))
    rests = before.filter(F.col("size") < window).select("part", F.col("size").alias("rest"), F.col("before").alias("part_rests"))
    both = rests.join(windows, "part")
    rows = encoded.drop("ids").join(both, ["part", "rest"])
    return rows.withColumn("rank", F.col("rank") + F.col("part_rests")).withColumn("windows_before", F.col("windows_before") + F.col("part_windows")), histogram


def placed(rows: DataFrame, plan: Plan) -> DataFrame:
    """Pieces of every document; the checksum is null where the residual cut a rest."""
    sent = rows.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = sent.value
        w = p.window
        for b in batches:
            col = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("n_tokens", "rest", "rank", "windows_before")}
            crc, crc_at = b.column("crcs").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(b.column("crcs").value_lengths().to_numpy(zero_copy_only=False))])
            whole = col["n_tokens"] // w
            d = np.repeat(np.arange(b.num_rows), whole)
            nth = np.arange(len(d)) - np.repeat(np.cumsum(whole) - whole, whole)
            has = np.flatnonzero(col["rest"])
            k, start, size, seq, off = rest_places(p, col["rest"][has].astype(np.int64), col["rank"][has])
            r = has[k]
            doc = np.concatenate([d, r])
            sums = np.concatenate([crc[crc_at[d] + nth], crc[crc_at[r + 1] - 1]])
            cut = np.concatenate([np.zeros(len(d), bool), size < col["rest"][r]])
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("part").take(take), b.column("row").take(take), b.column("doc_id").take(take), pa.array(np.concatenate([nth * w, whole[r] * w + start])), pa.array(np.concatenate([np.full(len(d), w), size])),
                 b.column("n_tokens").take(take), pa.array(np.concatenate([p.first_window + col["windows_before"][d] + nth, seq])), pa.array(np.concatenate([np.zeros(len(d), np.int64), off])), pa.array(sums, pa.int64(), mask=cut)],
                ["part", "row", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"])

    return rows.select("part", "row", "doc_id", "n_tokens", "rest", "rank", "windows_before", "crcs").mapInArrow(run, PLACED)


def with_ids(pieces: DataFrame, encoded: DataFrame, dtype: np.dtype) -> DataFrame:
    """Pieces with their ids (little-endian, unsigned 32 bits), for writing the sequences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices([b], "__ids", SLICE):
                data, at = text_bytes(s.column("__ids"))
                start, size = s.column("start").to_numpy(), s.column("length").to_numpy()
                raw = [np.frombuffer(data[a:z], dtype)[x:x + n].astype("<u4").tobytes() for a, z, x, n in zip(at[:-1], at[1:], start, size)]
                keep = s.drop_columns(["__ids"])
                yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(raw, pa.binary())], [*keep.schema.names, "ids"])

    joined = checked_join(encoded.select("part", "row", F.col("ids").alias("__ids")), pieces, ["part", "row"], "inner", spread="row")
    return joined.select(*pieces.columns, "__ids").mapInArrow(run, PLACED + ", ids binary")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(pieces, encoded): the pieces of all documents as ``PLACED`` with every checksum, and
    the written ids they are ranges of."""
    from tokenizers import Tokenizer

    from keelson.llm.token_store import id_type

    if not 1 < window <= MAX_WINDOW or window & (window - 1):
        raise ValueError(f"a window is a power of two up to {MAX_WINDOW}")
    encoded = staged(encode(docs, tokenizer_path, end_id, window), "packed_ids")
    rows, histogram = ranked(encoded, window)
    pieces = staged(placed(rows, solve(histogram, window)), "pieces")
    dtype = id_type(Tokenizer.from_file(tokenizer_path).get_vocab_size())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = pa.array([zlib.crc32(x) for x in b.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:8], crc], b.schema.names[:9])

    cut = with_ids(pieces.filter("ids_crc32 IS NULL"), encoded, dtype).mapInArrow(sums, PLACED)
    return pieces.filter("ids_crc32 IS NOT NULL").unionByName(cut), encoded
