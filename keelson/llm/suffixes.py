"""Exact removal of byte strings that occur earlier in the corpus, by suffix sorting.

Every ``length``-byte window picks an anchor, its smallest hashed gram, from its own bytes
alone, so equal windows pick equal anchors at equal places.  Windows next to each other with
one anchor form a piece; only pieces whose anchors are equal can share a window, and the work
is dealt out by anchor.  Equal pieces are told apart first: all but the earliest are removed
whole, inside a task before the shuffle and then per anchor.  Pieces that differ under one
anchor are cut out of their texts and suffix-sorted in two stages: suffixes smaller than their
successors are sorted directly, the rest is induced by a scan over the first-byte buckets;
adjacent common prefixes of ``length`` bytes then give the windows that repeat.  An anchor
with more than ``CROWD`` different pieces is dealt out again window by window, by the hash of
the window, so no group grows without bound.

Earlier means a smaller doc_id, or the same document and an earlier start; a string is not
earlier than itself.  Cases: null and empty texts have no bytes; a null doc_id counts as
smaller than any other; rows that repeat a doc_id share what is found in either (cut at each
text's end); texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import text as T
from keelson.llm.staging import staged
from keelson.llm.text import long_array, mix, powers, slices, text_bytes

LENGTH = 100
GRAM = 28
CROWD = 4096
BLOCK_BYTES = 1 << 20
NO_ID = -(1 << 63)
ROWS = "kind int, anchor long, body long, doc long, start long, n int"
_ORDER = ["kind", "anchor", "body", "doc", "start"]


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(T._LETTER[data] * up[:len(data)], out=total[1:])
    return total


def _range_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(total))
    return mix(((total[end] - total[start]) * down[start]) ^ (end - start).astype(np.uint64))


def pieces(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor hash, piece hash, row, first window (in its text) and windows of every piece."""
    n, wide = len(data), length - gram + 1
    empty = np.empty(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    total = _prefix_sums(data)
    _, down = powers(n + 1)
    low = mix((total[gram:] - total[:-gram]) * down[:n - gram + 1])
    place = np.arange(len(low), dtype=np.int32)
    span = 1
    while span < wide:
        step = min(span, wide - span)
        left, right = low[:-step], low[step:]
        later = right < left                # the leftmost of equal grams stays
        place = np.where(later, place[step:], place[:-step])
        low = np.where(later, right, left)
        span += step
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    window = np.flatnonzero(row[:len(low)] == row[length - 1:])
    if not len(window):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    spot = place[window]
    new = np.ones(len(window), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    many = np.diff(np.concatenate([first, [len(window)]]))
    begin = window[first]
    body = _range_hash(total, begin, begin + many - 1 + length)
    r = row[begin]
    return low[begin], body, r, begin - at[r], many


def _rows(kind, anchor, body, doc, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), long_array(anchor), long_array(body), pa.array(doc), pa.array(start), pa.array(n.astype(np.int32))], ROWS.replace(" int", "").replace(" long", "").split(", "))


def _locally(anchor, body, doc, start, n) -> Iterator[pa.RecordBatch]:
    """One row (kind 1) of each different piece of a slice, and the others as removed (kind 0)."""
    order = np.lexsort((start, doc, body))
    head = np.ones(len(order), bool)
    head[1:] = body[order][1:] != body[order][:-1]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    gone = (doc[order] != doc[first]) | (start[order] != start[first])
    keep, drop = order[head], order[gone]
    if len(keep):
        yield _rows(1, anchor[keep], body[keep], doc[keep], start[keep], n[keep])
    if len(drop):
        yield _rows(0, mix(doc[drop].view(np.uint64)), body[drop] * np.uint64(0), doc[drop], start[drop], n[drop])


def found_pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            data, at = text_bytes(b.column("text"))
            anchor, body, row, start, n = pieces(data, at, length, gram)
            ids = b.column("doc").to_numpy(zero_copy_only=False)
            yield from _locally(anchor, body, ids[row], start, n)

    return docs.mapInArrow(run, ROWS)


def collapse(rows: DataFrame) -> DataFrame:
    """Of pieces (kind 1): those equal to an earlier one come out as removed (kind 0), and the
    earliest of each, where its anchor has several, as still open (kind 1).  A task reads its
    rows in order and holds one row at a time over from batch to batch."""
    def run(batches):
        last = None            # anchor, body of the row before, and its piece's first doc and start
        wait = None            # an anchor's only piece so far
        for b in batches:
            kind = b.column("kind").to_numpy()
            anchor, body, doc, start, n = (b.column(c).to_numpy() for c in ("anchor", "body", "doc", "start", "n"))
            cut = int(np.searchsorted(kind, 1))
            if cut:
                yield b.slice(0, cut)
            if cut == b.num_rows:
                continue
            anchor, body, doc, start, n = (x[cut:] for x in (anchor, body, doc, start, n))
            new_a, new = np.ones(len(doc), bool), np.ones(len(doc), bool)
            new_a[1:] = anchor[1:] != anchor[:-1]
            new[1:] = new_a[1:] | (body[1:] != body[:-1])
            if last is not None:
                new_a[0] = anchor[0] != last[0]
                new[0] = new_a[0] or body[0] != last[1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
            of = head >= 0
            d0, s0 = (np.where(of, x[head], last[k] if last is not None else 0) for x, k in ((doc, 2), (start, 3)))
            gone = (doc != d0) | (start != s0)
            h = np.flatnonzero(new)
            open_ = ~new_a[h]
            if len(h):
                open_[:-1] |= new_a[h[:-1]] & ~new_a[h[1:]]
            if new_a[0]:
                wait = None
            if wait is not None and len(h) and not new_a[h[0]]:
                yield wait
                wait = None
            if len(h) and new_a[h[-1]]:
                i = h[-1]
                wait = _rows(1, anchor[i:i + 1], body[i:i + 1], doc[i:i + 1], start[i:i + 1], n[i:i + 1])
            elif len(h) and (new_a[h]).any():
                wait = None
            for pick, k in ((gone, 0), (h[open_], 1)):
                if np.any(pick) if k == 0 else len(pick):
                    yield _rows(k, anchor[pick], body[pick], doc[pick], start[pick], n[pick])
            last = anchor[-1], body[-1], d0[-1], s0[-1]

    return rows.repartition("anchor").sortWithinPartitions(*_ORDER).mapInArrow(run, ROWS)


def two_stage_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in order of their first ``depth`` bytes.  Suffixes smaller than
    their successors are sorted directly; each other one is put into its first byte's bucket
    when the scan meets its successor."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    # smaller than the successor: the first byte that differs further on is larger; the last
    # suffix is larger than the empty one after it
    change = np.flatnonzero(data[1:] != data[:-1])
    nxt = np.searchsorted(change, np.arange(n))
    small = np.zeros(n, bool)
    inner = nxt < len(change)
    edge = change[nxt[inner]]
    small[inner] = data[edge] < data[edge + 1]
    direct = np.flatnonzero(small)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")]
    del keys
    edges = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    if not small[n - 1]:
        waiting[data[n - 1]].append(np.array([n - 1]))
    for c in range(256):
        bucket = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        run = bucket
        while len(run):                     # a run of one byte is induced step by step
            run = run[run > 0] - 1
            run = run[(data[run] == c) & ~small[run]]
            bucket = np.concatenate([bucket, run])
        bucket = np.concatenate([bucket, direct[edges[c]:edges[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (data[before] > c)]
        if len(before):
            byte = data[before]
            order = np.argsort(byte, kind="stable")
            for part in np.split(before[order], np.flatnonzero(np.diff(byte[order])) + 1):
                waiting[data[part[0]]].append(part)
    return np.concatenate(out)


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs, up to ``most``."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(most):
        i, j = a[live] + k, b[live] + k
        ok = (i < len(data)) & (j < len(data))
        ok[ok] = data[i[ok]] == data[j[ok]]
        live = live[ok]
        if not len(live):
            break
        out[live] = k + 1
    return out


def repeats(pieces_: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """doc and start of every window of the pieces that another piece has earlier."""
    data = np.frombuffer(b"".join(pieces_), np.uint8)
    size = np.fromiter(map(len, pieces_), np.int64, len(pieces_))
    owner = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    order = two_stage_order(data, length)
    order = order[within[order] < n[owner[order]]]          # suffixes that begin a whole window
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = common_prefix(data, order[:-1], order[1:], length) >= length
    group = np.concatenate([[0], np.cumsum(~same)])
    d, s = doc[owner[order]], start[owner[order]] + within[order]
    by = np.lexsort((s, d, group))
    d, s, group = d[by], s[by], group[by]
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    gone = (d != d[first]) | (s != s[first])
    return d[gone], s[gone]


def _cut_out(open_rows: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """anchor, doc, start, n and the bytes of open pieces."""
    asked = open_rows.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("asked"))

    def run(batches):
        for b in slices(batches, "text"):
            data, at = text_bytes(b.column("text"))
            data, out = data.tobytes(), []
            for lo, hi, doc, asked in zip(at, at[1:], b.column("doc").to_pylist(), b.column("asked").to_pylist()):
                for x in asked:
                    s, size = int(lo) + x["start"], x["n"] - 1 + length
                    if s + size <= hi:
                        out.append((x["anchor"], doc, x["start"], x["n"], data[s:s + size]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["anchor", "doc", "start", "n", "bytes"])

    return docs.join(asked, "doc").select("doc", "text", "asked").mapInArrow(run, "anchor long, doc long, start long, n int, bytes binary")


def _sorted_out(cut: DataFrame, length: int) -> DataFrame:
    """Removed windows of pieces that differ under one anchor, block by block of anchors."""
    def run(batches):
        held, size = [], 0

        def flush(table: pa.Table):
            d, s = repeats(table.column("bytes").to_pylist(), *(table.column(c).to_numpy() for c in ("doc", "start", "n")), length)
            return _rows(0, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, s, np.ones(len(d)))

        for b in batches:
            held.append(b)
            size += b.column("bytes").nbytes
            if size < BLOCK_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            stop = int(np.searchsorted(anchor, anchor[-1]))       # the last anchor may go on
            if stop:
                yield flush(table.slice(0, stop))
                held, size = table.slice(stop).to_batches(), table.slice(stop).column("bytes").nbytes
        if held:
            yield flush(pa.Table.from_batches(held))

    return cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, ROWS)


def _window_by_window(cut: DataFrame, length: int) -> DataFrame:
    """Removed windows of crowded anchors: each window is a piece, dealt out by its hash."""
    def run(batches):
        for b in batches:
            doc, start, n = (b.column(c).to_numpy() for c in ("doc", "start", "n"))
            data, at = text_bytes(b.column("bytes"))
            total = _prefix_sums(data)
            begin = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            body = _range_hash(total, begin, begin + length)
            own = np.repeat(np.arange(len(n)), n)
            yield from _locally(mix(body), body, doc[own], start[own] + begin - at[own], np.ones(len(own), np.int32))

    return collapse(cut.mapInArrow(run, ROWS)).filter("kind = 0")


def repeated_ranges(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc and byte ranges (start, end) covered by ``length``-byte strings that occur earlier,
    of rows (doc, text); ranges may overlap."""
    first = staged(collapse(found_pieces(docs, length, gram)), "pieces")
    open_rows = first.filter("kind = 1")
    crowded = staged(open_rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > crowd).select("anchor"), "crowded")
    found = first.filter("kind = 0")
    if crowded.isEmpty():
        found = found.union(_sorted_out(_cut_out(open_rows, docs, length), length))
    else:
        found = found.union(_sorted_out(_cut_out(open_rows.join(crowded, "anchor", "left_anti"), docs, length), length))
        found = found.union(_window_by_window(_cut_out(open_rows.join(crowded, "anchor", "left_semi"), docs, length), length))
    return found.select("doc", "start", (F.col("start") + F.col("n") - 1 + length).alias("end"))


def _merged(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by ranges, cut at ``size``; ranges that touch are one run."""
    ends = np.minimum(ends, size)
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    keep = s < e
    s, e = s[keep], e[keep]
    if not len(s):
        return s, e
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate([at[1:] - 1, [len(s) - 1]])]


def without_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of (doc_id, text), and the
    remaining bytes with ``with_bytes`` (they may cut a character, hence binary)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string"))
    ranges = repeated_ranges(rows, length=length, gram=gram, crowd=crowd)
    per_doc = ranges.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_bytes
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def run(batches):
        for b in slices(batches, "text"):
            data, at = text_bytes(b.column("text"))
            data, out = data.tobytes(), []
            starts, ends = b.column("starts"), b.column("ends")
            for k, (doc, lo, hi) in enumerate(zip(b.column("doc").to_pylist(), at.tolist(), at[1:].tolist())):
                text, s, e = data[lo:hi], [], []
                if starts[k].is_valid:
                    s, e = _merged(starts[k].values.to_numpy(), ends[k].values.to_numpy(), hi - lo)
                    parts, pos = [], 0
                    for p, q in zip(s.tolist(), e.tolist()):
                        parts.append(text[pos:p])
                        pos = q
                    text = b"".join([*parts, text[pos:]])
                out.append((None if doc == NO_ID else doc, hi - lo, hi - lo - len(text), len(s), hashlib.sha256(text).hexdigest(), text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*out), kinds))[:len(names)]], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes
    return rows.join(per_doc, "doc", "left").select("doc", "text", "starts", "ends").mapInArrow(run, schema)
