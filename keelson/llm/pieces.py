"""SentencePiece segmentations sampled by forward filtering and backward sampling.

Blanks become the piece mark and a leading mark is added, as the model file asks.  No piece of
a fit vocabulary has a mark after another character, so the lattice of a text falls apart at
every mark that follows another character: such chunks are sampled independently.  The
forward sums are found once for each distinct chunk of a slice, and all chunks then walk
backward together, each step drawing with a counter-based hash of (row key, seed, chunk
number, step), so a row's segmentation depends on nothing but its key and text.

Piece probabilities: a unigram model gives its log-probabilities.  A BPE model only ranks its
pieces; rank r then counts as probability proportional to 1 / (r + ``SHIFT``) (Zipf's law).
Characters outside the vocabulary, and the mark itself where a text holds it, are written as
byte pieces, so decoding returns the very text.

Cases: null and empty texts give no ids and decode to an empty text; a null key is hashed as
a value of its own; equal rows get equal segmentations; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.text import mix, slices, text_bytes
from keelson.llm.workers import tidy

SHIFT = 10.0
SHARPNESS = 1.0
SLICE = 1 << 20
MARK = "▁"
UNKNOWN_COST = 20.0
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_OWN_MARK = "\udfff"      # a mark that the text itself holds; no text can hold this one


@dataclass
class Lattice:
    """Chunks laid end to end; node v stands after character v.

    An edge holds its piece (-1: the character in bytes), the node it leads back to (-1: the
    chunk's start) and ``upto``: its node plus the share of choices up to and including it, so
    one sorted array serves to draw for any node.
    """

    code: np.ndarray
    last: np.ndarray
    upto: np.ndarray
    back: np.ndarray
    first: np.ndarray


class Vocabulary:
    """Pieces, their log-probabilities and all prefixes of pieces by hash."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(names) if sp.is_byte(i)}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(a != MARK and b == MARK for i in plain for a, b in zip(names[i], names[i][1:])) or len(self.byte) < 256:
            raise ValueError("the vocabulary has pieces across words, or lacks byte pieces")
        score = {i: sp.get_score(i) for i in plain}
        if all(float(s).is_integer() for s in score.values()):
            score = {i: -float(np.log(SHIFT - s)) for i, s in score.items()}
        self.log = np.full(size, -sharpness * UNKNOWN_COST)
        self.log[plain] = [sharpness * score[i] for i in plain]
        known: dict[int, int] = {}
        for i in plain:
            h = 0
            for k, c in enumerate(names[i]):
                h = (h * _STEP + ord(c) + 1) & _MASK
                known[h] = i if k == len(names[i]) - 1 else known.get(h, -1)
        self.hash = np.array(sorted(known), np.uint64)
        self.piece = np.array([known[int(h)] for h in self.hash], np.int32)
        self.longest = max((len(names[i]) for i in plain), default=1)
        self.bytes_of = [b""] * size
        for i in plain:
            self.bytes_of[i] = names[i].replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])

    def lattice(self, chunks: list[str]) -> Lattice:
        """All pieces that fit in the chunks, with forward sums taken level by level over all
        chunks at once."""
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        n, stop = len(code), np.repeat(np.cumsum(size), size)
        level = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        at, h = np.arange(n), np.zeros(n, np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for k in range(1, self.longest + 1):
            h = h * np.uint64(_STEP) + code[at + k - 1] + np.uint64(1)
            place = np.searchsorted(self.hash, h)
            place[place == len(self.hash)] = 0
            hit = self.hash[place] == h
            piece = self.piece[place]
            whole = hit & (piece >= 0)
            if k == 1:       # characters that are no pieces are spelled in bytes
                found.append((at, np.where(whole, piece, -1), 1))
            else:
                found.append((at[whole], piece[whole], k))
            more = hit & (at + k < stop[at])
            at, h = at[more], h[more]
            if not len(at):
                break
        edges = np.zeros(n + 1, np.int64)
        for begin, _, k in found:
            edges[begin + k] += 1
        edges = np.cumsum(edges)                        # edges of node v: edges[v] to edges[v + 1]
        free = edges[:-1].copy()
        back, first = np.empty(edges[-1], np.int32), np.empty(edges[-1], np.int32)
        for begin, piece, k in found:
            end = begin + k - 1
            slot = free[end]
            back[slot] = np.where(level[begin] == 0, -1, begin - 1)
            first[slot] = piece
            free[end] += 1
        forward = np.zeros(n + 1)                       # the last one stands for a chunk's start
        upto = np.empty(edges[-1])
        many = np.diff(edges)
        order = np.argsort(level.astype(np.int32), kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(level))]) if n else [0]
        for lo, hi in zip(bounds, bounds[1:]):
            v = order[lo:hi]
            ends = np.cumsum(many[v])
            starts = ends - many[v]
            e = np.repeat(edges[v] - starts, many[v]) + np.arange(ends[-1])
            x = forward[back[e]] + self.log[first[e]]
            top = np.maximum.reduceat(x, starts)
            share = np.exp(x - np.repeat(top, many[v]))
            total = np.add.reduceat(share, starts)
            forward[v] = top + np.log(total)
            share = np.cumsum(share / np.repeat(total, many[v]))
            share -= np.repeat(np.concatenate([[0], share[ends[:-1] - 1]]), many[v])
            share[ends - 1] = 1.0
            upto[e] = np.repeat(v, many[v]) + share
        return Lattice(code, np.cumsum(size) - 1, upto, back, first)

    def sample(self, column: pa.Array, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n + 1 offsets into them."""
        data, at = text_bytes(column)
        data = data.tobytes()
        parts = [chunks(data[a:b]) for a, b in zip(at, at[1:])]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        if not n.sum():
            return np.empty(0, np.int32), np.zeros(len(n) + 1, np.int64)
        known: dict[bytes, int] = {}
        index = np.fromiter((known.setdefault(c, len(known)) for c in chain.from_iterable(parts)), np.int64, int(n.sum()))
        del parts
        found = self.lattice([c.decode().replace(MARK, _OWN_MARK).replace(" ", MARK) for c in known])
        row = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
        state = mix(keys[row] + np.uint64(seed)) ^ mix(number.astype(np.uint64))
        node, live = found.last[index], np.arange(len(index))
        got, owner, step = [], [], 0
        while len(live):
            # 30 bits, so that node + draw is exact and stays below the next node
            draw = mix(state[live] + np.uint64(step)) >> np.uint64(34)
            edge = np.searchsorted(found.upto, node + draw * (1.0 / (1 << 30)), "right")
            got.append(edge)
            owner.append(live)
            node = found.back[edge]
            go = node >= 0
            node, live, step = node[go], live[go], step + 1
        # the draws of a chunk run from its end to its start
        per = np.zeros(len(index), np.int64)
        for x in owner:
            per[x] += 1
        left = np.cumsum(per)
        edge = np.empty(int(left[-1]), np.int64)
        for e, x in zip(got, owner):
            left[x] -= 1
            edge[left[x]] = e
        cut = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(n)])]
        ids = found.first[edge]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelled = [[self.byte[x] for x in (chr(c) if c != ord(_OWN_MARK) else MARK).encode()] for c in found.code[self.end_of(found, edge[odd])].tolist()]
            size = np.ones(len(ids), np.int64)
            size[odd] = [len(x) for x in spelled]
            moved = np.concatenate([[0], np.cumsum(size)])
            ids = np.repeat(ids, size)
            for k, x in zip(moved[odd].tolist(), spelled):
                ids[k:k + len(x)] = x
            cut = moved[cut]
        return ids, cut

    @staticmethod
    def end_of(found: Lattice, edge: np.ndarray) -> np.ndarray:
        """The node an edge ends at: upto lies above the node and at most at the next."""
        return np.ceil(found.upto[edge]).astype(np.int64) - 1


def chunks(text: bytes) -> list[bytes]:
    """Chunks of a text with the leading blank added: each is a run of blanks and what follows
    up to the next blank.  They join to the text again."""
    if not text:
        return []
    words = text.split(b" ")
    if b"" not in words:
        return [b" " + w for w in words]
    out, run = [], b""
    for w in words:
        run += b" "
        if w:
            out.append(run + w)
            run = b""
    if run:
        out.append(run)
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


class Decoder:
    """Ids to bytes: pieces joined, marks as blanks, without the leading one."""

    def __init__(self, path: str):
        table = vocabulary(path, SHARPNESS).bytes_of
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and the n + 1 offsets into them."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.data[np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[cut]
        lead = at[:-1][at[1:] > at[:-1]]
        keep = np.ones(len(out), bool)
        keep[lead] = False
        return out[keep], at - np.concatenate([[0], np.cumsum(at[1:] > at[:-1])])


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str, *, seed: int = 0, sharpness: float = SHARPNESS, with_text: bool = False) -> DataFrame:
    """doc_id and piece_ids of every row of (doc_id, text), and the text decoded from them
    with ``with_text``; ``lossless`` says whether it is the input."""
    schema = "doc_id long, piece_ids array<int>, n_pieces long, lossless boolean" + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            keys = mix(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
            ids, cut = vocabulary(path, sharpness).sample(b.column("text"), keys, seed)
            back, at = decoder(path).decode(ids, cut)
            data, want = text_bytes(b.column("text"))
            same = np.diff(at) == np.diff(want)
            if same.all():
                odd = np.flatnonzero(back != data)
                same[np.searchsorted(want, odd, "right") - 1] = False
            else:
                whole = back.tobytes(), data.tobytes()
                same = np.array([whole[0][p:q] == whole[1][r:s] for p, q, r, s in zip(at, at[1:], want, want[1:])])
            columns = [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)), pa.array(np.diff(cut)), pa.array(same)]
            names = ["doc_id", "piece_ids", "n_pieces", "lossless"]
            if with_text:
                columns.append(pa.StringArray.from_buffers(len(same), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(back)))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id").alias("key"))
    return rows.mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, piece_ids)."""
    def run(batches):
        for b in batches:
            lists = b.column("piece_ids").fill_null([]) if b.column("piece_ids").null_count else b.column("piece_ids")
            cut = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            back, at = decoder(path).decode(lists.flatten().to_numpy(zero_copy_only=False), cut)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(back))], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "piece_ids").mapInArrow(run, "doc_id long, text string")
