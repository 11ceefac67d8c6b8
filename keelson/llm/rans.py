"""Static range asymmetric numeral system over interleaved lanes, vectorised in numpy.

A block of ids is dealt to ``LANES`` coder states in turn (id i goes to lane i mod LANES);
all lanes of a block share one stream of 32-bit words.  After every ``STEP`` rounds the
block keeps a checkpoint (all states and the place in the stream), so any segment between
checkpoints decodes on its own.  The frequency table is shared by all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 128
STEP = 256
SCALE_BITS = 20
MAGIC = b"RNS1"
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIII")    # magic, ids, checkpoints, words, crc of ids, crc of body


def normalised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits with at least 1 for every id that occurs."""
    counts = np.asarray(counts, np.float64)
    seen = np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not len(seen):
        return freq
    room = (1 << bits) - len(seen)
    if room < 0:
        raise ValueError("more symbols than the frequency scale can hold")
    share = counts[seen] / counts[seen].sum() * room
    freq[seen] = 1 + np.floor(share).astype(np.int64)
    left = (1 << bits) - int(freq.sum())
    order = np.lexsort((seen, np.floor(share) - share))
    freq[seen[order[:left]]] += 1
    return freq


class Coder:
    """Both directions of the code for one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.below = (np.cumsum(freq) - freq).astype(np.uint64)
        self.full = self.freq << (np.uint64(63) - self.bits)
        self.gap = np.uint64(1 << bits) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq) if freq.any() else np.zeros(1 << bits, np.uint32)

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """One payload per block of ids; the blocks are coded side by side."""
        sizes = np.array([len(b) for b in blocks])
        rounds = max(1, -(-int(sizes.max(initial=0)) // LANES))
        ids = np.zeros((len(blocks), rounds * LANES), np.uint32)
        for row, b in zip(ids, blocks):
            row[:len(b)] = b
        ids = ids.reshape(len(blocks), rounds, LANES)
        lane = np.arange(LANES)
        state = np.full((len(blocks), LANES), _LOW)
        marks, words, states = [], [], []
        for t in range(rounds - 1, -1, -1):
            live = t * LANES + lane < sizes[:, None]
            s = ids[:, t]
            full = state >= self.full[s]
            whole = bool(live.all())
            if not whole:
                full &= live
            marks.append(full)
            moved = state[full]
            words.append((moved & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            state[full] = moved >> np.uint64(32)
            coded = state + state // np.maximum(self.freq[s], 1) * self.gap[s] + self.below[s]
            state = coded if whole else np.where(live, coded, state)
            if t % STEP == 0:
                states.append(state.copy())
        marks, words, states = marks[::-1], words[::-1], states[::-1]
        per = np.stack([m.sum(1) for m in marks], 1)               # words of each block and round
        flat, owner = np.concatenate(words), np.repeat(np.tile(np.arange(len(blocks)), rounds), per.T.ravel())
        place = np.cumsum(per, 1) - per
        out = []
        for b, block in enumerate(blocks):
            cuts = max(1, -(-len(block) // (LANES * STEP)))
            body = b"".join((
                place[b, ::STEP][:cuts].astype("<u4").tobytes(),
                np.stack([s[b] for s in states[:cuts]]).astype("<u8").tobytes(),
                flat[owner == b].astype("<u4").tobytes()))
            head = _HEAD.pack(MAGIC, len(block), cuts, int(per[b].sum()), zlib.crc32(block.astype("<u4").tobytes()), zlib.crc32(body))
            out.append(head + body)
        return out

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]:
        """The ids of each payload; every segment of every block is decoded side by side."""
        plan, streams, base = [], [], 0
        for p in payloads:
            magic, n, cuts, n_words, crc, body_crc = _HEAD.unpack_from(p)
            if magic != MAGIC or zlib.crc32(p[_HEAD.size:]) != body_crc:
                raise ValueError("damaged token block")
            at = _HEAD.size
            place = np.frombuffer(p, "<u4", cuts, at).astype(np.int64)
            state = np.frombuffer(p, "<u8", cuts * LANES, at + 4 * cuts).reshape(cuts, LANES)
            streams.append(np.frombuffer(p, "<u4", n_words, at + 4 * cuts + 8 * cuts * LANES))
            plan.append((n, cuts, crc, place + base, state))
            base += n_words
        stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        place = np.concatenate([x[3] for x in plan])
        state = np.concatenate([x[4] for x in plan]).astype(np.uint64)
        left = np.concatenate([np.clip(n - np.arange(cuts) * LANES * STEP, 0, LANES * STEP) for n, cuts, *_ in plan])
        rounds = max(1, -(-int(left.max(initial=0)) // LANES))
        lane = np.arange(LANES)
        out = np.zeros((len(left), rounds, LANES), np.uint32)
        for t in range(rounds):
            live = t * LANES + lane < left[:, None]
            slot = state & self.mask
            out[:, t] = s = self.symbol[slot]
            coded = self.freq[s] * (state >> self.bits) + slot - self.below[s]
            state = coded if live.all() else np.where(live, coded, state)
            need = state < _LOW
            row, _ = np.nonzero(need)
            per = np.bincount(row, minlength=len(left))
            rank = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            state[need] = (state[need] << np.uint64(32)) | stream[place[row] + rank]
            place = place + per
        result, row = [], 0
        for n, cuts, crc, *_ in plan:
            # all segments but the last are full, so cutting each at its own length joins them
            ids = np.concatenate([out[row + k].ravel()[:left[row + k]] for k in range(cuts)])
            row += cuts
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("token block fails its checksum")
            result.append(ids)
        return result
