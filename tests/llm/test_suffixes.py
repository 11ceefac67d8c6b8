import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import suffixes as S


def brute(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        t = (t or "").encode()
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if t[p:p + length] in seen:
                cover[p:p + length] = b"\1" * length
            seen.add(t[p:p + length])
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out[d] = (len(t), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(t, cover) if not c)).hexdigest())
    return out


def made(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    rows = [(k * 3, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 8)))) for k in range(40)]
    return rows + [(500, None), (501, ""), (502, "a" * 200), (503, "a" * 90 + "b"), (504, "ab" * 80), (505, "\0" * 50 + "x" + "\0" * 50)]


def test_against_brute_force(spark, docs):
    rows = made(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(docs(*rows), length=24, gram=7).collect()}
    assert got == brute(rows, 24)


def test_crowded_anchors_give_the_same(spark, docs):
    rows = made(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(docs(*rows), length=24, gram=7, crowd=1).collect()}
    assert got == brute(rows, 24)


def test_null_ids_repeats_and_empty(spark, docs):
    long = "".join(chr(97 + k % 26) + str(k) for k in range(80))
    out = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in S.without_repeats(docs((None, long), (4, long), (4, long))).collect())
    n = len(long)
    assert out == [(False, 0, 0), (True, 4, n), (True, 4, n)]
    twice = S.without_repeats(docs((4, long), (4, long))).collect()
    assert [r.n_removed for r in twice] == [0, 0]
    assert S.without_repeats(docs((1, "a")).limit(0)).collect() == []


@given(st.lists(st.sampled_from([0, 97, 98, 255]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_two_stage_order(values):
    data = np.array(values, np.uint8)
    raw = bytes(values)
    order = S.two_stage_order(data, 80)
    assert sorted(order.tolist()) == list(range(len(raw)))
    got = [raw[k:].ljust(80, b"\0") for k in order]
    assert got == sorted(got)
    for a, b, n in zip(order[:-1], order[1:], S.common_prefix(data, order[:-1], order[1:], 80)):
        want = next((k for k, (x, y) in enumerate(zip(raw[a:], raw[b:])) if x != y), min(len(raw) - a, len(raw) - b))
        assert n == want
