from collections import defaultdict
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelson.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_every_combination_fills_the_window_once():
    lengths = np.array([1, 3, 4, 6, 8, 12, 13])
    a, i, c = P.combinations(lengths, 16)
    assert (a * i + c == 16).all() and (i >= 1).all()
    ways = [tuple(sorted([x] * n + ([y] if y else []))) for x, n, y in zip(a.tolist(), i.tolist(), c.tolist())]
    assert len(set(ways)) == len(ways)
    there = set(lengths.tolist())
    want = {tuple(sorted([x] * n + ([16 - x * n] if 16 - x * n else []))) for x in there for n in range(1, 16 // x + 1) if 16 - x * n == 0 or 16 - x * n in there}
    assert set(ways) == want


def test_repeat_counts_solve_the_histogram():
    rng = np.random.default_rng(3)
    a, i, c = P.combinations(np.arange(1, 64), 64)
    pick = rng.choice(len(a), 30, replace=False)
    true = np.zeros(len(a))
    true[pick] = rng.integers(1, 50, 30)
    h = np.zeros(64)
    for k in pick:
        h[a[k]] += i[k] * true[k]
        if c[k]:
            h[c[k]] += true[k]
    x = P.repeats(h, a, i, c, 3000)
    used = np.bincount(a, i * x, 64) + np.bincount(c, (c > 0) * x, 64)
    assert (x >= 0).all() and np.abs(used - h).sum() < 0.02 * h.sum()          # an exact solution exists


def check(pieces, window):
    """Sequences without gap or overlap, none over the window, all whole or a power of two."""
    by = defaultdict(list)
    for seq, off, size in pieces:
        by[seq].append((off, size))
    for seq, parts in by.items():
        parts.sort()
        assert parts[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(parts, parts[1:])), (seq, parts)
        total = sum(n for _, n in parts)
        assert total <= window and total & (total - 1) == 0, total
    assert set(by) == set(range(len(by)))
    return by


@given(st.lists(st.tuples(st.integers(1, 63), st.integers(1, 40)), max_size=40), st.sampled_from([16, 64]))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_rest_once(items, window):
    h = np.zeros(window, np.int64)
    for size, n in items:
        h[size % window or 1] += n
    plan = P.solve(h, window)
    length = np.repeat(np.arange(window), h)
    rank = np.concatenate([np.arange(n) for n in h]) if h.sum() else np.empty(0, np.int64)
    k, start, size, seq, off = P.rest_places(plan, length, rank)
    check(list(zip(seq.tolist(), off.tolist(), size.tolist())), window)
    covered = defaultdict(list)
    for j, s, n in zip(k.tolist(), start.tolist(), size.tolist()):
        covered[j].append((s, n))
    assert len(covered) == len(length)
    for j, parts in covered.items():
        parts.sort()
        assert parts[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) == length[j]
    assert plan.first_window == len(set(seq.tolist()))


def packed(spark, rows, docs, window, end_id=2):
    pieces, encoded = P.pack(docs(*rows), PATH, end_id, window)
    ids = P.with_ids(pieces, encoded, np.dtype("<u2"))
    return [r.asDict() for r in ids.collect()]


def verify(out, rows, window, end):
    t = Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc[r["part"], r["row"]].append(r)
    got = []
    for parts in by_doc.values():
        parts.sort(key=lambda r: r["start"])
        assert all(x["start"] + x["length"] == y["start"] for x, y in zip(parts, parts[1:])) and parts[0]["start"] == 0
        assert {r["doc_tokens"] for r in parts} == {sum(r["length"] for r in parts)} and len({r["doc_id"] for r in parts}) == 1
        got.append((parts[0]["doc_id"], b"".join(bytes(r["ids"]) for r in parts)))
    want = [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + end, "<u4").tobytes()) for i, x in rows]
    assert sorted(got, key=str) == sorted([w for w in want if w[1]], key=str)
    check([(r["sequence_id"], r["offset"], r["length"]) for r in out], window)


def test_documents_against_the_tokenizer(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["word"] * int(n))) for k, n in enumerate(rng.geometric(0.05, 300))]
    rows += [(None, None), (None, "two words"), (5, "same id"), (5, "same id"), (900, ""), (901, "x " * 5000), (902, "a " * 63), (903, "a " * 127)]
    rows += [(2000 + k, "a common length of seven words here") for k in range(400)]
    verify(packed(spark, rows, docs, 64), rows, 64, [2])


def test_one_document_no_end_and_nothing(spark, docs):
    verify(packed(spark, [(1, "a b c")], docs, 4096), [(1, "a b c")], 4096, [2])
    rows = [(1, None), (2, "a"), (3, "")]
    verify(packed(spark, rows, docs, 16, end_id=None), rows, 16, [])
    assert packed(spark, [], docs, 4096) == []
    with pytest.raises(ValueError):
        P.pack(docs((1, "a")), PATH, 2, 100)
