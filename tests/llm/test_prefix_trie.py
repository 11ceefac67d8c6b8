import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int, key string"


@given(st.lists(st.integers(0, 1), max_size=600), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_find_close_against_a_stack(choice, seed):
    bits, open_now = [1], 1
    for x in choice:
        step = 1 if x or open_now == 1 else -1
        bits.append(step)
        open_now += step
    bits += [-1] * open_now
    stack, want = [], {}
    for k, b in enumerate(bits):
        if b > 0:
            stack.append(k)
        else:
            want[stack.pop()] = k
    opens = np.flatnonzero(np.array(bits) > 0)
    assert P.find_close(np.cumsum(bits), opens).tolist() == [want[k] for k in opens.tolist()]


def brute(sequences):
    """sequences: conv_id -> list of (role, text)."""
    members, at_end = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        at_end[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        w = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += w
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(at_end[p]))).encode()).hexdigest()) for p, m in members.items())


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def nodes(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in df.collect())


def result(spark, rows):
    df = spark.createDataFrame([(*r, "p", 1, "k") for r in rows], SCHEMA)
    return nodes(P.prefix_nodes(P.paths(P.with_shared_heads(P.turn_lists(df), 5, 9))))


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(P, "SHARD_TURNS", 12)
    monkeypatch.setattr(P, "SHARD_PATHS", 3)
    monkeypatch.setattr(P, "LAST_PATHS", 6)


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"t{int(rng.integers(0, 2))} é" if t < 3 else f"own {c % 7}"))
    return rows


def test_shards_against_brute_force(spark, small_shards):
    rows = conversations(np.random.default_rng(4), 150)
    assert result(spark, rows) == brute(rebuilt(rows))


def test_one_level(spark):
    rows = conversations(np.random.default_rng(5), 20)
    assert result(spark, rows) == brute(rebuilt(rows))


def test_common_conversation_and_first_turn(spark, small_shards):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 200, 2) for t in range(4)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(1, 200, 2) for t in range(3)]
    assert result(spark, rows) == brute(rebuilt(rows))


def test_cases(spark, small_shards):
    rows = [(0, None, None, "first"), (0, 2, "a", None), (0, 1, None, None), (None, 1, "u", "lost"), (7, 1, "u", "x"), (9, 3, "", ""), (9, None, "", ""), (-3, 1, "a", "neg"), (12345, 1, "r", "t" * 100_000)]
    rows += [(50, t, "u", f"long {t}") for t in range(400)] + [(55, t, "u", f"long {t}") for t in range(300)]
    got = result(spark, rows)
    own = rebuilt([r for r in rows if r[0] is None or r[0] >= 0])
    h = zlib.crc32(b"-3") % 9            # -3 - (-3 % 5) is 0 with the remainder of SQL
    own[-3] = own[0][:h] + [("a", "neg")][h:]
    assert got == brute(own) and [] in own.values()          # a conversation without turns counts for the root
    assert result(spark, []) == []


def test_repeated_rows_and_any_paths(spark, small_shards):
    rows = [(1, 1, "u", "x")] * 3 + [(2, 1, "u", "x")] * 2 + [(3, 5, "u", "x")]
    lists = P.turn_lists(spark.createDataFrame([(*r, "p", 1, "k") for r in rows], SCHEMA))
    x = ("u", "x")
    assert nodes(P.prefix_nodes(P.paths(lists))) == brute({1: [x] * 3, 2: [x] * 2, 3: [x]})
