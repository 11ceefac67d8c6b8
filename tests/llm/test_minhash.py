import random

import keelson.llm.minhash as M

WORDS = [f"w{k}" for k in range(400)]


def shingle_set(text, size):
    w = (text or "").lower().split()
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = {d: shingle_set(t, size) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def test_against_all_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)           # several blocks per bucket
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(8):
        base = " ".join(rng.choice(WORDS) for _ in range(120))
        for _ in range(9):
            base = edited(rng, base, rng.choice([0, 1, 2, 3, 6]))
            rows.append((k, base))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "one two"), (k + 3, "ONE two"), (k + 4, " \n"), (k + 5, "solo")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs(*rows), size=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_null_ids_repeats_and_empty(spark, docs):
    same = " ".join(WORDS[:30])
    out = M.near_duplicates(docs((None, same), (3, same), (3, same), (5, same), (7, None))).collect()
    by = {(r.doc_id, r.kept) for r in out}
    assert by == {(None, True), (3, True), (5, False), (7, True)} and len(out) == 5
    assert M.near_duplicates(docs((1, "a")).limit(0)).collect() == []


def test_shuffle_files_are_released_between_steps(spark, docs, monkeypatch):
    from keelson.llm import minhash

    calls = []
    monkeypatch.setattr(minhash, "release", lambda s: calls.append(s))
    words = " ".join(f"w{k}" for k in range(60))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs((1, words), (2, words + " end"), (3, "other"))).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and calls == [spark] * 3
