"""Words, hashes and shingles of Arrow columns against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import text as T

LIST = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té\x85 z", max_size=25)), max_size=8)


@given(LIST)
@settings(max_examples=150, deadline=None)
def test_words_and_shingles(texts):
    w = T.words(pa.array(texts, pa.string()))
    data = w.data.tobytes()
    got = [[] for _ in texts]
    for d, a, b in zip(w.doc, w.start, w.end):
        got[d].append(data[a:b].decode())
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == want and w.count.tolist() == [len(x) for x in want]
    flat = [x.replace("B", "b") for x in sum(want, [])]
    h = T.word_hashes(w, lower=True)
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(flat, h.tolist())))
    value, at = T.shingles(h, w.doc, 2)
    pairs = [(d, tuple(x.replace("B", "b") for x in ws[k:k + 2])) for d, ws in enumerate(want) for k in range(len(ws) - 1)]
    assert w.doc[at].tolist() == [d for d, _ in pairs]
    assert len(set(value.tolist())) == len({p for _, p in pairs})


def test_slices_keep_rows_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "", "b" * 50, "c"])], ["text"])
    parts = list(T.slices(iter([batch]), "text", 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) < 5 and list(T.slices(iter([batch.slice(0, 0)]), "text")) == []


def test_equal_words_hash_equally_in_any_place():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcé"), 3)) for _ in range(2000)]
    w = T.words(pa.array([" ".join(words)]))
    seen = {}
    for x, h in zip(words, T.word_hashes(w, lower=False).tolist()):
        assert seen.setdefault(x, h) == h
