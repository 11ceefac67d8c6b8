import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import pieces as P
from keelson.llm.text import mix

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(alphabet="ab the▁ \n\té漢🙂\x00", max_size=30)


def sample(texts, seed=0):
    keys = mix(np.arange(len(texts), dtype=np.uint64))
    return P.vocabulary(PATH, 1.0).sample(pa.array(texts, pa.string()), keys, seed)


@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_lossless(texts):
    ids, cut = sample(texts)
    data, at = P.decoder(PATH).decode(ids, cut)
    data = data.tobytes()
    assert [data[a:b].decode() for a, b in zip(at, at[1:])] == [t or "" for t in texts]


def segmentations(vocabulary, text):
    """All ways to write a text in pieces, with their probabilities, by recursion."""
    table = {b.decode(): i for i, b in enumerate(vocabulary.bytes_of) if i > 258}
    ways = {}

    def go(at, ids, p):
        if at == len(text):
            ways[tuple(ids)] = p
            return
        for end in range(at + 1, len(text) + 1):
            i = table.get(text[at:end])
            if i is not None:
                go(end, [*ids, i], p * np.exp(vocabulary.log[i]))

    go(0, [], 1.0)
    total = sum(ways.values())
    return {k: p / total for k, p in ways.items()}


def test_samples_follow_the_lattice():
    n = 30_000
    ids, cut = sample(["other"] * n)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(cut))
    want = segmentations(P.vocabulary(PATH, 1.0), " other")
    assert set(got) <= set(want) and max(abs(got[k] / n - p) for k, p in want.items()) < 0.01


def test_long_unbroken_text_and_seeds():
    text = "x" * 5000 + "漢" * 200
    one, two, three = sample([text])[0], sample([text])[0], sample([text], seed=9)[0]
    assert (one == two).all() and (len(one) != len(three) or (one != three).any())


def test_rows(spark, docs):
    rows = [(1, "hello  world\n"), (1, "hello  world\n"), (None, " x"), (3, None), (4, "")]
    out = P.encode(docs(*rows), PATH, with_text=True).collect()
    assert all(r.lossless for r in out) and [r.decoded for r in out] == [t or "" for _, t in rows]
    assert out[0].piece_ids == out[1].piece_ids and out[3].n_pieces == 0
    back = P.decode(P.encode(docs(*rows), PATH), PATH).collect()
    assert [r.text for r in back] == [t or "" for _, t in rows]
    assert P.encode(docs((1, "a")).limit(0), PATH).collect() == []
