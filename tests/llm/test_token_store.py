import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelson.llm import rans
from keelson.llm import token_store as S
from keelson.llm.staging import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, hello WORLD!!", None, "", " \n", "don't DON'T 3.14 it's,'s", "a<|endoftext|>b <|ENDOFTEXT|>", "É é cafe\u0301, ΑΣ Σ\u2003x\x85y ﬁ", "zz***&&& end...", "x" * 3000, "Hello, hello WORLD!!"]


@given(st.lists(st.lists(st.integers(0, 40), max_size=700), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    coder = rans.Coder(rans.normalised(np.bincount(np.concatenate(blocks).astype(int), minlength=41)))
    assert all((a == b).all() for a, b in zip(blocks, coder.decode(coder.encode(blocks))))


def test_long_blocks_and_damage():
    rng = np.random.default_rng(2)
    blocks = [rng.geometric(0.02, n).clip(0, 999).astype(np.uint32) for n in (rans.LANES * rans.STEP, rans.LANES * rans.STEP * 2 + 77, 5)]
    coder = rans.Coder(rans.normalised(np.bincount(np.concatenate(blocks), minlength=1000)))
    coded = coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, coder.decode(coded))) and len(coded[1]) < len(blocks[1]) * 1.3
    with pytest.raises(ValueError):
        coder.decode([coded[0][:-1] + bytes([coded[0][-1] ^ 1])])


def test_frequencies():
    f = rans.normalised(np.array([0, 1, 10**9, 3]))
    assert f.sum() == 1 << rans.SCALE_BITS and f[0] == 0 and f.min() == 0 and (f[[1, 2, 3]] > 0).all()


def read(spark, docs, path=PATH, **kw):
    where = shared_path(spark, "store")
    S.build_store(docs, where, path, **kw)
    return S.read_store(spark, where).orderBy("start").collect()


def expected(texts, end, path=PATH):
    t = Tokenizer.from_file(path)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + end, "<u4").tobytes() for x in texts]


def test_store_against_the_tokenizer(spark, docs):
    order = [7, 3, 9, 1, 0, 8, 2, 6, 5, 4]
    out = read(spark, docs(*[(k, TEXTS[k]) for k in order]), end_id=1)
    want = expected(TEXTS, [1])
    assert [r.doc_id for r in out] == list(range(10)) and [bytes(r.ids) for r in out] == want
    sizes = [len(x) // 4 for x in want]
    assert [r.n_tokens for r in out] == sizes and [r.start for r in out] == [sum(sizes[:k]) for k in range(10)]
    assert S.crc_of(bytes(out[0].ids)) == zlib.crc32(want[0])


def test_null_ids_repeats_and_empty(spark, docs):
    out = read(spark, docs((4, "b"), (None, "a"), (4, "b")), end_id=1)
    assert [r.doc_id for r in out] == [None, 4, 4] and [r.start for r in out] == [0, 2, 4]
    assert read(spark, docs((1, "a")).limit(0), end_id=1) == []


def test_other_tokenizers_encode_whole_texts(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello,  world\n it's", "", "naïve"]
    assert [bytes(r.ids) for r in read(spark, docs(*enumerate(texts)), path, end_id=None)] == expected(texts, [], path)


def test_forgetting_words_changes_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "CACHE_WORDS", 3)
    e = S.WordEncoder(PATH)
    for _ in range(3):
        for x in TEXTS:
            ids, cut = e.encode(pa.array([x], pa.string()), 1)
            assert ids.astype("<u4").tobytes() == expected([x], [1])[0] and cut.tolist() == [0, len(ids)]


def test_special_tokens_are_looked_for_once_a_slice():
    import pyarrow as pa

    encoder = S.WordEncoder(PATH)
    seen, find = [], encoder.special
    encoder.special = lambda x: seen.append(len(x)) or find(x)
    plain = [" ".join(f"word{chr(97 + k % 26)}{k} Abc{chr(97 + k % 26)}x" for k in range(700)), "Hello"]
    marked = ["Hello a<|ENDOFTEXT|>b a<|endoftext|>b worda0"]
    own = Tokenizer.from_file(PATH)
    for texts in (plain, marked, plain):
        ids, cut = encoder.encode(pa.array(texts), None)
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [own.encode(t, add_special_tokens=False).ids for t in texts]
        assert texts is not plain or len(seen) == 1     # one search of the slice, none of its words
        seen.clear()
