"""Token ids in a compressed store, written in document order and read back per document.

A store is a folder with two tables written by Spark: ``model`` (the shared frequency table)
and ``blocks`` (one row per block: its place, the documents in it and the coded payload of
``rans``).  Blocks hold whole documents and decode on their own.

Cases: a null or empty text has only the end id; a null doc_id sorts first; rows with equal
doc_id are kept as they are, in the order of their ids; an empty table gives an empty store;
other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm import rans
from keelson.llm.staging import discard, staged
from keelson.llm.text import slices, text_bytes
from keelson.llm.workers import tidy

END_ID = 1
SLICE = 2 << 20
BLOCK_IDS = 1 << 17
SIDE_BY_SIDE = 16
CACHE_WORDS, CACHE_STEMS = 150_000, 400_000
#: stems that are encoded in one string
JOINED = 1024
_MARKS = b".,;:!?|%&*#$"
_END = b"end of text"
ENCODED = "doc_id long, ids binary, n_tokens long"
BLOCKS = "part int, seq int, first long, n_ids long, doc_ids array<long>, doc_lens array<int>, payload binary"


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


class WordEncoder(dict):
    """Encodes texts with a bounded memory of words seen.

    Tokenizers with a word-end suffix drop white space and never make a token across it, so
    the ids of a text are those of its words.  A word is kept as its stem (A-Z lower-cased,
    when it holds no special token) and its tail of marks after an ASCII letter or digit; these
    two never share a token either.  Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS, stems: int = CACHE_STEMS):
        super().__init__()
        from tokenizers import Tokenizer

        self.most_words, self.most_stems = words, stems

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        self.suffix = model["model"].get("end_of_word_suffix")
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in model["added_tokens"]) or b"(?!)").search
        if self.suffix:
            size = self.tokenizer.get_vocab_size()
            self.closes = np.array([str(self.tokenizer.id_to_token(i)).endswith(self.suffix) for i in range(size)])
        self.tails: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}        # ids of stems as raw bytes, kept longer than words
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.marked = True
        self.reset()

    def reset(self) -> None:
        self.clear()
        if len(self.stems) > self.most_stems:
            self.stems.clear()
        self.tails.clear()
        self.fresh: list[tuple[bytes, bytes]] = []
        self.flat, self.used = np.empty(1 << 16, self.kind), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        low = word.lower()
        stem = word if self.marked and self.special(low) else low
        body = stem.rstrip(_MARKS)
        tail = b""
        if len(body) < len(stem) and body and body[-1] < 128 and chr(body[-1]).isalnum():
            stem, tail = body, stem[len(body):]
        self.fresh.append((stem, tail))
        return at

    def closing(self, end_id: int) -> None:
        """Files the end id under a key that no word can be."""
        if _END not in self:
            at = self[_END] = len(self)
            self.fresh.append((b"", b"\0 end"))
            self.tails[b"\0 end"] = np.array([end_id], self.kind).tobytes()
            assert self[_END] == at

    def one_by_one(self, items: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([x.decode() for x in items], add_special_tokens=False)]

    def learn(self) -> None:
        """Encodes new stems and tails.  Stems of letters only are encoded many in one string
        and told apart by word-end tokens; where these do not add up, one by one."""
        stems, kind = self.stems, self.kind
        plain, other = [], []
        for s in {s for s, _ in self.fresh}:
            if s not in stems:
                (plain if s.decode().isalpha() else other).append(s)
        width = kind.itemsize
        for lo in range(0, len(plain), JOINED):
            group = plain[lo:lo + JOINED]
            ids = self.one_by_one([b" ".join(group)])[0]
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(group):
                raw, at = ids.tobytes(), (ends * width).tolist()
                stems.update(zip(group, map(raw.__getitem__, map(slice, [0, *at[:-1]], at))))
            else:
                other += group
        stems.update((s, ids.tobytes()) for s, ids in zip(other, self.one_by_one(other)))
        tails = [t for t in {t for _, t in self.fresh} if t not in self.tails]
        self.tails.update((t, ids.tobytes()) for t, ids in zip(tails, self.one_by_one(tails)))
        while len(self) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.empty_like(a)]) for a in (self.start, self.size))
        known, tails = len(self) - len(self.fresh), self.tails
        spelled = [stems[s] + tails[t] for s, t in self.fresh]
        size = np.fromiter(map(len, spelled), np.int64, len(spelled)) // width
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used:self.used + total] = np.frombuffer(b"".join(spelled), kind)
        self.start[known:len(self)] = self.used + np.cumsum(size) - size
        self.size[known:len(self)] = size
        self.used += total
        self.fresh = []

    def encode(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n + 1 offsets into them; ``end_id`` closes each text."""
        data, at = text_bytes(column)
        data = data.tobytes()
        if self.suffix:
            self.marked = self.special(data.lower()) is not None       # else no word of these texts is looked at
            if len(self) > self.most_words:
                self.reset()
            parts = [data[a:b].split() for a, b in zip(at, at[1:])]
            if end_id is not None:
                self.closing(end_id)
                for p in parts:
                    p.append(_END)
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            index = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
            del parts
            if self.fresh:
                self.learn()
            size = self.size[index]
            ends = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=ends[1:])
            shift = self.start[index]
            shift -= ends[:-1]
            at = np.repeat(shift, size)
            at += np.arange(len(at))
            return self.flat[at], ends[np.concatenate([[0], np.cumsum(n)])]
        close = np.array([] if end_id is None else [end_id], self.kind)
        each = [np.concatenate([x, close]) for x in self.one_by_one([data[a:b] for a, b in zip(at, at[1:])])]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


@lru_cache(maxsize=1)
def word_encoder(path: str, words: int = CACHE_WORDS, stems: int = CACHE_STEMS) -> WordEncoder:
    """One per Python worker, so tasks that follow each other share the words seen."""
    return WordEncoder(path, words, stems)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, ids (little-endian, of ``id_type`` width) and n_tokens of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for b in slices(batches, "text", SLICE):
            ids, cut = encoder.encode(b.column("text"), end_id)
            ids = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((cut * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(np.diff(cut))], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), ENCODED)


def id_counts(encoded: DataFrame, dtype: np.dtype) -> DataFrame:
    """How often each id occurs; each task sends one row per id."""
    def run(batches):
        word_encoder.cache_clear()          # the words are no longer needed
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(text_bytes(b.column("ids"))[0], dtype), minlength=len(total))
            n[:len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return encoded.select("ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_store(encoded: DataFrame, path: str, dtype: np.dtype, *, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Writes the store at ``path`` from ``encode_documents``'s rows.  The counts that reach
    the driver are one row per id of the vocabulary."""
    spark = encoded.sparkSession
    counts = id_counts(encoded, dtype).toPandas()
    table = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    table[counts["id"]] = counts["n"]
    freq = rans.normalised(table)
    seen = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in seen], "id long, freq long").coalesce(1).write.parquet(f"{path}/model")

    def run(batches):
        from pyspark import TaskContext

        word_encoder.cache_clear()
        coder, part = rans.Coder(freq), TaskContext.get().partitionId()
        docs, size, seq, first, ready = [], 0, 0, 0, []

        def flush():
            coded = coder.encode([np.concatenate([d[1] for d in r[3]]) for r in ready])
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ready), pa.int32()), pa.array([r[0] for r in ready], pa.int32()), pa.array([r[1] for r in ready]), pa.array([r[2] for r in ready]),
                 pa.array([[d[0] for d in r[3]] for r in ready], pa.list_(pa.int64())), pa.array([[len(d[1]) for d in r[3]] for r in ready], pa.list_(pa.int32())), pa.array(coded, pa.binary())],
                ["part", "seq", "first", "n_ids", "doc_ids", "doc_lens", "payload"])

        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                docs.append((doc_id, np.frombuffer(raw, dtype)))
                size += len(raw) // dtype.itemsize
                if size >= block_ids:
                    ready.append((seq, first, size, docs))
                    docs, first, size, seq = [], first + size, 0, seq + 1
                    if len(ready) == SIDE_BY_SIDE:
                        yield flush()
                        ready = []
        if docs:
            ready.append((seq, first, size, docs))
        if ready:
            yield flush()

    order = ["doc_id", "ids"]
    ranged = encoded.repartitionByRange(partitions, "doc_id") if partitions else encoded.repartitionByRange("doc_id")
    ranged.sortWithinPartitions(*order).mapInArrow(tidy(run), BLOCKS).write.parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the store at ``path``."""
    model = spark.read.parquet(f"{path}/model").toPandas()
    freq = np.zeros(int(model["id"].max()) + 1 if len(model) else 0, np.int64)
    freq[model["id"]] = model["freq"]

    def run(batches):
        word_encoder.cache_clear()
        coder = rans.Coder(freq)
        for b in batches:
            for lo in range(0, b.num_rows, SIDE_BY_SIDE):
                s = b.slice(lo, SIDE_BY_SIDE)
                ids = coder.decode(s.column("payload").to_pylist())
                docs, lens = s.column("doc_ids").to_pylist(), s.column("doc_lens").to_pylist()
                for part, first, i, d, n in zip(s.column("part").to_pylist(), s.column("first").to_pylist(), ids, docs, lens):
                    n = np.array(n, np.int64)
                    cut = np.concatenate([[0], np.cumsum(n)])
                    raw = pa.BinaryArray.from_buffers(pa.binary(), len(d), [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(i.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array([part] * len(d), pa.int32()), pa.array(first + cut[:-1]), pa.array(n), raw], ["doc_id", "part", "at", "n_tokens", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row per written part: as many as tasks that wrote the store
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    rows = blocks.select("part", "first", "doc_ids", "doc_lens", "payload").mapInArrow(tidy(run), "doc_id long, part int, at long, n_tokens long, ids binary")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def build_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID) -> None:
    from tokenizers import Tokenizer

    encoded = staged(encode_documents(docs, tokenizer_path, end_id), "ids")
    write_store(encoded, path, id_type(Tokenizer.from_file(tokenizer_path).get_vocab_size()))
    discard(encoded)


def crc_of(ids: bytes) -> int:
    return zlib.crc32(ids)
