"""Benchmark decontamination by an exact bound on common words.

Documents are cut into overlapping passages of words.  Around each passage, as far as an item is
long, the item's words that occur there are counted (one matrix product for all items of about one
length).  No common subsequence is longer than that count, so a passage that could hold the item
is always a candidate, however long it is, and no latent space or cosine is needed to find it; a
paraphrase must also keep ``WEIGHT`` of the item's TF-IDF weight (document frequencies of hashed
words, counted over the whole corpus).  Candidates are then checked word by word: the longest common
subsequence of the item with the words around the passage, and, for
paraphrases (``LOOSE`` up to ``TIGHT`` of the item's words), also the item's answer, its last
quarter.  The item set is the query set: it is read in blocks of ``BLOCK`` items, each
against all documents.

Cases: null and empty texts are clean; null, empty and repeated items are looked for once or
not at all; items under ``EXACT_BELOW`` words count only word for word; an empty benchmark
leaves all documents clean; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.staging import staged
from keelson.llm.text import NOT_ALNUM, list_array, slices, word_hashes, words
from keelson.llm.workers import tidy

BUCKETS = 1 << 18
PASSAGE, STRIDE = 32, 16
BLOCK = 256
TIGHT, LOOSE, ANSWER = 0.8, 0.6, 0.75
#: share of an item's TF-IDF weight that a paraphrase must keep, so that stop words alone are none
WEIGHT = 0.5
#: parts that document frequencies are summed in
_PARTS = 64
EXACT_BELOW = 13
#: windows counted at a time
WINDOWS = 512
SLICE = 1 << 20


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _summed(rows: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """Vectors (part, values) added up by part in two steps.  Parts are few and of fixed size; a
    task reads its rows as they come and holds one sum for each part."""
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, values in zip(b.column("part").to_pylist(), b.column("values")):
                total[part] = total.get(part, 0) + np.frombuffer(values.as_buffer(), kind)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "values"])

    schema = "part int, values binary"
    some = rows.withColumn("salt", F.spark_partition_id() % 32).repartition("part", "salt").select("part", "values").mapInArrow(add, schema)
    whole = some.repartition("part").mapInArrow(add, schema)
    return {r["part"]: np.frombuffer(r["values"], kind) for r in whole.toArrow().to_pylist()}


def _vectors(parts: Sequence[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "values"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each word bucket occurs, and how many texts have words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + _PARTS, np.int64)
        for b in slices(batches, "text", SLICE):
            w = words(b.column("text"), NOT_ALNUM)
            code = np.unique(w.doc * BUCKETS + _buckets(word_hashes(w, lower=True)))
            total[:BUCKETS] += np.bincount(code % BUCKETS, minlength=BUCKETS)
            total[BUCKETS] += np.count_nonzero(w.count)
        yield _vectors(np.split(np.concatenate([total[:BUCKETS].reshape(_PARTS, -1), total[BUCKETS:, None]], 1).ravel(), _PARTS))

    got = _summed(docs.select("text").mapInArrow(tidy(run), "part int, values binary"), np.int64)
    whole = np.stack([got[p] for p in range(_PARTS)]) if got else np.zeros((_PARTS, BUCKETS // _PARTS + 1), np.int64)
    return whole[:, :-1].ravel(), int(whole[:, -1].sum())


class Class:
    """Items of about one length: how often each of their terms is in each item and its answer."""

    def __init__(self, members: list[int], texts: list[np.ndarray], idf: np.ndarray):
        self.members = members
        self.longest = max(len(texts[j]) for j in members)
        self.terms = np.unique(np.concatenate([_buckets(texts[j]) for j in members]))
        self.term_of = np.full(BUCKETS, -1, np.int32)
        self.term_of[self.terms] = np.arange(len(self.terms))
        self.whole, self.answer = (np.zeros((len(self.terms), len(members)), np.float32) for _ in range(2))
        for k, j in enumerate(members):
            at = self.term_of[_buckets(texts[j])]
            np.add.at(self.whole[:, k], at, 1)
            np.add.at(self.answer[:, k], at[-_answer(len(at)):], 1)
        weight = idf[self.terms].astype(np.float32)[:, None]
        self.weights = self.whole * weight
        self.heavy = WEIGHT * self.weights.sum(0) * (1 - 1e-4)
        n = np.array([len(texts[j]) for j in members])
        # small slack for the rounding of products
        short = n < EXACT_BELOW
        self.tight = np.where(short, n, TIGHT * n) - 1e-3
        self.loose = np.where(short, n, LOOSE * n) - 1e-3
        self.asked = np.array([ANSWER * _answer(x) for x in n.tolist()]) - 1e-3

    def possible(self, there: np.ndarray) -> np.ndarray:
        """Which items the words of each window (windows x terms, 0 or 1) could hold."""
        found = there @ self.whole
        return (found >= self.tight) | (found >= self.loose) & (there @ self.answer >= self.asked) & (there @ self.weights >= self.heavy)


class Items:
    """A block of benchmark items: their words, in classes of about one length."""

    def __init__(self, ids: list[int], texts: list[str], idf: np.ndarray):
        w = words(pa.array(texts, pa.string()), NOT_ALNUM)
        h = word_hashes(w, lower=True)
        self.ids = ids
        self.words = [h[a:b] for a, b in zip(w.first, w.first[1:])]
        sized: dict[int, list[int]] = {}
        for j, t in enumerate(self.words):
            if len(t):
                sized.setdefault(max(4, (2 * len(t) - 1).bit_length()), []).append(j)
        self.classes = [Class(m, self.words, idf) for _, m in sorted(sized.items())]


def _answer(n: int) -> int:
    """Words of the answer of an item of n words."""
    return max(3, n // 4)


def _passages(w, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end word of every passage; the last one of a text may be short."""
    n = np.maximum(1, -(-(w.count - (PASSAGE - STRIDE)) // STRIDE)) * (w.count > 0)
    row = np.repeat(np.arange(len(n)), n)
    start = w.first[row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    return row, start, np.minimum(start + PASSAGE, w.first[row + 1])


def common_subsequence(item: Sequence[int], text: Sequence[int]) -> int:
    """Length of the longest common subsequence, by bit vectors over the item's words."""
    where: dict[int, int] = {}
    for k, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for x in text:
        m = where.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def leaked(item: list[int], text: list[int]) -> float:
    """Share of the item's words found in order, or 0 if that is no leak."""
    n = len(item)
    if n < EXACT_BELOW:
        return 1.0 if any(text[k:k + n] == item for k in range(len(text) - n + 1)) else 0.0
    there = set(text)
    if sum(x in there for x in item) < LOOSE * n:       # no subsequence is longer than that
        return 0.0
    share = common_subsequence(item, text) / n
    if share >= TIGHT:
        return share
    if share >= LOOSE:
        answer = item[-_answer(n):]
        if common_subsequence(answer, text) >= ANSWER * len(answer):
            return share
    return 0.0


def search(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, item ids and the best share, of rows that hold an item."""
    given = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        ids, plain = given.value.ids, [t.tolist() for t in given.value.words]
        for b in slices(batches, "text", SLICE):
            w = words(b.column("text"), NOT_ALNUM)
            h = word_hashes(w, lower=True)
            bucket = _buckets(h)
            row, start, _ = _passages(w, h)
            hits: dict[int, dict[int, float]] = {}
            for c in given.value.classes:
                term = c.term_of[bucket]
                known = np.flatnonzero(term >= 0)               # words that any item of the class has
                spot = np.concatenate([[0], np.cumsum(term >= 0)])
                begin = np.maximum(w.first[row], start - c.longest)
                end = np.minimum(w.first[row + 1], start + PASSAGE + c.longest + STRIDE)
                first, count = spot[begin], spot[end] - spot[begin]
                may = np.flatnonzero(count > 0)
                for lo in range(0, len(may), WINDOWS):
                    p = may[lo:lo + WINDOWS]
                    n = count[p]
                    owner = np.repeat(np.arange(len(p)), n)
                    at = np.arange(n.sum()) + np.repeat(first[p] - (np.cumsum(n) - n), n)
                    there = np.zeros((len(p), len(c.terms)), np.float32)
                    there[owner, term[known[at]]] = 1
                    for k, m in zip(*np.nonzero(c.possible(there))):
                        j, r, s = c.members[m], int(row[p[k]]), int(start[p[k]])
                        found = hits.setdefault(r, {})
                        if j in found:
                            continue
                        size = len(plain[j])
                        a, z = max(int(w.first[r]), s - size), min(int(w.first[r + 1]), s + PASSAGE + size + STRIDE)
                        part = leaked(plain[j], h[a:z].tolist())
                        if part:
                            found[j] = part
            got = sorted(r for r, x in hits.items() if x)
            lists = [sorted(ids[j] for j in hits[r]) for r in got]
            cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(got, pa.int64())), list_array(pa.array([i for x in lists for i in x], pa.int64()), cut), pa.array([max(hits[r].values()) for r in got], pa.float64())],
                ["doc_id", "items", "share"])

    return docs.mapInArrow(tidy(run), "doc_id long, items array<long>, share double")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, items and best share of every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # each different item once, under its smallest id
    wanted = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL AND item_id IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"))
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    found = None
    block: list = []

    def finish():
        items = Items([r["item_id"] for r in block], [r["text"] for r in block], idf)
        if not items.classes:
            return None
        return staged(search(docs, items), "leaks")

    for r in wanted.orderBy("item_id").toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            part, block = finish(), []
            found = part if found is None else found.union(part) if part is not None else found
    if block:
        part = finish()
        found = part if found is None else found.union(part) if part is not None else found
    if found is None:
        return docs.select("doc_id", F.lit(False).alias("contaminated"), F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("share"))
    per_doc = found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("share").alias("share"))
    rows = docs.select("doc_id")
    return rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["doc_id"]), "left").select(
        rows["doc_id"], F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"))
