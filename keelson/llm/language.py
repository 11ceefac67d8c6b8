"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of characters that are not letters becomes one blank;
n-grams of 1 to 3 characters fall into ``BUCKETS`` hash buckets.  Counts are summed over all
training rows; the log-probability matrix (languages x buckets, checked against
``MAX_MATRIX_BYTES``) goes to every task and a batch is scored by gathering its rows.

Cases: null texts and texts without a letter are ``und`` with score 0; ties go to the first
language in order of name; no training rows: every text is ``und``; repeated rows train and
score each; a null doc_id is scored but not trained on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.text import slices, text_bytes
from keelson.llm.workers import give_back, tidy

BUCKETS = 1 << 15
ORDERS = 3
SMOOTH = 0.5
MAX_MATRIX_BYTES = 256 << 20
UNKNOWN = "und"
#: share of a language's training documents that may lie below its floor, and steps a nat of the histogram
LOW_SHARE, FINE, LEAST = 0.001, 50, -20.0
SLICE = 1 << 20
#: slices of the measures that a pipeline keeps beside other stages in the same workers
SMALL_SLICE = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the row of each, and how many letters each row has.  Rows are
    told apart by two blanks, so n-grams that reach over a border hold nothing but blanks and
    one neighbour's edge; they are left out."""
    data, at = text_bytes(column)
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(at, at[1:])]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    letter = _letters()[code]
    has = np.bincount(row[letter], minlength=len(texts))
    first = np.ones(len(code), bool)
    first[1:] = row[1:] != row[:-1]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]       # the first blank after a letter
    code, row = np.where(letter, code, 32)[keep].astype(np.uint32), row[keep]
    out, owner = [], []
    h = np.zeros(len(code), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(code) < n:
            break
        h = h[:len(code) - n + 1] * np.uint32(0x01000193) ^ code[n - 1:]
        same = row[:len(h)] == row[n - 1:]
        out.append((((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))[same])
        owner.append(row[:len(h)][same])
    if not out:
        return np.empty(0, np.uint32), np.empty(0, np.int32), has
    return np.concatenate(out), np.concatenate(owner), has


def counts(docs: DataFrame) -> DataFrame:
    """How often each n-gram bucket and each language occur in rows (text, lang)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, "text", SLICE):
            names = b.column("lang").to_pylist()
            known = {x: i for i, x in enumerate(dict.fromkeys(names))}
            bucket, row, has = grams(b.column("text"))
            code = np.fromiter((known[x] for x in names), np.int64, len(names))
            sums = np.bincount(code[row] * (BUCKETS + 1) + bucket, minlength=len(known) * (BUCKETS + 1)).reshape(len(known), -1)
            for x, i in known.items():
                sums[i, BUCKETS] = np.count_nonzero((code == i) & (has > 0))
                total[x] = total.get(x, 0) + sums[i]
        for x, v in total.items():
            seen = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(seen), pa.string()), pa.array(seen), pa.array(v[seen])], ["lang", "bucket", "n"])

    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(tidy(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs = langs
        n = table[:, :BUCKETS] + SMOOTH
        self.log = np.log(n / n.sum(1, keepdims=True)).T.astype(np.float32).copy() if langs else None
        self.prior = np.log((table[:, BUCKETS] + SMOOTH) / (table[:, BUCKETS] + SMOOTH).sum()) if langs else None

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        return self.measure(column)[:2]

    def measure(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score, and the mean log-probability of an n-gram in that
        language."""
        bucket, row, has = grams(column)
        n = len(column)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.full(n, LEAST)
        raw = np.stack([np.bincount(row, weights=self.log[bucket, k], minlength=n) for k in range(len(self.langs))], 1)
        total = raw + self.prior
        best = total.argmax(1)
        odds = np.exp(total - total.max(1, keepdims=True))
        score = np.where(has > 0, 1 / odds.sum(1), 0.0)
        many = np.bincount(row, minlength=n)
        mean = raw[np.arange(n), best] / np.maximum(many, 1)
        return [self.langs[k] if h else UNKNOWN for k, h in zip(best.tolist(), (has > 0).tolist())], score, mean


def floors(docs: DataFrame, model: Model) -> dict[str, float]:
    """Per language, the mean log-probability of an n-gram that all but ``LOW_SHARE`` of the
    training documents reach which are taken for the language they name; counted over all of them
    in steps of 1 / ``FINE`` (the driver gets a row per language and step).  The floor lies
    below that by the distance of the quantile from the median, for what training has not seen."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, "text", SMALL_SLICE):
            lang, _, mean = shared.value.measure(b.column("text"))
            ok = np.array([x == y and x != UNKNOWN for x, y in zip(lang, b.column("lang").to_pylist())], bool)
            step = np.floor(np.maximum(mean, LEAST) * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()).filter(pa.array(ok)), pa.array(step[ok])], ["lang", "step"])

    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    seen: dict[str, list[tuple[int, int]]] = {}
    for r in rows.mapInArrow(tidy(run), "lang string, step long").groupBy("lang", "step").count().sort("lang", "step").collect():
        seen.setdefault(r["lang"], []).append((r["step"], r["count"]))
    out = {}
    for lang, steps in seen.items():
        total = np.cumsum([n for _, n in steps])
        low, middle = (steps[int(np.searchsorted(total, share * total[-1], "right"))][0] / FINE for share in (LOW_SHARE, 0.5))
        out[lang] = low - (middle - low)
    return out


def fit(docs: DataFrame) -> Model:
    """Trains on all rows (text, lang); what reaches the driver is one row per language and
    bucket, checked against the matrix bound before it is fetched."""
    table = counts(docs).persist()
    try:
        langs = [r[0] for r in table.select("lang").distinct().sort("lang").limit(MAX_MATRIX_BYTES // (4 * BUCKETS) + 1).collect()]
        if len(langs) * BUCKETS * 4 > MAX_MATRIX_BYTES:
            raise ValueError(f"too many languages for the matrix bound: {len(langs)} or more")
        sums = np.zeros((len(langs), BUCKETS + 1))
        place = {x: i for i, x in enumerate(langs)}
        got = table.toArrow()
        sums[[place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
        return Model(langs, sums)
    finally:
        table.unpersist()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, "text", SLICE):
            lang, score = shared.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def likely(docs: DataFrame, model: Model, score: float, floor: dict[str, float] | None = None) -> DataFrame:
    """Rows whose text has a language at least this likely, and whose n-grams are as likely in it
    as its ``floor``; all columns stay, nothing is moved."""
    floor = floor or {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        out = []
        for b in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text", SMALL_SLICE):
            lang, p, mean = shared.value.measure(b.column("text"))
            out += [x != UNKNOWN and y >= score and m >= floor.get(x, LEAST) for x, y, m in zip(lang, p.tolist(), mean.tolist())]
        give_back()
        return pa.array(out, pa.bool_())

    return docs.filter(F.arrow_udf(run, "boolean")(F.col("text").cast("string")))
