"""Quality rules with cutoffs whose false rejections are bounded by exact binomial tests.

Each rule rejects a document when one of its figures passes a cutoff.  Vectors of cutoffs, one for
each rule, come in a fixed sequence from lenient to strict (``SEQUENCE``: all rules at their mildest
cutoff, then one rule after the other a step stricter) and are tried on the labelled good
documents of one stratum; a vector holds if the exact binomial test rejects "more than ``risk`` of
good documents fall to any rule" and all more lenient ones held (fixed-sequence testing).  The
level is divided among all strata (Bonferroni), so with probability 1 - ``level`` every
stratum loses at most ``risk`` of its good documents to all rules together.  A stratum with
too few labels gets no cutoffs: the rules are off there.

Cases: null or empty texts have no words and fail the base; a null stratum is a stratum of
its own; a null doc_id has no label; repeated rows are judged each on their own text, and
contradicting labels count as not good; with no labels at all only the base decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.text import blanks, mix, running, shingles, slices, span_hashes, word_hashes, words

RISK, LEVEL = 0.02, 0.05
MIN_WORDS = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

FIGURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: name -> (figure per document, cutoffs from lenient to strict)
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04]),
    "dup_lines": ("n_dup_lines / greatest(n_words, 1)", [0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "long_words": ("word_chars / greatest(n_words, 1)", [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0]),
}

def _sequence() -> list[tuple[float, ...]]:
    grids = [grid for _, grid in RULES.values()]
    at = [0] * len(grids)
    out = [tuple(g[0] for g in grids)]
    for step in range(1, max(map(len, grids))):
        for k, g in enumerate(grids):
            if step < len(g):
                at[k] = step
                out.append(tuple(g[i] for g, i in zip(grids, at)))
    return out


#: vectors of cutoffs, in order of RULES
SEQUENCE = _sequence()


def _per_doc(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def figures(docs: DataFrame, stratum: str) -> DataFrame:
    """Base figures of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"))
            n, at = b.num_rows, w.offsets
            body = ~blanks(w.data)
            inside, chars, symbols = running(body), running(body & (w.data & 0xC0 != 0x80)), running(_SYMBOL[w.data])
            # lines: one more than line feeds in each document
            feed = np.flatnonzero(w.data == 10)
            start = np.sort(np.concatenate([at[:-1], feed + 1]))
            end = np.sort(np.concatenate([feed, at[1:]]))
            owner = np.repeat(np.arange(n), 1 + _per_doc(np.searchsorted(at, feed, "right") - 1, n))
            full = inside[end] > inside[start]
            start, end, owner = start[full], end[full], owner[full]
            line = span_hashes(w.data, start, end) ^ mix(owner.astype(np.uint64) + np.uint64(1))
            _, first = np.unique(line, return_index=True)
            dup = _per_doc(owner, n) - _per_doc(owner[first], n)
            # words inside three-word windows that the same text has twice or more
            gram, place = shingles(word_hashes(w, lower=False), w.doc, 3)
            _, code, times = np.unique(gram ^ mix(w.doc[place].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
            hit = place[times[code] > 1]
            cover = np.zeros(len(w.start), bool)
            for k in range(3):
                cover[hit + k] = True
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("stratum"), pa.array(w.count), pa.array(chars[at[1:]] - chars[at[:-1]]), pa.array(symbols[at[1:]] - symbols[at[:-1]]),
                 pa.array(dup), pa.array(_per_doc(w.doc[cover], n))],
                ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col(stratum).cast("string").alias("stratum")).mapInArrow(run, FIGURES)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_below(k: int, n: int, p: float) -> float:
    """Exact P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i.tolist()]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(log).sum()))


def certified(n: int, rejected: list[int], cutoffs: list, risk: float, level: float):
    """The strictest cutoff (or vector of cutoffs) reached before the first that fails its test."""
    best = None
    for k, c in zip(rejected, cutoffs):
        if n == 0 or binomial_below(k, n, risk) > level:
            break
        best = c
    return best


def cutoffs(rows: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum with a cutoff (or null) for each rule."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    held = rows.filter(~base_failed()).join(good, "doc_id", "left_semi")
    falls = [" OR ".join(f"({figure}) > {c}D" for (figure, _), c in zip(RULES.values(), vector)) for vector in SEQUENCE]
    counts = F.array(*(F.count_if(F.expr(x)) for x in falls)).alias("rejected")
    # strata without good labels count in the correction too, so the level does not depend on the labels
    table = rows.select("stratum").distinct().join(held.groupBy(F.col("stratum").alias("s")).agg(F.count(F.lit(1)).alias("n"), counts), F.col("stratum").eqNullSafe(F.col("s")), "left").drop("s")
    table = table.crossJoin(F.broadcast(table.agg(F.count(F.lit(1)).alias("strata"))))   # one row with one number
    names = list(RULES)

    def run(batches):
        for b in batches:
            out = {k: [] for k in names}
            for r in b.to_pylist():
                best = certified(r["n"] or 0, r["rejected"] or [], SEQUENCE, risk, level / r["strata"])
                for k, c in zip(names, best or [None] * len(names)):
                    out[k].append(c)
            yield pa.RecordBatch.from_arrays([b.column("stratum"), pa.array([r or 0 for r in b.column("n").to_pylist()], pa.int64()), *(pa.array(out[k], pa.float64()) for k in names)], ["stratum", "n_good", *(f"cut_{k}" for k in names)])

    return table.mapInArrow(run, "stratum string, n_good long, " + ", ".join(f"cut_{k} double" for k in names))


def judged(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Every row with ``base_failed`` and ``kept``."""
    cut = table.withColumnRenamed("stratum", "s")
    out = rows.join(cut, F.col("stratum").eqNullSafe(F.col("s")), "left").withColumn("base_failed", base_failed())
    fails = F.lit(False)
    for name, (figure, _) in RULES.items():
        fails = fails | F.coalesce(F.expr(figure) > F.col(f"cut_{name}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~fails).drop("s", "n_good", *(f"cut_{k}" for k in RULES))
