"""Near-duplicate documents by MinHash, confirmed on full shingle sets.

Documents with equal shingle sets form a class, and only its smallest doc_id goes on.  Many
universal hash minima make a signature; bands of it are bucket keys.  Every member of a bucket
is compared with the bucket's smallest member first (a star, not all pairs): signature, then
full sets.  Components of these links leave few buckets that hold more than one component;
there, members of different components are compared in blocks of bounded size, inside the
task, and only pairs whose signatures agree come out and are confirmed on full sets.  Links
inside one component change nothing, so the components are those of all links that share a
band.  ``bands`` x ``rows`` make a missed link at the threshold as rare as 1 in 10**8.

Cases: null and empty texts have no shingles and link with nothing; a text of fewer words
than a shingle is one shingle; a null doc_id is kept and links with nothing; rows that repeat
a doc_id count as one document with all their links; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.components import components
from keelson.llm.staging import release, staged
from keelson.llm.text import long_array, mix, shingles, slices, word_hashes, words
from keelson.llm.workers import tidy

BANDS, ROWS = 32, 5
BLOCK = 256
#: signatures agree if this share of bytes does: five standard deviations below the threshold
MARGIN = 0.15
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, keys array<long>"


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted inside each, and the n + 1 offsets."""
    w = words(column)
    h = word_hashes(w, lower=True)
    value, at = shingles(h, w.doc, size)
    doc = w.doc[at]
    few = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            has = w.count[few] > k
            whole[has] = mix(whole[has] * np.uint64(31) + h[w.first[few[has]] + k] + np.uint64(k + 1))
        value, doc = np.concatenate([value, whole]), np.concatenate([doc, few])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(column) + 1))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Set size, set identity, signature bytes and band keys of every document."""
    mult, add = _coefficients(BANDS * ROWS)
    seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            value, cut = shingle_sets(b.column("text"), size)
            n = np.diff(cut)
            full = np.flatnonzero(n)
            sig = np.zeros((b.num_rows, BANDS * ROWS), np.uint32)
            set_a, set_b = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            if len(full):
                starts, x = cut[full], value >> np.uint64(32)
                for k in range(BANDS * ROWS):
                    sig[full, k] = np.minimum.reduceat(x * mult[k] + add[k], starts) >> np.uint64(32)
                set_a[full], set_b[full] = np.add.reduceat(value, starts), np.add.reduceat(mix(value + np.uint64(77)), starts)
            keys = np.zeros((b.num_rows, BANDS), np.uint64)
            for k in range(ROWS):
                keys = mix(keys * np.uint64(31) + sig[:, k::ROWS])
            keys ^= seeds
            low = np.ascontiguousarray(mix(sig.astype(np.uint64)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), long_array(set_a), long_array(set_b),
                 pa.FixedSizeBinaryArray.from_buffers(pa.binary(BANDS * ROWS), b.num_rows, [None, pa.py_buffer(low)]).cast(pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BANDS, pa.int32()), long_array(keys.ravel()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "signature", "keys"])

    return docs.mapInArrow(tidy(run), SIGNED)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose set sizes allow the threshold and whose signatures agree."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").filter(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
    floor = percent / 100 - MARGIN

    def run(batches):
        for b in batches:
            s = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("s_u", "s_v")]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(_agree(*s) >= floor))

    return both.select("u", "v", "s_u", "s_v").mapInArrow(tidy(run), "u long, v long")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union of their full shingle sets."""
    side = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"t_{c}"))

    def run(batches):
        for b in slices(batches, "t_u", 1 << 20):
            u, cu = shingle_sets(b.column("t_u"), size)
            v, cv = shingle_sets(b.column("t_v"), size)
            # members of both sets of one pair, found in one sort of all
            owner = np.concatenate([np.repeat(np.arange(b.num_rows), np.diff(cu)), np.repeat(np.arange(b.num_rows), np.diff(cv))])
            value = np.concatenate([u, v])
            order = np.lexsort((value, owner))
            value, owner = value[order], owner[order]
            same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
            both = np.bincount(owner[1:][same], minlength=b.num_rows)
            union = np.diff(cu) + np.diff(cv) - both
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array((100 * both >= percent * union) & (both > 0)))

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "t_u", "t_v").mapInArrow(tidy(run), "u long, v long")


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one bucket whose signatures agree, once for all buckets
    they share.  A bucket is cut into blocks by doc_id hash; each pair of blocks is one small
    group."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc_id", "component", "n_shingles", "signature", "keys")
    floor = percent / 100 - MARGIN
    order = ["key", "lo", "hi"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool):
            """Pairs of all groups but the last one, whose rows may go on; it is handed back."""
            n = table.num_rows
            key, lo, hi = (table.column(c).to_numpy() for c in order)
            new = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            cut = np.concatenate([[0], new, [n]])
            stop = len(cut) - 1 - (not last)
            own, doc, comp, size = (table.column(c).to_numpy() for c in ("own", "doc_id", "component", "n_shingles"))
            sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(n, -1)
            bands = table.column("keys").combine_chunks().flatten().to_numpy().reshape(n, -1)
            u, v = [], []
            for a, b in zip(cut[:stop], cut[1:stop + 1]):
                if b - a < 2:
                    continue
                for i in range(a, b - 1):
                    # blocks meet once: inside a block where both numbers are equal
                    ok = (comp[i + 1:b] != comp[i]) & ((own[i + 1:b] != own[i]) if lo[a] != hi[a] else True)
                    ok &= 100 * np.minimum(size[i], size[i + 1:b]) >= percent * np.maximum(size[i], size[i + 1:b])
                    j = np.flatnonzero(ok) + i + 1
                    if len(j):
                        j = j[_agree(sig[i], sig[j]) >= floor]
                    if len(j):
                        # of the buckets two documents share, the first alone hands them out
                        j = j[bands[i, (bands[i] == bands[j]).argmax(1)] == key[i]]
                    if len(j):
                        u.append(np.full(len(j), doc[i]))
                        v.append(doc[j])
            out = None
            if u:
                p, q = np.concatenate(u), np.concatenate(v)
                out = pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], ["u", "v"])
            return out, table.slice(int(cut[-2]))

        for b in batches:
            held.append(b)
            out, rest = groups(pa.Table.from_batches(held), False)
            held = rest.to_batches()
            if out:
                yield out
        if held:
            out, _ = groups(pa.Table.from_batches(held), True)
            if out:
                yield out

    return spread.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of (doc_id, text): documents are
    linked with 100 * intersection >= percent * union of their distinct ``size``-word shingles."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = staged(signatures(docs, size), "signatures")
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    member = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["n_shingles", "set_a", "set_b"], "left").select("doc_id", "n_shingles", "rep")
    member = staged(member, "classes")
    reps = staged(signed.join(member.select(F.col("rep").alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "set_a", "set_b"]), "reps")
    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = staged(keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    bucket = staged(keyed.join(shared, "key"), "bucket_members")
    release(docs.sparkSession)
    texts = docs.join(reps.select("doc_id"), "doc_id", "left_semi")

    star = bucket.filter("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v")).distinct()
    links = staged(confirmed(alike(star, reps, percent), texts, size, percent), "links")
    release(docs.sparkSession)          # shuffle files of the steps so far
    first = components(links)

    placed = bucket.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("key")
    rest = placed.join(mixed, "key", "left_semi").join(reps.select("doc_id", "n_shingles", "signature", "keys"), "doc_id")
    more = staged(confirmed(across(rest.select("key", "n", "doc_id", "component", "n_shingles", "signature", "keys"), percent), texts, size, percent), "more_links")
    release(docs.sparkSession)
    # classes that share a repeated doc_id are one document
    least = member.filter("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("v"))
    ties = member.join(least, "doc_id").filter("rep <> v").select(F.col("rep").alias("u"), "v")
    final = components(links.union(more).union(ties))
    home = F.coalesce("component", "rep", "doc_id")
    return member.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", home.alias("component_id"), F.coalesce(F.col("doc_id") == home, F.lit(True)).alias("kept"))
