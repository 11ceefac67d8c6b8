"""run() and the registered queries on the smallest tables."""

import random

import pytest

import corpus_pipeline as C
from keelson.llm.queries import QUERIES, SQL
from tests.llm.conftest import FULL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with one planted case for each stage."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(6)
    bag = [f"{a}{b}" for a in ("house", "river", "mount", "field") for b in ("er", "ing", "s", "ed", "ly", "ish", "ness")]
    text = lambda n: " ".join(rng.choice(bag) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))
    passage, item = text(70), text(30)
    rows = [(k, text(120), "en", "s", 0) for k in range(20)]
    rows += [(30, rows[3][1], "en", "s", 0), (31, rows[4][1] + " end", "en", "s", 0)]                         # copies
    rows += [(40, text(90) + " " + passage + " " + text(90), "en", "s", 0), (41, text(40) + " " + passage + " " + text(30), "en", "s", 0)]
    rows += [(50, text(60) + " " + item + " " + text(40), "en", "s", 0), (60, "12 34 --", None, None, None), (61, None, "en", "s", 0), (62, "", None, "s", 0), (None, text(50), "en", "s", 0), (5, rows[5][1], "en", "s", 0)]
    spark.createDataFrame(rows, FULL).withColumn("component", C.F.lit(1)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, passage


def test_stages_take_effect(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    gone = []
    for name, stage in C.STAGES[:-1]:
        after = C.staged(stage(spark, docs, path), name)
        assert after.columns == columns and after.dtypes == docs.dtypes
        gone.append(sorted({r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()}))
        docs = after
    assert gone == [[60, 61, 62], [30, 31], [], [50]]
    out = {r.doc_id: r for r in C.run(spark, path).collect()}
    want = {k: t for k, t, *_ in rows if k not in (30, 31, 50, 60, 61, 62)}
    want[41] = want[41].replace(passage + " ", "")
    assert {k: r.text for k, r in out.items()} == want and all(r.lossless for r in out.values())


def test_empty_corpus(spark, folder, tmp_path):
    path, _, _ = folder
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_registered_queries(spark):
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op3_html_extraction", "op7_language_id"):
        assert QUERIES[name](spark, SF).count() in n.values()


@pytest.mark.parametrize("name", ["op2_minhash_dedup", "op11_centroid_clusters", "op12_prefix_trie"])
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cur.fetchall(), key=str)


def test_packing_query_against_the_tokenizer(spark):
    import zlib
    from collections import defaultdict

    import numpy as np
    from tokenizers import Tokenizer

    from keelson.llm.queries import tokenizer_file

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op13_least_squares_packing"](spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for parts, total in [(sorted(v), len(ids[k])) for k, v in pieces.items()] + [(sorted(v), None) for v in sequences.values()]:
        end = 0
        for start, n in parts:
            assert start == end and n > 0
            end += n
        assert end == total if total is not None else end <= 4096 and end & (end - 1) == 0      # nothing is padded


def test_dirty_rows_take_no_other_row_along(spark, folder):
    """Rows without an id, or with the same one, of which one holds an item."""
    path, rows, _ = folder
    dirty = next(t for k, t, *_ in rows if k == 50)
    docs = spark.createDataFrame([(None, dirty, "en", "s", 0), (None, "an innocent text without an id", "en", "s", 0), (7, dirty, "en", "s", 0), (7, "an innocent text of the same id", "en", "s", 0), (8, None, "en", "s", 0)], FULL)
    got = C.decontaminate_benchmark(spark, docs, path).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("7", "an innocent text of the same id"), ("8", "None"), ("None", "an innocent text without an id")]
    twice = docs.unionByName(docs)
    kept = C.drop_near_duplicates(spark, twice, path).collect()
    assert sum(r.doc_id is None for r in kept) == 4 and sum(r.doc_id == 8 for r in kept) == 1
