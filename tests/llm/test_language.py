import pyarrow as pa

from keelson.llm import language as L
from tests.llm.conftest import FULL


def test_grams_by_hand():
    bucket, row, has = L.grams(pa.array(["Ab1c", None, "", "12 !", "b"]))
    assert has.tolist() == [3, 0, 0, 0, 1]
    # "ab c": one, two and three characters; "b": one
    assert sorted(row.tolist()) == [0] * 9 + [4]
    again, _, _ = L.grams(pa.array(["ab c"]))
    assert sorted(bucket[row == 0].tolist()) == sorted(again.tolist())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = "crc32(cast(doc_id as string)) % 4 = 2"
    model = L.fit(docs.filter(f"NOT {held}"))
    got = L.identify(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "der hund und die katze", "de", "s", 1), (2, "the dog and the cat", "en", "s", 1), (3, None, "de", None, None), (4, "12 !", None, "s", 1), (None, "the cat", None, "s", 1), (2, "the dog and the cat", "en", "s", 1)]
    docs = spark.createDataFrame(rows, FULL).withColumnRenamed("source", "bucket")
    out = L.identify(docs, L.fit(docs)).collect()
    assert [r.lang_pred for r in out] == ["de", "en", "und", "und", "en", "en"] and out[2].score == 0
    nothing = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0), nothing).collect() == []
    kept = L.likely(docs, L.fit(docs), 0.5)
    assert kept.columns == docs.columns and kept.count() == 4


def test_unlearned_language_and_junk_go(spark):
    import random

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    junk = [(-1, " ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(80)), None), (-2, "".join(rng.choice(letters + "0123456789+/") for _ in range(900)), None),
            (-3, "Привет мир, это текст на русском языке. " * 12, None), (-4, "Hyvää päivää, tämä on suomenkielinen teksti jota kukaan ei ole opettanut. " * 8, None)]
    table = docs.union(spark.createDataFrame(junk, docs.schema))
    known = table.select("text", "lang")
    model = L.fit(known)
    kept = {r.doc_id for r in L.likely(table, model, 0.5, L.floors(known, model)).collect()}
    lettered = {r.doc_id for r in L.likely(docs, model, 0.5).collect()}
    assert not kept & {-1, -2, -3, -4}
    assert len(kept) >= 0.98 * len(lettered)
