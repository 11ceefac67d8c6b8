import random

from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import decontaminate as D


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert D.common_subsequence(a, b) == table[-1][-1]


def table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", __import__("pyspark").sql.functions.lit("x"))


def test_leaks_and_paraphrases(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)            # several blocks of items
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(900)]
    common = ["the", "of", "and", "to"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randrange(16, 60)) for _ in range(18)] + [["alpha", "beta", "gamma", "delta"]]
    rows, want = [], {}
    for k in range(120):
        t = text(rng.randrange(20, 300))
        if k % 6 == 0:
            item = list(items[k // 6 % len(items)])
            if k % 12 == 0 and len(item) > 20:             # a paraphrase: words dropped and put in
                del item[3:len(item) // 2:5]
                item.insert(5, "so")
            at = rng.randrange(len(t) + 1)
            t[at:at] = item
            want[k] = [k // 6 % len(items)]
        rows.append((k, " ".join(t).capitalize() + "."))
    rows += [(200, None), (201, ""), (202, "alpha beta other gamma delta")]
    bench = table(spark, [(i, " ".join(t) + ".") for i, t in enumerate(items)] + [(90, None), (91, ""), (None, "x y"), (92, " ".join(items[0]) + ".")])
    got = {r.doc_id: r for r in D.contamination(docs(*rows), bench).collect()}
    assert len(got) == len(rows) and {k: r["items"] for k, r in got.items() if r.contaminated} == want
    assert all(r.share >= D.LOOSE for r in got.values() if r.contaminated)


def test_empty_tables_and_null_ids(spark, docs):
    item = " ".join(f"word{k}" for k in range(20))
    rows = docs((None, item), (1, item), (1, item), (2, "other"))
    out = D.contamination(rows, table(spark, [(5, item)])).collect()
    assert sorted((r.doc_id or 0, r.contaminated) for r in out if r.doc_id != 1) == [(0, True), (2, False)] and [r["items"] for r in out if r.doc_id == 1] == [[5], [5]]
    assert not any(r.contaminated for r in D.contamination(rows, table(spark, [(5, item)]).limit(0)).collect())
    assert D.contamination(rows.limit(0), table(spark, [(5, item)])).collect() == []


def test_long_short_and_common_items(spark, docs):
    """Copies and paraphrases of items of any length are candidates, common words or not."""
    rng = random.Random(7)
    common = [f"c{k}" for k in range(60)]
    lengths = (4, 40, 100, 200, 500)
    items = [[rng.choice(common) for _ in range(n)] for n in lengths]
    rows = [(k, " ".join(f"r{rng.randrange(10**6)}" for _ in range(120))) for k in range(60)]
    fill = lambda n: [f"r{rng.randrange(10**6)}" for _ in range(n)]
    for i, item in enumerate(items):
        rows.append((100 + i, " ".join(fill(100) + item + fill(100))))
        if len(item) > 13:                      # every third word but those of the answer replaced
            loose = [x if k % 3 or k >= len(item) * 3 // 4 else "other" for k, x in enumerate(item)]
            rows.append((200 + i, " ".join(fill(100) + loose + fill(100))))
    got = {r.doc_id: r["items"] for r in D.contamination(docs(*rows), table(spark, [(i, " ".join(x)) for i, x in enumerate(items)])).collect() if r.contaminated}
    assert all(k % 100 in x for k, x in got.items()) and set(got) == {100, 101, 102, 103, 104, 201, 202, 203, 204}
