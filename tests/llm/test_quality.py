import re
from collections import Counter
from math import comb

import pytest

from keelson.llm import quality as Q
from tests.llm.conftest import FULL


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


TEXTS = [None, "", "\n\n", "a b c a b c", "a\na\n a\n\na\r\na\r\n", "é🙂 ## $x|<y>\u2003z", "x " * 60, "one two three " * 30, " a\n a", "\n".join(f"line {k % 3} of text" for k in range(40))]


def test_figures(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(TEXTS)], FULL).withColumnRenamed("n_chars", "n_words")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.figures(docs, "lang").collect()}
    assert got == {k: brute(t) for k, t in enumerate(TEXTS)}


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 40, 0.05), (7, 7, 0.3), (12, 300, 0.02)])
def test_exact_binomial(k, n, p):
    assert abs(Q.binomial_below(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_cutoffs_stop_at_the_first_failure():
    grid = [0.5, 0.4, 0.3, 0.2]
    assert Q.certified(2000, [0, 0, 30, 0], grid, 0.005, 0.01) == 0.4
    assert Q.certified(50, [0, 0, 0, 0], grid, 0.005, 0.01) is None and Q.certified(0, [], grid, 0.1, 0.1) is None


def test_rules_keep_good_documents(spark):
    clean = " ".join(f"word{k}" for k in range(80))
    junk = " ".join(f"w{k}###$$$" for k in range(80))
    rows = [(k, clean + f" v{k}", "en", "s", 0) for k in range(4000)] + [(5000 + k, junk + f" v{k}", "en" if k % 2 else None, "s", 0) for k in range(40)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, FULL)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(4000)] + [(None, 1, 0), (5001, 1, 0), (5001, 0, 0)], "doc_id long, quality int, toxic int")
    figures = Q.figures(docs, "lang")
    out = Q.judged(figures, Q.cutoffs(figures, labels)).collect()
    kept = {r.doc_id: (r.base_failed, r.kept) for r in out}
    assert len(out) == len(rows) and all(kept[k] == (False, True) for k in range(4000)) and kept[None] == (True, False)
    # no labels for the null stratum: the rule is off there
    assert all(kept[5000 + k] == (False, k % 2 == 0) for k in range(40))
    plain = Q.judged(figures, Q.cutoffs(figures, labels.limit(0))).collect()
    assert all(r.kept != r.base_failed for r in plain)
    assert Q.judged(figures.limit(0), Q.cutoffs(figures.limit(0), labels)).collect() == []


def test_few_hundred_labels_certify_a_stratum(spark):
    clean = " ".join(f"word{k}" for k in range(80))
    junk = " ".join(f"w{k}###$$$" for k in range(80))
    langs = ["en", "fr", "de", "es"]
    rows = [(k, clean + f" v{k}", langs[k % 4] if k < 200 else "en", "s", 0) for k in range(400)] + [(1000 + k, junk, langs[k], "s", 0) for k in range(4)]
    docs = spark.createDataFrame(rows, FULL)
    figures = Q.figures(docs, "lang")
    cuts = Q.cutoffs(figures, spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int"))
    kept = {r.doc_id: r.kept for r in Q.judged(figures, cuts).collect()}
    # 250 good documents of en are enough, 50 of each other language are not
    assert all(kept[k] for k in range(400)) and [kept[1000 + k] for k in range(4)] == [False, True, True, True]
