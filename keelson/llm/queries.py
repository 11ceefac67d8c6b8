"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import clusters, decontaminate, html, language, minhash, packing, passages, pieces, prefix_trie, quality, suffixes, token_store, urls
from keelson.llm.catalog import QUERIES, SQL, query, table  # noqa: F401
from keelson.llm.staging import shared_path, staged


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the files are never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_token_store")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in a compressed store, read back: place, length and checksum."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    path = shared_path(spark, "token_store")
    token_store.build_store(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_store.read_store(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of every document, and cutoffs per language with bounded false rejections."""
    rows = staged(quality.figures(table(spark, sf_dir, "documents"), "lang"), "figures")
    cuts = staged(quality.cutoffs(rows, table(spark, sf_dir, "labels")), "cutoffs")
    return quality.judged(rows, cuts).drop("stratum")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the three quarters that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest fitting rule's, else the trees'."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.RULES)


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every document, and whether it decodes to the very text."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT links.u, reach.r FROM links JOIN reach ON links.v = reach.doc_id),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("op2_minhash_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: three-word shingles, Jaccard at least 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without 100-byte strings that occur earlier."""
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


@query("op8_passage_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat, exactly or nearly, one of an earlier document."""
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds, word for word or paraphrased."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op11_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The rounds one after the other, as one table expression each."""
    def nearest(at: int) -> str:
        return (f"a{at} AS MATERIALIZED (SELECT vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.q, m.c, list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.q[i] - m.q[i]) * (v.q[i] - m.q[i])))::BIGINT AS d "
                f"FROM v, m{at} m) GROUP BY 1, 2)")

    steps = []
    for r in range(rounds):
        steps += [nearest(r), f"m{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.q, m.q) AS q FROM m{r} m LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q "
                  f"FROM (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(q) AS x, unnest(range(1, {dim + 1})) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1) n ON n.c = m.c)"]
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q FROM v ORDER BY sha256('3:' || vec_id), q LIMIT {k}),
{', '.join(steps)}, {nearest(rounds)}
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN m{rounds} m ON m.c = a.c"""


@query("op11_centroid_clusters", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and exact distance of every vector after ten rounds from eight seeds."""
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


@query("op13_least_squares_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 ids, and its checksum."""
    pieces, _ = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return pieces.drop("part", "row")


OP12_SQL = """WITH b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM b)),
t AS (SELECT c.conv_id, 0 AS own, b.i, b.role, b.text FROM c JOIN b ON b.conv_id = c.conv_id - c.conv_id % 5 AND b.i <= c.h UNION ALL SELECT c.conv_id, 1, b.i, b.role, b.text FROM c JOIN b ON b.conv_id = c.conv_id AND b.i > c.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d, role, text FROM t),
p AS (SELECT conv_id, d, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS pre, strlen(text) AS bytes FROM r UNION ALL SELECT conv_id, 0, [], 0 FROM c),
e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT d, pre, min(conv_id) AS m, count(*) AS n, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS sha FROM e GROUP BY d, pre),
o AS (SELECT e.conv_id, e.d, n.m FROM e JOIN n ON n.d = e.d AND n.pre = e.pre),
k AS (SELECT n.d, n.m, n.n, n.bytes, n.sha, o.m AS parent FROM n LEFT JOIN o ON o.conv_id = n.m AND o.d = n.d - 1),
f AS (SELECT d - 1 AS d, parent AS m, count(*) AS children FROM k WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT o.d, o.m, sum((k.n - 1) * k.bytes)::BIGINT AS saved, sum((f.m IS NULL)::INT)::BIGINT AS leaves FROM k LEFT JOIN f ON f.d = k.d AND f.m = k.m JOIN o ON o.conv_id = k.m AND o.d <= k.d GROUP BY 1, 2)
SELECT k.m AS conv_id, k.d AS depth, k.parent AS parent_conv_id, k.n AS n_convs, coalesce(f.children, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, k.sha AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.m = k.m LEFT JOIN f ON f.d = k.d AND f.m = k.m"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations with the figures of its subtree."""
    lists = prefix_trie.with_shared_heads(prefix_trie.turn_lists(table(spark, sf_dir, "conversations")), group=5, most=9)
    return prefix_trie.prefix_nodes(prefix_trie.paths(lists))
