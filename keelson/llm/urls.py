"""URL filter: rules by host and path, and boosted trees on lexical figures for the rest.

The trees learn from urls that a rule decides, on a sample of at most ``MAX_TRAIN`` of them
(those with the smallest hash, so the choice is reproducible); suffix statistics count all of
them.  Rules are a short list (at most ``MAX_RULES``) and become one CASE expression.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged
by the trees; without labelled urls every url is allowed, with labels of one kind only every
url gets that verdict; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.staging import staged

MAX_TRAIN = 20_000
MAX_RULES = 1_000
TREES, DEPTH, BINS, SEED = 16, 4, 32, 7
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SMOOTH = 20.0
FEATURES = ["n_chars", "host_chars", "path_chars", "host_labels", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "params", "query_chars", "has_fragment", "has_extension", "secure", "www", "suffix_block"]


def parts(urls: DataFrame) -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return urls.withColumns({"host": lower, "path": F.regexp_extract(tail, r"^[^?#]*", 0)})


def ruled(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and rule_verdict of the longest fitting (verdict, host, path) rule."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the figures of ``FEATURES`` but for those of the suffix, and the suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    letters = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    return rows.withColumns({
        "n_chars": F.length(url), "host_chars": F.length("host"), "path_chars": F.length("path"),
        "host_labels": F.size(F.split("host", r"\.")), "depth": count(F.col("path"), "/"),
        "digit_ratio": count(url, "[0-9]") / size, "host_digits": count(F.col("host"), "[0-9]"), "hyphens": count(F.col("host"), "-"),
        "entropy": entropy, "params": F.when(query == "", 0).otherwise(1 + count(query, "&")), "query_chars": F.length(query),
        "has_fragment": F.instr(url, "#") > 0, "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]+$"),
        "secure": F.lower(url).startswith("https"), "www": F.col("host").startswith("www."),
        "suffix": F.regexp_extract("host", r"[^.]*$", 0)})


def with_suffix(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Joins what labelled urls say of the suffix; the tables meet on the suffix, and the
    optimiser broadcasts the smaller one only if it is small."""
    out = rows.join(stats, "suffix", "left").withColumn("suffix_block", F.coalesce("suffix_block", F.lit(0.5)))
    return VectorAssembler(inputCols=FEATURES, outputCol="figures").transform(out.withColumns({c: F.col(c).cast("double") for c in FEATURES}))


def fit(labelled: DataFrame, *, max_train: int = MAX_TRAIN) -> tuple[GBTClassificationModel | str, DataFrame]:
    """Trees (or the only verdict there is) and the suffix statistics of labelled rows."""
    block = F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(block).alias("b")).first()
    n, blocked = total["n"], total["b"] or 0.0
    # both verdicts weigh the same in all
    weight = F.when(block == 1.0, n / (2 * max(blocked, 1.0))).otherwise(n / (2 * max(n - blocked, 1.0)))
    stats = labelled.groupBy("suffix").agg(F.sum(weight).alias("w"), F.sum(weight * block).alias("b")).select(
        "suffix", ((F.col("b") + SMOOTH / 2) / (F.col("w") + SMOOTH)).alias("suffix_block"))
    if blocked in (0.0, n):
        return ("block" if n and blocked else "allow"), stats
    sample = labelled.withColumns({"label": block, "weight": weight}).orderBy(F.xxhash64("url"), "url", "page_id").limit(max_train)
    data = with_suffix(sample, stats).select("figures", "label", "weight")
    if data.agg(F.countDistinct("label")).first()[0] < 2:
        return ("block" if 2 * blocked > n else "allow"), stats
    trees = GBTClassifier(featuresCol="figures", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=0.3, seed=SEED, minInstancesPerNode=5)
    return trees.fit(data), stats


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]], *, max_train: int = MAX_TRAIN) -> DataFrame:
    """page_id, host, path, rule, verdict of every url."""
    base = urls.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    rows = staged(lexical(ruled(parts(base), rules)), "urls")
    model, stats = fit(rows.filter("rule_verdict IS NOT NULL"), max_train=max_train)
    if isinstance(model, str):
        out = rows.withColumn("guess", F.lit(model))
    else:
        out = model.transform(with_suffix(rows, stats)).withColumn("guess", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "guess").alias("verdict"))
