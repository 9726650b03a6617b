"""Operator 4: URL filter by rules and gradient-boosted trees on lexical features.

A URL is judged by the longest rule that fits it, otherwise by boosted trees
trained on labelled URLs. The trees see no words: only lengths, depth, digit and
hyphen shares, character entropy, parameter counts, and statistics of the
address suffix gathered over all labelled URLs.

All expressions are DataFrame functions; the trees are Spark's own. Scoring adds
no shuffle but the lookup of the suffix statistics, whose few hot suffixes are
joined as skewed partitions. Training reads at most ``train_rows`` distinct labelled
URLs, an even share of each label, weighted by how many the label has.

Defined results: a null URL or one without ``://`` has an empty host and path
and is judged by the trees; repeated rows are judged alike; without labelled
URLs of both kinds nothing is blocked by the method; other columns stay.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import fresh, saved, shares

#: Labelled URLs used for training, at most.
TRAIN_ROWS = 20_000
#: Prior weight of the overall rate in a suffix's rate.
SMOOTHING = 20.0
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict); null if none fits.

    ``rules`` are (``host/path``, verdict). They are settings and part of the plan.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("double")


def _entropy(s: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars).cast("double")

    def term(total: Column, c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return total - p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), term)).otherwise(0.0)


def features(url: Column) -> dict[str, Column]:
    u, host, path = F.coalesce(url, F.lit("")), host_of(url), path_of(url)
    share = lambda s, pattern: _count(s, pattern) / F.greatest(F.length(s), F.lit(1))
    return {
        "url_length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"), "labels": _count(host, r"\."), "hyphens": _count(host, "-"),
        "url_digits": share(u, "[0-9]"), "host_digits": share(host, "[0-9]"), "host_vowels": share(host, "[aeiou]"),
        "parameters": F.when(F.contains(u, F.lit("?")), _count(u, "&") + 1).otherwise(0.0),
        "fragment": F.contains(u, F.lit("#")).cast("double"), "secure": F.startswith(u, F.lit("https://")).cast("double"),
        "host_entropy": _entropy(host), "url_entropy": _entropy(u),
    }


def suffix_of(url: Column) -> Column:
    """The last label of the host."""
    return F.substring_index(host_of(url), ".", -1)


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], url: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score.

    ``labelled``: (url, label), 1 for unwanted; a null label is left out.
    """
    lab = labelled.select(F.col("url"), F.col("label").cast("double").alias("label")).filter("url IS NOT NULL AND label IS NOT NULL")
    overall = lab.agg(F.avg("label").alias("rate"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    rate = overall.rate if overall.rate is not None else 0.0
    suffixes = saved(lab.groupBy(suffix_of(F.col("url")).alias("suffix"))
                     .agg(((F.sum("label") + SMOOTHING * rate) / (F.count("*") + SMOOTHING)).alias("suffix_rate"),
                          F.log(F.count("*") + F.lit(1.0)).alias("suffix_count")), "suffixes")
    names = [*features(F.col("url")), "suffix_rate", "suffix_count"]
    assembler = VectorAssembler(inputCols=["f_" + n for n in names], outputCol="f_vector")

    def with_features(df: DataFrame, address: str) -> DataFrame:
        df = df.withColumns({"f_" + n: c for n, c in features(F.col(address)).items()})
        df = df.withColumn("f_suffix", suffix_of(F.coalesce(F.col(address), F.lit(""))))
        known = suffixes.select(F.col("suffix").alias("f_suffix"), F.col("suffix_rate").alias("f_suffix_rate"), F.col("suffix_count").alias("f_suffix_count"))
        df = df.join(known, "f_suffix", "left").fillna({"f_suffix_rate": rate, "f_suffix_count": 0.0})
        return assembler.transform(df)

    made = fresh(pages, "f_score")
    out = pages.withColumn(fresh(pages, "f_url"), F.col(url))
    address = out.columns[-1]
    if overall.lo is None or overall.lo == overall.hi:
        scored = out.withColumn(made, F.lit(0.0))
    else:
        some, sizes = shares(lab, "label", "url", train_rows)
        train = saved(some.orderBy(F.xxhash64("url"), "label", "url").limit(max(train_rows, len(sizes))), "labelled")
        taken = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
        whole = sum(taken.values()) / sum(sizes.values())
        weight = F.create_map(*[F.lit(x) for one, n in taken.items() for x in (one, sizes[one] / n * whole)])[F.col("label")]
        model = GBTClassifier(featuresCol="f_vector", labelCol="label", weightCol="f_weight", maxIter=15, maxDepth=4, seed=7).fit(with_features(train, "url").withColumn("f_weight", weight))
        kept = [c for c in out.columns if c != address]
        model.setPredictionCol("f_predicted").setRawPredictionCol("f_raw").setProbabilityCol("f_probability")
        scored = model.transform(with_features(out, address)).select(*kept, address, vector_to_array("f_probability")[1].alias(made))
    rule = rule_of(host_of(F.col(address)), path_of(F.col(address)), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col(made) >= 0.5, "block").otherwise("allow"))
    result = {"host": host_of(F.col(address)), "path": path_of(F.col(address)), "rule": rule["rule"], "verdict": verdict, "score": F.col(made)}
    return scored.select(*[F.col(c) for c in pages.columns if c not in result], *[c.alias(n) for n, c in result.items()])
