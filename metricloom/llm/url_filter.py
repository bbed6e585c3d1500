"""URL filter: host and path rules first, logistic regression on hashed character n-grams for the rest.

The labelled table is small: urls the rules decide, each (host, path) once, in the order of a hash,
`sample` of each verdict at most (the documented bound of the training set). The model is fitted
and applied by Spark ML on the JVM; nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: (host, path prefix, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Labelled urls of each verdict that the model is fitted on.
SAMPLE = 2000
FEATURES = 1 << 14


def with_parts(pages: DataFrame) -> DataFrame:
    """Add host (A-Z lower-cased) and path; both are empty for a null url or one without `://`."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.translate(host, upper, lower), "path": path})


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add rule and ruled (allow or block; null where no rule fits). The longest rule that fits wins, the first of equals."""
    rule = ruled = None
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        name = F.lit(host + path)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        ruled = F.when(fits, F.lit(verdict)) if ruled is None else ruled.when(fits, F.lit(verdict))
    return urls.withColumns({"rule": rule if rule is not None else F.lit(None).cast("string"), "ruled": ruled if ruled is not None else F.lit(None).cast("string")})


def grams(sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of host and path, each marked by where it is from and padded with its ends."""
    def of(mark: str, name: str, n: int) -> Column:
        padded, last = F.concat(F.lit("^"), F.col(name), F.lit("$")), F.length(name) + 3 - n
        starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        return F.when(last >= 1, F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(padded, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(mark, name, n) for mark, name in (("h", "host"), ("p", "path")) for n in sizes))


def features(urls: DataFrame, size: int = FEATURES) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=size, binary=True).transform(urls.withColumn("grams", grams()))


def labelled(urls: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` distinct (host, path) of each verdict, by a hash of them."""
    once = urls.where("ruled is not null").select("host", "path", "ruled").distinct().withColumn("order", F.xxhash64("host", "path"))
    both = [once.where(F.col("ruled") == v).orderBy("order", "host", "path").limit(sample) for v in ("allow", "block")]
    return both[0].unionByName(both[1]).select("host", "path", (F.col("ruled") == "block").cast("double").alias("label"))


def fit(labelled: DataFrame, size: int = FEATURES) -> LogisticRegressionModel | None:
    """A model of block against allow; None unless both are there. One partition, so the fit is the same every time."""
    rows = features(labelled.coalesce(1), size).select("features", "label").cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        return LogisticRegression(regParam=0.01, maxIter=40, standardization=False).fit(rows)
    finally:
        rows.unpersist()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE, size: int = FEATURES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row.

    Defined results: a null url or one without `://` has an empty host and path and is judged by
    the model like any other; without labelled urls of both kinds the model allows all. A null
    page_id stays null, repeated rows are judged each, other columns are ignored.
    """
    urls = with_rules(with_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"))), rules)
    model = fit(labelled(urls, sample), size)
    if model is None:
        scored = urls.withColumn("block_score", F.lit(0.0))
    else:
        scored = model.transform(features(urls, size)).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
