"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule is host and path (``com/fr/``) with a verdict; it fits its host and all subdomains where
the URL's path starts with its path, and the longest fitting rule wins. URLs that a rule
decides are the labelled ones: at most ``TRAIN_ROWS`` of them teach the trees. Features are
length, depth, digit ratio, entropy, parameter counts, separators and the smoothed log odds of
the host's last label, its last two labels and the path's first part, learned on the other half
of the sample. No feature names a rule.

Results: a null URL, or one without ``://``, has empty host and path and no rule; its verdict
is the trees'. Equal URLs have equal verdicts. Without labels of both kinds the trees' verdict
is the only one seen, or allow. Every row gives one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common
from gaugelake.llm import features as fx
from gaugelake.session import stage

TRAIN_ROWS = 20_000
SUFFIXES = 2_000
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$")


def host_and_path(url):
    """Columns host and path; both empty where there is no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url, _SPLIT, 2).alias("path")


def longest_rule(host, path, rules=RULES):
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, _, below = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{below}"))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffixes(url: str) -> tuple[str, str, str]:
    """Last label, last two labels and first path part, as keys of the statistics."""
    match = _PARTS.match(url)
    host, path = (match[1].lower(), match[2]) if match else ("", "")
    labels = host.split(".")
    return f"1 {labels[-1]}", f"2 {'.'.join(labels[-2:])}", f"/ {path[1:].split('/')[0]}"


def lexical(url: str) -> list[float]:
    match = _PARTS.match(url)
    host, path, tail = match.groups() if match else ("", "", "")
    n = max(len(url), 1)
    counts = Counter(url)
    return [
        len(url), len(host), len(path), host.count("."), path.count("/"), sum(c.isdigit() for c in url) / n,
        sum(c.isdigit() for c in path) / max(len(path), 1), -sum(k / n * math.log2(k / n) for k in counts.values()),
        tail.count("="), tail.count("&"), "#" in tail, url.count("-"), "-" in host, "." in path.rsplit("/", 1)[-1],
        max(map(len, re.split(r"[^A-Za-z]+", url))), path.endswith("/"), url.startswith("https:"),
    ]


def featurizer(odds: list[dict[str, float]]):
    """Features by (url, part): part 0 and 1 use the odds learned on the other half, 2 on all."""
    return lambda: lambda url, part: [float(x) for x in lexical(url)] + [odds[part[-1]].get(s, 0.0) for s in suffixes(url)]


def suffix_odds(sample: DataFrame) -> list[dict[str, float]]:
    """Smoothed log odds of blocking for the most frequent suffixes."""
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            counts: Counter = Counter()
            for url, label, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update((s, part, label) for s in suffixes(url))
            yield pa.RecordBatch.from_pylist(
                [{"suffix": s, "part": p, "label": y, "n": n} for (s, p, y), n in counts.items()],
                common.schema_of("suffix string, part int, label double, n long"),
            )

    rows = sample.select("url", "label", "part").mapInArrow(task, "suffix string, part int, label double, n long")
    sums = [F.sum(F.when((F.col("part") == p) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{p}{y}") for p in (0, 1) for y in (0, 1)]
    found = rows.groupBy("suffix").agg(F.sum("n").alias("n"), *sums).orderBy(F.desc("n"), "suffix").limit(SUFFIXES).collect()
    use = {0: (1,), 1: (0,), 2: (0, 1)}
    return [
        {r["suffix"]: math.log((sum(r[f"n{p}1"] for p in use[k]) + 1) / (sum(r[f"n{p}0"] for p in use[k]) + 1)) for r in found}
        for k in range(3)
    ]


def judged(pages: DataFrame, rules=RULES, most: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", url.alias("url"), host, path).withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    known = rows.where("found is not null").select("url", (F.col("found.verdict") == "block").cast("double").alias("label")).distinct()
    sample = known.orderBy(F.xxhash64("url"), "url").limit(most).withColumn("part", F.pmod(F.crc32("url"), F.lit(2)).cast("int"))
    sample = stage(sample.coalesce(1), "urls")
    n, block = sample.agg(F.count("*"), F.sum("label")).first()
    method = F.lit("block" if n and block == n else "allow")
    if n and 0 < block < n:
        odds = suffix_odds(sample)
        seen = fx.featured(sample.withColumn("text", F.col("url")), ["label", "part"], featurizer(odds), "part")
        seen = stage(seen.select("label", array_to_vector("features").alias("features")).coalesce(2), "url-features")
        trees = GBTClassifier(labelCol="label", maxIter=10, maxDepth=3, stepSize=0.3, seed=7, minInstancesPerNode=8).fit(seen)
        rows = fx.featured(rows.withColumn("text", F.col("url")).withColumn("part", F.lit(2)), ["page_id", "host", "path", "found", "part"], featurizer(odds), "part")
        rows = trees.transform(rows.withColumn("features", array_to_vector("features")))
        method = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"))


def op7_url_filters(spark, sf_dir) -> DataFrame:
    return judged(common.read_table(spark, sf_dir, "pages").select("page_id", "url"))
