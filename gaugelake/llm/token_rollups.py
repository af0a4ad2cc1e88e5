"""Token counts: additive totals by source, language and tokenizer version, kept by deltas.

A batch of changes holds signed rows: +1 for an insert, -1 for a delete, and for a revised
count the old row with -1 and the new one with +1. A batch is summed by key (partial sums
first, so a key that holds a third of all rows is no hot task) and written to a folder named by
its id; Spark's success mark commits it. Applying a committed id again changes nothing, and an
attempt that failed before its mark is overwritten by the next, so a job that is repeated after
losing executors or the driver counts once. Totals are the sums over committed batches.
``compact`` folds them into one, so totals stay cheap to read.

Results: null source, language or version is a key of its own; null counts are zero. Keys whose
documents and tokens are both zero are left out. An empty batch commits and changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.llm import common
from gaugelake.session import new_folder, stage

KEYS = ("source", "lang", "tokenizer_version")
_DELTA = "source string, lang string, tokenizer_version string, documents long, tokens long"


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows (keys and tokens) as changes."""
    return rows.select(*(F.col(k).cast("string").alias(k) for k in KEYS), F.col("tokens").cast("long").alias("tokens"), F.lit(sign).alias("sign"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals below ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]
        return sorted(n for n in found if self._fs.exists(self._at(folder, n, "_SUCCESS")))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest folded state and the batches in it."""
        bases = self._names("base")
        if not bases:
            return None, set()
        names = self.spark.read.schema("name string").parquet(f"{self.path}/base/{bases[-1]}/batches")
        return bases[-1], {r["name"] for r in names.collect()}

    def committed(self) -> set[str]:
        return set(self._names("batch")) | self._base()[1]

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; false if it already was."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.committed():
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        sums.where("documents <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/batch/{batch}")
        return True

    def totals(self) -> DataFrame:
        base, folded = self._base()
        paths = [f"{self.path}/batch/{b}" for b in self._names("batch") if b not in folded]
        if base:
            paths.append(f"{self.path}/base/{base}/totals")
        if not paths:
            return self.spark.createDataFrame([], _DELTA)
        sums = self.spark.read.schema(_DELTA).parquet(*paths).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold the committed batches into one state; the mark of its folder makes it count."""
        names, totals = sorted(self.committed()), self.totals()
        target = f"{len(self._names('base')):08d}"
        rows = self.spark.createDataFrame([(n,) for n in names], "name string")
        totals.write.mode("overwrite").parquet(f"{self.path}/base/{target}/totals")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base/{target}/batches")
        self._fs.create(self._at("base", target, "_SUCCESS"), True).close()


#: Two versions of counting: words between white space, and runs of ASCII letters, digits and
#: all other characters.
WORDS_1 = r"[^\x20\x09-\x0D]+"
WORDS_2 = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def op8_token_rollups(spark, sf_dir) -> DataFrame:
    """Insert all documents under the first version, delete exact copies of earlier documents,
    move those that the second version counts otherwise to it, and apply the deletion again."""
    text = F.coalesce("text", F.lit(""))
    docs = common.read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.md5(text).alias("digest"),
        F.regexp_count(text, F.lit(WORDS_1)).alias("first"), F.regexp_count(text, F.lit(WORDS_2)).alias("second"))
    docs = stage(docs, "counts")
    least = docs.groupBy("digest").agg(F.min("doc_id").alias("least"))
    docs = stage(docs.join(least, "digest"), "copies")
    by = lambda rows, column, version: rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.col(column).alias("tokens"))
    copies, moved = docs.where("doc_id <> least"), docs.where("doc_id = least and first <> second")
    rollup = Rollup(spark, new_folder(spark, "rollup"))
    rollup.apply("insert", signed(by(docs, "first", "words-1"), 1))
    rollup.apply("delete-copies", signed(by(copies, "first", "words-1"), -1))
    rollup.compact()
    rollup.apply("recount", revised(by(moved, "first", "words-1"), by(moved, "second", "words-2")))
    rollup.apply("delete-copies", signed(by(copies, "first", "words-1"), -1))
    return rollup.totals()


OP8_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n1,
         len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS n2,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), kept AS (
  SELECT source, lang, CASE WHEN n1 <> n2 THEN 'words-2' ELSE 'words-1' END AS tokenizer_version,
         CASE WHEN n1 <> n2 THEN n2 ELSE n1 END AS n
  FROM counted WHERE doc_id = least
)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS tokens
FROM kept GROUP BY ALL
"""
