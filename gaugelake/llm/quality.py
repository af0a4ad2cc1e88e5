"""Quality classifier: Bradley-Terry pairwise ranking of documents.

Every labelled row outside the held-out fold teaches it. Low-quality texts are set against good
ones in the order of a hash, ``PAIRS_EACH`` pairs for every labelled row, so that every row is in
a pair, and a logistic loss on the differences of their features gives one weight per feature:
the strength of a document is the weighted sum. Features are made once, for learning and scores. Features are shares of character classes, word and line statistics and measures
of repetition, each as it is and as its quantile bin among labelled rows, so strength need not be
linear in them. The threshold is a quantile of the labelled rows' strengths, the share of low labels;
it is mapped to a score of 0.3.

Results: null or empty text has zero features and a score like any other. Every row gets a
score; equal texts have equal scores; a null doc_id is not held out. Without labels of both
kinds every score is the share of good labels (0 without any).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.llm import common
from gaugelake.llm import features as fx
from gaugelake.session import stage

PAIRS_EACH = 2
THRESHOLD = 0.3
_BINS = 10
_CLASSES, _MATRIX = fx.byte_classes(
    upper=bytes(range(65, 91)), lower=bytes(range(97, 123)), digit=b"0123456789", bang=b"!", ask=b"?",
    bar=b"|", symbol=b"@#$%^&*<>~_=+\\/", other=bytes(range(128, 256)), stop=b".", comma=b",;:",
    quote=b"'\"-()[]", space=b" \t", line=b"\n",
)
NAMES = (
    *_CLASSES, "log_words", "mean_length", "short_words", "long_words", "caps_words", "title_words", "odd_words",
    "ended_words", "distinct_words", "top_word", "distinct_pairs", "log_lines", "repeated_lines", "line_words", "per_stop",
)


def describe(word: str) -> tuple:
    core = word.strip(".,;:!?\"'()")
    return len(word), len(word) <= 3, len(word) > 14, len(word) > 1 and word.isupper(), word[:1].isupper(), not core.isalpha(), word[-1] in ".!?"


def make():
    table = fx.WordTable(describe, 7)

    def of(text: str, _=()) -> list[float]:
        raw = text.encode()
        counts = fx.histogram(raw) @ _MATRIX
        share = (counts / max(len(raw), 1)).tolist()
        words = text.split()
        if not words:
            return share + [0.0] * (len(NAMES) - len(share))
        table.trim()
        numbers = table.numbers(words)
        seen = table.values[numbers].mean(axis=0).tolist()
        ranked = np.sort(numbers)
        heads = np.flatnonzero(np.diff(ranked, prepend=-1))
        pairs = np.sort(numbers[:-1] << 32 | numbers[1:])
        lines = [x for x in text.split("\n") if x.strip()]
        n = len(words)
        return share + [
            math.log1p(n), *seen, len(heads) / n, int(np.diff(heads, append=n).max()) / n,
            (1 + np.count_nonzero(np.diff(pairs))) / max(n - 1, 1), math.log1p(len(lines)),
            1 - len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)), math.log1p(n / (1 + counts[8])),
        ]

    return of


def expand(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Every feature as it is, and a mark for its bin."""
    parts = [rows]
    for i, edges in enumerate(cuts):
        parts.append(np.eye(len(edges) + 1)[np.searchsorted(edges, rows[:, i], "left")])
    return np.concatenate(parts, axis=1)


class Model:
    """Feature cuts and weights; ``share`` stands in where there is nothing to learn."""

    def __init__(self, cuts=None, weights=None, cut=0.0, share=0.0):
        self.cuts, self.weights, self.cut, self.share = cuts, weights, cut, share

    def strengths(self, found: DataFrame, *keep: str) -> DataFrame:
        """Columns ``keep`` and strength of every row of ``found``, which has ``features``."""
        cuts, weights = self.cuts, self.weights
        fields = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in keep)

        def task(batches):
            for batch in batches:
                strength = expand(matrix(batch.column(0)), cuts) @ weights
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(strength, pa.float64())], names=[*keep, "strength"])

        return found.select("features", *keep).mapInArrow(task, f"{fields}, strength double")

    def score_features(self, found: DataFrame, *keep: str) -> DataFrame:
        if self.weights is None:
            return found.select(*keep, F.lit(float(self.share)).alias("score"))
        at = math.log(THRESHOLD / (1 - THRESHOLD)) - self.cut
        return self.strengths(found, *keep).select(*keep, (1 / (1 + F.exp(-(F.col("strength") + at)))).alias("score"))

    def score(self, texts: DataFrame, *keep: str) -> DataFrame:
        """Columns ``keep`` and score of every row of ``texts``, which needs a column text."""
        return self.score_features(fx.featured(texts, list(keep), make), *keep)


def matrix(column: pa.Array) -> np.ndarray:
    """One row of features for every list of a column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES)))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``at``, from 0 within each label in the order of a hash; no task sees more than its range."""
    order = ["label", F.xxhash64("doc_id"), "text_key"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "quality-order")
    # One row for a range and label.
    counts = ranged.groupBy("label", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("part")) - F.col("n")
    counts = counts.select("label", "part", "first", before.alias("before"))
    return ranged.join(F.broadcast(counts), ["label", "part"]).select(*rows.columns, (F.col("row") - F.col("first") + F.col("before")).alias("at"))


def pairs_of(rows: DataFrame, low: int, good: int, most: int, cuts: list[np.ndarray] | None = None) -> DataFrame:
    """Feature differences of pairs, label 1 where the first is the better; half are turned round.

    Every bad text meets equally many good ones; from as many pairs as there are good texts on,
    each of those is met too. With ``cuts`` features are expanded before they are compared.
    """
    placed = numbered(rows)
    each = max(1, min(good, most // low))
    worse = placed.where("label = 0").select(F.col("at").alias("low"), F.col("features").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("turn"))
    # The bad texts go through the good ones in turn: no pair twice.
    worse = worse.withColumn("at", F.pmod(F.col("low") * each + F.col("turn"), F.lit(good).cast("long")))
    better = placed.where("label = 1").select("at", F.col("features").alias("y"))
    sign = F.when(F.pmod(F.col("low") + F.col("turn"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    pairs = worse.join(better, "at").select("y", "x", sign.alias("sign"))
    if cuts is None:
        pairs = pairs.select(F.zip_with("y", "x", lambda y, x: (y - x) * F.col("sign")).alias("features"), "sign")
    else:
        pairs = pairs.mapInArrow(_differences(cuts), "features array<double>, sign double")
    return pairs.select(array_to_vector("features").alias("features"), ((F.col("sign") + 1) / 2).alias("label"))


def _differences(cuts: list[np.ndarray]):
    def task(batches):
        for batch in batches:
            for part in (batch.slice(i, 1_000) for i in range(0, batch.num_rows, 1_000)):
                sign = part.column(2).to_numpy(zero_copy_only=False)
                apart = (expand(matrix(part.column(0)), cuts) - expand(matrix(part.column(1)), cuts)) * sign[:, None]
                starts = pa.array(np.arange(len(sign) + 1, dtype=np.int32) * apart.shape[1])
                lists = pa.ListArray.from_arrays(starts, pa.array(apart.ravel()))
                yield pa.RecordBatch.from_arrays([lists, part.column(2)], names=["features", "sign"])

    return task


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text_key, ``keep`` and features of every row, written once to learn from and to score."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"),
        F.col("text").cast("string").alias("text"), *keep,
    )
    return stage(fx.featured(texts, ["doc_id", "text_key", *keep], make), "quality-features")


def learn(found: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Model:
    """A model from every labelled row outside the held-out fold; ``found`` is of ``described``."""
    marks = fx.labelled(labels, "quality", folds, held_out)
    # Of a doc_id the text of least hash counts; minima combine before rows move.
    one = found.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text_key", "features")).alias("one"))
    rows = stage(one.join(marks, "doc_id").select("doc_id", "one.text_key", "label", "one.features"), "quality-labelled")
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    low, good = int(n - (good or 0)), int(good or 0)
    if not low or not good:
        return Model(share=good / max(n, 1))
    columns = rows.select(*(F.col("features")[i].alias(c) for i, c in enumerate(NAMES)))
    steps = [i / _BINS for i in range(1, _BINS)]
    cuts = [np.unique(q) for q in columns.approxQuantile(list(NAMES), steps, 0.002)]
    compared = pairs_of(rows, low, good, PAIRS_EACH * n, cuts)
    fit = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=40).fit(compared)
    model = Model(cuts, fit.coefficients.toArray())
    model.cut = model.strengths(rows, "label").approxQuantile("strength", [low / n], 0.0005)[0]
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Model:
    return learn(described(docs), labels, folds, held_out)


def op3_quality(spark, sf_dir) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select(F.col("doc_id").alias("own_id"), "doc_id", "text")
    found = described(docs, "own_id")
    scored = learn(found, common.read_table(spark, sf_dir, "labels")).score_features(found, "own_id")
    return scored.select(
        F.col("own_id").alias("doc_id"), fx.held_out("own_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
