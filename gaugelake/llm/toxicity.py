"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Learning reads at most ``TRAIN_ROWS`` labelled rows. Words and word beginnings that occur much
more often in toxic than in other texts of that sample make the lexicon, at most
``LEXICON_TERMS`` entries, each with the logarithm of its odds; a short list of common insults
is added with a fixed weight. Features are lexicon densities and weights, hits near words that
address somebody, capitals, punctuation, symbols, and words that hide letters behind digits or
signs. For rows of the sample the weights come from the other folds, so the trees see lexicon
scores as honest as those of unseen texts. Trees are fitted on three of five folds, the
isotonic curve on the scores of the rest.

Results: null or empty text has zero features and a score like any other. Every row gets a
score; equal texts have equal scores; a null doc_id is not held out. Without labels, or with
labels of one kind only, the score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common
from gaugelake.llm import features as fx
from gaugelake.session import stage

TRAIN_ROWS = 20_000
LEXICON_TERMS = 3_000
COUNTS_KEPT = 300_000
LEAST_DOCUMENTS = 4
LEAST_ODDS = 8.0
FOLDS = 5
CURVE_FOLD = 1
TREES = 12
THRESHOLD = 0.7

#: Common insults, and words that address somebody.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown "
    "imbecile fool jerk bastard filth vermin freak garbage ugly hate".split()
)
ADDRESS = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi vous ton ta votre tú ti usted vosotros su".split()
)
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TRIPLE = re.compile(r"(.)\1\1", re.DOTALL)
_LEET = str.maketrans("013457@$!|", "oieastasil")
_SIZES = range(3, 8)
_CLASSES, _MATRIX = fx.byte_classes(
    upper=bytes(range(65, 91)), lower=bytes(range(97, 123)), digit=b"0123456789", bang=b"!",
    ask=b"?", symbol=b"@#$%^&*<>|~_=+\\/", other=bytes(range(128, 256)), mark=b".,;:'\"-()",
)


def terms_of(word: str) -> list[str]:
    """A lower-case word and its beginnings, which end in a star."""
    return [word, *(word[:n] + "*" for n in _SIZES if len(word) > n)]


def weighed(word: str, weights: dict[str, float], heads: frozenset) -> float:
    """Largest weight of a lower-case word and its beginnings; ``heads`` are the starts of all terms with a star."""
    best = weights.get(word, 0.0)
    if word[: _SIZES[0]] in heads:
        for n in _SIZES:
            if len(word) <= n:
                break
            best = max(best, weights.get(word[:n] + "*", 0.0))
    return best


def lexicon(sample: DataFrame) -> list[dict[str, float]]:
    """Weights by term: one dictionary without each fold, and one over all."""
    schema = common.schema_of("term string, fold int, toxic long, other long")

    def flushed(counts):
        for fold, (toxic, other) in enumerate(counts):
            terms = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([fold] * len(terms), pa.int32()),
                 pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())], schema=schema,
            )
            toxic.clear()
            other.clear()

    def task(batches):
        counts = [(Counter(), Counter()) for _ in range(FOLDS)]
        for batch in batches:
            for text, label, fold in zip(*batch.columns, strict=True):
                words = set(_LETTERS.findall((text.as_py() or "").lower()))
                counts[fold.as_py()][label.as_py() < 0.5].update({t for w in words if len(w) <= 30 for t in terms_of(w)} | {""})
                # Sums follow, so counts may leave in parts.
                if sum(len(c) for pair in counts for c in pair) > COUNTS_KEPT:
                    yield from flushed(counts)
        yield from flushed(counts)

    # Toxic texts are few and clean ones many: count the clean only for terms of toxic ones.
    rows = sample.select("text", "label", "fold").mapInArrow(task, "term string, fold int, toxic long, other long")
    slots = [F.sum(F.when(F.col("fold") == f, F.col(k)).otherwise(0)).alias(f"{k}_{f}") for k in ("toxic", "other") for f in range(FOLDS)]
    sums = stage(rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), *slots)
                 .where(F.col("toxic") >= LEAST_DOCUMENTS), "terms")
    total = sums.where("term = ''").first()
    if total is None or not total.other:
        return [{} for _ in range(FOLDS + 1)]
    rate = (F.col("toxic") / total.toxic) / ((F.col("other") + 0.5) / total.other)
    # Half of the signed information a term holds about the label.
    gain = F.col("toxic") * F.log(rate)
    best = sums.where((F.col("term") != "") & (rate >= LEAST_ODDS)).orderBy(F.desc(gain), "term").limit(LEXICON_TERMS)
    out: list[dict[str, float]] = []
    found = best.collect()
    for f in range(FOLDS + 1):
        def part(row, kind, f=f):
            return row[kind] - (row[f"{kind}_{f}"] if f < FOLDS else 0)

        toxic, other = max(part(total, "toxic"), 1), max(part(total, "other"), 1)
        odds = {r.term: math.log((part(r, "toxic") + 0.1) / toxic) - math.log((part(r, "other") + 0.5) / other) for r in found}
        out.append({t: w for t, w in odds.items() if w > 1})
    return out


class Describer:
    """Features of a text; the fold's lexicon, or the one over all, weighs its words."""

    names = (
        "log_words", "hits", "hit_share", "weight_mean", "weight_best", "weight_second", "distinct", "insult_share",
        "near_address", "hidden_share", "hidden_hits", "caps_words", "mean_length", "long_runs", *_CLASSES,
    )

    def __init__(self, weights: list[dict[str, float]]):
        self.weights = weights
        # Few words begin like a term that ends in a star.
        heads = [frozenset(t[: _SIZES[0]] for t in x if t[-1:] == "*") for x in weights]
        self.tables = [fx.WordTable(lambda w, x=x, h=h: self.describe(w, x, h), 7, np.float32) for x, h in zip(weights, heads, strict=True)]

    def describe(self, word: str, weights: dict[str, float], heads: frozenset) -> tuple:
        """weight, insult, address, hidden, hidden hit, capitals, long run"""
        lower = word.lower()
        core = lower.strip(".,;:!?\"'()[]…«»¿¡“”")
        # Letters alone between signs are the word's only run of letters, and hide nothing.
        alone = core.isalpha()
        found = [core] if alone else _LETTERS.findall(lower)
        best = weighed(core, weights, heads) if alone else max([weighed(w, weights, heads) for w in found], default=0.0)
        hidden = not alone and bool(found) and bool(core) and not _PLAIN_WORD.fullmatch(core)
        hit = False
        if hidden:
            bare = "".join(_LETTERS.findall(core.translate(_LEET)))
            hit = bare in INSULTS or bare in weights or (bare[: _SIZES[0]] in heads and any(t in weights for t in terms_of(bare)))
        run = _TRIPLE.search(lower) is not None and any(
            a == b == c for a, b, c in zip(lower, lower[1:], lower[2:], strict=False) if a.isalpha())
        return (best, not INSULTS.isdisjoint(found), not ADDRESS.isdisjoint(found), hidden, hit,
                len(word) > 2 and word.isupper(), run)

    def __call__(self, text: str, extra: tuple) -> list[float]:
        table = self.tables[extra[-1]]
        raw = text.encode()
        words = text.split()
        share = histogram_shares(raw)
        if not words:
            return [0.0] * (len(self.names) - len(_CLASSES)) + share
        numbers = table.numbers(words)
        seen = table.values[numbers].astype(float)
        weight = seen[:, 0]
        hit = np.flatnonzero((weight > 0) | (seen[:, 1] > 0))
        address = np.cumsum(np.concatenate([[0], seen[:, 2]]))
        near = address[np.minimum(hit + 4, len(words))] - address[np.maximum(hit - 3, 0)] > 0
        best = np.sort(weight[hit])[::-1][:2].tolist() + [0.0, 0.0]
        table.trim()
        n = len(words)
        return [
            math.log1p(n), len(hit), len(hit) / n, weight.mean(), best[0], best[1], len(set(numbers[hit].tolist())),
            seen[:, 1].mean(), near.sum() / n, seen[:, 3].mean(), seen[:, 4].sum(), seen[:, 5].mean(),
            len(text) / n, seen[:, 6].mean(), *share,
        ]


def histogram_shares(raw: bytes) -> list[float]:
    return ((fx.histogram(raw) @ _MATRIX) / max(len(raw), 1)).tolist()


class Model:
    """Lexicon, trees and calibration curve; ``share`` stands in where there is nothing to learn."""

    def __init__(self, weights, trees=None, curve=None, share=0.0):
        self.weights, self.trees, self.curve, self.share = weights, trees, curve, share

    def score(self, texts: DataFrame, *keep: str) -> DataFrame:
        """Columns ``keep`` and score of every row of ``texts``, which needs a column text."""
        if self.trees is None:
            return texts.select(*keep, F.lit(float(self.share)).alias("score"))
        weights = self.weights
        rows = fx.featured(texts.withColumn("fold", F.lit(FOLDS)), [*keep, "fold"], lambda: Describer(weights), "fold")
        raw = raw_scores(self.trees, rows.select(*keep, array_to_vector("features").alias("features")))
        points = list(zip(self.curve.boundaries.toArray().tolist(), self.curve.predictions.toArray().tolist(), strict=True))
        return raw.select(*keep, interpolated("raw", points).alias("score"))


def raw_scores(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("raw", vector_to_array("rawPrediction")[1])


def interpolated(column: str, points: list[tuple[float, float]]):
    """The piecewise linear curve through ``points``, level outside."""
    x = F.col(column)
    cuts = F.array(*(F.lit(float(a)) for a, _ in points))
    values = F.array(*(F.lit(float(b)) for _, b in points))
    i = F.size(F.filter(cuts, lambda c: c <= x))
    low, high = F.element_at(cuts, F.greatest(i, F.lit(1))), F.element_at(cuts, F.least(i + 1, F.lit(len(points))))
    a, b = F.element_at(values, F.greatest(i, F.lit(1))), F.element_at(values, F.least(i + 1, F.lit(len(points))))
    return F.when((i < 1) | (i >= len(points)) | (high <= low), a).otherwise(a + (b - a) * (x - low) / (high - low))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most: int = TRAIN_ROWS) -> Model:
    sample = fx.labelled_sample(labels, "toxic", folds, held_out, most)
    texts = fx.sample_texts(docs, sample).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    texts = stage(texts.withColumn("fold", F.coalesce("fold", F.lit(0))), "toxic-sample")
    n, toxic = texts.agg(F.count("*"), F.sum("label")).first()
    if not n or toxic in (0, n):
        return Model([], share=(toxic or 0) / max(n, 1))
    weights = lexicon(texts)
    rows = fx.featured(texts, ["label", "fold"], lambda: Describer(weights), "fold")
    # A bounded sample of numbers: described by all tasks, then a few partitions hold it.
    rows = stage(rows.select("label", "fold", array_to_vector("features").alias("features")), "toxic-features").coalesce(2)
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=4, stepSize=0.3, seed=7, minInstancesPerNode=8)
    model = trees.fit(rows.where(F.col("fold") > CURVE_FOLD))
    held = raw_scores(model, rows.where(F.col("fold") <= CURVE_FOLD)).select("raw", "label")
    return Model(weights, model, IsotonicRegression(labelCol="label", featuresCol="raw").fit(held.coalesce(1)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, all columns, that score below ``threshold``; labels not held out teach the model."""
    found = train(docs, labels).score(fx.plain(docs), "text", "rest")
    return found.where(F.col("score") < threshold).select(*common.unkeyed(docs))


def op9_toxicity(spark, sf_dir) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.read_table(spark, sf_dir, "labels"))
    found = model.score(fx.plain(docs), "rest")
    return found.select(
        F.col("rest.doc_id").alias("doc_id"), fx.held_out("rest.doc_id", 3, 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
