"""Dense features of whole texts, and bounded samples of labelled rows to learn from.

Words are looked up in a table that each worker fills as it meets them, so what is known of a
word is found once and a text costs a few vector operations.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common
from gaugelake.session import stage

WORDS_KEPT = 400_000


class WordTable(dict):
    """Number of a word, with one row of properties per word found by ``describe``."""

    def __init__(self, describe: Callable[[str], tuple], width: int, dtype: type = np.float64):
        self.describe = describe
        self.values = np.zeros((1 << 12, width), dtype)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[n] = self.describe(word)
        self[word] = n
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def trim(self) -> None:
        if len(self) > WORDS_KEPT:
            self.clear()


def byte_classes(**classes: bytes) -> tuple[list[str], np.ndarray]:
    """A 256 x n matrix that turns a histogram of bytes into class counts."""
    out = np.zeros((256, len(classes)))
    for i, members in enumerate(classes.values()):
        out[list(members), i] = 1
    return list(classes), out


def histogram(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def featured(texts: DataFrame, keep: list[str], make: Callable[[], Callable], by: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``features`` (array of double) of every row.

    ``make`` gives a worker its function from (text, (value of the kept column ``by``,)) to
    numbers. Null text is empty. Kept columns pass as they are; a kept text travels once.
    """
    others = [c for c in keep if c != "text"]
    names = ["text", *others] if "text" in keep else others
    fields = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)

    def task(batches):
        of = make()
        for batch in batches:
            extra = zip(batch.column(1 + others.index(by)).to_pylist()) if by else repeat(())
            rows = [of(t.as_py() or "", x) for t, x in zip(batch.column(0), extra, strict=False)]
            kept = batch.columns if "text" in keep else batch.columns[1:]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(rows, pa.list_(pa.float64()))], names=[*names, "features"]
            )

    read = F.col("text").alias("read")
    return texts.select(read, *others).mapInArrow(task, f"{fields}, features array<double>")


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """At most ``most`` rows of ``labelled``, the same ones whatever the layout.

    The bound makes it small enough to broadcast; it holds 16 bytes a row.
    """
    rows = labelled(labels, label, folds, held_out)
    return stage(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).coalesce(1), "labelled")


def labelled(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """Every row (doc_id, label) to learn from.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_out`` never take part. Of a
    doc_id labelled more than once the largest label counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    return rows.where(fold_of("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))


def fold_of(column: str, folds: int):
    return F.crc32(F.col(column).cast("string")) % folds


def held_out(column: str, folds: int, remainder: int):
    return F.coalesce(fold_of(column, folds) == remainder, F.lit(False))


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, label and text of the sampled documents, one row for a doc_id: its text of least hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("one")
    return found.groupBy("doc_id", "label").agg(one).select("doc_id", "label", F.col("one.text").alias("text"))


def plain(docs: DataFrame) -> DataFrame:
    return common.keyed(docs).select("text", "rest")
