"""A corpus from raw documents to packed sequences, in stages that Spark writes and rereads.

Every stage reads all rows its predecessor kept. The first four return the columns of
documents; the last returns the pieces of the packed sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.llm.common import read_table
from gaugelake.llm.decontaminate import drop_contaminated
from gaugelake.llm.ngram_join import keep_first
from gaugelake.llm.packing import pack
from gaugelake.llm.substring_dedup import remove_repeats
from gaugelake.llm.toxicity import drop_toxic
from gaugelake.session import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group that Jaccard links connect, one row of the document with the least doc_id."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words that an earlier document holds are cut; no document goes."""
    cut = remove_repeats(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark windows."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    pieces = pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        F.col("rest.doc_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "ids",
    )


STAGES = [
    ("toxicity", toxicity),
    ("ngram-jaccard-join", near_duplicates),
    ("substring-dedup", substring_dedup),
    ("benchmark-decontamination", decontamination),
    ("packing", packing),
]

#: Trained scores and token ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
