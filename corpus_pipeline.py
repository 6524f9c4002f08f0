"""Corpus pipeline: quality, near-duplicates, benchmark passages, encoding.

Each stage takes what its predecessor kept and is written as Parquet before the
next one reads it, so a lost executor costs at most a part of one stage.

Defined cases: a null text is scored like an empty one, has no shingles (so no
near-duplicate), repeats no item and gets null ids and a null count; a null id
takes part like any other; of rows that repeat id and words one stays; an empty
table passes as an empty table. Columns beyond id and text go through all stages
unread, whatever their names; in the last one ``ids`` takes the place of the text
and ``n_tokens`` is added, columns of these names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import decontaminate, minhash, pieces, quality
from creditloom.llm.queries import GOOD, prepared, table, vocabulary_file
from creditloom.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled documents of the source table."""
    prepared(spark)
    network = quality.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, network, GOOD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    prepared(spark)
    return minhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontaminate.clean(docs, table(prepared(spark), sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids instead of texts."""
    prepared(spark)
    encoded = pieces.encode(docs, pieces.load_vocabulary(vocabulary_file("piece_bpe_32k.model")))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", piece_encoding),
]

# Learned scores, hashed signatures, alignments and segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepared(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
