"""Corpus pipeline: documents in, packed sequences out.

Each stage calls one operator of ``helixlake.llm``, works on all that the one before kept, and has its result written as
Parquet and read again by the next. All stages but the last return the columns of ``documents``. Further columns of the
input don't matter; empty tables give empty ones; a document without doc_id goes through all stages as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import chunk_dedup, decontaminate, jaccard_join, language_id, packing
from helixlake.llm.common import discard, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null texts too) or without a clear language. The labels to learn from are those of
    the input that aren't null; if there are none, whatever has a letter stays. Repeated rows are judged alike."""
    return language_id.keep_identified(docs, language_id.train(language_id.training_docs(docs))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates, and one of repeated rows. Documents
    without doc_id or without text are kept."""
    return jaccard_join.keep_one(docs).select(COLUMNS)


def cut_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document of smaller doc_id holds as well; a document of which nothing is left goes, one that had
    no text stays. Rows that share an id, or have none, keep their texts."""
    return chunk_dedup.rewrite(docs).select(COLUMNS)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Null texts hold none; items without words aren't looked for."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the sequence and offset they take. A null text is one id; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_chunks),
    ("decontamination", decontaminate_documents),
    ("packing", pack_sequences),
]

#: The language model and the rolling hash are out of SQL's reach; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            if before is not None:  # nothing reads the copy before the last any more
                discard(before)
            before = docs
    return docs
