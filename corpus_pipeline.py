"""Corpus pipeline: quality rules, near-duplicates, decontamination, token ids.

Each stage takes the documents that the one before it kept and returns a
DataFrame; all but the last return the columns of ``documents``.  The caller
may write a stage's result as Parquet and read it back as the next one's input;
:func:`run` does so in the shared checkpoint folder.

Defined results of every stage: a null text is the empty text; rows are kept or
dropped whole, with all their columns, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covlattice.llm import bpe, decontaminate, quality, simhash
from covlattice.llm.common import remove_folder, shared_folder, table
from covlattice.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts are rejected, having too few words; equal rows share a verdict.
    """
    return quality.quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group.

    Texts without words are one group; a null id comes after all others; rows
    equal in id and text are one document and give one row.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item.

    Null and empty texts and items share none; equal rows go or stay together.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents kept, one row for each."""
    return bpe.encoding_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Merging by rank and fingerprint components are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between them are tables in the checkpoint folder.

    A stage's table is deleted when that of the next is written; the last one
    stays, since the result reads it.
    """
    folder, before = shared_folder(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
