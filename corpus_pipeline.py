"""The corpus pipeline: language ID, near-duplicate removal, repeated-substring removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Null and empty texts go at the first stage (no language); an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.llm import decontaminate, language_id, ngram_jaccard, packing, suffix_dedup
from crossgauge.llm.common import documents, fewer_files, stash

#: No stage but the joins can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model is fitted on a bounded sample of the labelled ones.

    Null and empty texts and those without a letter go, and all if no row has a language; ids, ties and repeated rows
    play no part.
    """
    return fewer_files(language_id.keep_identified(docs, language_id.fit(docs)), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the least id (null last), once; rows without words all stay."""
    return fewer_files(ngram_jaccard.one_of_each(docs), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur twice, repeated rows included; a document goes if no word is left or its text is null."""
    return fewer_files(suffix_dedup.without_repeats(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows share their fate."""
    return fewer_files(decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset; a null text is one end id."""
    return fewer_files(packing.pack_documents(docs), docs)


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard", one_of_each),
    ("suffix_dedup", without_repeats),
    ("decontaminate", uncontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
