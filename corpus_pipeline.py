"""A training-data pipeline over ``documents``: quality, language, exact and
near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import common, exact_dedup, jaccard, langid, packing, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of at least 0.7).

    Null, empty and blank texts have score 0.5 and go; long texts are scored
    whole; equal texts, and so repeated rows, stay or go together; without
    labels of both kinds all rows have one score; other columns pass through,
    whatever their names; an empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, by a score that is learned from labelled ones.

    Texts without a letter (null and empty ones too) go; rows with a null
    ``lang`` or id are judged, not learned from; where no row has a ``lang``, none stays;
    long texts are read whole; equal texts stay or go together; other columns pass through;
    an empty table stays empty.
    """
    return langid.keep_known(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id.

    Null counts as empty; a null id is larger than all others; of rows with the
    same smallest id one stays, by the order of their texts and other columns;
    an empty table stays empty.
    """
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id.

    Texts without a word, null ones too, are no copies; rows without an id stay;
    rows that repeat an id stay or go together; an empty table stays empty.
    """
    return jaccard.keep_representatives(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens.

    Null counts as empty, so that a document has its end id alone; repeated rows
    are packed each; long texts are cut into windows; an empty table gives no
    rows; other columns aren't read. The table of chunks and what is encoded at once are smaller than the operator's own,
    since executors still hold the heap of earlier stages.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), max_chunks=300_000, at_once=1_000_000)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: A trained classifier and a tokenizer decide what stays: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
