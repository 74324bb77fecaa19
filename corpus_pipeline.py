"""From raw documents to packed sequences: the stages of the training-data pipeline, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knownat.llm import exact, nearcopies, packing, quality, toxicity
from knownat.llm.common import keep_predicted, stored, table
from knownat.llm.queries import BYTE_BPE, configured


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Null and empty texts hold no evidence and stay; repeated rows are judged alike; an empty table stays empty.  Columns that clash with
    the score's own names are handed on as they came.
    """
    configured(spark)
    found = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return keep_predicted(docs, lambda rows: toxicity.judged(rows, found, threshold=0.5), wanted=0)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more.

    Null and empty texts are scored as one empty chunk; repeated rows are judged alike; an empty table stays empty.  Columns that
    clash with the score's own names are handed on as they came.
    """
    configured(spark)
    network = quality.fit(docs, table(spark, sf_dir, "labels"))
    return keep_predicted(docs, lambda rows: quality.judged(rows, network, threshold=0.3), wanted=1)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts that are equal up to white space.

    Null counts as empty, null ids rank last, of repeated rows one stays, an empty table stays empty; all columns are handed on.
    """
    configured(spark)
    return exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies.

    Texts without words, null ones among them, are copies of nothing; rows with a null id stay; rows that repeat a kept id stay; an empty
    table stays empty; all columns are handed on.
    """
    configured(spark)
    return nearcopies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 tokens.

    Null and empty texts are their end token alone; repeated rows are packed each; an empty table gives no piece.
    """
    configured(spark)
    return packing.pack(docs, BYTE_BPE, capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Two stages learn a classifier and one runs a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
