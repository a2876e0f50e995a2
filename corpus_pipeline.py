"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.

Defined results: null text counts as empty; such a document is scored like any
other, equals all empty texts, links with texts without words, holds no
benchmark item and is packed as the end id alone. Null ids rank behind all
others and stay null. Of repeated rows one stays. Very long texts are read
whole. Columns pass through all stages but the last, whatever their names.
Without labels of both classes every score is the labels' share of 1, and the
first stage keeps all documents or none. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relgrove.llm import decontaminate, exact_dedup, near_copies as near, packing, quality
from relgrove.llm.common import own_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 0.8 or more over five-word shingles), the row with the smallest doc_id."""
    return near.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packed),
]

#: SQL can express neither fingerprints, nor tiles, nor trees, nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for the table ``documents``; the stages' tables go to the folder that the cluster shares until the driver ends."""
    folder = own_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
