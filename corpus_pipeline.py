"""Training-corpus pipeline: five stages, each over all that the one before kept, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelsentry.llm.byte_bpe import bpe_encode
from panelsentry.llm.decontaminate import decontaminate
from panelsentry.llm.jaccard_join import keep_one_of_each
from panelsentry.llm.quality_classifier import keep_good
from panelsentry.llm.substring_dedup import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least row of each group that links connect, with or without an id: five-word shingles, a similarity of 0.8 or more."""
    return keep_one_of_each(docs, shingle=5, percent=80, unnamed=False)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of 35 words or more that start elsewhere too."""
    return substring_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return bpe_encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("encode", encode)]

#: SQL has no classifier and no tokenizer: the tests hold what run() makes of the documents that the classifier keeps against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Results of stages go to a new folder in the shared checkpoint folder."""
    from panelsentry.llm.components import shared_folder

    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the tokens of what the whole pipeline keeps."""
    return run(spark, sf_dir)
