"""From raw documents to packed training batches, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read
again; ``docs`` has the columns of ``documents``, in any order and with any
others beside them. All stages but the last carry them along; the last returns
the id, length, bucket and place of each row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventframe.llm.common import BATCH_ROWS, BATCH_SETTING, shared_dir, stored
from eventframe.llm.mixing import mixed_documents
from eventframe.llm.ngram_join import one_of_each
from eventframe.llm.packing import packed_documents
from eventframe.llm.quality_rules import quality_filter
from eventframe.llm.toxicity import toxicity_filter


def lean(spark: SparkSession) -> None:
    """Texts are long, and batches on their way to Python stand outside of the heap: few rows in each."""
    if not 0 < int(spark.conf.get(BATCH_SETTING, "10000")) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go."""
    lean(spark)
    return quality_filter(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of the labelled ones among them."""
    lean(spark)
    return toxicity_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket and batch of each row of the mix."""
    return packed_documents(docs)


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("ngram_join", near_duplicates), ("mixing", mix), ("packing", packing)]

#: Tokenisers, models and dynamic programming are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, folder, name)
    return docs
