"""From raw documents to packed training sequences: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Between stages docs is written as Parquet and read again, so a lost executor repeats a stage's
tasks at most. ORACLE_SQL is None: a boosted model and tokenisers can't be put in SQL; tests/llm/test_pipeline.py holds
the result against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved
from ledgerloom.llm.contamination import decontaminate
from ledgerloom.llm.minhash import drop_near_duplicates
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality import keep_good
from ledgerloom.llm.substrings import remove_repeats

#: Documents that score less are rejected.
LEAST_QUALITY = 0.5
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: A passage of so many words that an earlier document has is cut.
REPEAT_WORDS = 25
BENCHMARK_WORDS = 10


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it is there, as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT).select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(remove_repeats(docs, REPEAT_WORDS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), BENCHMARK_WORDS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, "byte_bpe_50k.json", end_id=0, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *inner, (_, last) = STAGES
    for _, stage in inner:
        docs = saved(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
