"""The corpus pipeline: five stages, each a corpus operator, from ``documents`` to a mix of sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from eventry.llm import decontaminate, exact_dedup, language_id, mixing, simhash
from eventry.llm._shared import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# All stages: rows with null texts or ids, empty and very long texts and repeated rows are read whole; an empty table gives no rows; columns beyond
# those of documents are dropped, so none can clash.


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (10): documents without a recognised language go. So do null texts and texts without a letter; repeated rows are judged alike."""
    return language_id.keep_known(docs).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (4): of equal texts the document with the largest id stays (nulls are smallest; null and empty texts are equal; of repeated rows one stays)."""
    return exact_dedup.keep_one(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (8): of each group the document with the smallest id stays (nulls last, then by text hash; texts without words are one group)."""
    return simhash.keep_one(docs).select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (7): documents that hold an item's window go (null and empty texts hold none; repeated rows fare alike)."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (9): the words that the mix takes of each document; documents it takes nothing of go, as do those without words. Ties go by id and size."""
    found = mixing.mix_documents(spark, docs, sf_dir)
    return found.where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("decontaminate", clean_of_benchmark),
    ("mix_sources", mixture),
]

# Language ID is a trained model, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again.

    A stage's files are deleted when the next stage's are complete; those of the last hold the result.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="corpus-pipeline-")
    folder = f"{folder}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            _delete(spark, before)
        before = here
    return docs
