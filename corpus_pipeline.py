"""Training-data pipeline over ``documents``: five stages, each applying one operator of ``threadspark.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept;
all but the last return the columns of ``documents``. The label model, the disclosure counts and
the packing plan are fitted on the stage's own input, which plain SQL cannot express, so
there is no oracle: README says what each stage is tested against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadspark.llm import decontam, packing, pii, quality, simhash
from threadspark.llm.common import ship_code, table
from threadspark.llm.encoder import vocabulary_path
from threadspark.llm.queries import WORD_VOCABULARY
from threadspark.llm.tokencodes import scratch_path

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents the rules reject go."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each near-duplicate group stays."""
    ship_code(spark)
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents holding a benchmark item go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii_sanitising(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: personal data is replaced, revealing terms are generalised or removed."""
    ship_code(spark)
    return pii.sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the remaining documents packed into sequences of 2048 tokens."""
    ship_code(spark)
    return packing.pack_documents(docs, vocabulary_path(WORD_VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_sanitising", pii_sanitising),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
