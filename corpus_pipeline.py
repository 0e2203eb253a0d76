"""The corpus pipeline: documents in, packed training rows out.

Stages: the grade model rejects poor and toxic documents; line labelling rejects boilerplate; of each
group of near-duplicates one document stays; sources are mixed to their target weights (whole documents,
repeated as often as the mix takes them); conflict-constrained best-fit packing places the pieces. All but
the last return the columns of documents. A null in any column and an empty table pass through as each
operator's docstring defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenary.llm import conflict_pack, grade_model, line_crf, simhash_dedup, source_mix
from lumenary.llm.common import drop_shared, shared_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grade_model.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chain is fitted on rated documents as they came in, since those of poor quality are gone by now."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_crf.kept_documents(docs, labels, rated)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_unique(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return conflict_pack.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: The classifiers, fingerprints and packing are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_shared(spark, before)
        before = path
    return docs
