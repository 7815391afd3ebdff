"""The corpus pipeline: five training-data operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``docs``, extra ones included, whatever they are named.

Edge cases, stage by stage: a null text is empty everywhere. Toxicity judges row by
row; without labels of both kinds it keeps all. The join keeps one row of each class,
so repeated rows and empty texts leave one, but unlike texts of one id all stay.
Decontamination drops rows that hold an item, whatever the ids, null ones included;
without items it keeps all. The secret scan keeps every row. The mix answers row by
row. An empty table stays empty through all stages; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, mixing, secret_scan, similar_join, toxicity
from corpusloom.llm.store import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return similar_join.one_of_each(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each stretch that the scan found replaced by a mark; n_chars follows."""
    found = secret_scan.scan_all(docs, out="__secrets")
    masked = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("__secrets")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate of each document in the mix."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_similar),
    ("benchmark decontamination", drop_leaked),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs


#: Trained stages and iterative solutions are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None
