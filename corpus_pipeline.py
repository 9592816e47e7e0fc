"""A training corpus from raw documents: quality, near copies, personal data, mix, packing.

``run`` applies ``STAGES`` in order; each stage's result is written as Parquet to the
shared folder and read again as the documents of the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.llm import jaccard, mixing, packing, quality, sanitise
from tableweave.llm.copies import row_hash
from tableweave.llm.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels))


def first_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies (five words, similarity of 0.8 or more) leave one row of each group.

    It is one with the smallest doc_id, rows without a doc_id last. Rows are compared, told
    apart by a hash of all their columns: two texts under one doc_id are two documents, of
    equal rows one stays.
    """
    rows = docs.select(F.struct("*").alias("row"), row_hash(docs).alias("number"))
    keys = stored(rows.select("number", F.col("row.doc_id").alias("doc_id")).distinct())
    texts = rows.select("number", F.col("row.text").alias("text"))
    found = jaccard.similar_documents(texts, "number", words=5, percent=80).select("number", "component_id").distinct()
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")
    kept = found.join(keys, "number").groupBy("component_id").agg(F.min(first).alias("kept"))
    return rows.join(kept.select(F.col("kept.number").alias("number")), "number", "left_semi").dropDuplicates(["number"]).select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced; n_chars follows the text."""
    clean = sanitise.sanitised(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice comes twice."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's words in sequences of the permitted lengths."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", first_of_each_group),
    ("personal data", without_personal_data),
    ("mix of sources", mixed_by_weight),
    ("best-fit packing", packed),
]

#: The classifier and the mix have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
