"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import mixing, packing, pii, quality, simhash
from tidemark.llm.common import table
from tidemark.llm.queries import vocabulary
from tidemark.session import shared_folder, ship_package


def rest_of(docs: DataFrame, *names: str) -> list[str]:
    """The columns that a stage hands on as one struct, so that none can clash with its own."""
    return [name for name in docs.columns if name not in names]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    ship_package(spark)
    kept = docs.select("doc_id", "source", "lang", "text", F.struct(*rest_of(docs, "text")).alias("_rest"))
    judged = quality.classify(kept, table(spark, sf_dir, "labels")).where("keep")
    return judged.select(*[F.col(name) if name == "text" else F.col("_rest").getField(name).alias(name) for name in docs.columns])


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that give it away replaced by their kind."""
    kept = docs.select("text", F.struct(*rest_of(docs, "text", "n_chars")).alias("_rest"))
    clean = pii.sanitise(pii.find(kept))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*[made.get(name, F.col("_rest").getField(name)).alias(name) for name in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of every document as the mix takes, a row each."""
    kept = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_document"))
    copies = mixing.mix(kept, narrow=False).where("copies > 0").select("_document", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select("_document.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 2,048 tokens."""
    return packing.place(packing.pieces_of(docs, vocabulary("word_bpe_49k.json"), end_id=0))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", copies_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training, tokenizers and bit planes are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/tidemark/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
