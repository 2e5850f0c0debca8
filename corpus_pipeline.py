"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, secrets are masked, sources are
mixed to their weights, and the texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampliq.llm import toxicity
from ampliq.llm.minhash import MinHashPlan, deduplicated
from ampliq.llm.mixing import mixed_documents
from ampliq.llm.queries import PIECES
from ampliq.llm.secrets import masked_documents
from ampliq.llm.sentencepiece_wfst import PieceModel, encode_texts
from ampliq.session import scratch_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on these documents and their labels, does not call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


#: Five words and a similarity of 0.8; a pair at 0.8 shares none of the 53 bands with probability 1e-7.
NEAR = MinHashPlan(percent=80, bands=53, rows=6)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return deduplicated(docs, NEAR)


def with_masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return masked_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture of their sources takes them."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their pieces and the text that the ids give back."""
    return encode_texts(docs, PieceModel.read(PIECES))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", with_masked_secrets),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The stages learn, hash and encode in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
