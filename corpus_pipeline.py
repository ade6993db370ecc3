"""A training-data pipeline over ``documents``: each stage works on all that the one before has kept.

Edge cases are those of the operators. Extra columns of any name pass through all stages but the last. Empty tables
pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.common import Scratch, unused
from pixelmill.llm.line_dups import dedup_lines
from pixelmill.llm.mixing import mixed_documents
from pixelmill.llm.near_dups import without_near_duplicates
from pixelmill.llm.packing import best_fit_packing
from pixelmill.llm.toxicity import drop_toxic

#: 25 bands of 4 miss a pair at 0.8 with probability 2e-6.
NEAR = {"percent": 80, "rows": 4}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate lines the first stays; all documents stay, if with an empty text, and n_chars follows."""
    (count,) = unused(docs, "n_dropped")
    out = dedup_lines(docs, count=count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the first by doc_id: word 5-shingles, similarity of 0.8 or more."""
    return without_near_duplicates(docs, **NEAR)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by source weights 5, 2, 1 in turn, at most twice each, 150 % of all words together."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: Scores, near-duplicate components and token ids have no SQL; tests/llm holds brute-force versions of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; the last is read as the result."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop_all_but(name)
    return docs
