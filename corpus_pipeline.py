"""A training-data pipeline over ``documents``: quality rules, line dedup, SimHash near-dedup, source mixing, packing.

Each stage works on all rows its predecessor kept; ``run`` writes each result as Parquet in the shared folder and
reads it again. ``ORACLE_SQL`` is None: tokenizer, SimHash and divergence have no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engrama.llm import linededup, mixing, packing, quality, simhash
from engrama.llm.common import materialize, read_table
from engrama.llm.queries import RATE, ROUNDS, SEED, TARGETS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the text; ``n_chars`` follows where there is one."""
    from pyspark.sql import functions as F

    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities."""
    return mixing.mix(docs, TARGETS, RATE, rounds=ROUNDS, seed=SEED)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, 2048)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
