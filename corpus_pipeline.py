"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import common, ngram_join, packing, quality, queries, substring, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-frequency rules, without boilerplate lines."""
    return quality.clean(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject."""
    chain = queries.toxicity_chain(spark, docs, sf_dir)
    mark = common.free_name(docs.columns, "rejected")
    scored = toxicity.score(docs, chain, prefix=common.free_name(docs.columns, "_p_"), verdict=mark)
    return scored.where(~scored[mark]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds."""
    return substring.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in training sequences."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json")).drop("loss_tokens")


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("n-gram join", near_duplicates),
          ("substring dedup", repeated_passages), ("packing", packed)]

#: Classifiers and near-duplicate components are not SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again; the
    tables that a stage stored on its way are removed then.  The caller removes
    the rest with ``common.release`` when it has written the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.settled(spark, lambda s=stage, d=docs: s(spark, d, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
