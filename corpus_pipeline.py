"""A training corpus from raw documents: each stage works on all that its predecessor kept.

Counted with the subpackage of training-data operators, on which it depends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import common, decontaminate, exact_dedup, ngram_join, pieces, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on the labelled ones doesn't find toxic.

    Rows with a null or empty text stay, as do all rows where there are no labels;
    repeated rows are decided alike; all columns are kept; no rows give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the least doc_id.

    Each row is settled by its own text, also where rows repeat a doc_id; rows with a
    null text or doc_id stay; empty texts equal each other; all columns are kept; no
    rows give none.
    """
    return exact_dedup.drop_duplicates(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the least doc_id.

    Each row is settled by its own text, also where rows repeat a doc_id; rows with a
    null or empty text or a null doc_id stay; all columns are kept; no rows give none.
    """
    return ngram_join.drop_similar(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, re-parameterised ones included.

    Each row is settled by its own text; rows with a null or empty text or a null
    doc_id stay; repeated rows are decided alike; all columns are kept; no rows, or
    no items, take none away.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, roundtrip, agrees) of all rows that are left.

    A null text has null ids, an empty one none; doc_id may be null; repeated rows are
    encoded alike; no rows give none.
    """
    return pieces.encode(docs)


STAGES = [("toxicity", _toxicity), ("exact_dedup", _exact), ("ngram_jaccard", _near), ("decontamination", _decontaminate), ("sentencepiece", _encode)]

#: A trained classifier and a subword encoder can't be stated in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's output is written to the shared folder and read again, and deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
