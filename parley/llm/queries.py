"""The registered queries of the training-data operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, lm, ngram_join, pieces, secrets, suffix_dedup, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, d):
    return exact_dedup.exact_duplicates(table(spark, d, "documents"))


def op3_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, d, "labels")))


def op5_url_filter(spark, d):
    return url_filter.block_pages(table(spark, d, "pages"))


def op7_ngram_jaccard(spark, d):
    return ngram_join.similar_documents(table(spark, d, "documents"))


def op4_decontaminate(spark, d):
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op9_warc(spark, d):
    return warc.pages_from_records(warc.records(table(spark, d, "pages")))


def op6_suffix_dedup(spark, d):
    return suffix_dedup.repeated_passages(table(spark, d, "documents"))


def op10_secrets(spark, d):
    return secrets.scan(table(spark, d, "documents"))


def op2_sentencepiece(spark, d):
    return pieces.encode(table(spark, d, "documents"))


def op8_lm_score(spark, d):
    return lm.score(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_sentencepiece, op3_toxicity, op4_decontaminate, op5_url_filter, op6_suffix_dedup, op7_ngram_jaccard, op8_lm_score, op9_warc, op10_secrets)}
ORACLE_SQL = {"op1_exact_dedup": exact_dedup.SQL, "op5_url_filter": url_filter.SQL, "op7_ngram_jaccard": ngram_join.SQL, "op6_suffix_dedup": suffix_dedup.SQL, "op9_warc": warc.SQL}
