"""The queries of this subpackage and the SQL that some of them have.

op1 to op10 return the digests that their contracts name; the pipeline is in
corpus_pipeline.py at the top of the repository.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import bpe, cascade, cdc, dedup, langid, mixing, omh, pagediff, tokenfile, toxicity


def tokenizer_path() -> str:
    """The vocabulary file of the contracts, as the installed package has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), "ids_sha256", "decoded_sha256")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = omh.near_classes(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels"))).withColumnRenamed("reject", "toxic")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), langid.fit(table(spark, sf_dir, "documents")))


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.edits(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mixing, op2_bpe, op3_minhash, op4_url_filter, op5_toxicity, op6_language, op7_page_text, op8_token_files, op9_fingerprints, op10_exact_dedup)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op1_mixing": mixing.ORACLE, "op4_url_filter": cascade.ORACLE, "op10_exact_dedup": dedup.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
