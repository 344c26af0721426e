"""The corpus pipeline: language ID, near copies, secrets, mixing, tokens; each stage is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import langid, mixing, secret_scan, sentencepieces, simhash
from sheafline.llm.common import held_out, written


def _row(docs: DataFrame):
    """All columns as one value, so that no name of theirs meets one of an operator's."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language (und: a null or empty text, or one without a letter); the others stay, ambiguous ones
    too.  A null lang is not learnt from; without any lang every text is und.  All columns pass through, whatever their names."""
    model = langid.fit(docs, where=~held_out())
    return langid.identify(docs.select(_row(docs), "text"), model).where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the smallest id, of each group of near copies.  Texts without a word, null ones too, are
    copies of each other; rows of that id all stay, and so do rows without an id."""
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by [SECRET]; n_chars follows the text, and both stay null where the text is.  All documents stay,
    and all other columns, whatever their names."""
    got = secret_scan.redact(docs.select(_row(docs), "text"))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return got.select(F.col("row").withField("text", F.col("text")).withField("n_chars", n_chars).alias("row")).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; the null source is one, and texts without a word stay once."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of every row; a null or empty text has no tokens."""
    return sentencepieces.encode(docs.select("doc_id", "source", "text"), sentencepieces.load()).select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Trained models and fingerprints have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
