"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import html_extract, langid, merkle, mixing, quality, secret_scan, sentencepieces, simhash, toxicity, warc
from sheafline.llm.common import held_out


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, where=~held_out())
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document."""
    got = simhash.simhash_classes(_documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")



def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and whether they decode to it again (a null text counts as empty)."""
    vocabulary = sentencepieces.load()
    got = sentencepieces.encode(_documents(spark, sf_dir).select("doc_id", "text"), vocabulary)
    got = sentencepieces.decode(got, vocabulary)
    return got.select("doc_id", "n_tokens", "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole document, base_failed, content_share and kept."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels, where=~held_out())
    got = quality.judge(docs, model)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs, where=~held_out())
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.mix(_documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written, normalised and read back."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text."""
    return merkle.fingerprint_pairs(_documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every whole document."""
    got = secret_scan.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    return got.select(
        "doc_id",
        *(secret_scan.counted(k, "base_spans").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.joined("base_spans").cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_sentencepiece, op4_quality, op5_language, op6_mixing, op7_warc, op8_merkle, op9_secrets, op10_html)}

WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS largest FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM g
"""

#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op6_mixing": mixing.MIX_SQL, "op7_warc": WARC_SQL}
