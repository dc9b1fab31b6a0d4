"""One query per operator over its whole table, and the SQL twins that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.bytebpe import bpe_digest
from colsight.llm.decontaminate import contamination
from colsight.llm.divergence import DIVERGENCE_SQL, source_divergence
from colsight.llm.jaccard import jaccard_groups
from colsight.llm.licenses import LICENSES_SQL, license_scan
from colsight.llm.packing import pack
from colsight.llm.pages import extract_pages
from colsight.llm.phrases import PHRASES_SQL, collocations
from colsight.llm.pii import PII_SQL, pii_digest
from colsight.llm.quality import REJECT_BELOW, fit_quality, held_out, score_quality
from colsight.llm.secrets import SECRETS_SQL, secret_digest
from colsight.llm.vectors import near_vectors
from colsight.llm.wordpiece import count_pieces


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of whole documents and of single lines."""
    return license_scan(_read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document by a model of the labels that are not held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= REJECT_BELOW).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return count_pieces(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract_pages(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_groups(_read(spark, sf_dir, "documents"), words=4, percent=85)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all tokenised documents in sequences of 4096."""
    return pack(_read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii_digest(_read(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_digest(_read(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    found = contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "bench_items", "bench_retrieved", "bench_score")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again."""
    return bpe_digest(_read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set each source apart."""
    return source_divergence(_read(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most strongly bound phrases of each language."""
    return collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans, op2_quality_classifier, op3_token_counts, op4_html_extraction, op5_ngram_jaccard_join, op6_packing, op7_pii, op8_secret_scans,
        op9_embedding_near_dedup, op10_benchmark_decontamination, op11_byte_bpe,
        op12_source_divergence, op13_phrase_collocations,
    )
}
ORACLES: dict[str, str] = {"op1_license_scans": LICENSES_SQL, "op7_pii": PII_SQL, "op8_secret_scans": SECRETS_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_phrase_collocations": PHRASES_SQL}
