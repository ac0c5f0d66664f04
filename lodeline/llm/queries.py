"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from lodeline.llm import bottomk, decontam, html_text, importance, langid, mixing, periodic, quality, secret_scan, simhash, surrogates, toxicity, whitening
from lodeline.llm.sampling import in_training
from lodeline.session import table


#: The key of surrogates for the synthetic tables; a deployment sets spark.lodeline.surrogates.key to a secret of its own.
TEST_KEY = "synthetic tables"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.components(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, text, n_lines of every page."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced, and n_replaced."""
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("spark.lodeline.surrogates.key", TEST_KEY))


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept of every document."""
    return importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score", "letter_logp")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, base_failed and kept of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_crf")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the longest overlap of every document and benchmark item that overlap."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every document."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (~in_training()).alias("held_out"), "score", "predicted", "n_sentences", "offending")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in shuffled order."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return bottomk.groups(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact deviation of every whole vector and its whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs and the collapsed text of every document, of which every tenth by the hash of its id ends in a repeated tail."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents")
    return periodic.digest(periodic.find(docs.select("doc_id", periodic.repeated(F.col("text"), number).alias("text"))))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_text": op2_html_text,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_importance": op4_importance,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_bottom_k": op11_bottom_k,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op10_mixing": mixing.oracle()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
