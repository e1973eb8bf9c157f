"""Registered queries of this package: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.llm import (
    html_text, jaccard_join, language, packing, pii, piece_codec, quality, record_files, secret_scan, spelling, token_alignment,
    topk_search, url_filter,
)
from burdenframe.llm.common import table
from burdenframe.llm.oracle import ORACLE
from burdenframe.plans.workspace import work_folder

__all__ = ["ORACLE", "QUERIES"]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars")
    return judged.select("doc.doc_id", *[f"quality.{f}" for f in fields])


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", *[c.alias(name) for name, c in span_digest(F.col("spans"), pii.BASE).items()])


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again: number and checksum of the ids, and whether the text came back."""
    coded = piece_codec.encode(table(spark, sf_dir, "documents"))
    back = coded.select("doc_id", "text", "ids", piece_codec.decoder()("ids").alias("decoded"))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    predict = language.predictor(spark, language.train(docs.filter(~F.col("held_out"))))
    found = docs.select("doc_id", "held_out", predict("text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def span_digest(spans: Column, base: tuple[str, ...]) -> dict[str, Column]:
    """Counts by base kind, the hash of the base spans, and all spans as text."""
    of_kind = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    own = F.filter(spans, lambda x: x["kind"].isin(*base))
    return {f"n_{kind}": of_kind(kind) for kind in base} | {
        "base_sha256": F.sha2(secret_scan.spans_text(own), 256), "spans": secret_scan.spans_text(spans)}


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.findings(docs, work_folder(spark, "ledger"), doc_id="doc_id")
    digest = span_digest(F.col("findings"), tuple(secret_scan.BASE_RULES))
    return found.select("doc_id", *[c.alias(name) for name, c in digest.items()], "blob")


def op11_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_files.round_trip(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_line_quality, op3_exact_top_k, op4_html_text, op5_url_filter, op6_personal_data,
        op7_piece_codec, op8_ngram_jaccard_join, op9_language_id, op10_secret_ledger, op11_record_files, op12_token_alignment,
        op13_spelling_variants,
    )
}
