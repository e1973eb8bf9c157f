"""From raw documents to packed training sequences: five stages, each one of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.llm import jaccard_join, language, packing, quality, secret_scan
from burdenframe.llm.common import table
from burdenframe.plans.workspace import stored, work_folder

MIN_LANGUAGE_SCORE = 0.5
#: Natural logarithms per character sequence below what is usual in the language: documents of a language learned are rarely below -1.
MIN_FIT = -2.0
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents; the rest lose the lines that failed, and ``n_chars`` follows.

    Null, empty and blank texts are rejected as too short. Texts may be of any length; repeated rows get the same verdict; other columns stay
    as they are; an empty table stays empty.
    """
    judged = quality.assess(docs).filter("quality.kept")
    changed = {"text": F.col("quality.clean_text"), "n_chars": F.char_length("quality.clean_text").cast("long")}
    return judged.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents at hand; drop those without letters, without a likely language, or unlike the one found.

    The probability only compares the languages learned and goes to 1 with a text's length, whatever it is written in; so a text is also
    dropped if its character sequences are much rarer than usual in the language found. Null and empty texts have no letters and go.
    Without a labelled row every document goes. Repeated rows fare alike; all columns stay, whatever their names; an empty table stays empty.
    """
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.predictor(spark, model)("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), found.alias("found"))
    sure = (F.col("found.lang") != language.UNKNOWN) & (F.col("found.score") >= MIN_LANGUAGE_SCORE) & (F.col("found.fit") >= MIN_FIT)
    return rows.filter(sure).select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents stays, as ``jaccard_join.representatives`` says, nulls, empty and repeated rows included."""
    return jaccard_join.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked, and ``n_chars`` follows where one was.

    Null and empty texts stay as they are; texts may be of any length; repeated rows share one scan and stay all; other columns stay as they
    are; an empty table stays empty.
    """
    found = secret_scan.attach(docs, work_folder(spark, "ledger"))
    clean = secret_scan.masked(F.col("doc.text"), F.col("findings"))
    hit = F.size("findings") > 0
    changed = {"text": clean, "n_chars": F.when(hit, F.char_length(clean).cast("long")).otherwise(F.col("doc.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens, each with its sequence and its place there, as ``packing.pack`` says: null and empty texts are one token,
    longer texts are cut, repeated rows are packed each, other columns are left out, an empty table gives an empty table."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: The last stage packs tokens and the second learns a model; SQL can't express either.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
