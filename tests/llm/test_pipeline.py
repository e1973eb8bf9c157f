"""The registered queries of the text operators against DuckDB, and the pipeline stage by stage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from burdenframe.llm import packing
from burdenframe.llm.queries import ORACLE, QUERIES
from oracle import check, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    problem, n = check(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], ORACLE.get(name))
    assert problem is None, problem
    assert n > 0


CLEAN = "\n".join(" ".join(f"{w}{i}" for w in "the house of a river is on that hill".split()) + "." for i in range(12))
OTHER = CLEAN.replace("house", "garden").replace("river", "valley")


def test_stages(spark, documents, tmp_path):
    secret = CLEAN.replace("hill", "mountain").replace("river", "sea") + "\nThe password = abcdefgh1 is here."
    texts = [CLEAN, CLEAN, OTHER, secret, "too short.", None, "1 2 3. " * 60, CLEAN + "\nLicensed under the MIT License."]
    docs = documents(*texts).union(documents((2, OTHER), (None, OTHER.replace("garden", "castle").replace("valley", "lake").replace("hill", "rock"))))
    docs = docs.withColumns({"doc": F.lit(1), "findings": F.lit(2)})
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        path = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc", "findings"]
        kept.append(sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect()))
    assert kept == [[-1, 0, 1, 2, 2, 3, 7]] * 2 + [[-1, 0, 2, 3]] * 2
    rows = {r.doc_id: r for r in docs.collect()}
    assert "abcdefgh1" not in rows[3].text and "[secret]" in rows[3].text and rows[3].n_chars == len(rows[3].text)
    assert rows[0].text == CLEAN
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == {None, 0, 2, 3} and packed.agg(F.max("length")).first()[0] <= packing.CAPACITY


def test_rows_that_share_a_doc_id_keep_their_own_texts(spark, documents):
    third = CLEAN.replace("house", "castle").replace("hill", "rock").replace("river", "lake")
    near = CLEAN.replace("the0 ", "those0 ")
    rows = [(1, CLEAN), (5, OTHER), (5, near), (6, third), (6, OTHER), (7, third), (8, ""), (8, third), (8, None), (None, CLEAN), (None, "a b"), (None, "a b"), (9, "c d"), (9, "e f"), (9, "C D")]
    found = corpus_pipeline.ngram_jaccard_join(spark, documents(*rows), SF_DIR)
    kept = sorted(((r.doc_id or 0, (r.text or "").lower()) for r in found.collect()))
    assert kept == sorted([(1, CLEAN.lower()), (5, OTHER.lower()), (6, third.lower()), (8, ""), (0, "a b"), (9, "c d"), (9, "e f")])


def test_a_language_not_learned_goes(spark):
    rng = random.Random(4)
    words = {"en": "the of and with house tree water under every", "de": "der die und mit haus baum wasser unter jeder", "fi": "talo joki metsä aamu yö kylä hyvä pöytä äiti"}
    text = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    rows = [(i, text(lang, n), lang, "s", 0) for i, (lang, n) in enumerate([(lang, n) for lang in ("en", "de") for n in (3, 20, 400) for _ in range(20)])]
    rows += [(1000 + i, text("fi", n), None, "s", 0) for i, n in enumerate((20, 400, 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF_DIR).collect()}
    assert not kept & {1000, 1001, 1002} and len(kept) >= 118


def test_empty_tables_pass_every_stage(spark, documents):
    docs = documents()
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.collect() == []


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
