"""Registered queries against DuckDB; ``BURDENFRAME_ORACLE=all`` runs every one of them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from burdenframe.plans.catalog.burden_queries import ingest_in_batches
from oracle import check, connect

SF_DIR = "/root/testdata/sf0.001"
SHORT = (
    "S01 S03 S06 P02 P13 P16 P24 J01 J03 J06 J12 A01 A02 A03 A05 A08 A10_resampling_listed A13 W01 W02 W03c T02 T04 ST1 U02"
).split()
NAMES = [n for n in queries() if os.environ.get("BURDENFRAME_ORACLE") == "all" or n.startswith(tuple(SHORT))]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem, _ = check(spark, con, SF_DIR, name, queries()[name], oracle_sql().get(name))
    assert problem is None, problem


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_query_but_text_operators_has_sql():
    assert [q for q in set(queries()) - set(oracle_sql()) if not q.startswith(("op", "pipeline"))] == []


@pytest.mark.parametrize("name", ["S02_resolve_inputs_files", "S10_relatedness_sink_all"])
def test_whole_cohort(spark, con, name):
    problem, _ = check(spark, con, SF_DIR, name, queries()[name], oracle_sql()[name])
    assert problem is None, problem


def test_relatedness_of_customers_not_pools(spark):
    pairs = queries()["S10_relatedness_sink_all"](spark, SF_DIR)
    assert pairs.count() > 300 and pairs.filter("s_i LIKE 'N%'").isEmpty()


def test_ingest_runs_over_batches_and_a_redelivery(spark):
    store = spark.read.parquet(ingest_in_batches(spark, SF_DIR))
    assert store.select("file").distinct().count() == 16 and store.select("batch_id").distinct().count() == 5
    again = {r.file for r in store.groupBy("file").agg(F.countDistinct("batch_id").alias("n")).filter("n = 2").collect()}
    assert again == {"file=0", "file=4", "file=8", "file=12"}
