"""A variant cohort derived from the star-schema tables.

Customers are samples, parts are variants and line items are calls; brand and type name the gene.
Frequencies fall on, between and beyond all bin boundaries, and some alleles are ``*`` or a third
allele, so every filter has rows to drop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.functions.genotype import variant_fraction
from burdenframe.operators import cohort, filters, genetable
from burdenframe.plans.workspace import stored

PHENOTYPE = "BUILDING"
SET_TYPES = ("ECONOMY", "SMALL")  # part types whose genes form the tested gene list

# Allele frequency by p_partkey % 8, boundaries of the bins included.
FREQUENCIES = (None, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05)
IMPACT_BY_SIZE = ("MODIFIER", "LOW", "MODERATE", "HIGH")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_side(df: DataFrame) -> DataFrame:
    """A table that grows with the cohort, for joins by sorting: its file is so much smaller than its rows that Spark would send it whole to every task."""
    return df.hint("merge")


def _choose(key, values):
    choice = None
    for i, v in enumerate(values):
        choice = F.when(key == i, F.lit(v)) if choice is None else choice.when(key == i, F.lit(v))
    return choice


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key % 22 + 1).cast("string").alias("contig"),
        key.cast("int").alias("pos"),
        F.when(key % 89 == 0, F.array(F.lit("A"), F.lit("T"), F.lit("G")))
        .when(key % 97 == 0, F.array(F.lit("A"), F.lit("*")))
        .otherwise(F.array(F.lit("A"), F.lit("T")))
        .alias("alleles"),
        F.concat_ws(".", "p_brand", "p_type").alias("gene"),
        _choose(F.col("p_size") % 4, IMPACT_BY_SIZE).alias("impact"),
        key.cast("int").alias("HGNC_ID"),
        _choose(key % 8, FREQUENCIES).cast("double").alias("MAX_AF"),
    )


def calls_of(items: DataFrame, spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """Calls with read depths, before annotation; columns of ``keep`` stay."""
    items = items.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", *keep)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    dp = (F.col("l_quantity") * 2).cast("int")
    ad1 = F.floor(dp * F.col("l_linenumber") / 7.0).cast("int")
    ac = F.col("l_linenumber") % 3
    called = items.join(sorted_side(orders), items["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("s"),
        F.col("l_partkey").cast("int").alias("pos"),
        _choose(ac, ("0/0", "0/1", "1/1")).alias("gt"),
        F.array(dp - ad1, ad1).alias("AD"),
        dp.alias("DP"),
        ac.alias("AC"),
        *keep,
    )
    return called.withColumn("VF", variant_fraction(F.col("AD"), F.col("DP")))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "lineitem"), spark, sf_dir)


def entries_of(items: DataFrame, spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    return calls_of(items, spark, sf_dir, keep).join(sorted_side(variants(spark, sf_dir)), "pos")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(table(spark, sf_dir, "lineitem"), spark, sf_dir)


def kept_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.burden_filters(entries(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("s"),
        F.concat(F.col("c_mktsegment"), F.lit(",N"), F.col("c_nationkey").cast("string")).alias("phenotype"),
        F.col("c_name").alias("mutation"),
    )


def labelled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(cohort.label_null_cohort(samples(spark, sf_dir), PHENOTYPE), "labels")


def label_entries(labelled: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_entries(spark, sf_dir).join(sorted_side(labelled.select("s", "is_case", "is_null_case")), "s")


def labelled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_entries(labelled_samples(spark, sf_dir), spark, sf_dir)


def gene_counts(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """Aligned wide counts of the four cohorts, stored."""
    labelled = labelled_samples(spark, sf_dir) if labelled is None else labelled
    return stored(genetable.four_cohort_wide(label_entries(labelled, spark, sf_dir)), "genes")


def gene_counts_long(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    return genetable.wide_to_long(gene_counts(spark, sf_dir, labelled), genetable.TESTED_BINS)


def listed_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tested gene list."""
    part = table(spark, sf_dir, "part").filter(F.col("p_type").isin(*SET_TYPES))
    return part.select(F.concat_ws(".", "p_brand", "p_type").alias("gene")).distinct()
