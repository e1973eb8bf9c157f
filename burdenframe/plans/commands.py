"""The commands a user runs, as functions over a session and paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.operators import burden, cohort, filters, genotypes, kinship
from burdenframe.plans.workspace import stored
from burdenframe.sources import inventory as inv
from burdenframe.sources import metadata as meta
from burdenframe.sources import tables, vcf


@dataclass(frozen=True)
class Cohort:
    """Filtered entries with their case labels."""

    entries: DataFrame
    phenotype: str | None

    def frequency_tables(self) -> dict[str, DataFrame]:
        """Wide gene table per cohort; without a phenotype there is one cohort.

        Both cohorts come from one pass over the entries, whose small result is stored.
        """
        if self.phenotype is None:
            return {"all": burden.frequency_table(self.entries)}
        both = stored(burden.frequency_table(self.entries, ["cohort"]), "frequency")
        return {c: both.filter(F.col("cohort") == c).drop("cohort") for c in ("positive", "negative")}

    def counts(self) -> DataFrame:
        """Case and control counts side by side per gene."""
        return burden.case_control_counts(
            burden.to_long(burden.burden_by_impact(self.entries, ["is_case"]), ["is_case"])
        )


def inventory(spark: SparkSession, source: str, suffix: str, regex: str | None = None) -> DataFrame:
    """Files below ``source`` with the suffix, tagged by prefix uniqueness and regex."""
    return inv.file_list(inv.with_suffix(inv.list_files(spark, source), suffix), regex)


def read_entries(
    spark: SparkSession,
    paths: str | Sequence[str],
    annotations: DataFrame | None = None,
    intervals: str | Sequence[str] | None = None,
    csq_positions: tuple[int, int, int, int] = (0, 1, 2, 3),
    sample_from: str = "file",
    glob: str = vcf.VCF_GLOB,
) -> DataFrame:
    """Annotated, unfiltered entries of VCF files.

    Annotation comes from ``annotations`` or, without it, from the text in INFO.
    """
    entries = vcf.read_vcf(spark, paths, sample_from, glob=glob, intervals=intervals)
    if intervals is not None:
        entries = filters.in_intervals(entries, intervals)
    if annotations is not None:
        return vcf.annotate_from_table(entries, annotations)
    return vcf.annotate_from_csq(entries, csq_positions)


def label(entries: DataFrame, metadata: DataFrame | None, phenotype: str | None) -> Cohort:
    """Attach cohort labels; a leading ``*`` asks for the null split of the phenotype after it."""
    if phenotype is None:
        return Cohort(entries, None)
    if metadata is None:
        raise ValueError("a phenotype needs metadata")
    if phenotype.startswith("*"):
        labelled = cohort.label_null_cohort(metadata, phenotype[1:])
        flags = labelled.select("s", F.col("is_null_case").alias("is_case"))
        for side in ("is_case", "NOT is_case"):
            flags = filters.require_rows(flags, f"the null split of {phenotype[1:]} has an empty side", flags.filter(side))
        joined = entries.join(flags, "s")
    else:
        flags = cohort.label_cases(metadata, phenotype).select("s", "is_case")
        flags = filters.require_rows(flags, f"no sample matches phenotype {phenotype}", flags.filter("is_case"))
        joined = entries.join(flags, "s", "left").withColumn("is_case", F.coalesce("is_case", F.lit(False)))
    cohort_name = F.when(F.col("is_case"), "positive").otherwise("negative")
    return Cohort(joined.withColumn("cohort", cohort_name), phenotype)


def burden_tables(
    spark: SparkSession,
    paths: str | Sequence[str],
    metadata_path: str | None = None,
    phenotype: str | None = None,
    annotations: DataFrame | None = None,
    intervals: str | Sequence[str] | None = None,
    sample_from: str = "file",
) -> dict[str, DataFrame]:
    """VCF files to one gene table per cohort."""
    entries = filters.burden_filters(read_entries(spark, paths, annotations, intervals, sample_from=sample_from))
    metadata = meta.read_metadata(spark, metadata_path) if metadata_path else None
    return label(entries, metadata, phenotype).frequency_tables()


def burden_tables_from(
    spark: SparkSession,
    stored: str | Sequence[str],
    metadata: DataFrame | None = None,
    phenotype: str | None = None,
) -> dict[str, DataFrame]:
    """Gene tables from saved entries."""
    entries = filters.burden_filters(tables.load_cohort(spark, stored))
    return label(entries, metadata, phenotype).frequency_tables()


def relatedness(entries: DataFrame, interval: str | None = None) -> DataFrame:
    """Kinship of all pairs over every contig, or over one interval; pass unfiltered entries."""
    return kinship.kinship(entries, interval)


def pca_scores(spark: SparkSession, pca_path: str, locations_path: str) -> DataFrame:
    return meta.pca_scores(*meta.read_pca(spark, pca_path, locations_path))


def genotype_matrix(
    entries: DataFrame, samples: DataFrame, on_duplicate: str = "error"
) -> tuple[DataFrame, DataFrame]:
    """Long genotypes and phenotype vector; pivot the former with ``genotypes.genotype_matrix``."""
    return genotypes.genotype_long(entries, on_duplicate), tables.phenotype_vector(samples)


def case_control_counts(entries: DataFrame, metadata: DataFrame, phenotype: str) -> DataFrame:
    """Gene-bin counts of cases and controls side by side."""
    return label(filters.burden_filters(entries), metadata, phenotype).counts()


def legacy_gene_table(
    entries: DataFrame,
    metadata: DataFrame | None = None,
    phenotype: str | None = None,
    min_dp: int | None = None,
) -> DataFrame:
    """Gene structs with the coarse frequency bins; cohort filter by phenotype pattern, depth optional."""
    kept = filters.min_variant_fraction(filters.drop_star(entries))
    if min_dp is not None:
        kept = filters.min_depth(kept, min_dp)
    if phenotype is not None:
        if metadata is None:
            raise ValueError("a phenotype needs metadata")
        matched = filters.require_rows(
            filters.phenotype_matches(metadata, phenotype), f"no sample matches phenotype {phenotype}"
        )
        kept = kept.join(matched.select("s"), "s", "left_semi")
    return burden.gene_structs(kept)
