"""Expressions over variant-call text: contigs, INFO, FORMAT/sample pairs and calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burdenframe.functions.text import number_or_null


def recode_contig(contig: Column) -> Column:
    """``chr1..chr22, chrX, chrY`` lose their prefix and ``chrM`` becomes ``MT``; other names stay."""
    return (
        F.when(contig == "chrM", F.lit("MT"))
        .when(contig.rlike(r"^chr([1-9]|1\d|2[0-2]|X|Y)$"), F.substring(contig, 4, 2))
        .otherwise(contig)
    )


def info_value(info: Column, key: str) -> Column:
    """Value of ``key`` in an INFO string, NULL when absent."""
    pattern = rf"(?:^|;){key}=([^;]*)"
    return F.when(info.rlike(pattern), F.regexp_extract(info, pattern, 1))


def info_flag(info: Column, key: str) -> Column:
    """True when the flag ``key`` occurs in an INFO string."""
    return info.rlike(rf"(?:^|;){key}(?:;|=|$)")


def sample_field(fmt: Column, sample: Column, key: str) -> Column:
    """Text of FORMAT field ``key`` in a sample cell; NULL when absent or trimmed off the end."""
    at = F.array_position(fmt, key).cast("int") - 1
    return F.nullif(F.get(sample, at), F.lit("."))


def int_list(text: Column) -> Column:
    """Comma list to ``array<int>``; dots become NULL elements."""
    return F.transform(F.split(text, ","), lambda x: x.try_cast("int"))


def call_alleles(gt: Column) -> Column:
    """Allele indices of a call, NULL elements for dots."""
    return F.transform(F.split(gt, r"[/|]"), lambda a: a.try_cast("int"))


def call_struct(gt: Column) -> Column:
    """``struct<alleles, phased>`` of a call."""
    return F.when(
        gt.isNotNull(),
        F.struct(call_alleles(gt).alias("alleles"), gt.contains("|").alias("phased")),
    )


def alt_allele_count(gt: Column) -> Column:
    """Number of non-reference alleles in a call, NULL when any allele is missing."""
    parts = F.split(gt, r"[/|]")
    return F.when(~F.array_contains(parts, "."), F.size(F.filter(parts, lambda a: a != "0")))


def variant_fraction(ad: Column, dp: Column) -> Column:
    """Share of reads that support the first alternate allele."""
    return F.try_divide(F.get(ad, F.lit(1)).cast("double"), dp.cast("double"))


def csq_parts(info: Column, key: str = "CSQ") -> Column:
    """Pipe-separated fields of the first annotation record in INFO."""
    return F.split(F.split_part(info_value(info, key), F.lit(","), F.lit(1)), r"\|")


def csq_fields(info: Column, positions: tuple[int, int, int, int] = (0, 1, 2, 3)) -> dict[str, Column]:
    """impact, gene, HGNC_ID and MAX_AF taken by position from the first annotation record."""
    parts = csq_parts(info)
    impact, gene, hgnc, af = (F.get(parts, F.lit(i)) for i in positions)
    return {
        "impact": impact,
        "gene": gene,
        "HGNC_ID": number_or_null(hgnc).cast("int"),
        "MAX_AF": number_or_null(af),
    }
