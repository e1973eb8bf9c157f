"""Sums of alternate alleles per gene, impact class and frequency bin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPACTS = ("MODIFIER", "LOW", "MODERATE", "HIGH")

# Bin name -> (exclusive lower bound, exclusive upper bound) of MAX_AF.
AF_BINS = {
    "gnomad_001": (None, 0.0001),
    "gnomad_001_01": (0.0001, 0.001),
    "gnomad_01_1": (0.001, 0.01),
}
OPEN_AF_BINS = {**AF_BINS, "gnomad_01_1": (0.001, None)}
LEGACY_AF_BINS = {
    "gnomad_1": (None, 0.01),
    "gnomad_1_5": (0.01, 0.05),
    "gnomad_5_100": (0.05, None),
}
Bins = Mapping[str, tuple[float | None, float | None]]


def in_bin(bounds: tuple[float | None, float | None], af: str = "MAX_AF") -> Column:
    """Both bounds are excluded, so a frequency on a boundary is in no bin."""
    low, high = bounds
    tests = [F.col(af) > low] if low is not None else []
    tests += [F.col(af) < high] if high is not None else []
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def allele_sum(condition: Column, ac: str = "AC") -> Column:
    """Filtered sum that is 0, not NULL, when nothing qualifies."""
    return F.coalesce(F.sum(F.when(condition, F.col(ac))), F.lit(0)).cast("long")


def bin_names(impacts: Sequence[str] = IMPACTS, bins: Bins = AF_BINS) -> list[str]:
    return [f"{i}.{b}" for i in impacts for b in bins]


def burden_by_impact(entries: DataFrame, by: Sequence[str] = (), bins: Bins = AF_BINS) -> DataFrame:
    """One row per ``by``, impact and gene with a column per frequency bin.

    Sums are partially aggregated before the shuffle, so a gene that holds most entries costs one
    row per task.
    """
    return entries.groupBy(*by, "impact", "gene").agg(
        *[allele_sum(in_bin(bounds)).alias(name) for name, bounds in bins.items()]
    )


def to_long(by_impact: DataFrame, by: Sequence[str] = (), bins: Bins = AF_BINS) -> DataFrame:
    """Long form ``by, gene, bin, ac`` of ``burden_by_impact``."""
    pairs = [c for b in bins for c in (F.lit(b), F.col(b))]
    stacked = by_impact.select(*by, "gene", "impact", F.stack(F.lit(len(bins)), *pairs).alias("_b", "ac"))
    return stacked.select(*by, "gene", F.concat_ws(".", "impact", "_b").alias("bin"), "ac")


def frequency_table(
    entries: DataFrame,
    by: Sequence[str] = (),
    impacts: Sequence[str] = IMPACTS,
    bins: Bins = AF_BINS,
) -> DataFrame:
    """Wide gene table with a column ``IMPACT.bin`` for each pair.

    Entries are summed by gene and impact first; the wide step only sees those few rows.
    """
    cells = [
        F.coalesce(F.sum(F.when(F.col("impact") == i, F.col(b))), F.lit(0)).alias(f"{i}.{b}")
        for i in impacts
        for b in bins
    ]
    return burden_by_impact(entries, by, bins).groupBy(*by, "gene").agg(*cells)


def pivot_long(
    long: DataFrame, by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """Wide gene table from ``gene, bin, ac`` rows; absent bins become 0."""
    names = bin_names() if names is None else list(names)
    wide = long.groupBy(*by, "gene").pivot("bin", names).agg(F.sum("ac"))
    return wide.select(*by, "gene", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])


def _impact_struct(impact: str, bins: Bins) -> Column:
    hit = F.col("impact").contains(impact)
    return F.struct(*[allele_sum(hit & in_bin(bounds)).alias(b) for b, bounds in bins.items()])


def gene_structs(
    entries: DataFrame, by: Sequence[str] = (), bins: Bins = LEGACY_AF_BINS
) -> DataFrame:
    """Per gene one struct of bins for each impact; impacts match by substring."""
    return entries.groupBy(*by, "gene").agg(
        *[_impact_struct(i, bins).alias(i.lower()) for i in IMPACTS]
    )


def sample_gene_structs(entries: DataFrame) -> DataFrame:
    """Per gene and sample, with the rarest-to-common bins and no upper bound on the last."""
    return gene_structs(entries, ["s"], OPEN_AF_BINS)


def sample_counts(entries: DataFrame, bins: Bins = AF_BINS, by: Sequence[str] = ("s",)) -> DataFrame:
    """Long per-sample counts ``s, gene, bin, ac``; adding them up gives any cohort's gene table."""
    return to_long(burden_by_impact(entries, by, bins), by, bins)


def add_counts(tables: Sequence[DataFrame], keys: Sequence[str] = ("gene", "bin")) -> DataFrame:
    """Outer-aligned addition of long count tables."""
    merged = tables[0]
    for other in tables[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy(*keys).agg(F.sum("ac").alias("ac"))


def case_control_counts(counts: DataFrame) -> DataFrame:
    """Wide gene table with ``_case`` and ``_control`` columns, absent genes filled with 0.

    ``counts`` carries ``is_case, gene, bin, ac``; one conditional aggregation takes the place of the
    outer join of two tables.
    """
    cells = []
    for side, keep in (("case", F.col("is_case")), ("control", ~F.col("is_case"))):
        cells += [
            F.coalesce(F.sum(F.when(keep & (F.col("bin") == n), F.col("ac"))), F.lit(0)).alias(f"{n}_{side}")
            for n in bin_names()
        ]
    return counts.groupBy("gene").agg(*cells)


def join_case_control(case: DataFrame, control: DataFrame) -> DataFrame:
    """Outer join of two wide gene tables with side suffixes and zeros for absent genes."""

    def tagged(df: DataFrame, side: str) -> DataFrame:
        return df.select("gene", *[F.col(f"`{c}`").alias(f"{c}_{side}") for c in df.columns if c != "gene"])

    joined = tagged(case, "case").join(tagged(control, "control"), "gene", "full")
    return joined.select(
        "gene", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in joined.columns if c != "gene"]
    )


def merged_lengths(entries: DataFrame) -> DataFrame:
    """Statistics of the number of entries per variant."""
    per_variant = entries.groupBy("contig", "pos", "alleles").agg(F.count(F.lit(1)).alias("len"))
    return per_variant.agg(
        F.avg("len").alias("mean"),
        F.stddev_pop("len").alias("stdev"),
        F.min("len").alias("min"),
        F.max("len").alias("max"),
        F.count(F.lit(1)).alias("n"),
        F.sum("len").alias("sum"),
    )
