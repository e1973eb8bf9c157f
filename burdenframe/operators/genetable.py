"""Gene tables of four cohorts, aligned by gene and kept wide or long.

``COHORTS`` names the case and control tables of the phenotype and of the null split. The long form
``gene, bin, ac_case_pheno, ac_control_pheno, ac_case_null, ac_control_null`` feeds every test.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenframe.operators.burden import AF_BINS, IMPACTS, Bins, bin_names, in_bin

COHORTS = ("case_pheno", "control_pheno", "case_null", "control_null")
COUNTS = tuple(f"ac_{c}" for c in COHORTS)
TOTAL = "total_burden"
EPSILON = 0.01
TESTED_BINS = tuple(bin_names([i for i in IMPACTS if i != "MODIFIER"])) + (TOTAL,)


def q(name: str) -> Column:
    """Column whose name may hold dots."""
    return F.col(f"`{name}`")


def bin_columns(table: DataFrame) -> list[str]:
    return table.columns[1:]


def drop_matching_columns(table: DataFrame, substring: str = "MODIFIER") -> DataFrame:
    """Drop columns whose name contains ``substring`` in any case, then rows left with only zeros."""
    hit = [c for c in table.columns if substring.upper() in c.upper()]
    if not hit:
        return table
    kept = [c for c in table.columns if c not in hit]
    slim = table.select(*[q(c) for c in kept])
    nonzero = [~q(c).eqNullSafe(F.lit(0)) for c in kept[1:]]
    return slim.filter(reduce(or_, nonzero)) if nonzero else slim


def with_total(table: DataFrame) -> DataFrame:
    """Name the first column ``gene`` and add the row sum, which then counts as one more bin."""
    first, *bins = table.columns
    total = reduce(add, [F.coalesce(q(b), F.lit(0)) for b in bins])
    return table.select(q(first).alias("gene"), *[q(b) for b in bins], total.alias(TOTAL))


def drop_null_genes(table: DataFrame) -> DataFrame:
    return table.filter(F.col("gene").isNotNull() & (F.col("gene") != ""))


def keep_genes(table: DataFrame, genes: DataFrame) -> DataFrame:
    return table.join(genes.select("gene"), "gene", "left_semi")


def add_epsilon(table: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Add ``epsilon`` to every bin, the total included."""
    return table.select("gene", *[(q(b).cast("double") + epsilon).alias(b) for b in bin_columns(table)])


def fill_counts(table: DataFrame) -> DataFrame:
    """Missing counts become 0 and all counts integers."""
    return table.select(
        "gene", *[F.coalesce(q(b), F.lit(0)).cast("long").alias(b) for b in bin_columns(table)]
    )


def unpivot_table(table: DataFrame, out: str = "ac") -> DataFrame:
    """Long ``gene, bin, ac`` form of a wide gene table."""
    pairs = [c for b in bin_columns(table) for c in (F.lit(b), q(b))]
    return table.select("gene", F.stack(F.lit(len(pairs) // 2), *pairs).alias("bin", out))


def genes_on_every_side(entries: DataFrame, sides: Sequence[str]) -> DataFrame:
    """Genes with an entry on every side, each a condition on the entries; one pass over them."""
    marks = [F.bool_or(F.expr(s)).alias(f"_{i}") for i, s in enumerate(sides)]
    return entries.groupBy("gene").agg(*marks).filter(" AND ".join(f"_{i}" for i in range(len(sides)))).select("gene")


def align_tables(tables: Mapping[str, DataFrame], genes: DataFrame | None = None) -> DataFrame:
    """Long counts over the genes present in all four wide tables.

    The tables are stacked with a cohort mark and aggregated once by gene, in place of three joins.
    """
    bins = bin_columns(next(iter(tables.values())))
    stacked = reduce(
        DataFrame.unionByName,
        [drop_null_genes(t).withColumn("_cohort", F.lit(c)) for c, t in tables.items()],
    )
    if genes is not None:
        stacked = keep_genes(stacked, genes)
    sides = {c: F.col("_cohort") == c for c in tables}
    cells = [
        F.coalesce(F.sum(F.when(here, q(b))), F.lit(0)).alias(f"{c}_{i}")
        for c, here in sides.items()
        for i, b in enumerate(bins)
    ]
    marks = [F.max(here).alias(f"_has_{c}") for c, here in sides.items()]
    wide = stacked.groupBy("gene").agg(*cells, *marks)
    present = reduce(and_, [F.col(f"_has_{c}") for c in tables])
    return wide_to_long(wide.filter(present), bins, tuple(tables))


def wide_to_long(wide: DataFrame, bins: Sequence[str], cohorts: Sequence[str] = COHORTS) -> DataFrame:
    """Turn columns ``{cohort}_{i}`` into one row per bin with a count column per cohort."""
    rows = [c for i, b in enumerate(bins) for c in (F.lit(b), *[F.col(f"{k}_{i}") for k in cohorts])]
    return wide.select("gene", F.stack(F.lit(len(bins)), *rows).alias("bin", *[f"ac_{c}" for c in cohorts]))


def bin_index(impacts: Sequence[str], bins: Bins = AF_BINS) -> Column:
    """Position of an entry's bin in ``bin_names(impacts, bins)``, NULL outside of all bins."""
    af = reduce(lambda c, ib: c.when(in_bin(ib[1]), F.lit(ib[0])), enumerate(bins.values()), F)
    impact = reduce(lambda c, ii: c.when(F.col("impact") == ii[1], F.lit(ii[0])), enumerate(impacts), F)
    return impact * len(bins) + af


def four_cohort_wide(entries: DataFrame, bins: Bins = AF_BINS, keep_modifier: bool = False) -> DataFrame:
    """Aligned counts straight from labelled entries, in one pass over them.

    ``entries`` carries ``is_case`` and ``is_null_case``. They are first summed by gene, bin and label,
    at most four rows per gene and bin, and those rows are then spread into the columns
    ``{cohort}_{i}`` with ``i`` counting the tested bins and the total last. A gene stays when each
    cohort has a non-zero bin, or, with ``keep_modifier``, any entry.
    """
    impacts = [i for i in IMPACTS if keep_modifier or i != "MODIFIER"]
    n_bins = len(impacts) * len(bins)
    summed = (
        drop_null_genes(entries)
        .withColumn("_bin", bin_index(impacts, bins))
        .groupBy("gene", "_bin", "is_case", "is_null_case")
        .agg(F.sum("AC").alias("ac"))
    )
    sides = {
        "case_pheno": F.col("is_case"),
        "control_pheno": ~F.col("is_case"),
        "case_null": F.col("is_null_case"),
        "control_null": ~F.col("is_null_case"),
    }
    cells, marks = [], []
    for c, here in sides.items():
        cells += [
            F.coalesce(F.sum(F.when(here & (F.col("_bin") == n), F.col("ac"))), F.lit(0)).alias(f"{c}_{n}")
            for n in range(n_bins)
        ]
        in_any = here & F.col("_bin").isNotNull()
        cells.append(F.coalesce(F.sum(F.when(in_any, F.col("ac"))), F.lit(0)).alias(f"{c}_{n_bins}"))
        marks.append(F.max(here).alias(f"_has_{c}"))
    wide = summed.groupBy("gene").agg(*cells, *marks)
    shown = [F.col(f"_has_{c}") if keep_modifier else F.col(f"{c}_{n_bins}") > 0 for c in sides]
    return wide.filter(reduce(and_, shown)).drop(*[f"_has_{c}" for c in sides])


def four_cohort_long(entries: DataFrame, keep_modifier: bool = False) -> DataFrame:
    bins = [*bin_names(), TOTAL] if keep_modifier else TESTED_BINS
    return wide_to_long(four_cohort_wide(entries, keep_modifier=keep_modifier), bins)


def infinite_ratio_genes(
    long: DataFrame, case: str = "ac_case_pheno", control: str = "ac_control_pheno",
    keyword: str = "all", min_case: int = 3,
) -> DataFrame:
    """Gene-bins with no control allele and at least ``min_case`` case alleles, last gene first."""
    hit = (F.col(control) == 0) & (F.col(case) >= min_case)
    if keyword != "all":
        hit = hit & F.upper("bin").contains(keyword.upper())
    return long.filter(hit).select(
        "gene", "bin", F.col(case).alias("case_burden"), F.col(control).alias("control_burden"),
        F.lit("inf").alias("ratio_status"),
    ).orderBy(F.col("gene").desc(), F.col("bin").desc())


def gene_lookup(df: DataFrame, gene: str) -> DataFrame:
    return df.filter(F.col("gene") == gene)


def set_sizes(gene_sets: DataFrame) -> DataFrame:
    """Number of genes per named list."""
    return gene_sets.groupBy("set_name").agg(F.count("gene").alias("n_genes"))
