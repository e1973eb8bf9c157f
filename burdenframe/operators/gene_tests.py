"""Per gene-bin tests over long four-cohort counts.

``sizes`` gives the number of individuals as columns or numbers under the cohort names; each
individual carries two alleles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenframe.functions.numeric import finite_or_null, log2_ratio, neg_log10, two_sided_p
from burdenframe.operators.genetable import COHORTS, COUNTS
from burdenframe.operators.multitest import ALPHA, bonferroni, fdr_two_stage
from burdenframe.plans.workspace import stored

Sizes = Mapping[str, int | Column]


def cohort_sizes(labelled: DataFrame) -> DataFrame:
    """One row with the number of samples in each of the four cohorts."""
    case, null = F.col("is_case"), F.col("is_null_case")
    return labelled.agg(
        F.count_if(case).alias("case_pheno"),
        F.count_if(~case).alias("control_pheno"),
        F.count_if(null).alias("case_null"),
        F.count_if(~null).alias("control_null"),
    )


def sizes_of(labelled: DataFrame) -> dict[str, Column]:
    """Cohort sizes, all from one scalar subquery."""
    row = cohort_sizes(labelled).select(F.struct(*COHORTS)).scalar()
    return {c: row[c] for c in COHORTS}


def with_alleles(long: DataFrame, sizes: Sizes) -> DataFrame:
    """Add ``n_{cohort}``, the number of alleles of each cohort."""
    def column(v: int | Column) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    return long.withColumns({f"n_{c}": (column(sizes[c]) * 2).cast("double") for c in sizes})


def drop_sizes(df: DataFrame) -> DataFrame:
    return df.drop(*[f"n_{c}" for c in COHORTS])


def fold_change(long: DataFrame, min_mac: int = 10) -> DataFrame:
    """log2 of the phenotype case/control ratio over the null ratio, all four counts ``>= min_mac``."""
    kept = long
    for c in COUNTS:
        kept = kept.filter(F.col(c) >= min_mac)
    return kept.select(
        "gene", "bin",
        F.col("ac_case_pheno").alias("case_burden"),
        F.col("ac_control_pheno").alias("control_burden"),
        F.col("ac_case_null").alias("nullcase_burden"),
        F.col("ac_control_null").alias("nullcontrol_burden"),
        F.try_divide(F.col("ac_case_pheno"), F.col("ac_control_pheno")).alias("pheno_ratio"),
        F.try_divide(F.col("ac_case_null"), F.col("ac_control_null")).alias("null_ratio"),
    ).withColumn("log2_fold_change", log2_ratio(F.col("pheno_ratio"), F.col("null_ratio")))


def two_proportion_z(long: DataFrame, sizes: Sizes, min_mac: int = 5, alpha: float = ALPHA) -> DataFrame:
    """Pooled two-proportion z-test of phenotype cases against null cases, two-stage FDR."""
    x1, x2 = F.col("ac_case_pheno"), F.col("ac_case_null")
    n1, n2 = F.col("n_case_pheno"), F.col("n_case_null")
    pooled = F.col("_pooled")
    tested = (
        with_alleles(long.filter((x1 >= min_mac) & (x2 >= min_mac)), sizes)
        .withColumns({"p1_pheno": x1 / n1, "p2_null": x2 / n2, "_pooled": (x1 + x2) / (n1 + n2)})
        .withColumns(
            {
                "effect_size": F.col("p1_pheno") - F.col("p2_null"),
                "_se": F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.0)) * (1 / n1 + 1 / n2)),
            }
        )
        .withColumn("z_score", F.try_divide(F.col("effect_size"), F.col("_se")))
        .withColumn("p_val", two_sided_p(F.col("z_score")))
        .filter(F.col("p_val").isNotNull())
        .select("gene", "bin", "ac_case_pheno", "ac_case_null", "p1_pheno", "p2_null", "effect_size",
                "z_score", "p_val")
    )
    return fdr_two_stage(stored(tested, "tested"), alpha=alpha)


def _with_min_mac(long: DataFrame, min_pheno: int, min_null: int) -> DataFrame:
    return long.filter(
        (F.col("ac_case_pheno") + F.col("ac_control_pheno") >= min_pheno)
        & (F.col("ac_case_null") + F.col("ac_control_null") >= min_null)
    )


def diff_of_proportions_z(
    long: DataFrame, sizes: Sizes, min_pheno: int = 5, min_null: int = 5, alpha: float = ALPHA
) -> DataFrame:
    """z-test of the case-control difference in the phenotype against that in the null cohort."""
    props = {f"_p_{c}": F.col(f"ac_{c}") / F.col(f"n_{c}") for c in COHORTS}
    variance = sum(
        F.greatest(F.col(f"_p_{c}") * (1 - F.col(f"_p_{c}")) / F.col(f"n_{c}"), F.lit(0.0)) for c in COHORTS
    )
    tested = (
        with_alleles(_with_min_mac(long, min_pheno, min_null), sizes)
        .withColumns(props)
        .withColumns(
            {
                "delta_p_pheno": F.col("_p_case_pheno") - F.col("_p_control_pheno"),
                "delta_p_null": F.col("_p_case_null") - F.col("_p_control_null"),
                "_se": F.sqrt(variance),
            }
        )
        .withColumn("effect_size_diff_of_diffs", F.col("delta_p_pheno") - F.col("delta_p_null"))
        .withColumn("z_score", F.try_divide(F.col("effect_size_diff_of_diffs"), F.col("_se")))
        .withColumn("p_val", two_sided_p(F.col("z_score")))
        .filter(F.col("p_val").isNotNull())
        .select("gene", "bin", *COUNTS, "delta_p_pheno", "delta_p_null", "effect_size_diff_of_diffs",
                "z_score", "p_val")
    )
    return bonferroni(tested, alpha=alpha)


def _log_odds(side: str) -> tuple[Column, Column]:
    """Log odds ratio and its variance with one half added to every cell."""
    x, y = F.col(f"ac_case_{side}"), F.col(f"ac_control_{side}")
    nx, ny = F.col(f"n_case_{side}"), F.col(f"n_control_{side}")
    a, b, c, d = x + 0.5, nx - x + 0.5, y + 0.5, ny - y + 0.5
    return F.log((a * d) / (b * c)), 1 / a + 1 / b + 1 / c + 1 / d


def log_odds_difference_z(
    long: DataFrame, sizes: Sizes, min_pheno: int = 5, min_null: int = 5, alpha: float = ALPHA
) -> DataFrame:
    """z-test of the difference of two log odds ratios, Bonferroni corrected."""
    lp, vp = _log_odds("pheno")
    ln, vn = _log_odds("null")
    variance = F.col("_variance")
    tested = (
        with_alleles(_with_min_mac(long, min_pheno, min_null), sizes)
        .withColumns({"log_or_pheno": lp, "log_or_null": ln, "_variance": vp + vn})
        .withColumn("effect_size_diff_log_or", F.col("log_or_pheno") - F.col("log_or_null"))
        .withColumn(
            "z_score", F.when(variance > 1e-12, F.col("effect_size_diff_log_or") / F.sqrt(variance))
        )
        .withColumn("p_val", two_sided_p(F.col("z_score")))
        .filter(F.col("p_val").isNotNull())
        .select("gene", "bin", "log_or_pheno", "log_or_null", "effect_size_diff_log_or", "z_score",
                "p_val", *COUNTS)
    )
    return bonferroni(tested, alpha=alpha)


def odds_ratio(x_case: Column, n_case: Column, x_control: Column, n_control: Column) -> Column:
    """Odds ratio over individuals, NULL where undefined."""
    return F.try_divide(
        x_case.cast("double") * (n_control - x_control), (n_case - x_case) * x_control.cast("double")
    )


def discovery_table(z: DataFrame, fold: DataFrame) -> DataFrame:
    """z-test joined with fold change on gene and bin, undefined values dropped."""
    joined = z.select("gene", "bin", "p_val").join(
        fold.select("gene", "bin", "log2_fold_change"), ["gene", "bin"]
    )
    return (
        joined.withColumn("log2_fold_change", finite_or_null(F.col("log2_fold_change")))
        .na.drop(subset=["p_val", "log2_fold_change"])
        .withColumn("neg_log10_raw_pval", neg_log10(F.col("p_val")))
    )


def top_by(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows in the given order, gene and bin breaking ties."""
    return df.orderBy(*order, F.col("gene"), F.col("bin")).limit(n)


def top_fold_changes(fold: DataFrame, n: int = 20) -> DataFrame:
    return top_by(fold, [F.col("log2_fold_change").desc(), F.col("case_burden").desc()], n)


def top_significant(z: DataFrame, effect: str, n: int = 20, flag: str = "significant_bonferroni") -> DataFrame:
    """Significant rows by ``-log10`` adjusted p, then absolute effect."""
    return top_by(
        z.filter(F.col(flag)), [F.col("neg_log10_adjusted").desc(), F.abs(F.col(effect)).desc()], n
    )


def top_significant_by_gene(z: DataFrame, n: int = 20, flag: str = "significant_bonferroni") -> DataFrame:
    return z.filter(F.col(flag)).orderBy(F.col("gene").desc(), F.col("bin").desc()).limit(n)


def top_discoveries(discovery: DataFrame, n: int = 25) -> DataFrame:
    """Rows with the smallest raw p."""
    return top_by(discovery, [F.col("neg_log10_raw_pval").desc()], n)


def counts_beside(tests: DataFrame, counts: DataFrame) -> DataFrame:
    """Test results with the raw counts of their gene and bin."""
    return tests.join(counts, ["gene", "bin"], "left")
