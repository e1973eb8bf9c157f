"""Multiple-testing corrections over a table of p-values.

The number of tests enters as a scalar subquery. For ranks, equal p-values are folded first and only
p-values of one bucket meet in a window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burdenframe.functions.numeric import neg_log10
from burdenframe.functions.ordering import p_value_bucket, running_total, value_counts
from burdenframe.plans.workspace import stored

ALPHA = 0.05


def n_tests(df: DataFrame, p: str = "p_val"):
    """Scalar count of tests with a p-value."""
    return df.select(F.count(p).cast("double")).scalar()


def bonferroni(
    df: DataFrame, p: str = "p_val", alpha: float = ALPHA,
    adjusted: str = "pval_bonferroni", flag: str = "significant_bonferroni",
) -> DataFrame:
    """Adjusted p, rejection flag and ``-log10`` of the adjusted p."""
    m = n_tests(df, p)
    return df.withColumn("_m", m).withColumns(
        {adjusted: F.least(F.col(p) * F.col("_m"), F.lit(1.0)), flag: F.col(p) <= alpha / F.col("_m")}
    ).withColumn("neg_log10_adjusted", neg_log10(F.col(adjusted))).drop("_m")


def bonferroni_joint(tables: Sequence[DataFrame], p: str, alpha: float = ALPHA) -> DataFrame:
    """Correct several tables together; ``source`` numbers the table a row came from."""
    stacked = tables[0].withColumn("source", F.lit(0))
    for i, t in enumerate(tables[1:], start=1):
        stacked = stacked.unionByName(t.withColumn("source", F.lit(i)))
    return bonferroni(stacked, p, alpha, "Bonferroni_Adjusted_Pval", "Significant_pval").drop(
        "neg_log10_adjusted"
    )


def benjamini_hochberg(df: DataFrame, p: str = "p_val") -> DataFrame:
    """``(p, bh)`` per distinct p-value: the smallest ``p_j * m / j`` over all ranks at or above it.

    The suffix minimum is taken inside each bucket and joined with the minimum of all later buckets.
    """
    bucket = p_value_bucket(F.col(p))
    counts = value_counts(df, p)
    m = counts.select(F.sum("n").cast("double")).scalar()
    ranked = running_total(counts, F.col("n"), bucket, [F.col(p)], "cum").withColumns({"_bucket": bucket, "_m": m})
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("cum"))
    per_bucket = raw.groupBy("_bucket").agg(F.min("_raw").alias("_low"))
    after = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = per_bucket.select("_bucket", F.min("_low").over(after).alias("_later"))
    inside = Window.partitionBy("_bucket").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        raw.withColumn("_own", F.min("_raw").over(inside))
        .join(later, "_bucket")
        .select(p, "n", F.least("_own", "_later").alias("bh"), F.col("_m").alias("m"))
    )


def fdr_two_stage(
    df: DataFrame, p: str = "p_val", alpha: float = ALPHA,
    adjusted: str = "pval_bonferroni", flag: str = "significant_bonferroni",
) -> DataFrame:
    """Two-stage Benjamini-Hochberg (``fdr_tsbh``).

    Stage one rejects ``r1`` tests at ``alpha``. Unless that is none or all of them, adjusted values
    shrink by the share of tests left and rejection is repeated at ``alpha * m / (m - r1)``. The input is
    read more than once; store it first when its p-values are costly.
    """
    bh = stored(benjamini_hochberg(df, p), "bh")
    r1 = bh.agg(F.coalesce(F.sum(F.when(F.col("bh") <= alpha, F.col("n"))), F.lit(0)).cast("double")).scalar()
    staged = bh.withColumn("_r1", r1)
    two = (F.col("_r1") > 0) & (F.col("_r1") < F.col("m"))
    left = F.when(two, (F.col("m") - F.col("_r1")) / F.col("m")).otherwise(F.lit(1.0))
    corrected = staged.select(
        p,
        (F.least("bh", F.lit(1.0)) * left).alias(adjusted),
        (F.col("bh") <= alpha / left).alias(flag),
    )
    return df.filter(F.col(p).isNotNull()).join(corrected, p).withColumn(
        "neg_log10_adjusted", neg_log10(F.col(adjusted))
    )


def thresholds(df: DataFrame, p: str = "p_val", alpha: float = ALPHA) -> DataFrame:
    """Scalar cut-offs drawn on the plots: Bonferroni and Šidák alpha and their ``-log10``."""
    m = F.col("n_tests")
    sidak = 1.0 - F.pow(F.lit(1.0 - alpha), 1.0 / m)
    return df.agg(F.count(p).alias("n_tests")).withColumns(
        {
            "alpha_bonferroni": alpha / m,
            "alpha_sidak": sidak,
            "neg_log10_alpha": F.lit(-math.log10(alpha)),
            "neg_log10_alpha_bonferroni": -F.log10(alpha / m),
        }
    )
