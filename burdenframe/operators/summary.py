"""Cohort-level burden summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenframe.functions.numeric import log2_ratio
from burdenframe.functions.ordering import exact_quantile
from burdenframe.operators.genetable import TOTAL

METRICS = (
    "Expected_Ratio", "Log2_Expected_Ratio", "Total_Case_Burden", "Total_Control_Burden", "Total_Ratio",
    "Log2_Total_Ratio", "Mean_Case_Burden", "Mean_Control_Burden", "Mean_Ratio", "Log2_Mean_Ratio",
    "Case_Median", "Control_Median", "Case_Std", "Control_Std",
)


def burden_summary(long: DataFrame, side: str, n_case: int | Column, n_control: int | Column) -> DataFrame:
    """One row of totals, means, medians and deviations of the total burden over genes.

    ``side`` is ``pheno`` or ``null``.
    """
    totals = long.filter(F.col("bin") == TOTAL).select(
        F.col(f"ac_case_{side}").cast("double").alias("x"), F.col(f"ac_control_{side}").cast("double").alias("y")
    )

    def column(v: int | Column) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    def median(name: str) -> Column:
        return exact_quantile(totals, name, [], 0.5, "m").select("m").scalar()

    sums = totals.agg(
        F.sum("x").alias("Total_Case_Burden"),
        F.sum("y").alias("Total_Control_Burden"),
        F.avg("x").alias("Mean_Case_Burden"),
        F.avg("y").alias("Mean_Control_Burden"),
        F.stddev_samp("x").alias("Case_Std"),
        F.stddev_samp("y").alias("Control_Std"),
    )
    full = sums.withColumns(
        {
            "Expected_Ratio": F.try_divide(column(n_case), column(n_control)),
            "Total_Ratio": F.try_divide(F.col("Total_Case_Burden"), F.col("Total_Control_Burden")),
            "Mean_Ratio": F.try_divide(F.col("Mean_Case_Burden"), F.col("Mean_Control_Burden")),
            "Case_Median": median("x"),
            "Control_Median": median("y"),
        }
    )
    one = F.lit(1.0)
    return full.withColumns(
        {
            "Log2_Expected_Ratio": log2_ratio(F.col("Expected_Ratio"), one),
            "Log2_Total_Ratio": log2_ratio(F.col("Total_Ratio"), one),
            "Log2_Mean_Ratio": log2_ratio(F.col("Mean_Ratio"), one),
        }
    ).select(*METRICS)


def compare_summaries(
    pheno: DataFrame,
    null: DataFrame,
    log2_delta: bool = True,
    digits: int = 4,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """``Metric, Phenotype, Null, Delta`` over the shared or named metrics, values rounded first."""
    shared = [c for c in pheno.columns if c in null.columns] if metrics is None else list(metrics)

    def tall(df: DataFrame, name: str) -> DataFrame:
        rounded = df.select(*[F.round(c, digits).alias(c) for c in shared])
        return rounded.unpivot([], shared, "Metric", name)

    both = tall(pheno, "Phenotype").join(tall(null, "Null"), "Metric")
    x, y = F.col("Phenotype"), F.col("Null")
    return both.withColumn("Delta", log2_ratio(x, y) if log2_delta else x - y)
