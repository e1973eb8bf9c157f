"""Exact global ordering without a single-task window.

A row is first put into a bucket by a deterministic expression that never decreases along the sort
order. Totals per bucket form a table whose size is bounded by the number of buckets; its running
sum gives each bucket its offset, and ranks inside a bucket come from a window over that bucket
alone. Results do not depend on how well the buckets are balanced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burdenframe.functions.sampling import hash_hex
from burdenframe.plans.workspace import stored

SKETCH_ACCURACY = 10_000  # a quantile sketch errs by one in so many rows at most
BRACKET_ROWS = 1_000_000  # rows of a group that may be folded around its quantile


def hash_bucket(key: Column, seed: str = "order") -> Column:
    """Bucket 0..4095 from the leading digits of a hash, for keys without a natural spread."""
    return F.conv(F.substring(hash_hex(seed, key), 1, 3), 16, 10).cast("int")


def p_value_bucket(p: Column) -> Column:
    """Bucket of a p-value: even steps above 0.001, eighths of a decade below, at most 3,700."""
    small = -F.floor(-F.log10(F.greatest(p, F.lit(4.9e-324))) * 8.0)
    return F.when(p < 0.001, small).otherwise(F.floor(p * 1000.0)).cast("int")


def running_total(
    df: DataFrame,
    weight: Column,
    bucket: Column,
    order: Sequence[Column],
    out: str,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: the inclusive running sum of ``weight`` along ``order`` within ``groups``.

    ``order`` must be unique within a bucket and ``bucket`` must not decrease along it.
    """
    groups = list(groups)
    tagged = df.withColumns({"_bucket": bucket, "_weight": weight})
    totals = tagged.groupBy(*groups, "_bucket").agg(F.sum("_weight").alias("_total"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.withColumn("_inside", F.sum("_weight").over(inside))
        .join(offsets, [*groups, "_bucket"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_bucket", "_weight", "_inside", "_offset")
    )


def dense_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """Number distinct keys 0..n-1 in (hash bucket, key) order."""
    numbered = running_total(df, F.lit(1), hash_bucket(F.col(key)), [F.col(key)], out)
    return numbered.withColumn(out, (F.col(out) - 1).cast("int"))


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct values per group with ``n`` occurrences; NULL is left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantile(
    df: DataFrame, value: str, groups: Sequence[str], q: float, out: str, accuracy: int = SKETCH_ACCURACY, most: int = BRACKET_ROWS
) -> DataFrame:
    """Exact quantile with linear interpolation per group, plus ``n_values``; for values of any range, without a window.

    A mergeable sketch of each group gives two of its values around the rank. A second pass folds the values between them and counts those below,
    and the quantile is read off the folded values. The sketch errs by about one in ``accuracy`` rows, more finely if groups are so large that
    more than ``most`` rows would lie between; should it have missed the rank of a group, the second pass shows it, and wider values are taken.
    """
    groups = list(groups)
    names, v = groups or ["_all"], F.col("_v")
    keyed = [F.col(g) for g in groups] or [F.lit(0).alias("_all")]
    rows = df.filter(F.col(value).isNotNull()).select(*keyed, F.col(value).alias("_v"))
    at = (F.col("n_values") - 1) * F.lit(float(q))

    def around(margin: float, accuracy: int) -> DataFrame:
        ends = [F.percentile_approx("_v", min(max(q + m, 0.0), 1.0), accuracy).alias(n) for n, m in (("_lo", -margin), ("_hi", margin))]
        return stored(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_values"), *ends), "quantile")

    margin = 2.0 / accuracy
    known = around(margin, accuracy)
    largest = known.agg(F.max("n_values")).first()[0] or 0
    if largest * 3 * margin > most:
        accuracy = int(largest * 6 / most)
        margin = 2.0 / accuracy
        known = around(margin, accuracy)
    while True:
        # below the two values a row counts only: all such rows of a group are folded into one, without a value
        folded = rows.join(known, names).filter(v <= F.col("_hi")).groupBy(
            *names, "n_values", F.when(v >= F.col("_lo"), v).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        entry = F.when(v.isNotNull(), F.struct("_v", "_n"))
        per_group = stored(folded.groupBy(*names, "n_values").agg(
            F.coalesce(F.sum(F.when(v.isNull(), F.col("_n"))), F.lit(0)).alias("_below"), F.sum("_n").alias("_reach"),
            F.sort_array(F.collect_list(entry)).alias("_held")), "quantile")
        if margin >= 1 or per_group.filter((F.col("_below") > F.floor(at)) | (F.col("_reach") <= F.ceil(at))).isEmpty():
            break
        margin *= 8
        known = around(margin, accuracy)

    def reached(rank: Column) -> Column:
        """The value of a 0-based rank."""
        start = F.struct(F.col("_below").alias("seen"), F.lit(None).cast("double").alias("found"))
        step = lambda s, x: F.struct(
            (s["seen"] + x["_n"]).alias("seen"),
            F.when(s["found"].isNull() & (s["seen"] + x["_n"] > rank), x["_v"].cast("double")).otherwise(s["found"]).alias("found"))
        return F.aggregate("_held", start, step)["found"]

    read = per_group.select(*names, "n_values", reached(F.floor(at)).alias("_low"), reached(F.ceil(at)).alias("_high"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))
    return read.select(*groups, between.alias(out), "n_values")
