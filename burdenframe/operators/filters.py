"""Row, entry and sample filters over long entry tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burdenframe.functions import text as X
from burdenframe.plans.workspace import stored

MAX_AF = 0.01
MIN_VF = 0.3
MIN_DP = 30
INTERVAL_BIN = 1 << 14
MERGE_STRETCH = 1 << 20
FEW_INTERVALS = 64
LAST_POSITION = (1 << 31) - 1

CORE_COLUMNS = (
    "s", "contig", "pos", "alleles", "gene", "impact", "HGNC_ID", "MAX_AF", "gt", "AD", "DP", "VF", "AC",
)


def drop_mitochondrial(df: DataFrame) -> DataFrame:
    return df.filter(F.col("contig") != "MT")


def drop_star(df: DataFrame) -> DataFrame:
    """Drop sites whose first alternate allele is ``*``."""
    return df.filter(F.get("alleles", F.lit(1)) != "*")


def drop_multiallelic(df: DataFrame) -> DataFrame:
    return df.filter(F.size("alleles") <= 2)


def rare(df: DataFrame, max_af: float = MAX_AF) -> DataFrame:
    """Keep variants below the frequency limit; unknown frequency is dropped."""
    return df.filter(F.col("MAX_AF") < max_af)


def min_variant_fraction(df: DataFrame, min_vf: float = MIN_VF) -> DataFrame:
    return df.filter(F.col("VF") >= min_vf)


def min_depth(df: DataFrame, min_dp: int = MIN_DP) -> DataFrame:
    """Keep entries with strictly more reads than ``min_dp``."""
    return df.filter(F.col("DP") > min_dp)


def burden_filters(
    df: DataFrame, max_af: float = MAX_AF, min_vf: float = MIN_VF, min_dp: int = MIN_DP
) -> DataFrame:
    """All site and entry filters that precede the burden aggregation."""
    sites = rare(drop_star(drop_mitochondrial(df)), max_af)
    return min_depth(min_variant_fraction(sites, min_vf), min_dp)


def select_core(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Columns kept when cohorts are merged."""
    return df.select(*[c for c in (*CORE_COLUMNS, *extra) if c in df.columns])


def parse_interval(text: str) -> tuple[str, int, int]:
    """``contig``, ``contig:a-b`` or ``contig:a-contig:b`` as ``(contig, start, end)``, end excluded.

    ``start`` and ``end`` stand for the contig bounds and a ``chr`` prefix is removed.
    """
    m = re.fullmatch(r"(?:chr)?([^:\-\s]+)(?::([\d,]+|start)-(?:(?:chr)?([^:\s]+):)?([\d,]+|end))?", text.strip())
    if m is None or (m[3] is not None and m[3] != m[1]):
        raise ValueError(f"cannot read interval {text!r}")
    contig = "MT" if m[1] == "M" else m[1]
    if m[2] is None:
        return contig, 1, LAST_POSITION
    start = 1 if m[2] == "start" else int(m[2].replace(",", ""))
    end = LAST_POSITION if m[4] == "end" else int(m[4].replace(",", ""))
    return contig, start, end


def in_intervals(df: DataFrame, intervals: str | Sequence[str]) -> DataFrame:
    """Keep sites inside any interval, written as in ``parse_interval``. A few intervals are a filter that reaches the scan, more a table."""
    parsed = [parse_interval(t) for t in ([intervals] if isinstance(intervals, str) else intervals)]
    if len(parsed) > FEW_INTERVALS:
        return in_interval_table(df, df.sparkSession.createDataFrame(parsed, "contig string, start int, end int"))
    whole = {contig for contig, start, end in parsed if (start, end) == (1, LAST_POSITION)}
    inside = [(F.col("contig") == c) & (F.col("pos") >= start) & (F.col("pos") < end) for c, start, end in parsed if c not in whole]
    return df.filter(reduce(or_, inside, F.col("contig").isin(sorted(whole))))


def merged_intervals(intervals: DataFrame, stretch: int = MERGE_STRETCH) -> DataFrame:
    """Disjoint intervals that cover the same positions; ``whole`` marks those that hold a whole contig.

    Positions are cut into stretches. What lies before a row is known from its own stretch, by a window over that stretch alone, and from
    the maxima of the stretches before it, a table of at most 2**31 / ``stretch`` rows per contig.
    """
    rows = intervals.filter((F.col("end") > F.col("start")) & F.col("contig").isNotNull()).select(
        "contig", "start", "end", ((F.col("start") == 1) & (F.col("end") == LAST_POSITION)).alias("whole"))
    rows = rows.withColumn("_at", F.floor(F.col("start") / stretch))
    inside = Window.partitionBy("contig", "_at").orderBy("start", "end")
    earlier = Window.partitionBy("contig").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)

    def highest_before(df: DataFrame, value: Column, name: str, last: int) -> DataFrame:
        """Adds the maximum of ``value`` over the rows of the contig that come before, up to the row itself with ``last`` 0."""
        carried = df.groupBy("contig", "_at").agg(F.max(value).alias("_m")).select("contig", "_at", F.max("_m").over(earlier).alias("_carried"))
        own = F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, last))
        return df.withColumn("_own", own).join(carried, ["contig", "_at"]).withColumn(name, F.greatest("_own", "_carried")).drop("_own", "_carried")

    reached = highest_before(rows, F.col("end"), "_reached", -1)
    begins = F.when(F.col("_reached").isNull() | (F.col("start") > F.col("_reached")), F.col("start"))
    islands = highest_before(reached.withColumn("_begins", begins), F.col("_begins"), "_island", 0)
    return islands.groupBy("contig", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("whole").alias("whole")).drop("_island")


def in_interval_table(df: DataFrame, intervals: DataFrame, bin_size: int = INTERVAL_BIN) -> DataFrame:
    """Keep sites inside any row of ``(contig, start, end)``, end excluded.

    An interval from 1 to ``LAST_POSITION`` is a whole contig: it keeps every row of it, whatever its position, null included. Intervals
    are merged and stored. Each is a handful of bins of a width that suits it, ``bin_size`` times a power of 8, and sites meet them in an
    equi-join on contig, width and bin; a site has a row for each width in use, one as a rule, and lies in one interval at most. The
    bounds per contig (one row each on the driver) are filters that reach the scan.
    """
    width = F.lit(0)
    for level in range(1, 8):
        width = F.when(F.col("end") - F.col("start") > 8 * bin_size * 8 ** (level - 1), level).otherwise(width)
    merged = stored(merged_intervals(intervals).withColumn("width", width), "intervals")
    bounds = merged.groupBy("contig").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("whole").alias("whole"),
        F.collect_set(F.when(~F.col("whole"), F.col("width"))).alias("widths")).collect()
    whole = F.col("contig").isin([r.contig for r in bounds if r.whole])
    inside = [(F.col("contig") == r.contig) & (F.col("pos") >= r.start) & (F.col("pos") < r.end) for r in bounds if not r.whole]
    near = df.filter(reduce(or_, inside, whole))
    if not inside:
        return near
    widths = sorted({w for r in bounds for w in r.widths})
    at = lambda pos, w: F.floor(pos / (F.lit(float(bin_size)) * F.pow(F.lit(8.0), w))).cast("long")
    binned = merged.filter("NOT whole").select(
        F.col("contig").alias("_contig"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("width").alias("_w"),
        F.explode(F.sequence(at(F.col("start"), F.col("width")), at(F.col("end") - 1, F.col("width")))).alias("_bin"))
    if len(widths) == 1:
        placed = near.withColumn("_width", F.lit(widths[0]))
    else:  # a row of a whole contig stays one row
        placed = near.withColumn("_width", F.explode(F.when(whole, F.array(F.lit(-1))).otherwise(F.array(*map(F.lit, widths)))))
    meet = (F.col("contig") == F.col("_contig")) & (F.col("_width") == F.col("_w")) & (at(F.col("pos"), F.col("_width")) == F.col("_bin"))
    meet &= (F.col("pos") >= F.col("_start")) & (F.col("pos") < F.col("_end"))
    if len(inside) == len(bounds):
        return placed.join(binned, meet, "left_semi").drop("_width")
    found = placed.join(binned, meet, "left").filter(whole | F.col("_start").isNotNull())
    return found.drop("_contig", "_start", "_end", "_w", "_bin", "_width")


def phenotype_matches(df: DataFrame, pattern: str) -> DataFrame:
    """Keep samples whose phenotype text matches the pattern in full."""
    return df.filter(X.regex_full(F.col("phenotype"), pattern))


def require_rows(df: DataFrame, message: str, of: DataFrame | None = None) -> DataFrame:
    """``df``; raises ``message`` at run time when ``of``, by default ``df`` itself, is empty."""
    guard = (df if of is None else of).limit(1).agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    )
    return df.filter(guard.scalar())
