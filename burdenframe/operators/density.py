"""Gaussian kernel density of log ratios on a common grid per bin."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = 500
#: Width of a cell in bandwidths, and terms of the series in a cell. A value lies at most a quarter of a bandwidth from the middle, so what the
#: series leaves out is below 1.1 * sum(0.25**k / sqrt(k!) for k >= 16), 6e-17 of the kernel's height per value.
CELL, TERMS = 0.5, 16
SPREAD = np.sqrt(2 * np.pi)


def density_curves(values: DataFrame, n_grid: int = GRID) -> DataFrame:
    """``bin, side, grid_idx, x, density`` of ``bin, side, v`` rows.

    The grid spans all sides of a bin, one unit beyond its extremes. Bandwidth follows Scott's rule
    with the sample deviation. Values are put into cells of half a bandwidth, and of each cell only the sums of powers of the distances from its
    middle are kept: they are the coefficients of the cell's curve in Hermite polynomials. So a value costs a few multiplications in one
    aggregation, not an exponential for each point of the grid, and the curves are made from one row per cell.
    """
    values = values.filter(F.col("v").isNotNull())
    span = values.groupBy("bin").agg((F.min("v") - 1).alias("lo"), (F.max("v") + 1).alias("hi"))
    shape = (
        values.groupBy("bin", "side").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"))
        .filter((F.col("n") > 1) & (F.col("sd") > 0))
        .withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .join(span, "bin")
    )
    key = ["bin", "side", "n", "h", "lo", "hi"]
    at = F.floor((F.col("v") - F.col("lo")) / (F.col("h") * CELL))
    placed = values.join(shape.select(*key), ["bin", "side"]).withColumn("cell", at)
    placed = placed.withColumn("t", (F.col("v") - F.col("lo")) / F.col("h") - (F.col("cell") + 0.5) * CELL)
    powers = [F.lit(1.0)]
    for _ in range(1, TERMS):
        powers.append(powers[-1] * F.col("t"))
    cells = placed.groupBy(*key, "cell").agg(F.array(*[F.sum(p) for p in powers]).alias("sums"))
    schema = pa.schema([("bin", pa.string()), ("side", pa.string()), ("grid_idx", pa.int32()), ("x", pa.float64()), ("part", pa.float64())])

    def curve(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """The grid, and what a cell adds to it."""
        x = np.linspace(row["lo"], row["hi"], n_grid)
        u = (x - row["lo"]) / row["h"] - (row["cell"] + 0.5) * CELL
        before, now, total = np.zeros(n_grid), np.ones(n_grid), np.zeros(n_grid)
        for k, s in enumerate(row["sums"]):
            total += s / factorial(k) * now
            before, now = now, u * now - k * before
        return x, total * np.exp(-0.5 * u * u) / (row["n"] * row["h"] * SPREAD)

    def grid_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
            for row in batch.to_pylist():
                x, part = curve(row)
                own = row["bin"], row["side"]
                found[own] = (x, found[own][1] + part if own in found else part)
            for (bin_, side), (x, total) in found.items():
                columns = [[bin_] * n_grid, [side] * n_grid, np.arange(n_grid, dtype=np.int32), x, total]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return (
        cells.mapInArrow(grid_sums, "bin string, side string, grid_idx int, x double, part double")
        .groupBy("bin", "side", "grid_idx")
        .agg(F.first("x").alias("x"), F.sum("part").alias("density"))
    )


def ratio_densities(log_ratios: DataFrame, n_grid: int = GRID) -> DataFrame:
    """Curves of the phenotype and null log ratios of every bin."""
    sides = F.stack(F.lit(2), F.lit("pheno"), F.col("log2_pheno"), F.lit("null"), F.col("log2_null"))
    return density_curves(log_ratios.select("bin", sides.alias("side", "v")), n_grid)
