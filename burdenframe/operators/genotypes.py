"""Genotype matrices for variant-set tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burdenframe.functions.text import variant_id

ROW_GROUP_BYTES = 8 << 20  # small, so that a block is found without reading many others


def genotype_long(entries: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """``variant_id, s, AC``, one row per variant and sample.

    A repeated pair raises an error, or keeps the largest count with ``on_duplicate="max"``.
    """
    pairs = entries.groupBy("contig", "pos", "alleles", "s").agg(
        F.max("AC").alias("AC"), F.count(F.lit(1)).alias("_n")
    )
    ac = F.col("AC")
    if on_duplicate == "error":
        ac = F.when(F.col("_n") == 1, ac).otherwise(
            F.raise_error(F.lit("a sample has several entries at one variant")).cast("int")
        )
    elif on_duplicate != "max":
        raise ValueError("on_duplicate must be 'error' or 'max'")
    return pairs.select(
        variant_id(F.col("contig"), F.col("pos"), F.col("alleles")).alias("variant_id"), "s", ac.alias("AC")
    )


def genotype_matrix(long: DataFrame, sample_ids: Sequence[str], fill: int | None = 0) -> DataFrame:
    """One row per variant and one column per named sample; for export only, the long form scales."""
    wide = long.groupBy("variant_id").pivot("s", list(sample_ids)).agg(F.max("AC"))
    return wide if fill is None else wide.na.fill(fill)


def sample_index(samples: DataFrame, block: Column) -> DataFrame:
    """``s, block, position, size``: samples in blocks of bounded size, numbered from 0 in each in the order of ``s``."""
    dealt = samples.select("s", block.cast("long").alias("block")).distinct()
    own = Window.partitionBy("block")
    position = F.row_number().over(own.orderBy("s")) - 1
    return dealt.select("s", "block", position.alias("position"), F.count(F.lit(1)).over(own).cast("int").alias("size"))


def genotype_blocks(long: DataFrame, index: DataFrame) -> DataFrame:
    """The whole genotype matrix as sparse vectors: ``variant_id, block, size, positions, counts``, one row per variant and block with a call.

    ``positions`` ascend and have the allele counts beside them; samples in between have no call. A row holds a block of samples at most,
    so neither a common variant nor a large cohort makes it longer. Samples that the index lacks are left out.
    """
    placed = long.join(index.hint("merge"), "s").groupBy("variant_id", "block").agg(  # an index has a row per sample: too much for every task
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("position", "AC"))).alias("_calls"))
    return placed.select("variant_id", "block", "size", F.col("_calls.position").alias("positions"), F.col("_calls.AC").alias("counts"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Column groups in the order of their blocks, each sorted by variant. A file holds the blocks of a range, and its statistics say which, so a
    reader of some samples reads their row groups only, and the files grow in number with the calls, not with blocks times tasks."""
    blocks.repartitionByRange("block", "variant_id").sortWithinPartitions("block", "variant_id").write.option(
        "parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def export_block(spark: SparkSession, path: str, index: DataFrame, block: int, fill: int | None = 0) -> DataFrame:
    """One column group as a wide table: a row per variant with a call in it, a column per sample of the block. No shuffle."""
    names = [r.s for r in index.filter(F.col("block") == block).orderBy("position").select("s").collect()]
    call = F.map_from_arrays("positions", "counts")
    rows = spark.read.parquet(path).filter(F.col("block") == block).select("variant_id", call.alias("_calls"))
    cell = lambda i: F.col("_calls")[F.lit(i)]
    return rows.select("variant_id", *[(cell(i) if fill is None else F.coalesce(cell(i), F.lit(fill))).alias(str(s)) for i, s in enumerate(names)])
