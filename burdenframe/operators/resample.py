"""Gene-set resampling: sampled sets, their burden ratios and what the extreme sets have in common.

Counts stay integers until a set has been summed; ``epsilon`` is then added once per gene of the
set. That equals adding it to every gene beforehand and makes sums independent of their order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from burdenframe.functions.numeric import log2_ratio
from burdenframe.functions.ordering import dense_index, exact_quantile
from burdenframe.functions.sampling import distinct_draws
from burdenframe.operators.genetable import COHORTS, EPSILON, TESTED_BINS

SEED = 12345
SET_SIZE = 10
#: Numbers of a gene table that go to every task at most: 64 MB.
MOST_CELLS = 8_000_000
ITERATIONS = 1_000_000
MIN_BURDEN = 1.0


def index_genes(wide: DataFrame) -> DataFrame:
    """Number the genes of a wide table 0..n-1 as ``gene_idx``."""
    index = dense_index(wide.select("gene"), "gene", "gene_idx")
    return wide.join(index, "gene")


def draw_sets(counters: DataFrame, genes: DataFrame, k: int = SET_SIZE, seed: int = SEED, shrink: bool = False) -> DataFrame:
    """``iter, drawn``: an array of ``k`` distinct gene numbers for each counter in column ``iter``.

    Each set is computed from its counter alone, row by row, without a shuffle. A set size above the
    number of genes raises an error, or is lowered to it with ``shrink``.
    """
    n = genes.select(F.count(F.lit(1)).cast("bigint")).scalar()
    too_many = F.raise_error(F.lit("set size is larger than the population")).cast("bigint")
    size = F.least(F.lit(k), F.col("_n")) if shrink else F.when(F.col("_n") < k, too_many).otherwise(F.lit(k))
    sized = counters.select("iter").withColumn("_n", n).withColumn("_k", size.cast("int"))
    return sized.select("iter", distinct_draws(seed, F.col("iter"), F.col("_n"), F.col("_k")).alias("drawn"))


def _of_top_sets(top: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of ``top`` with each ``gene_idx`` of their sets. Sets drawn as arrays meet ``top`` first and are taken apart then, so only those of top
    sets become rows. The join sorts: what is known of the size of the sets is that of their counters, ten times too small."""
    if "drawn" in sets.columns:
        return top.join(sets.select("iter", "drawn").hint("merge"), "iter").select(*top.columns, F.explode("drawn").alias("gene_idx"))
    return top.join(sets.select("iter", "gene_idx").hint("merge"), "iter")


def set_rows(sets: DataFrame) -> DataFrame:
    """``iter, pos, gene_idx`` of sets drawn as arrays."""
    return sets.select("iter", F.posexplode("drawn").alias("pos", "gene_idx"))


def sample_gene_sets(
    counters: DataFrame, genes: DataFrame, k: int = SET_SIZE, seed: int = SEED, shrink: bool = False
) -> DataFrame:
    """The rows of ``draw_sets``."""
    return set_rows(draw_sets(counters, genes, k, seed, shrink))


def _in_order(genes: DataFrame, columns: Sequence[str]) -> pa.Table | None:
    """Columns of the numbered genes by their numbers, or None if they are more than ``MOST_CELLS`` values: what every task may hold."""
    if genes.count() * len(columns) > MOST_CELLS:
        return None
    return genes.select("gene_idx", *columns).toArrow().sort_by("gene_idx").select(list(columns)).combine_chunks()


def genes_of_sets(sets: DataFrame, genes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``iter, pos, gene_idx`` and ``columns`` of every drawn gene, looked up by its number; by a join if the genes are too many."""
    table = _in_order(genes, columns)
    if table is None:
        return set_rows(sets).join(genes.select("gene_idx", *columns), "gene_idx").select("iter", "pos", "gene_idx", *columns)
    rows = set_rows(sets)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = table.take(batch.column("gene_idx")).combine_chunks()
            columns_found = [found.column(c).chunk(0) if batch.num_rows else found.column(c).combine_chunks() for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns_found], [*batch.schema.names, *columns])

    return rows.mapInArrow(look_up, StructType([*rows.schema.fields, *[genes.schema[c] for c in columns]]))


def counters(spark, iterations: int = ITERATIONS) -> DataFrame:
    return spark.range(iterations).withColumnRenamed("id", "iter")


def set_sums(sets: DataFrame, genes: DataFrame, n_bins: int) -> DataFrame:
    """Integer sums of every cohort and bin per set, plus the set size and the numbers of genes with a count.

    Sets drawn as arrays stay arrays: the counts of their genes are looked up by number in a table of checked size, so nothing is exploded,
    joined or shuffled. Sets as rows, and more genes than ``MOST_CELLS`` allows, are joined and summed in one aggregation.
    """
    cells = [f"{c}_{i}" for c in COHORTS for i in range(n_bins)]
    table = _in_order(genes, cells) if "drawn" in sets.columns else None
    if table is not None:
        return _looked_up_sums(sets, table, cells)
    joined = (set_rows(sets) if "drawn" in sets.columns else sets).join(genes.select("gene_idx", *cells), "gene_idx")
    sums = [F.sum(c).alias(c) for c in cells]
    carriers = [
        F.count_if(F.col(f"{c}_{i}") > 0).alias(f"n_{c}_{i}") for c in COHORTS for i in range(n_bins)
    ]
    return joined.groupBy("iter").agg(*sums, *carriers, F.count(F.lit(1)).alias("k"))


def _looked_up_sums(sets: DataFrame, table: pa.Table, cells: Sequence[str]) -> DataFrame:
    counts = np.column_stack([pc.fill_null(table.column(c), 0).to_numpy() for c in cells]) if table.num_rows else np.zeros((0, len(cells)), np.int64)
    counts = np.hstack([counts, counts > 0]).astype(np.int64)
    names = ["iter", *cells, *[f"n_{c}" for c in cells], "k"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column("drawn")
            sizes = drawn.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            some = np.flatnonzero(sizes)  # an empty set has no row, as in a join
            sums = np.zeros((len(some), counts.shape[1]), np.int64)
            if len(some):
                begins = (np.cumsum(sizes) - sizes)[some]
                sums = np.add.reduceat(counts[drawn.flatten().to_numpy()], begins, axis=0)
            columns = [pa.array(np.ascontiguousarray(sums[:, i])) for i in range(sums.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column("iter").take(pa.array(some)), *columns, pa.array(sizes[some])], names)

    return sets.mapInArrow(add, StructType([sets.schema["iter"], *[StructField(n, LongType()) for n in names[1:]]]))


def burden_ratios(
    sums: DataFrame, bins: Sequence[str] = TESTED_BINS, epsilon: float = EPSILON,
    min_burden: float = MIN_BURDEN,
) -> DataFrame:
    """One row per set and bin with sums, ratio and validity for the phenotype and the null split.

    A ratio is valid when both of its sums exceed ``min_burden``.
    """
    rows = [
        c
        for i, b in enumerate(bins)
        for c in (F.lit(b), *[F.col(f"{k}_{i}") for k in COHORTS], *[F.col(f"n_{k}_{i}") for k in COHORTS])
    ]
    names = ["bin", *[f"ac_{c}" for c in COHORTS], *[f"n_{c}" for c in COHORTS]]
    long = sums.select("iter", "k", F.stack(F.lit(len(bins)), *rows).alias(*names))
    long = long.withColumns({f"sum_{c}": F.col(f"ac_{c}") + F.col("k") * epsilon for c in COHORTS})
    fields = {}
    for side in ("pheno", "null"):
        case, control = F.col(f"sum_case_{side}"), F.col(f"sum_control_{side}")
        fields[f"ratio_{side}"] = F.try_divide(case, control)
        fields[f"valid_{side}"] = (case > min_burden) & (control > min_burden)
    return long.withColumns(fields)


def simulate(
    sets: DataFrame, genes: DataFrame, bins: Sequence[str] = TESTED_BINS, epsilon: float = EPSILON,
    min_burden: float = MIN_BURDEN,
) -> DataFrame:
    return burden_ratios(set_sums(sets, genes, len(bins)), bins, epsilon, min_burden)


def with_log_ratio(ratios: DataFrame, expected_pheno: Column | float, expected_null: Column | float) -> DataFrame:
    """``log2`` of valid ratios over the expected case/control ratio; invalid ones are NULL."""
    def column(v: Column | float) -> Column:
        return v if isinstance(v, Column) else F.lit(float(v))

    expected = ratios.withColumns({"_e_pheno": column(expected_pheno), "_e_null": column(expected_null)})
    fields = {
        f"log2_{side}": F.when(F.col(f"valid_{side}"), log2_ratio(F.col(f"ratio_{side}"), F.col(f"_e_{side}")))
        for side in ("pheno", "null")
    }
    return expected.withColumns(fields).drop("_e_pheno", "_e_null")


def retention(ratios: DataFrame) -> DataFrame:
    """Number of sets per bin that survive each filter."""
    both = F.col("valid_pheno") & F.col("valid_null")
    return ratios.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("valid_pheno").alias("n_pheno"),
        F.count_if("valid_null").alias("n_null"),
        F.count_if(both).alias("n_both"),
    )


def percentiles(log_ratios: DataFrame, side: str = "pheno", percent: float = 99.0) -> DataFrame:
    """``bin, threshold, n_values``: exact percentile of the log ratios per bin."""
    return exact_quantile(log_ratios, f"log2_{side}", ["bin"], percent / 100.0, "threshold")


def empirical_p(log_ratios: DataFrame, percent: float = 99.0) -> DataFrame:
    """One-sided empirical p per bin: share of null sets at or above the phenotype percentile.

    NULL for a bin without valid values on either side.
    """
    cut = percentiles(log_ratios, "pheno", percent).select("bin", "threshold")
    null = F.col("log2_null")
    counted = log_ratios.select("bin", "log2_null").join(F.broadcast(cut), "bin", "left").groupBy("bin").agg(
        F.count(null).alias("n_null"), F.count_if(null >= F.col("threshold")).alias("n_ge"),
        F.max("threshold").alias("threshold"),
    )
    defined = (F.col("n_null") > 0) & F.col("threshold").isNotNull()
    return counted.select(
        F.col("bin").alias("Frequency_Bin"),
        F.when(defined, (F.col("n_ge") + 1) / (F.col("n_null") + 1)).alias("Empirical_Pval_99thPercentile"),
    )


def top_sets(log_ratios: DataFrame, percent: float = 99.0, min_sets: int = 20) -> DataFrame:
    """Sets strictly above the percentile of their bin; bins with too few valid sets give none."""
    cut = percentiles(log_ratios, "pheno", percent).filter(F.col("n_values") >= min_sets)
    return log_ratios.join(F.broadcast(cut.select("bin", "threshold")), "bin").filter(
        F.col("log2_pheno") > F.col("threshold")
    )


def contributions(
    top: DataFrame, sets: DataFrame, genes: DataFrame, bins: Sequence[str] = TESTED_BINS,
    min_appearances: int = 1,
) -> DataFrame:
    """Per bin and gene: appearances in top sets, case burden summed over them, mean log ratio.

    ``min_appearances`` keeps genes seen at least that often.
    """
    pairs = [c for i, b in enumerate(bins) for c in (F.lit(b), F.col(f"case_pheno_{i}"))]
    burdens = genes.select("gene_idx", "gene", F.stack(F.lit(len(bins)), *pairs).alias("bin", "ac"))
    members = _of_top_sets(top.select("iter", "bin", "log2_pheno"), sets)
    seen = members.groupBy("bin", "gene_idx").agg(
        F.count(F.lit(1)).alias("appearance_in_top_sets"),
        F.avg("log2_pheno").alias("avg_log2_ratio_of_sets_involved_in"),
    )
    return (
        seen.filter(F.col("appearance_in_top_sets") >= min_appearances)
        .join(burdens, ["bin", "gene_idx"])
        .select(
            "gene", "bin", "appearance_in_top_sets",
            (F.col("ac") * F.col("appearance_in_top_sets"))
            .cast("double")
            .alias("summed_indiv_case_burden_in_top_sets"),
            "avg_log2_ratio_of_sets_involved_in",
        )
    )


def rank_contributors(contrib: DataFrame, n: int = 10) -> DataFrame:
    """Genes of one bin by mean log ratio, then appearances."""
    return contrib.orderBy(
        F.round("avg_log2_ratio_of_sets_involved_in", 9).desc(), F.col("appearance_in_top_sets").desc(), "gene"
    ).limit(n)


def gene_pairs(top: DataFrame, sets: DataFrame, genes: DataFrame, focus: DataFrame) -> DataFrame:
    """How often two of the ``focus`` genes share a top set, pairs in alphabetical order.

    A set holds as many genes as were drawn for it, so its pairs are taken inside the row of the set.
    """
    named = genes.select("gene_idx", "gene").join(focus.select("gene"), "gene", "left_semi")
    members = (
        _of_top_sets(top.select("iter").distinct(), sets)
        .join(named, "gene_idx")
        .groupBy("iter")
        .agg(F.array_sort(F.collect_list("gene")).alias("g"))
        .filter(F.size("g") >= 2)
    )
    pairs = F.flatten(
        F.transform(
            F.col("g"),
            lambda a, i: F.transform(
                F.slice(F.col("g"), i + 2, F.size("g")),
                lambda b: F.struct(a.alias("gene_1"), b.alias("gene_2")),
            ),
        )
    )
    return (
        members.select(F.explode(pairs).alias("p"))
        .groupBy("p.gene_1", "p.gene_2")
        .agg(F.count(F.lit(1)).alias("co_occurrence_count"))
    )


def rank_pairs(pairs: DataFrame, n: int | None = None) -> DataFrame:
    ordered = pairs.orderBy(F.col("co_occurrence_count").desc(), "gene_1", "gene_2")
    return ordered if n is None else ordered.limit(n)


def network_nodes(pairs: DataFrame, hub: str = "CAPN3") -> DataFrame:
    """Degree and drawing size per gene of the pair network."""
    ends = pairs.select(F.explode(F.array("gene_1", "gene_2")).alias("gene"))
    degree = ends.groupBy("gene").agg(F.count(F.lit(1)).alias("degree"))
    return degree.withColumns(
        {"node_size": F.col("degree") * 500 + 500, "is_hub": F.col("gene") == hub}
    )


def network_edges(pairs: DataFrame) -> DataFrame:
    """Edge width between 1 and 6, in proportion to the heaviest pair."""
    heaviest = pairs.select(F.max("co_occurrence_count")).scalar()
    return pairs.withColumn("_max", heaviest).select(
        "gene_1", "gene_2", F.col("co_occurrence_count").alias("weight"),
        (1 + F.col("co_occurrence_count") / F.col("_max") * 5).alias("edge_width"),
    )


def burden_events(
    log_ratios: DataFrame, percent: float = 99.0, min_variants: int = SET_SIZE, min_genes: int = 1
) -> DataFrame:
    """Top sets with more than ``min_variants`` alleles and ``min_genes`` carrying genes on each side."""
    enough = (
        (F.col("sum_case_pheno") > min_variants)
        & (F.col("sum_control_pheno") > min_variants)
        & (F.col("n_case_pheno") > min_genes)
        & (F.col("n_control_pheno") > min_genes)
    )
    return top_sets(log_ratios, percent).filter(enough)


def standardise(ratios: DataFrame, value: str = "x") -> DataFrame:
    """Centre and scale by the population deviation per bin; statistics are joined, not windowed, and sent to the tasks, a row per bin."""
    moments = ratios.groupBy("bin").agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    scale = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    return ratios.join(F.broadcast(moments), "bin").withColumn("z", (F.col(value) - F.col("_mean")) / scale).drop("_mean", "_sd")


def labelled_ratios(ratios: DataFrame) -> DataFrame:
    """Valid ratios of both splits stacked: ``bin, y, x`` with ``y`` 1 for the phenotype, 0 for null."""
    sides = F.stack(
        F.lit(2),
        F.lit(1), F.when(F.col("valid_pheno"), F.col("ratio_pheno")),
        F.lit(0), F.when(F.col("valid_null"), F.col("ratio_null")),
    )
    return ratios.select("bin", sides.alias("y", "x")).filter(F.col("x").isNotNull())
