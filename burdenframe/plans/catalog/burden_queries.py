"""Filters, cohort splits, merges, burden aggregation, genotypes, kinship and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from burdenframe.operators import burden, cohort, filters, genetable, genotypes, kinship
from burdenframe.plans import star_cohort as star
from burdenframe.plans.catalog.registry import query, r, rounded
from burdenframe.plans.catalog.source_queries import (
    BIALLELIC_SQL,
    GENOTYPE_SQL,
    POOLED_SQL,
    POOLS,
    VARIANT_ID_SQL,
    pooled_entries,
)
from burdenframe.plans.catalog.sql import (
    BIN_SUMS,
    WIDE_CELLS,
    extended,
    impact_bin,
    sum_if,
    with_,
)
from burdenframe.plans.catalog.sql import r as sr
from burdenframe.plans.workspace import stored, work_folder
from burdenframe.sources.metadata import first_per_sample
from burdenframe.streaming import ingest

ENTRY = ["s", "contig", "pos", "gene", "impact", "dp", "ac"]
ENTRY_SQL = ", ".join(ENTRY)


def shown(df):
    return df.select("s", "contig", "pos", "gene", "impact", F.col("DP").alias("dp"), F.col("AC").alias("ac"))


# --- filters --------------------------------------------------------------------------------------------


def interval_sql(test: str) -> str:
    return with_("entries", f"SELECT {ENTRY_SQL} FROM entries WHERE {test}")


@query("P02_interval_filter", interval_sql("contig = '7' OR (contig = '3' AND pos >= 100 AND pos < 1500) OR (contig = '11' AND pos >= 200 AND pos < 1000)"))
def interval_filter(spark, d):
    return shown(filters.in_intervals(star.entries(spark, d), ["3:100-1500", "chr7", "chr11:200-1000"]))


@query("P02_interval_table", interval_sql("""EXISTS (
    SELECT 1 FROM supplier WHERE CAST(1 + s_suppkey % 22 AS VARCHAR) = contig
    AND pos >= s_suppkey * 10 AND pos < s_suppkey * 10 + 300)"""))
def interval_table(spark, d):
    key = F.col("s_suppkey")
    intervals = star.table(spark, d, "supplier").select(
        (key % 22 + 1).cast("string").alias("contig"), (key * 10).alias("start"), (key * 10 + 300).alias("end")
    )
    return shown(filters.in_interval_table(star.entries(spark, d), intervals, bin_size=64))


def site_query(name: str, test: str, keep):
    @query(name, with_("variants", f"SELECT contig, pos, gene, max_af FROM variants WHERE {test}"))
    def run(spark, d):
        found = keep(star.variants(spark, d))
        return found.select("contig", "pos", "gene", F.col("MAX_AF").alias("max_af"))

    return run


site_query("P04_drop_star", "alleles[2] <> '*'", filters.drop_star)
site_query("P05_drop_multiallelic", "len(alleles) <= 2", filters.drop_multiallelic)
site_query("P08_rare_variants", "max_af < 0.01::DOUBLE", filters.rare)


@query("P11_min_variant_fraction", interval_sql("vf >= 0.3::DOUBLE"))
def min_variant_fraction(spark, d):
    return shown(filters.min_variant_fraction(star.entries(spark, d)))


@query("P12_min_depth", interval_sql("dp > 30"))
def min_depth(spark, d):
    return shown(filters.min_depth(star.entries(spark, d)))


@query("P13_attach_metadata", """
    SELECT c_name AS s, c_mktsegment AS phenotype, CASE WHEN c_nationkey = 0 THEN 'NA' ELSE 'n' || c_nationkey END AS mutation
    FROM customer UNION ALL SELECT s_name, 'NA', 'NA' FROM supplier""")
def attach_metadata(spark, d):
    customers = star.table(spark, d, "customer")
    metadata = customers.select(
        F.col("c_name").alias("s"), F.col("c_mktsegment").alias("phenotype"),
        F.when(F.col("c_nationkey") == 0, "").otherwise(F.concat(F.lit("n"), "c_nationkey")).alias("mutation"),
    )
    inputs = customers.select(F.col("c_name").alias("s")).unionByName(
        star.table(spark, d, "supplier").select(F.col("s_name").alias("s"))
    )
    return cohort.attach_metadata(inputs, metadata)


@query("P14_P15_core_columns", with_("entries", f"SELECT s, contig, pos, gene, impact, hgnc_id, max_af, gt, dp, {sr('vf')} AS vf, ac FROM entries"))
def core_columns(spark, d):
    core = filters.select_core(star.entries(spark, d)).drop("AD", "alleles")
    lower = core.select(*[F.col(c).alias(c.lower()) for c in core.columns])
    return lower.withColumn("vf", r("vf"))


@query("P16_phenotype_pattern", with_("samples", "SELECT s, phenotype FROM samples WHERE regexp_full_match(phenotype, '(BUILD|MACH).*')"))
def phenotype_pattern(spark, d):
    found = filters.phenotype_matches(star.samples(spark, d), "(BUILD|MACH).*")
    return filters.require_rows(found, "no sample matches").select("s", "phenotype")


# --- cohorts --------------------------------------------------------------------------------------------


@query("J01_case_control_split", with_("kept labelled", "SELECT is_case, count(*) AS n, CAST(sum(ac) AS BIGINT) AS ac, count(DISTINCT k.s) AS n_samples FROM kept k JOIN labelled l ON k.s = l.s GROUP BY is_case"))
def case_control_split(spark, d):
    entries, samples = star.kept_entries(spark, d), star.samples(spark, d)
    sides = [
        split(entries, samples, star.PHENOTYPE).withColumn("is_case", F.lit(flag))
        for split, flag in ((cohort.cases_only, True), (cohort.controls_only, False))
    ]
    return cohort.union_entries(sides).groupBy("is_case").agg(
        F.count(F.lit(1)).alias("n"), F.sum("AC").alias("ac"), F.countDistinct("s").alias("n_samples")
    )


@query("J03_null_cohort", with_("labelled", "SELECT s, is_case, is_null_case, CASE WHEN is_null_case THEN 'match' ELSE 'anti_match' END AS cohort FROM labelled"))
def null_cohort(spark, d):
    labelled = star.labelled_samples(spark, d)
    return cohort.null_split(labelled.select("s", "is_case"), labelled)


@query("W05a_hash_sample", "SELECT p_partkey FROM part QUALIFY row_number() OVER (ORDER BY md5('draw:' || p_partkey), p_partkey) <= (SELECT count(*) FROM supplier)")
def hash_sample(spark, d):
    n = star.table(spark, d, "supplier").select(F.count(F.lit(1))).scalar()
    return cohort.hash_sample(star.table(spark, d, "part").select("p_partkey"), "p_partkey", n, "draw")


@query("U03_difference", with_("samples labelled", "SELECT s FROM samples WHERE s NOT IN (SELECT s FROM labelled WHERE is_case)"))
def difference(spark, d):
    labelled = star.labelled_samples(spark, d)
    return labelled.select("s").exceptAll(labelled.filter("is_case").select("s"))


def calls_sql(sides: dict[str, str]) -> str:
    lists = ", ".join(f"string_agg(s || ':' || ac, ',' ORDER BY s, ac) FILTER ({test}) AS {name}" for name, test in sides.items())
    return f"SELECT contig, pos, s // 64 AS block, count(*) AS n_entries, {lists} FROM labelled_entries GROUP BY contig, pos, s // 64"


def calls_text(spark, d, sides):
    """The union of the tables that the filters make, each stored by site and blocks of 64 customers, with calls as text."""
    entries = stored(star.labelled_entries(spark, d), "entries")
    laid_out = {name: cohort.store_by_site(entries.filter(test), F.floor(F.col("s") / 64)) for name, test in sides.items()}
    texts = [F.array_join(F.transform(n, lambda c: F.concat_ws(":", c["s"], c["AC"])), ",").alias(n) for n in sides]
    return cohort.union_sites(laid_out).select("contig", "pos", "block", "n_entries", *texts)


@query("J04_column_union", with_("labelled_entries", calls_sql({"cases": "is_case", "controls": "NOT is_case"})))
def column_union(spark, d):
    return calls_text(spark, d, {"cases": F.col("is_case"), "controls": ~F.col("is_case")})


@query("J15_multi_way_union", with_("labelled_entries", calls_sql({i.lower(): f"impact = '{i}'" for i in burden.IMPACTS})))
def multi_way_union(spark, d):
    return calls_text(spark, d, {i.lower(): F.col("impact") == i for i in burden.IMPACTS})


@query("U01_row_union", with_("kept", "SELECT s, count(*) AS n, CAST(sum(ac) AS BIGINT) AS ac FROM kept GROUP BY s"))
def row_union(spark, d):
    e = star.labelled_entries(spark, d)
    merged = cohort.union_entries([e.filter("is_case"), e.filter("NOT is_case")])
    return merged.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("AC").alias("ac"))


@query("U02_table_union", "SELECT p_partkey AS key, p_brand AS brand, NULL AS nation FROM part UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def table_union(spark, d):
    part = star.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"))
    supp = star.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")
    )
    return cohort.union_entries([part, supp])


@query("W02_first_metadata_line", """
    SELECT o_custkey AS s, arg_min(o_orderpriority, o_orderkey) AS phenotype, arg_min(o_orderstatus, o_orderkey) AS mutation,
           count(*) - 1 AS n_duplicates FROM orders GROUP BY o_custkey""")
def first_metadata_line(spark, d):
    lines = star.table(spark, d, "orders").select(
        F.col("o_custkey").alias("s"), F.col("o_orderpriority").alias("phenotype"),
        F.col("o_orderstatus").alias("mutation"), F.col("o_orderkey").alias("at"),
    )
    return first_per_sample(lines)


# --- burden aggregation ------------------------------------------------------------------------------------


@query("A01_burden_by_impact", with_("kept", f"SELECT impact, gene, {BIN_SUMS} FROM kept GROUP BY impact, gene"))
def burden_by_impact(spark, d):
    return burden.burden_by_impact(star.kept_entries(spark, d))


@query("A01_A04_case_control_tables", with_("labelled_entries", f"SELECT CASE WHEN is_case THEN 'positive' ELSE 'negative' END AS cohort, gene, {WIDE_CELLS} FROM labelled_entries GROUP BY 1, 2"))
def case_control_tables(spark, d):
    split = cohort.split_cohort(star.kept_entries(spark, d), star.samples(spark, d), star.PHENOTYPE)
    return burden.frequency_table(split, ["cohort"])


def struct_columns(df, keys, bins):
    cells = [F.col(f"{i.lower()}.{b}").alias(f"{i.lower()}_{b}") for i in burden.IMPACTS for b in bins]
    return df.select(*keys, *cells)


def struct_sql(bins) -> str:
    return ", ".join(
        f"{sum_if(impact_bin(i, b))} AS {i.lower()}_{n}" for i in burden.IMPACTS for n, b in bins.items()
    )


@query("A02_sample_gene_structs", with_("kept", f"SELECT s, gene, {struct_sql(burden.OPEN_AF_BINS)} FROM kept GROUP BY s, gene"))
def sample_gene_structs(spark, d):
    return struct_columns(burden.sample_gene_structs(star.kept_entries(spark, d)), ["s", "gene"], burden.OPEN_AF_BINS)


@query("A03_legacy_gene_table", with_("entries", f"SELECT gene, {struct_sql(burden.LEGACY_AF_BINS)} FROM entries WHERE alleles[2] <> '*' AND vf >= 0.3::DOUBLE GROUP BY gene"))
def legacy_gene_table(spark, d):
    kept = filters.min_variant_fraction(filters.drop_star(star.entries(spark, d)))
    return struct_columns(burden.gene_structs(kept), ["gene"], burden.LEGACY_AF_BINS)


@query("A04_pivot", with_("kept", f"SELECT gene, {WIDE_CELLS} FROM kept GROUP BY gene"))
def pivot(spark, d):
    return burden.pivot_long(burden.to_long(burden.burden_by_impact(star.kept_entries(spark, d))))


LONG_SQL = " UNION ALL ".join(
    f"SELECT {{by}}gene, impact || '.{n}' AS bin, {n} AS ac FROM b" for n in burden.AF_BINS
)


@query("A05_sample_counts", extended("kept", f", b AS (SELECT s, impact, gene, {BIN_SUMS} FROM kept GROUP BY s, impact, gene)", LONG_SQL.format(by="s, ")))
def sample_counts(spark, d):
    return burden.sample_counts(star.kept_entries(spark, d))


@query("ST1_incremental_ingest", extended("kept", f", b AS (SELECT impact, gene, {BIN_SUMS} FROM kept GROUP BY impact, gene)", LONG_SQL.format(by="")))
def incremental_ingest(spark, d):
    """The call table arrives in files over several micro-batches; counts are stored per micro-batch and file and summed.

    Then a quarter of the files is delivered again and a finished batch is run again; neither counts twice.
    """
    return ingest.cohort_counts(ingest.stored_counts(spark, ingest_in_batches(spark, d)))


FILES, FILES_PER_BATCH = 16, 4


def ingest_in_batches(spark, d) -> str:
    """The store of counts."""
    path = work_folder(spark, "ingest")
    root, store = f"{path}/calls", f"{path}/store"
    items = star.table(spark, d, "lineitem").withColumn("file", F.pmod("l_orderkey", F.lit(FILES)))

    def deliver(rows, delivery):
        # one file in each folder, which names it, as Spark numbers the files it writes
        rows.repartition("file").write.option("maxRecordsPerFile", 0).partitionBy("file").parquet(f"{root}/{delivery}")

    def to_counts(batch):
        entries = filters.burden_filters(star.entries_of(batch, spark, d, ["file"]))
        return burden.sample_counts(entries, by=("s", "file"))

    def run():
        stream = spark.readStream.schema(items.drop("file").schema).option("recursiveFileLookup", "true").option(
            "maxFilesPerTrigger", FILES_PER_BATCH).parquet(root)
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        ingest.ingest(stream.withColumn("file", folder), to_counts, store, f"{path}/checkpoint").awaitTermination()

    deliver(items, "first")
    run()
    deliver(items.filter(F.col("file") % 4 == 0), "again")
    run()
    finished = stored(spark.read.parquet(f"{store}/batch_id=1"), "finished")
    ingest.append_batch(finished, store, 1)
    return store


@query("J07_add_counts", extended("kept", f", b AS (SELECT impact, gene, {BIN_SUMS} FROM kept GROUP BY impact, gene)", LONG_SQL.format(by="")))
def add_counts(spark, d):
    e = star.labelled_entries(spark, d)
    parts = [burden.to_long(burden.burden_by_impact(e.filter(f))) for f in ("is_case", "NOT is_case")]
    return burden.add_counts(parts)


SIDE_CELLS = ", ".join(
    sum_if(f"{test} AND {impact_bin(i, bounds)}") + f' AS "{i}.{b}_{side}"'
    for side, test in (("case", "is_case"), ("control", "NOT is_case"))
    for i in burden.IMPACTS
    for b, bounds in burden.AF_BINS.items()
)


@query("J05_case_control_join", with_("labelled_entries", f"SELECT gene, {SIDE_CELLS} FROM labelled_entries GROUP BY gene"))
def case_control_join(spark, d):
    e = star.labelled_entries(spark, d)
    return burden.join_case_control(*[burden.frequency_table(e.filter(f)) for f in ("is_case", "NOT is_case")])


@query("A05_J05_case_control_counts", with_("labelled_entries", f"SELECT gene, {SIDE_CELLS} FROM labelled_entries GROUP BY gene"))
def case_control_counts(spark, d):
    by_case = burden.burden_by_impact(star.labelled_entries(spark, d), ["is_case"])
    return burden.case_control_counts(burden.to_long(by_case, ["is_case"]))


POOL_CELLS = ", ".join(f"coalesce(max(p.ac) FILTER (WHERE p.s = '{n}'), 0) AS \"{n}\"" for n in POOLS)


@query("A06_genotype_matrix", extended("calls variants", f", {POOLED_SQL}", f"SELECT {VARIANT_ID_SQL} AS variant_id, {POOL_CELLS} FROM pooled p JOIN variants v ON p.pos = v.pos GROUP BY 1"))
def genotype_matrix(spark, d):
    long = genotypes.genotype_long(pooled_entries(spark, d))
    return genotypes.genotype_matrix(long, POOLS)


@query("A06_genotypes_long", with_("kept", GENOTYPE_SQL))
def genotypes_long(spark, d):
    long = genotypes.genotype_long(star.kept_entries(spark, d), "max")
    return long.select("variant_id", "s", F.col("AC").alias("ac"))


BLOCKS_SQL = f"""numbered AS (
    SELECT c_custkey AS s, c_custkey // 64 AS block, row_number() OVER (PARTITION BY c_custkey // 64 ORDER BY c_custkey) - 1 AS position,
        count(*) OVER (PARTITION BY c_custkey // 64) AS size FROM customer),
    matrix AS ({GENOTYPE_SQL})"""


def stored_blocks(spark, d):
    """The genotypes of all customers in column groups, and the index of the customers."""
    path = work_folder(spark, "genotype-blocks")
    index = stored(genotypes.sample_index(star.samples(spark, d), F.floor(F.col("s") / 64)), "sample-index")
    genotypes.write_blocks(genotypes.genotype_blocks(genotypes.genotype_long(star.kept_entries(spark, d), "max"), index), path)
    return path, index


@query("A06_genotype_blocks", extended("kept", f", {BLOCKS_SQL}", """SELECT variant_id, block, CAST(max(size) AS BIGINT) AS size,
    string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions, string_agg(CAST(ac AS VARCHAR), ',' ORDER BY position) AS counts
    FROM matrix JOIN numbered USING (s) GROUP BY variant_id, block"""))
def genotype_blocks(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    rows = spark.read.parquet(stored_blocks(spark, d)[0])
    return rows.select("variant_id", F.col("block").cast("long").alias("block"), F.col("size").cast("long").alias("size"), text("positions"), text("counts"))


BLOCK_CELLS = ", ".join(f'coalesce(max(ac) FILTER (WHERE s = {s}), 0) AS "{s}"' for s in range(64, 128))


@query("A06_block_export", extended("kept", f", {BLOCKS_SQL}", f"SELECT variant_id, {BLOCK_CELLS} FROM matrix WHERE s // 64 = 1 GROUP BY variant_id"))
def block_export(spark, d):
    path, index = stored_blocks(spark, d)
    return genotypes.export_block(spark, path, index, 1)


@query("A21_merged_lengths", with_("entries", f"SELECT {sr('avg(n)')} AS mean, {sr('stddev_pop(n)')} AS stdev, min(n) AS min, max(n) AS max, count(*) AS n, CAST(sum(n) AS BIGINT) AS sum FROM (SELECT pos, count(*) AS n FROM entries GROUP BY pos)"))
def merged_lengths(spark, d):
    return rounded(burden.merged_lengths(star.entries(spark, d)))


@query("A22_cohort_counts", with_("labelled", "SELECT count(*) AS n, count(*) FILTER (WHERE is_case) AS n_match, count(*) FILTER (WHERE NOT is_case) AS n_anti, count(*) FILTER (WHERE is_null_case) AS n_null FROM labelled"))
def cohort_counts(spark, d):
    return star.labelled_samples(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_case").alias("n_match"),
        F.count_if(~F.col("is_case")).alias("n_anti"), F.count_if("is_null_case").alias("n_null"),
    )


@query("A22_list_sizes", "SELECT p_type AS set_name, count(DISTINCT p_brand) AS n_genes FROM part GROUP BY p_type")
def list_sizes(spark, d):
    sets = star.table(spark, d, "part").select(F.col("p_type").alias("set_name"), F.col("p_brand").alias("gene"))
    return genetable.set_sizes(sets.distinct())


@query("A24_distinct_values", with_("kept", "SELECT count(DISTINCT gene) AS n_genes, count(DISTINCT s) AS n_samples, count(DISTINCT pos) AS n_sites FROM kept"))
def distinct_values(spark, d):
    return star.kept_entries(spark, d).agg(
        F.countDistinct("gene").alias("n_genes"), F.countDistinct("s").alias("n_samples"),
        F.countDistinct("pos").alias("n_sites"),
    )


# --- kinship ------------------------------------------------------------------------------------------------


@query("J12_pair_counts", extended("entries", BIALLELIC_SQL, "SELECT * FROM pairs"))
def pair_counts(spark, d):
    return kinship.pair_counts(kinship.biallelic_calls(star.entries(spark, d), None))


@query("A08_kinship", extended("entries", BIALLELIC_SQL, f"SELECT s_i, s_j, n_shared, {sr('phi')} AS phi FROM phis"))
def king(spark, d):
    return rounded(kinship.kinship(star.entries(spark, d), None))


@query("A09_likely_duplicates", extended("entries", BIALLELIC_SQL, f"SELECT s_i, s_j, n_shared, {sr('phi')} AS phi FROM phis WHERE phi > 0.4::DOUBLE"))
def likely_duplicates(spark, d):
    return rounded(kinship.find_duplicates(star.entries(spark, d)))
