"""Readers, writers, inventories and text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.functions import genotype as G
from burdenframe.functions import text as X
from burdenframe.operators import burden, cohort, filters, genetable, genotypes, kinship
from burdenframe.plans import star_cohort as star
from burdenframe.plans.catalog.registry import query, r, rounded
from burdenframe.plans.catalog.sql import BIN_SUMS, WIDE_CELLS, extended, r as sr, sum_if, with_
from burdenframe.plans.workspace import work_folder
from burdenframe.sources import inventory as inv
from burdenframe.sources import metadata as meta
from burdenframe.sources import tables
from burdenframe.sources import vcf

SHARDS = 16
FILES_PER_TASK = 1000
NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # how Spark names a null
POOLS = [f"N{i}" for i in range(25)]  # one pooled sample per nation

# --- VCF text derived from the tables ---------------------------------------------------------------

POOLED_SQL = """
    pooled AS (
        SELECT 'N' || c_nationkey AS s, pos, max(ac) AS ac, max(dp) AS dp, max(ad1) AS ad1
        FROM calls JOIN customer ON s = c_custkey GROUP BY 1, 2)"""


def pooled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per nation and variant: the largest count and depth among its samples."""
    nations = star.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("s"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("pool")
    )
    return (
        star.calls(spark, sf_dir)
        .join(star.sorted_side(nations), "s")
        .groupBy(F.col("pool").alias("s"), "pos")
        .agg(F.max("AC").alias("AC"), F.max("DP").alias("DP"), F.max(F.get("AD", F.lit(1))).alias("ad1"))
    )


def pooled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled_calls(spark, sf_dir).join(star.sorted_side(star.variants(spark, sf_dir)), "pos")


def write_vcf(spark: SparkSession, sf_dir: str) -> str:
    """Multi-sample VCF files of the pooled calls, variants spread over shards by position."""
    gt = F.when(F.col("AC") == 0, "0/0").when(F.col("AC") == 1, "0/1").otherwise("1/1")
    cell = F.concat_ws(":", gt, F.concat_ws(",", F.col("DP") - F.col("ad1"), F.col("ad1")), "DP")
    cells = pooled_calls(spark, sf_dir).withColumn("cell", cell)
    per_site = cells.groupBy("pos").agg(
        *[F.max(F.when(F.col("s") == p, F.col("cell"))).alias(p) for p in POOLS]
    )
    sites = star.variants(spark, sf_dir).join(star.sorted_side(per_site), "pos")
    shard = F.pmod("pos", F.lit(SHARDS)).alias("shard")
    body = sites.select(
        F.concat_ws(
            "\t",
            F.concat(F.lit("chr"), "contig"), "pos", F.lit("."), F.get("alleles", F.lit(0)),
            F.concat_ws(",", F.slice("alleles", 2, 10)), F.lit("50"), F.lit("PASS"),
            F.concat(F.lit("DP=100;CSQ="), F.concat_ws("|", "impact", "gene", "HGNC_ID"), F.lit("|"),
                     F.coalesce(F.col("MAX_AF").cast("string"), F.lit(""))),
            F.lit("GT:AD:DP"), *[F.coalesce(F.col(p), F.lit("./.")) for p in POOLS],
        ).alias("value"),
        shard, F.col("pos").alias("at"),
    )
    fixed = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split()
    head = body.select("shard").distinct().select(
        F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.lit("\t".join([*fixed, *POOLS])))).alias("value"),
        "shard", F.lit(-1).alias("at"),
    )
    path = work_folder(spark, "vcf")
    lines = head.unionByName(body).repartition(SHARDS, "shard").sortWithinPartitions("shard", "at", "value")
    lines.select("value", "shard").write.partitionBy("shard").text(path)
    return path


@query("S01_vcf_scan", extended("calls variants", f", {POOLED_SQL}", f"SELECT p.s, v.contig, v.pos, array_to_string(v.alleles, ',') AS alleles, p.dp, p.ad1, p.ac, {sr('p.ad1::DOUBLE / p.dp')} AS vf FROM pooled p JOIN variants v ON p.pos = v.pos"))
def vcf_scan(spark, d):
    found = vcf.read_vcf(spark, write_vcf(spark, d), glob="*.txt")
    return found.filter(F.col("AC").isNotNull()).select(
        "s", "contig", "pos", F.concat_ws(",", "alleles").alias("alleles"), F.col("DP").alias("dp"),
        F.get("AD", F.lit(1)).alias("ad1"), F.col("AC").alias("ac"), r("VF").alias("vf"),
    )


@query("S02_resolve_inputs", "SELECT count(DISTINCT l_partkey) AS n_sites FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def resolve_inputs(spark, d):
    root = write_vcf(spark, d)
    listing = work_folder(spark, "list")
    inv.list_files(spark, root).filter(F.col("name").endswith(".txt")).select(
        F.col("path").alias("value")
    ).write.text(listing)
    sites = vcf.read_sites(spark, vcf.paths_from_list(spark, listing), glob="*.txt")
    return sites.filter("block = 0").agg(F.count(F.lit(1)).alias("n_sites"))


def write_sample_vcfs(spark: SparkSession, sf_dir: str) -> str:
    """One VCF file per customer, ``sample=NAME.vcf.txt``; a customer without calls has a header only."""
    cell = F.concat_ws(":", "gt", F.concat_ws(",", "AD"), "DP")
    info = F.concat(F.lit("DP=100;CSQ="), F.concat_ws("|", "impact", "gene", "HGNC_ID"), F.lit("|"),
                    F.coalesce(F.col("MAX_AF").cast("string"), F.lit("")))
    body = star.entries(spark, sf_dir).select(
        F.concat_ws(
            "\t", F.concat(F.lit("chr"), "contig"), "pos", F.lit("."), F.get("alleles", F.lit(0)),
            F.concat_ws(",", F.slice("alleles", 2, 10)), F.lit("50"), F.lit("PASS"), info, F.lit("GT:AD:DP"), cell,
        ).alias("value"),
        F.col("s").cast("string").alias("s"), F.col("pos").alias("at"),
    )
    fixed = "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split())
    samples = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("s"))
    head = samples.select(
        F.posexplode(F.array(F.lit("##fileformat=VCFv4.2"), F.concat_ws("\t", F.lit(fixed), "s"))).alias("i", "value"), "s"
    ).select("value", "s", (F.col("i") - 2).alias("at"))
    path = work_folder(spark, "sample-vcf")
    lines = head.unionByName(body).withColumn("name", F.concat(F.lit("sample="), F.coalesce(F.concat("s", F.lit("_x.vcf")), F.lit(NO_NAME)), F.lit(".txt")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-samples.count() // FILES_PER_TASK))  # by their number: the bytes are few
    vcf.write_files(lines.repartition(tasks, "name").sortWithinPartitions("name", "at", "value"), path)
    return path


def named_by_file(sites: DataFrame) -> DataFrame:
    """The file ``sample=NAME.vcf.txt`` holds the name."""
    return sites.withColumn("file_id", X.trim_prefix(X.file_stem(F.substring_index(F.element_at(F.split("file", "/"), -1), "=", -1))))


@query("S01_vcf_scan_files", with_("entries", f"SELECT CAST(s AS VARCHAR) AS s, contig, pos, array_to_string(alleles, ',') AS alleles, dp, ad1, ac, {sr('vf')} AS vf FROM entries"))
def vcf_scan_files(spark, d):
    """All customers, one file each, named by the file."""
    sites = named_by_file(vcf.read_sites(spark, write_sample_vcfs(spark, d), glob="*.txt"))
    return vcf.entries_of(sites, "file").select(
        "s", "contig", "pos", F.concat_ws(",", "alleles").alias("alleles"), F.col("DP").alias("dp"),
        F.get("AD", F.lit(1)).alias("ad1"), F.col("AC").alias("ac"), r("VF").alias("vf"),
    )


@query("S02_resolve_inputs_files", with_("entries", "SELECT count(*) AS n_calls, count(DISTINCT s) AS n_samples, count(DISTINCT pos) AS n_sites FROM entries"))
def resolve_inputs_files(spark, d):
    root = write_sample_vcfs(spark, d)
    listing = work_folder(spark, "list")
    inv.list_files(spark, root).filter(F.col("name").endswith(".txt")).select(
        F.col("path").alias("value")
    ).write.text(listing)
    return named_by_file(vcf.read_sites(spark, vcf.paths_from_list(spark, listing), glob="*.txt")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.countDistinct("file_id").alias("n_samples"), F.countDistinct("pos").alias("n_sites")
    )


def metadata_line() -> Column:
    """One line per customer; some have two fields only, one nation has no phenotype."""
    return F.concat_ws(
        "\t",
        F.concat(F.translate("c_name", "#", "-"), F.lit("_x.vcf")),
        F.when(F.col("c_nationkey") == 3, F.lit("")).otherwise(F.col("c_mktsegment")),
        F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit(" mut"), F.col("c_nationkey").cast("string"))),
    )


@query("S03_sample_metadata", """
    SELECT replace(c_name, '#', '-') AS s,
           CASE WHEN c_nationkey % 5 = 0 THEN 'NA' WHEN c_nationkey = 3 THEN '' ELSE c_mktsegment END AS phenotype,
           CASE WHEN c_nationkey % 5 = 0 THEN 'NA' ELSE 'mut' || c_nationkey END AS mutation,
           CAST(0 AS BIGINT) AS n_duplicates
    FROM customer""")
def sample_metadata(spark, d):
    path = work_folder(spark, "metadata")
    star.table(spark, d, "customer").select(metadata_line().alias("value")).write.text(path)
    return meta.read_metadata(spark, path)


@query("S04_load_cohort", with_("entries", f"SELECT s, contig, pos, gene, impact, dp, ac, {sr('vf')} AS vf FROM entries"))
def load_cohort(spark, d):
    path = work_folder(spark, "cohort")
    tables.save_cohort(filters.select_core(star.entries(spark, d)), path)
    found = tables.load_cohort(spark, path)
    return found.select(
        "s", F.col("contig").cast("string").alias("contig"), "pos", "gene", "impact",
        F.col("DP").alias("dp"), F.col("AC").alias("ac"), r("VF").alias("vf"),
    )


@query("S05_save_cohort", with_("kept", "SELECT contig, count(*) AS n, CAST(sum(ac) AS BIGINT) AS ac FROM kept GROUP BY contig"))
def save_cohort(spark, d):
    path = work_folder(spark, "cohort")
    tables.save_cohort(star.kept_entries(spark, d), path, overwrite=True)
    found = tables.load_cohort(spark, path)
    return found.groupBy(F.col("contig").cast("string").alias("contig")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("AC").alias("ac")
    )


def _stored_frequency_table(spark: SparkSession, d: str) -> str:
    table = burden.frequency_table(star.kept_entries(spark, d))
    folder = work_folder(spark, "freq")
    return tables.write_frequency_table(table, folder, "frequency_table", star.PHENOTYPE, overwrite=True)


@query("S06_write_frequency_table", with_("kept", f"SELECT gene, {WIDE_CELLS} FROM kept GROUP BY gene"))
def write_frequency_table(spark, d):
    return tables.read_frequency_table(spark, _stored_frequency_table(spark, d))


@query("S07_read_frequency_table", with_("kept", f"SELECT gene, {sum_if('max_af < 0.0001::DOUBLE OR (max_af > 0.0001::DOUBLE AND max_af < 0.001::DOUBLE) OR max_af > 0.001::DOUBLE')} AS total_burden FROM kept GROUP BY gene"))
def read_frequency_table(spark, d):
    found = tables.read_frequency_table(spark, _stored_frequency_table(spark, d))
    return genetable.with_total(found).select("gene", "total_burden")


@query("S08_gene_config", "SELECT DISTINCT lower(p_type) AS set_name, p_brand AS gene FROM part")
def gene_config(spark, d):
    """Lists per part type; their length is bounded by the number of brands."""
    names = ["ECONOMY", "SMALL", "STANDARD", "MEDIUM", "LARGE", "PROMO"]
    part = star.table(spark, d, "part").select("p_type", "p_brand").distinct()
    lists = [F.collect_list(F.when(F.col("p_type") == n, F.col("p_brand"))).alias(n.lower()) for n in names]
    path = work_folder(spark, "config")
    part.agg(*lists).write.json(path)
    return meta.read_gene_config(spark, path)


@query("S09_count_store", with_("kept labelled", f"SELECT gene, impact, {BIN_SUMS} FROM kept k JOIN labelled l ON k.s = l.s GROUP BY gene, impact"))
def count_store(spark, d):
    path = work_folder(spark, "counts")
    labelled = star.labelled_entries(spark, d)
    for flag in (F.col("is_case"), ~F.col("is_case")):
        tables.append_counts(burden.burden_by_impact(labelled.filter(flag)), path)
    return spark.read.parquet(path).groupBy("gene", "impact").agg(
        *[F.sum(b).alias(b) for b in burden.AF_BINS]
    )


PAIR_SQL = """
    pairs AS (
        SELECT a.s AS s_i, b.s AS s_j, count(*) AS n_shared,
               count(*) FILTER (WHERE a.ac = 1 AND b.ac = 1) AS n_hethet,
               count(*) FILTER (WHERE (a.ac = 0 AND b.ac = 2) OR (a.ac = 2 AND b.ac = 0)) AS n_opphom,
               count(*) FILTER (WHERE a.ac = 1) AS het_i, count(*) FILTER (WHERE b.ac = 1) AS het_j
        FROM biallelic a JOIN biallelic b ON a.pos = b.pos AND a.s < b.s GROUP BY 1, 2),
    phis AS (
        SELECT *, CASE WHEN least(het_i, het_j) > 0 THEN
            (2 * n_hethet - 4 * n_opphom - het_i - het_j)::DOUBLE / (4 * least(het_i, het_j)) + 0.5::DOUBLE END AS phi
        FROM pairs)"""
POOLED_BIALLELIC = f""", {POOLED_SQL}, biallelic AS (
    SELECT p.s, p.pos, p.ac FROM pooled p JOIN variants v ON p.pos = v.pos WHERE len(v.alleles) <= 2), {PAIR_SQL}"""


BIALLELIC_SQL = f""", biallelic AS (
    SELECT CAST(s AS VARCHAR) AS s, pos, max(ac) AS ac FROM entries WHERE len(alleles) <= 2 GROUP BY 1, 2), {PAIR_SQL}"""


def stored_relatedness(entries: DataFrame) -> DataFrame:
    """The sink's pairs, read again."""
    spark = entries.sparkSession
    path = work_folder(spark, "king")
    tables.write_relatedness(kinship.kinship(entries, None), path, compression="gzip")
    stored = spark.read.option("header", True).option("sep", "\t").schema(
        "s_i string, s_j string, n_shared long, phi double"
    ).csv(path)
    return rounded(stored)


@query("S10_relatedness_sink_all", extended("entries", BIALLELIC_SQL, f"SELECT s_i, s_j, n_shared, {sr('phi')} AS phi FROM phis"))
def relatedness_sink_all(spark, d):
    """All customers."""
    return stored_relatedness(star.entries(spark, d))


@query("S10_relatedness_sink", extended("variants calls", POOLED_BIALLELIC, f"SELECT s_i, s_j, n_shared, {sr('phi')} AS phi FROM phis"))
def relatedness_sink(spark, d):
    return stored_relatedness(pooled_entries(spark, d))


@query("S11_phenotype_vector", with_("labelled", "SELECT s AS sample_id, CAST(is_case AS INTEGER) AS phenotype FROM labelled"))
def phenotype_vector(spark, d):
    path = work_folder(spark, "vector")
    tables.write_phenotype_vector(cohort.label_cases(star.samples(spark, d), star.PHENOTYPE), path)
    return spark.read.parquet(f"{path}/phenotype_vector.parquet")


# --- file names derived from documents -----------------------------------------------------------------

FILES_SQL = """
    SELECT doc_id, source || '_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.genome' ELSE '' END || '.vcf' AS name,
           '/data/' || lang || '/' || source || '_' || doc_id
               || CASE WHEN doc_id % 3 = 0 THEN '.genome' ELSE '' END || '.vcf' AS path
    FROM documents"""


def document_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(
        F.col("source"), F.lit("_"), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 3 == 0, ".genome").otherwise(""), F.lit(".vcf"),
    )
    return star.table(spark, d, "documents").select(
        "doc_id", name.alias("name"), F.concat(F.lit("/data/"), "lang", F.lit("/"), name).alias("path")
    )


@query("S12_size_from_name", f"SELECT doc_id, CAST(nullif(regexp_extract(name, '[0-9]+'), '') AS INTEGER) AS n FROM ({FILES_SQL})")
def size_from_name(spark, d):
    return document_files(spark, d).select("doc_id", X.first_number(F.col("name")).alias("n"))


@query("S13_file_inventory", """
    SELECT source || '.vcf' AS name, count(*) AS n_files, count(*) - 1 AS n_duplicates
    FROM documents GROUP BY source""")
def file_inventory(spark, d):
    named = star.table(spark, d, "documents").select(
        F.concat("source", F.lit(".vcf")).alias("name"),
        F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), F.lit("/"), "source").alias("path"),
    )
    return inv.with_suffix(named, ".vcf").groupBy("name").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if("is_duplicate").alias("n_duplicates")
    )


@query("S14_clean_prefixes", f"SELECT doc_id, string_split(name, '.')[1] AS prefix FROM ({FILES_SQL}) WHERE len(string_split(name, '.')) < 3")
def clean_prefixes(spark, d):
    files = document_files(spark, d)
    prefixes = inv.clean_prefixes(files, "vcf")
    return prefixes.select(F.split_part("prefix", F.lit("_"), F.lit(2)).cast("long").alias("doc_id"), "prefix")


FILE_LIST_SQL = f"""
    WITH files AS (SELECT *, split_part(split_part(name, '.', 1), '_', 1) AS prefix,
                          regexp_matches(path, '(?i)/(EN|FR)/') AS ok FROM ({FILES_SQL})),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY name, path) AS rn FROM files),
    firsts AS (SELECT *, min(rn) FILTER (WHERE ok) OVER (PARTITION BY prefix) AS first_ok FROM ranked)
    SELECT doc_id, prefix, name, path, ok AS regex_match,
           CASE WHEN rn = first_ok THEN 'unique' WHEN rn > first_ok THEN 'duplicate' ELSE 'rejected' END AS status
    FROM firsts"""


@query("W01_first_per_prefix", FILE_LIST_SQL)
def first_per_prefix(spark, d):
    return inv.file_list(document_files(spark, d), "/(EN|FR)/")


@query("A22_inventory_counts", f"SELECT count(*) AS n_files, count(*) FILTER (WHERE status = 'unique') AS n_unique, count(*) FILTER (WHERE status = 'duplicate') AS n_duplicates, count(*) FILTER (WHERE status = 'rejected') AS n_regexed_out FROM ({FILE_LIST_SQL})")
def inventory_counts(spark, d):
    return inv.inventory_counts(inv.file_list(document_files(spark, d), "/(EN|FR)/"))


@query("S15_file_list", f"""
    SELECT prefix || chr(9) || path AS line, 'main' AS list FROM ({FILE_LIST_SQL}) WHERE status = 'unique'
    UNION ALL SELECT prefix || chr(9) || name || chr(9) || path, 'duplicates' FROM ({FILE_LIST_SQL})
    WHERE status = 'duplicate'""")
def file_list(spark, d):
    path = work_folder(spark, "filelist")
    inv.write_file_list(inv.file_list(document_files(spark, d), "/(EN|FR)/"), path)
    both = [
        spark.read.text(p).select(F.col("value").alias("line"), F.lit(n).alias("list"))
        for p, n in ((path, "main"), (f"{path}.duplicates", "duplicates"))
    ]
    return both[0].unionByName(both[1])


@query("O09_files_by_name", f"SELECT name, path FROM ({FILES_SQL})")
def files_by_name(spark, d):
    return document_files(spark, d).select("name", "path").orderBy("name", "path")


@query("S16_line_count", "SELECT count(*) AS n_lines FROM customer")
def line_count(spark, d):
    path = work_folder(spark, "lines")
    star.table(spark, d, "customer").select(metadata_line().alias("value")).write.text(path)
    return inv.line_count(spark, path)


@query("S17_unique_names", "SELECT count(DISTINCT c_mktsegment || CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END) AS n_unique FROM customer")
def unique_names(spark, d):
    name = F.concat("c_mktsegment", F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_name")))
    lines = star.table(spark, d, "customer").select(F.concat_ws("|", "c_custkey", name).alias("value"))
    return inv.count_unique_names(lines, 1, "|")


@query("S18_find_file", f"SELECT name, path FROM ({FILES_SQL}) WHERE name = 'src7_7.vcf'")
def find_file(spark, d):
    return inv.find_file(document_files(spark, d), "src7_7.vcf")


@query("S19_J10_annotate_from_table", """
    SELECT o_custkey AS s, CAST(l_partkey AS INTEGER) AS pos, l_linenumber % 3 AS ac,
           CASE WHEN hit THEN p_brand || '.' || p_type END AS gene,
           CASE WHEN hit THEN CAST(p_partkey AS INTEGER) END AS hgnc_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN (SELECT *, NOT (p_partkey % 97 = 0 AND p_partkey % 89 <> 0) AS hit FROM part) ON l_partkey = p_partkey""")
def annotate_from_table(spark, d):
    sites = star.variants(spark, d)
    raw = star.calls(spark, d).join(star.sorted_side(sites.select("pos", "contig", "alleles")), "pos")
    annotations = sites.select(
        "contig", "pos", F.lit("A").alias("ref"), F.lit("T").alias("alt"), "gene", "impact", "HGNC_ID", "MAX_AF"
    )
    found = vcf.annotate_from_table(raw, star.sorted_side(annotations))
    return found.select("s", "pos", F.col("AC").alias("ac"), "gene", F.col("HGNC_ID").alias("hgnc_id"))


@query("S20_reference_contigs", """
    SELECT CAST(1 + p_partkey % 22 AS VARCHAR) AS contig, max(p_partkey) AS length,
           CASE WHEN 1 + p_partkey % 22 = 21 THEN 'X' WHEN 1 + p_partkey % 22 = 22 THEN 'MT' ELSE 'autosome' END AS kind
    FROM part GROUP BY p_partkey % 22""")
def reference_contigs(spark, d):
    lengths = star.table(spark, d, "part").groupBy((F.col("p_partkey") % 22 + 1).cast("string").alias("name")).agg(
        F.max("p_partkey").alias("length")
    )
    path = work_folder(spark, "genome")
    region = F.struct(F.lit("21").alias("contig"), F.lit(1).alias("position"))
    lengths.agg(F.collect_list(F.struct("name", "length")).alias("contigs")).select(  # 22 contigs
        "contigs", F.array(F.lit("21")).alias("xContigs"), F.array(F.lit("none")).alias("yContigs"),
        F.array(F.lit("22")).alias("mtContigs"),
        F.array(F.struct(region.alias("start"), region.alias("end"))).alias("par"),
    ).write.json(path)
    return meta.read_reference_genome(spark, path)[0]


@query("S21_pending_files", f"SELECT doc_id, path FROM ({FILES_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_files(spark, d):
    files = document_files(spark, d)
    done = files.join(star.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return tables.pending_files(files, done).select("doc_id", "path")


@query("S22_burden_json", with_("kept", f"SELECT impact, gene, {BIN_SUMS} FROM kept GROUP BY impact, gene"))
def burden_json(spark, d):
    path = work_folder(spark, "raw")
    tables.write_burden_json(burden.burden_by_impact(star.kept_entries(spark, d)), path)
    fields = "impact string, gene string, " + ", ".join(f"{b} long" for b in burden.AF_BINS)
    return spark.read.schema(fields).json(path)


@query("S24_run_store", with_("four_long", "SELECT gene, bin, ac_case_pheno, 1000 AS iterations, 10 AS k, 639 AS case_n, 9059 AS control_n FROM four_long"))
def run_store(spark, d):
    path = work_folder(spark, "runs")
    long = star.gene_counts_long(spark, d).select("gene", "bin", "ac_case_pheno")
    tables.write_run(long, path, 1000, 10, 639, 9059)
    return spark.read.parquet(path)


VARIANT_ID_SQL = "v.contig || ':' || v.pos || '_[''' || array_to_string(v.alleles, ''', ''') || ''']'"
GENOTYPE_SQL = f"""
    SELECT {VARIANT_ID_SQL} AS variant_id, e.s, e.ac
    FROM (SELECT s, pos, max(ac) AS ac FROM kept GROUP BY s, pos) e JOIN variants v ON e.pos = v.pos"""


@query("S25_genotype_store", with_("kept", GENOTYPE_SQL))
def genotype_store(spark, d):
    path = work_folder(spark, "genotypes")
    tables.write_genotypes(genotypes.genotype_long(star.kept_entries(spark, d), "max"), path)
    return spark.read.parquet(path).select("variant_id", "s", F.col("AC").alias("ac"))


@query("S23_J11_pca_scores", """
    SELECT 'V' || vec_id AS genotype_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS pc1,
           round(embedding[2]::DOUBLE, 6) + 0.0 AS pc2, label AS population_code FROM embeddings""")
def pca_scores(spark, d):
    vectors = star.table(spark, d, "embeddings").withColumn(
        "genotype_id", F.concat(F.lit("V"), F.col("vec_id").cast("string"))
    )
    long = vectors.select("genotype_id", F.posexplode(F.slice("embedding", 1, 2)).alias("component", "score"))
    locations = vectors.select("genotype_id", F.col("label").alias("population_code"))
    scores = meta.pca_scores_long(long.withColumn("component", F.col("component") + 1), locations)
    return scores.select("genotype_id", r("PC1").alias("pc1"), r("PC2").alias("pc2"), "population_code")


# --- text functions -------------------------------------------------------------------------------------


@query("F01_trim_prefix", f"SELECT doc_id, split_part(split_part(name, '.', 1), '_', 1) AS prefix FROM ({FILES_SQL})")
def trim_prefix(spark, d):
    return document_files(spark, d).select("doc_id", X.trim_prefix(F.col("name")).alias("prefix"))


@query("F02_regex_search", "SELECT doc_id, regexp_matches(text, '(?i)licen[sc]e') AS hit FROM documents")
def regex_search(spark, d):
    return star.table(spark, d, "documents").select("doc_id", X.regex_found(F.col("text"), "licen[sc]e").alias("hit"))


@query("F03_list_member", with_("samples", "SELECT s, list_contains(string_split(phenotype, ','), 'N1') AS hit FROM samples"))
def list_member(spark, d):
    return star.samples(spark, d).select("s", X.in_delimited_list(F.col("phenotype"), "N1").alias("hit"))


@query("F04_contains_and_full_match", with_("samples", "SELECT s, contains(phenotype, 'BUILD') AS has, regexp_full_match(phenotype, 'BUILDING,N\\d') AS whole FROM samples"))
def contains_and_match(spark, d):
    p = F.col("phenotype")
    return star.samples(spark, d).select(
        "s", p.contains("BUILD").alias("has"), X.regex_full(p, r"BUILDING,N\d").alias("whole")
    )


@query("F05_split_and_stem", f"SELECT doc_id, regexp_replace(name, '\\.[^.]*$', '') AS stem, string_split(path, '/')[3] AS folder, trim('  ' || name || ' ') AS stripped FROM ({FILES_SQL})")
def split_and_stem(spark, d):
    return document_files(spark, d).select(
        "doc_id", X.file_stem(F.col("path")).alias("stem"),
        F.get(F.split("path", "/"), F.lit(2)).alias("folder"),
        X.python_strip(F.concat(F.lit(" \t"), "name", F.lit(" "))).alias("stripped"),
    )


@query("F06_missing_and_casts", """
    SELECT event_id, try_cast(nullif(json_extract_string(props, '$.k'), '') AS DOUBLE) AS k,
           coalesce(nullif(event_type, 'view'), 'NA') AS kind FROM events""")
def missing_and_casts(spark, d):
    events = star.table(spark, d, "events")
    return events.select(
        "event_id", X.number_or_null(F.get_json_object("props", "$.k")).alias("k"),
        X.na_if_blank(F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))).alias("kind"),
    )


@query("F07_variant_id", with_("variants", "SELECT pos, contig || ':' || pos || '_[''' || array_to_string(alleles, ''', ''') || ''']' AS variant_id FROM variants"))
def variant_id(spark, d):
    return star.variants(spark, d).select(
        "pos", X.variant_id(F.col("contig"), F.col("pos"), F.col("alleles")).alias("variant_id")
    )


@query("F10_array_utilities", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(len(embedding) * (len(embedding) - 1) AS BIGINT) AS total, CAST(len(list_concat(embedding, embedding)) AS INTEGER) AS doubled FROM embeddings")
def array_utilities(spark, d):
    e = F.col("embedding")
    steps = F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda i: i * 2)
    return star.table(spark, d, "embeddings").select(
        "vec_id", F.size(e).alias("n"),
        F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"),
        F.size(F.flatten(F.array(e, e))).alias("doubled"),
    )


# --- call text ---------------------------------------------------------------------------------------------

RAW_CONTIG_SQL = """CASE p_partkey % 26 WHEN 23 THEN 'chrX' WHEN 24 THEN 'chrY' WHEN 25 THEN 'chrM'
    WHEN 0 THEN 'GL000207.1' ELSE 'chr' || p_partkey % 26 END"""


def raw_contigs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 26
    raw = (
        F.when(k == 23, "chrX").when(k == 24, "chrY").when(k == 25, "chrM").when(k == 0, "GL000207.1")
        .otherwise(F.concat(F.lit("chr"), k.cast("string")))
    )
    return star.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("pos"), raw.alias("raw"))


RECODED_SQL = f"""SELECT CAST(p_partkey AS INTEGER) AS pos,
    CASE WHEN raw = 'chrM' THEN 'MT' ELSE regexp_replace(raw, '^chr', '') END AS contig
    FROM (SELECT p_partkey, {RAW_CONTIG_SQL} AS raw FROM part)"""


@query("P01_recode_contig", RECODED_SQL)
def recode_contig(spark, d):
    return raw_contigs(spark, d).select("pos", G.recode_contig(F.col("raw")).alias("contig"))


@query("P03_drop_mitochondrial", f"SELECT * FROM ({RECODED_SQL}) WHERE contig <> 'MT'")
def drop_mitochondrial(spark, d):
    return filters.drop_mitochondrial(recode_contig(spark, d))


def csq_text(spark: SparkSession, d: str) -> DataFrame:
    v = star.variants(spark, d)
    record = F.concat(
        F.concat_ws("|", "impact", "gene"), F.lit("|"),
        F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("HGNC_ID").cast("string")), F.lit("|"),
        F.coalesce(F.col("MAX_AF").cast("string"), F.lit("")),
    )
    info = F.concat(F.lit("AC=1;CSQ="), record, F.lit(",LOW|OTHER|1|0.5;DB"))
    return v.select("pos", info.alias("info"))


@query("P06_csq_fields", with_("variants", "SELECT pos, impact, gene, CASE WHEN pos % 5 <> 0 THEN hgnc_id END AS hgnc_id, max_af FROM variants"))
def csq_fields(spark, d):
    found = vcf.annotate_from_csq(csq_text(spark, d))
    return found.select("pos", "impact", "gene", F.col("HGNC_ID").alias("hgnc_id"), F.col("MAX_AF").alias("max_af"))


@query("P07_parse_empty", with_("variants", "SELECT pos, CASE WHEN pos % 5 <> 0 THEN pos::DOUBLE END AS value FROM variants"))
def parse_empty(spark, d):
    return csq_text(spark, d).select(
        "pos", X.number_or_null(F.get(G.csq_parts(F.col("info")), F.lit(2))).alias("value")
    )


@query("P09_alt_allele_count", "SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN NULL WHEN 5 THEN 2 WHEN 6 THEN 1 END AS ac FROM lineitem")
def alt_allele_count(spark, d):
    texts = ["0/0", "0|1", "1/1", "./.", "1|2", "2/0", "./1"]
    gt = F.get(F.array(*[F.lit(t) for t in texts]), F.col("l_linenumber") - 1)
    return star.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", G.alt_allele_count(gt).alias("ac")
    )


@query("P10_variant_fraction", with_("calls", f"SELECT s, pos, dp, {sr('ad1::DOUBLE / dp')} AS vf FROM calls"))
def variant_fraction(spark, d):
    return star.calls(spark, d).select("s", "pos", F.col("DP").alias("dp"), r("VF").alias("vf"))


@query("J02_stem_key", f"SELECT doc_id, quality FROM ({FILES_SQL}) JOIN labels USING (doc_id)")
def stem_key(spark, d):
    keyed = document_files(spark, d).select(
        "doc_id", F.concat_ws("-", X.trim_prefix(X.file_stem(F.col("path"))), F.col("doc_id")).alias("key")
    )
    docs = star.table(spark, d, "documents").select("doc_id", "source")
    marks = star.table(spark, d, "labels").join(docs, "doc_id").select(
        F.concat_ws("-", "source", "doc_id").alias("key"), "quality"
    )
    return keyed.join(marks, "key").select("doc_id", "quality")

