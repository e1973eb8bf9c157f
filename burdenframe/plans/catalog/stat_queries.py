"""Gene tables, per gene-bin tests, corrections, rankings and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burdenframe.functions import numeric as N
from burdenframe.functions.ordering import exact_quantile
from burdenframe.operators import burden, gene_tests, genetable, multitest, summary
from burdenframe.plans import star_cohort as star
from burdenframe.plans.catalog.registry import query, r, rounded
from burdenframe.plans.catalog.sql import WIDE_CELLS, extended, neg_log10, sum_if, two_sided_p, with_
from burdenframe.plans.catalog.sql import r as sr
from burdenframe.plans.workspace import stored

COUNTS = ", ".join(genetable.COUNTS)
SLIM = [n for n in burden.bin_names() if not n.startswith("MODIFIER")]
WIDE = f", wide AS (SELECT gene, {WIDE_CELLS} FROM kept GROUP BY gene)"
SLIM_SQL = ", ".join(f'"{n}"' for n in SLIM)
NONZERO = " OR ".join(f'"{n}" <> 0' for n in SLIM)
TOTAL_SQL = " + ".join(f'"{n}"' for n in SLIM)


def slim_table(spark, d):
    return genetable.drop_matching_columns(burden.frequency_table(star.kept_entries(spark, d)))


@query("P17_P18_drop_modifier", extended("kept", WIDE, f"SELECT gene, {SLIM_SQL} FROM wide WHERE {NONZERO}"))
def drop_modifier(spark, d):
    return slim_table(spark, d)


@query("P19_total_burden", extended("kept", WIDE, f"SELECT gene, {SLIM_SQL}, {TOTAL_SQL} AS total_burden FROM wide WHERE {NONZERO}"))
def total_burden(spark, d):
    return genetable.with_total(slim_table(spark, d))


@query("P20_keep_genes", extended("kept gene_list", WIDE, f"SELECT gene, {SLIM_SQL} FROM wide WHERE ({NONZERO}) AND gene IN (SELECT gene FROM gene_list)"))
def keep_genes(spark, d):
    return genetable.keep_genes(slim_table(spark, d), star.listed_genes(spark, d))


@query("P21_drop_null_genes", "SELECT p_partkey, p_brand AS gene FROM part WHERE p_size % 5 NOT IN (0, 1)")
def drop_null_genes(spark, d):
    size = F.col("p_size") % 5
    gene = F.when(size == 0, F.lit("")).when(size > 1, F.col("p_brand"))
    return genetable.drop_null_genes(star.table(spark, d, "part").select("p_partkey", gene.alias("gene")))


@query("P22_add_epsilon", extended("kept", WIDE, "SELECT gene, " + ", ".join(sr(f'"{n}" + 0.01') + f' AS "{n}"' for n in SLIM) + f" FROM wide WHERE {NONZERO}"))
def add_epsilon(spark, d):
    return rounded(genetable.add_epsilon(slim_table(spark, d)))


def four(sql: str) -> str:
    return with_("four_long", sql)


@query("P23_min_counts", four(f"SELECT gene, bin, {COUNTS} FROM four_long WHERE ac_case_pheno >= 10 AND ac_control_pheno >= 10 AND ac_case_null >= 10 AND ac_control_null >= 10"))
def min_counts(spark, d):
    long = star.gene_counts_long(spark, d)
    for c in genetable.COUNTS:
        long = long.filter(F.col(c) >= 10)
    return long


@query("P24_infinite_ratio", four("SELECT gene, bin, ac_case_pheno AS case_burden, ac_control_pheno AS control_burden, 'inf' AS ratio_status FROM four_long WHERE ac_control_pheno = 0 AND ac_case_pheno >= 3"))
def infinite_ratio(spark, d):
    return genetable.infinite_ratio_genes(star.gene_counts_long(spark, d))


@query("P24_infinite_ratio_private_calls", with_("labelled_entries", f"""
    SELECT gene, bin, case_burden, control_burden, 'inf' AS ratio_status FROM (
        SELECT pos || ':' || s AS gene, impact AS bin, {sum_if('is_null_case')} AS case_burden,
               {sum_if('NOT is_null_case')} AS control_burden
        FROM labelled_entries GROUP BY 1, 2)
    WHERE control_burden = 0 AND case_burden >= 1 AND contains(bin, 'HIGH')"""))
def infinite_ratio_private_calls(spark, d):
    """Null split, one sample's calls at one site in place of a gene, HIGH impact only."""
    null = F.col("is_null_case")
    long = star.labelled_entries(spark, d).groupBy(
        F.concat_ws(":", "pos", "s").alias("gene"), F.col("impact").alias("bin")
    ).agg(burden.allele_sum(null).alias("case"), burden.allele_sum(~null).alias("control"))
    return genetable.infinite_ratio_genes(long, "case", "control", keyword="high", min_case=1)


@query("P25_fill_counts", with_("kept", "SELECT gene, " + ", ".join(f"{sum_if(f'''impact = '{i}' ''')} AS \"{i}\"" for i in burden.IMPACTS) + " FROM kept GROUP BY gene"))
def fill_counts(spark, d):
    raw = star.kept_entries(spark, d).groupBy("gene").pivot("impact", list(burden.IMPACTS)).agg(F.sum("AC"))
    return genetable.fill_counts(raw)


LOG_SQL = "CASE WHEN ac_case_pheno > 0 AND ac_control_pheno > 0 THEN log2(ac_case_pheno::DOUBLE / ac_control_pheno) END"


@query("P26_drop_infinite", four(f"SELECT gene, bin, {sr(LOG_SQL)} AS log2_ratio FROM four_long WHERE ac_case_pheno > 0 AND ac_control_pheno > 0"))
def drop_infinite(spark, d):
    long = star.gene_counts_long(spark, d)
    raw = F.when(F.col("ac_control_pheno") == 0, F.lit(float("inf"))).otherwise(
        N.log2_ratio(F.col("ac_case_pheno"), F.col("ac_control_pheno"))
    )
    kept = long.withColumn("log2_ratio", N.finite_or_null(raw)).na.drop(subset=["log2_ratio"])
    return rounded(kept.select("gene", "bin", "log2_ratio"))


@query("P27_zero_p_guard", f"SELECT event_id, {sr(neg_log10('CASE WHEN value < 5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / value END'))} AS y FROM events")
def zero_p_guard(spark, d):
    p = F.when(F.col("value") < 5, 0.0).otherwise(1.0 / F.col("value"))
    return star.table(spark, d, "events").select("event_id", r(N.neg_log10(p)).alias("y"))


@query("F08_logarithms", f"SELECT event_id, {sr('log2(value + 1)')} AS l2, {sr('ln(value + 1)')} AS le, {sr('exp(-value)')} AS ex, {sr('sqrt(value)')} AS sq, {sr('abs(value - 10)')} AS ab, {sr('-log10(value + 1)')} AS nl, {sr('1 / (1 + exp(-value))')} AS expit FROM events")
def logarithms(spark, d):
    v = F.col("value")
    return star.table(spark, d, "events").select(
        "event_id", r(F.log2(v + 1)).alias("l2"), r(F.log(v + 1)).alias("le"), r(F.exp(-v)).alias("ex"),
        r(F.sqrt(v)).alias("sq"), r(F.abs(v - 10)).alias("ab"), r(N.neg_log10(v + 1)).alias("nl"),
        r(N.expit(v)).alias("expit"),
    )


@query("F09_normal_tail", f"SELECT event_id, {sr(two_sided_p('value / 5'))} AS p, {sr(neg_log10(two_sided_p('value / 5')))} AS y FROM events")
def normal_tail(spark, d):
    events = star.table(spark, d, "events").select("event_id", (F.col("value") / 5).alias("z"))
    tail = events.withColumn("p", N.two_sided_p(F.col("z")))
    return tail.select("event_id", r("p").alias("p"), r(N.neg_log10(F.col("p"))).alias("y"))


@query("F11_round_4", "SELECT c_custkey, round(c_acctbal / 7, 4) + 0.0 AS x FROM customer")
def round_4(spark, d):
    return star.table(spark, d, "customer").select("c_custkey", (F.round(F.col("c_acctbal") / 7, 4) + 0.0).alias("x"))


# --- alignment --------------------------------------------------------------------------------------------


@query("J06_four_way_alignment", four(f"SELECT gene, bin, {COUNTS} FROM four_long"))
def four_way_alignment(spark, d):
    e = star.labelled_entries(spark, d)
    sides = ("is_case", "NOT is_case", "is_null_case", "NOT is_null_case")
    tables = {
        c: genetable.with_total(genetable.drop_matching_columns(burden.frequency_table(e.filter(side))))
        for c, side in zip(genetable.COHORTS, sides)
    }
    return genetable.align_tables(tables)


@query("J06_four_cohorts_one_pass", four(f"SELECT gene, bin, {COUNTS} FROM four_long"))
def four_cohorts(spark, d):
    return star.gene_counts_long(spark, d)


@query("U04_common_genes", with_("labelled_entries", "SELECT gene FROM labelled_entries GROUP BY gene HAVING bool_or(is_case) AND bool_or(NOT is_case) AND bool_or(is_null_case) AND bool_or(NOT is_null_case)"))
def common_genes(spark, d):
    e = star.labelled_entries(spark, d)
    sides = ("is_case", "NOT is_case", "is_null_case", "NOT is_null_case")
    return genetable.genes_on_every_side(e, sides)


@query("O05_genes_sorted", with_("four_wide", "SELECT gene, case_pheno_9 AS total_burden FROM four_wide ORDER BY gene"))
def genes_sorted(spark, d):
    return star.gene_counts(spark, d).select("gene", F.col("case_pheno_9").alias("total_burden")).orderBy("gene")


# --- tests --------------------------------------------------------------------------------------------------

FOLD = """, fold AS (
    SELECT gene, bin, ac_case_pheno AS case_burden, ac_control_pheno AS control_burden, ac_case_null AS nullcase_burden,
           ac_control_null AS nullcontrol_burden, ac_case_pheno::DOUBLE / ac_control_pheno AS pheno_ratio,
           ac_case_null::DOUBLE / ac_control_null AS null_ratio,
           log2((ac_case_pheno::DOUBLE / ac_control_pheno) / (ac_case_null::DOUBLE / ac_control_null)) AS log2_fold_change
    FROM four_long WHERE ac_case_pheno >= 10 AND ac_control_pheno >= 10 AND ac_case_null >= 10 AND ac_control_null >= 10)"""
FOLD_OUT = f"""SELECT gene, bin, case_burden, control_burden, nullcase_burden, nullcontrol_burden,
    {sr('pheno_ratio')} AS pheno_ratio, {sr('null_ratio')} AS null_ratio, {sr('log2_fold_change')} AS log2_fold_change FROM fold"""


def fold(spark, d):
    return gene_tests.fold_change(star.gene_counts_long(spark, d))


@query("T01_fold_change", extended("four_long", FOLD, FOLD_OUT))
def fold_change(spark, d):
    return rounded(fold(spark, d))


@query("O01_top_fold_changes", extended("four_long", FOLD, f"{FOLD_OUT} ORDER BY fold.log2_fold_change DESC, case_burden DESC, gene, bin LIMIT 20"))
def top_fold_changes(spark, d):
    return rounded(gene_tests.top_fold_changes(fold(spark, d)))


@query("P29_gene_lookup", extended("four_long", FOLD, f"{FOLD_OUT} WHERE gene = 'Brand#2.ECONOMY'"))
def gene_lookup(spark, d):
    return rounded(genetable.gene_lookup(fold(spark, d), "Brand#2.ECONOMY"))


@query("O08_preview", with_("four_wide", "SELECT gene, case_pheno_0, case_pheno_9 FROM four_wide ORDER BY gene LIMIT 5"))
def preview(spark, d):
    return star.gene_counts(spark, d).orderBy("gene").limit(5).select("gene", "case_pheno_0", "case_pheno_9")


FDR = """
    ranked AS (SELECT *, rank() OVER (ORDER BY p_val) + count(*) OVER (PARTITION BY p_val) - 1 AS rk,
                      count(*) OVER () AS m FROM tested),
    bh AS (SELECT *, min(p_val * m / rk) OVER (ORDER BY p_val DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj FROM ranked),
    staged AS (SELECT *, (SELECT count(*) FROM bh WHERE adj <= 0.05::DOUBLE) AS r1 FROM bh),
    corrected AS (SELECT *, CASE WHEN r1 > 0 AND r1 < m THEN (m - r1)::DOUBLE / m ELSE 1.0::DOUBLE END AS rest FROM staged)"""
TWO_PROP = f""", base AS (
        SELECT f.*, 2.0::DOUBLE * z.case_pheno AS n1, 2.0::DOUBLE * z.case_null AS n2 FROM four_long f, sizes z
        WHERE ac_case_pheno >= 5 AND ac_case_null >= 5),
    scored AS (
        SELECT *, ac_case_pheno / n1 AS p1_pheno, ac_case_null / n2 AS p2_null,
               (ac_case_pheno + ac_case_null) / (n1 + n2) AS pooled FROM base),
    zed AS (SELECT *, p1_pheno - p2_null AS effect_size, sqrt(greatest(pooled * (1 - pooled), 0) * (1 / n1 + 1 / n2)) AS se FROM scored),
    tested AS (SELECT *, effect_size / se AS z_score, {two_sided_p('effect_size / se')} AS p_val FROM zed WHERE se > 0),
    {FDR}"""
Z_OUT = f"""{sr('z_score')} AS z_score, {sr('p_val')} AS p_val"""
FDR_OUT = f"""{sr('least(adj, 1.0) * rest')} AS pval_bonferroni, (adj <= 0.05::DOUBLE / rest) AS significant_bonferroni,
    {sr(neg_log10('least(adj, 1.0) * rest'))} AS neg_log10_adjusted"""
T02_OUT = f"""SELECT gene, bin, ac_case_pheno, ac_case_null, {sr('p1_pheno')} AS p1_pheno, {sr('p2_null')} AS p2_null,
    {sr('effect_size')} AS effect_size, {Z_OUT}, {FDR_OUT} FROM corrected"""


def counts_and_sizes(spark, d):
    labelled = star.labelled_samples(spark, d)
    return star.gene_counts_long(spark, d, labelled), gene_tests.sizes_of(labelled)


def two_proportion(spark, d):
    return gene_tests.two_proportion_z(*counts_and_sizes(spark, d))


@query("T02_two_proportion_z", extended("four_long sizes", TWO_PROP, T02_OUT))
def two_proportion_z(spark, d):
    return rounded(two_proportion(spark, d))


BONFERRONI = "corrected AS (SELECT *, count(*) OVER () AS m FROM tested)"
BONF_OUT = f"""{sr('least(p_val * m, 1.0)')} AS pval_bonferroni, (p_val <= 0.05::DOUBLE / m) AS significant_bonferroni,
    {sr(neg_log10('least(p_val * m, 1.0)'))} AS neg_log10_adjusted"""
ALLELES = ", ".join(f"2.0::DOUBLE * z.{c} AS n_{c}" for c in genetable.COHORTS)
BASE4 = f"""base AS (
        SELECT f.*, {ALLELES} FROM four_long f, sizes z
        WHERE ac_case_pheno + ac_control_pheno >= 5 AND ac_case_null + ac_control_null >= 5)"""
PROPS = ", ".join(f"ac_{c} / n_{c} AS p_{c}" for c in genetable.COHORTS)
VARIANCE = " + ".join(f"greatest(p_{c} * (1 - p_{c}) / n_{c}, 0)" for c in genetable.COHORTS)
DIFF = f""", {BASE4}, props AS (SELECT *, {PROPS} FROM base),
    zed AS (SELECT *, p_case_pheno - p_control_pheno AS delta_p_pheno, p_case_null - p_control_null AS delta_p_null,
                   sqrt({VARIANCE}) AS se FROM props),
    scored AS (SELECT *, delta_p_pheno - delta_p_null AS effect FROM zed WHERE se > 0),
    tested AS (SELECT *, effect / se AS z_score, {two_sided_p('effect / se')} AS p_val FROM scored),
    {BONFERRONI}"""


@query("T03_diff_of_proportions_z", extended("four_long sizes", DIFF, f"SELECT gene, bin, {COUNTS}, {sr('delta_p_pheno')} AS delta_p_pheno, {sr('delta_p_null')} AS delta_p_null, {sr('effect')} AS effect_size_diff_of_diffs, {Z_OUT}, {BONF_OUT} FROM corrected"))
def diff_of_proportions_z(spark, d):
    return rounded(gene_tests.diff_of_proportions_z(*counts_and_sizes(spark, d)))


def cells(side: str) -> tuple[str, str, str, str]:
    x, y, nx, ny = f"ac_case_{side}", f"ac_control_{side}", f"n_case_{side}", f"n_control_{side}"
    return f"({x} + 0.5::DOUBLE)", f"({nx} - {x} + 0.5::DOUBLE)", f"({y} + 0.5::DOUBLE)", f"({ny} - {y} + 0.5::DOUBLE)"


def log_or(side: str) -> str:
    a, b, c, d = cells(side)
    return f"ln(({a} * {d}) / ({b} * {c}))"


VAR_OR = " + ".join(f"1 / {c}" for side in ("pheno", "null") for c in cells(side))
LOG_ODDS = f""", {BASE4},
    zed AS (SELECT *, {log_or('pheno')} AS log_or_pheno, {log_or('null')} AS log_or_null, {VAR_OR} AS variance FROM base),
    scored AS (SELECT *, log_or_pheno - log_or_null AS effect FROM zed WHERE variance > 1e-12::DOUBLE),
    tested AS (SELECT *, effect / sqrt(variance) AS z_score, {two_sided_p('effect / sqrt(variance)')} AS p_val FROM scored),
    {BONFERRONI}"""
T04_OUT = f"""SELECT gene, bin, {sr('log_or_pheno')} AS log_or_pheno, {sr('log_or_null')} AS log_or_null,
    {sr('effect')} AS effect_size_diff_log_or, {Z_OUT}, {COUNTS}, {BONF_OUT} FROM corrected"""


def log_odds(spark, d):
    return gene_tests.log_odds_difference_z(*counts_and_sizes(spark, d))


@query("T04_log_odds_difference_z", extended("four_long sizes", LOG_ODDS, T04_OUT))
def log_odds_difference_z(spark, d):
    return rounded(log_odds(spark, d))


@query("J08_counts_beside_tests", extended("four_long sizes", LOG_ODDS, f"SELECT gene, bin, {sr('p_val')} AS p_val, {', '.join(genetable.COUNTS)} FROM corrected"))
def counts_beside_tests(spark, d):
    long, sizes = counts_and_sizes(spark, d)
    z = gene_tests.log_odds_difference_z(long, sizes).select("gene", "bin", "p_val")
    return rounded(gene_tests.counts_beside(z, long))


DISCOVERY = f"""SELECT t.gene, t.bin, {sr('t.p_val')} AS p_val, {sr('f.log2_fold_change')} AS log2_fold_change,
    {sr(neg_log10('t.p_val'))} AS neg_log10_raw_pval FROM tested t JOIN fold f ON t.gene = f.gene AND t.bin = f.bin"""


def discovery(spark, d):
    long, sizes = counts_and_sizes(spark, d)
    return gene_tests.discovery_table(gene_tests.log_odds_difference_z(long, sizes), gene_tests.fold_change(long))


@query("J09_discovery_table", extended("four_long sizes", LOG_ODDS + FOLD, DISCOVERY))
def discovery_table(spark, d):
    return rounded(discovery(spark, d))


@query("T06_O04_top_discoveries", extended("four_long sizes", LOG_ODDS + FOLD, f"{DISCOVERY} ORDER BY neg_log10_raw_pval DESC, t.gene, t.bin LIMIT 25"))
def top_discoveries(spark, d):
    return gene_tests.top_discoveries(rounded(discovery(spark, d)))


@query("T05_odds_ratio", with_("four_long sizes", f"SELECT gene, bin, {sr('CASE WHEN (z.case_pheno - ac_case_pheno) * ac_control_pheno <> 0 THEN ac_case_pheno::DOUBLE * (z.control_pheno - ac_control_pheno) / ((z.case_pheno - ac_case_pheno) * ac_control_pheno::DOUBLE) END')} AS odds_ratio FROM four_long, sizes z"))
def odds_ratio(spark, d):
    long, sizes = counts_and_sizes(spark, d)
    long = long.withColumns({"_n": sizes["case_pheno"], "_m": sizes["control_pheno"]})
    ratio = gene_tests.odds_ratio(F.col("ac_case_pheno"), F.col("_n"), F.col("ac_control_pheno"), F.col("_m"))
    return long.select("gene", "bin", r(ratio).alias("odds_ratio"))


# --- corrections over the p-values of call depths, a table that grows with the data ------------------------------

P_SQL = f"""SELECT l_orderkey, l_partkey, l_linenumber, {two_sided_p('(l_quantity - 25) / 6')} AS p_val FROM lineitem"""
KEYS = ("l_orderkey", "l_partkey", "l_linenumber")


def p_values(spark, d):
    return star.table(spark, d, "lineitem").select(
        *KEYS, ((F.col("l_quantity") - 25) / 6).alias("z")
    ).withColumn("p_val", N.two_sided_p(F.col("z"))).drop("z")


@query("W03a_bonferroni", f"WITH tested AS ({P_SQL}), {BONFERRONI} SELECT l_orderkey, l_partkey, l_linenumber, {sr('p_val')} AS p_val, {BONF_OUT} FROM corrected")
def bonferroni(spark, d):
    return rounded(multitest.bonferroni(p_values(spark, d)))


@query("W03b_U06_bonferroni_joint", f"WITH both_tables AS (SELECT p_val, 0 AS source FROM ({P_SQL}) UNION ALL SELECT {two_sided_p('value / 5')}, 1 FROM events), c AS (SELECT *, count(*) OVER () AS m FROM both_tables) SELECT source, {sr('p_val')} AS p_val, {sr('least(p_val * m, 1.0)')} AS \"Bonferroni_Adjusted_Pval\", (p_val <= 0.05::DOUBLE / m) AS \"Significant_pval\" FROM c")
def bonferroni_joint(spark, d):
    other = star.table(spark, d, "events").select((F.col("value") / 5).alias("z"))
    other = other.select(N.two_sided_p(F.col("z")).alias("p_val"))
    return rounded(multitest.bonferroni_joint([p_values(spark, d).select("p_val"), other], "p_val"))


@query("W03c_fdr_two_stage", f"WITH tested AS ({P_SQL}), {FDR} SELECT l_orderkey, l_partkey, l_linenumber, {sr('p_val')} AS p_val, {FDR_OUT} FROM corrected")
def fdr_two_stage(spark, d):
    return rounded(multitest.fdr_two_stage(stored(p_values(spark, d), "pvalues")))


@query("W03d_W03e_thresholds", f"SELECT count(*) AS n_tests, {sr('0.05::DOUBLE / count(*)')} AS alpha_bonferroni, {sr('1 - pow(0.95::DOUBLE, 1.0::DOUBLE / count(*))')} AS alpha_sidak, {sr('-log10(0.05::DOUBLE)')} AS neg_log10_alpha, {sr('-log10(0.05::DOUBLE / count(*))')} AS neg_log10_alpha_bonferroni FROM ({P_SQL})")
def thresholds(spark, d):
    return rounded(multitest.thresholds(p_values(spark, d)))


# --- significant hits among read-depth outliers per variant and line, a table with many rejections -------------------


def depth_tests(spark, d):
    """Mean quantity per part and line against its expectation, with a deliberately tight deviation."""
    groups = star.table(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(
        (F.avg("l_quantity") - 25.5).alias("effect"), F.count(F.lit(1)).alias("n")
    )
    tested = groups.select(
        F.col("l_partkey").cast("string").alias("gene"), F.col("l_linenumber").cast("string").alias("bin"), "effect",
        N.two_sided_p(F.col("effect") * F.sqrt("n") / 5.0).alias("p_val"),
    )
    return multitest.fdr_two_stage(stored(tested, "pvalues"))


DEPTH = f"""WITH tested AS (
        SELECT CAST(l_partkey AS VARCHAR) AS gene, CAST(l_linenumber AS VARCHAR) AS bin, avg(l_quantity) - 25.5 AS effect,
               {two_sided_p('(avg(l_quantity) - 25.5) * sqrt(count(*)) / 5.0::DOUBLE')} AS p_val
        FROM lineitem GROUP BY l_partkey, l_linenumber), {FDR},
    hits AS (SELECT gene, bin, {sr('effect')} AS effect, {sr('p_val')} AS p_val, {FDR_OUT} FROM corrected)"""
DEPTH_ORDER = "ORDER BY neg_log10_adjusted DESC, abs(effect) DESC, gene, bin"


@query("P28_significant", f"{DEPTH} SELECT * FROM hits WHERE significant_bonferroni")
def significant(spark, d):
    return rounded(depth_tests(spark, d).filter("significant_bonferroni"))


@query("O02_top_significant", f"{DEPTH} SELECT * FROM hits WHERE significant_bonferroni {DEPTH_ORDER} LIMIT 20")
def top_significant(spark, d):
    return gene_tests.top_significant(rounded(depth_tests(spark, d)), "effect")


@query("O03_top_by_gene", f"{DEPTH} SELECT * FROM hits WHERE significant_bonferroni ORDER BY gene DESC, bin DESC LIMIT 20")
def top_by_gene(spark, d):
    return gene_tests.top_significant_by_gene(rounded(depth_tests(spark, d)))


@query("W04_numbered_hits", f"{DEPTH} SELECT gene, bin, CAST(row_number() OVER ({DEPTH_ORDER}) AS INTEGER) AS hit FROM hits WHERE significant_bonferroni ORDER BY hit LIMIT 20")
def numbered_hits(spark, d):
    top = gene_tests.top_significant(rounded(depth_tests(spark, d)), "effect")
    order = Window.orderBy(F.col("neg_log10_adjusted").desc(), F.abs("effect").desc(), "gene", "bin")
    return top.withColumn("hit", F.row_number().over(order)).select("gene", "bin", "hit")


@query("A12_exact_quantile", f"SELECT l_returnflag, {sr('quantile_cont(ln(l_extendedprice), 0.99)')} AS q99, count(*) AS n_values FROM lineitem GROUP BY l_returnflag")
def quantile(spark, d):
    prices = star.table(spark, d, "lineitem").select("l_returnflag", F.log("l_extendedprice").alias("v"))
    return rounded(exact_quantile(prices, "v", ["l_returnflag"], 0.99, "q99"))


# --- summaries ------------------------------------------------------------------------------------------------


def summary_sql(side: str) -> str:
    x, y = f"ac_case_{side}", f"ac_control_{side}"
    return f"""SELECT max(z.case_{side})::DOUBLE / max(z.control_{side}) AS "Expected_Ratio",
        log2(max(z.case_{side})::DOUBLE / max(z.control_{side})) AS "Log2_Expected_Ratio",
        sum({x})::DOUBLE AS "Total_Case_Burden", sum({y})::DOUBLE AS "Total_Control_Burden",
        sum({x})::DOUBLE / sum({y}) AS "Total_Ratio", log2(sum({x})::DOUBLE / sum({y})) AS "Log2_Total_Ratio",
        avg({x}) AS "Mean_Case_Burden", avg({y}) AS "Mean_Control_Burden", avg({x}) / avg({y}) AS "Mean_Ratio",
        log2(avg({x}) / avg({y})) AS "Log2_Mean_Ratio", median({x})::DOUBLE AS "Case_Median", median({y})::DOUBLE AS "Control_Median",
        stddev_samp({x}) AS "Case_Std", stddev_samp({y}) AS "Control_Std"
        FROM four_long, sizes z WHERE bin = 'total_burden'"""


def summary_of(long, sizes, side: str):
    return summary.burden_summary(long, side, sizes[f"case_{side}"], sizes[f"control_{side}"])


@query("A07_cohort_summary", extended("four_long sizes", f", s AS ({summary_sql('pheno')})", "SELECT " + ", ".join(f'{sr(chr(34) + m + chr(34))} AS "{m}"' for m in summary.METRICS) + " FROM s"))
def cohort_summary(spark, d):
    return rounded(summary_of(*counts_and_sizes(spark, d), "pheno"))


COMPARED = " UNION ALL ".join(
    f"""SELECT '{m}' AS "Metric", round(p."{m}", 4) AS "Phenotype", round(n."{m}", 4) AS "Null" FROM p, n"""
    for m in summary.METRICS
)


@query("A23_U07_compare_summaries", extended("four_long sizes", f", p AS ({summary_sql('pheno')}), n AS ({summary_sql('null')}), c AS ({COMPARED})", f"""SELECT "Metric", {sr('"Phenotype"')} AS "Phenotype", {sr('"Null"')} AS "Null", {sr('CASE WHEN "Null" <> 0 AND "Phenotype" / "Null" > 0 THEN log2("Phenotype" / "Null") END')} AS "Delta" FROM c"""))
def compare_summaries(spark, d):
    counts = counts_and_sizes(spark, d)
    return rounded(summary.compare_summaries(summary_of(*counts, "pheno"), summary_of(*counts, "null")))
