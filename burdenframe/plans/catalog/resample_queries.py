"""Gene-set resampling; every sample of the cohort draws one set, so the work grows with the tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from burdenframe.operators import density, firth, gene_tests, genetable, resample
from burdenframe.plans import star_cohort as star
from burdenframe.plans.catalog.registry import query, r, rounded
from burdenframe.plans.catalog.sql import erfc, extended, with_
from burdenframe.plans.catalog.sql import r as sr
from burdenframe.plans.workspace import stored

BIN = "total_burden"


SETS_PER_TASK = 10_000


def iterations(spark, d):
    """A counter per customer. Their file is a few MB that one task would read, so they are dealt out before any set is drawn and summed."""
    customers = star.table(spark, d, "customer").select(F.col("c_custkey").alias("iter"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-customers.count() // SETS_PER_TASK))
    return customers.repartition(tasks)


class Run:
    """Sets, sums and log ratios over all aligned genes, or over the listed ones only."""

    def __init__(self, spark, d, listed: bool = False, inputs=None):
        labelled, wide = inputs or self.inputs(spark, d)
        if listed:
            wide = genetable.keep_genes(wide, star.listed_genes(spark, d))
        self.genes = stored(resample.index_genes(wide), "indexed")
        self.drawn = stored(resample.draw_sets(iterations(spark, d), self.genes, shrink=listed), "drawn")
        self.sets = resample.set_rows(self.drawn)
        self.ratios = resample.simulate(self.drawn, self.genes)
        self.sizes = gene_tests.sizes_of(labelled)

    @staticmethod
    def inputs(spark, d):
        """Labelled samples and gene counts, which runs over the same tables can share."""
        labelled = star.labelled_samples(spark, d)
        return labelled, star.gene_counts(spark, d, labelled)

    @cached_property
    def logs(self):
        expected = [self.sizes[f"case_{s}"] / self.sizes[f"control_{s}"] for s in ("pheno", "null")]
        return stored(resample.with_log_ratio(self.ratios, *expected), "ratios")

    def in_bin(self, bin_name: str = BIN):
        return self.logs.filter(F.col("bin") == bin_name)


@query("W05b_gene_sets", with_("sets", "SELECT iter, CAST(pos AS INTEGER) AS pos, gene_idx FROM sets"))
def gene_sets(spark, d):
    return Run(spark, d).sets


@query("J14_set_genes", with_("set_genes", "SELECT iter, gene, case_pheno_9 AS burden FROM set_genes"))
def set_genes(spark, d):
    run = Run(spark, d)
    named = resample.genes_of_sets(run.drawn, run.genes, ["gene", "case_pheno_9"])
    return named.select("iter", "gene", F.col("case_pheno_9").alias("burden"))


RATIO_OUT = ", ".join(
    f"{sr(f'sum_case_{s}')} AS sum_case_{s}, {sr(f'sum_control_{s}')} AS sum_control_{s}, "
    f"{sr(f'ratio_{s}')} AS ratio_{s}, valid_{s}"
    for s in ("pheno", "null")
)
RATIO_COLUMNS = [f"{c}_{s}" for s in ("pheno", "null") for c in ("sum_case", "sum_control", "ratio", "valid")]


@query("A10_resampling", with_("ratios", f"SELECT iter, bin, {RATIO_OUT} FROM ratios"))
def resampling(spark, d):
    return rounded(Run(spark, d).ratios.select("iter", "bin", *RATIO_COLUMNS))


@query("A10_resampling_listed", with_("listed_ratios", f"SELECT iter, bin, {RATIO_OUT} FROM listed_ratios"))
def resampling_listed(spark, d):
    return rounded(Run(spark, d, listed=True).ratios.select("iter", "bin", *RATIO_COLUMNS))


@query("A11_log_ratios", with_("logs", f"SELECT iter, bin, {sr('log2_pheno')} AS log2_pheno, {sr('log2_null')} AS log2_null FROM logs"))
def log_ratios(spark, d):
    return rounded(Run(spark, d).logs.select("iter", "bin", "log2_pheno", "log2_null"))


@query("A12_percentile_99", with_("cuts", f"SELECT bin, {sr('threshold')} AS threshold, n_values FROM cuts"))
def percentile_99(spark, d):
    return rounded(resample.percentiles(Run(spark, d).logs))


EMPIRICAL = """SELECT l.bin AS "Frequency_Bin",
    CASE WHEN count(log2_null) > 0 AND max(threshold) IS NOT NULL
         THEN (count(*) FILTER (WHERE log2_null >= threshold) + 1)::DOUBLE / (count(log2_null) + 1) END AS p
    FROM {0}logs l LEFT JOIN {0}cuts c ON l.bin = c.bin GROUP BY l.bin"""


@query("A13_empirical_p", extended("cuts", f", e AS ({EMPIRICAL.format('')})", f'SELECT "Frequency_Bin", {sr("p")} AS "Empirical_Pval_99thPercentile" FROM e'))
def empirical_p(spark, d):
    return rounded(resample.empirical_p(Run(spark, d).logs))


@query("W03b_empirical_joint", extended("cuts listed_cuts", f", e AS (SELECT *, 0 AS source FROM ({EMPIRICAL.format('')}) UNION ALL SELECT *, 1 FROM ({EMPIRICAL.format('listed_')})), c AS (SELECT *, count(p) OVER () AS m FROM e)", f'SELECT source, "Frequency_Bin", {sr("p")} AS "Empirical_Pval_99thPercentile", {sr("least(p * m, 1.0)")} AS "Bonferroni_Adjusted_Pval", (p <= 0.05::DOUBLE / m) AS "Significant_pval" FROM c'))
def empirical_joint(spark, d):
    from burdenframe.operators.multitest import bonferroni_joint

    inputs = Run.inputs(spark, d)
    both = [resample.empirical_p(Run(spark, d, listed, inputs).logs) for listed in (False, True)]
    return rounded(bonferroni_joint(both, "Empirical_Pval_99thPercentile"))


CONTRIB = """, contrib AS (
    SELECT g.gene, t.bin, count(*) AS appearance_in_top_sets, sum(g.case_pheno_9)::DOUBLE AS burden,
           avg(t.log2_pheno) AS avg_ratio
    FROM listed_top t JOIN listed_sets s ON t.iter = s.iter JOIN listed g ON s.gene_idx = g.gene_idx
    WHERE t.bin = 'total_burden' GROUP BY g.gene, t.bin)"""
CONTRIB_OUT = f"""SELECT gene, bin, appearance_in_top_sets, {sr('burden')} AS summed_indiv_case_burden_in_top_sets,
    {sr('avg_ratio')} AS avg_log2_ratio_of_sets_involved_in FROM contrib"""


def contributors(run: Run):
    return resample.contributions(resample.top_sets(run.in_bin()), run.drawn, run.genes)


@query("A14_contributors", extended("listed_top", CONTRIB, CONTRIB_OUT))
def contributor_table(spark, d):
    return rounded(contributors(Run(spark, d, listed=True)))


TOP_GENES = "SELECT gene FROM contrib ORDER BY round(avg_ratio, 9) DESC, appearance_in_top_sets DESC, gene LIMIT {0}"


@query("O06_top_contributors", extended("listed_top", CONTRIB, f"{CONTRIB_OUT} WHERE gene IN ({TOP_GENES.format(10)})"))
def top_contributors(spark, d):
    return rounded(resample.rank_contributors(contributors(Run(spark, d, listed=True))))


@query("A25_burden_events", with_("top", f"SELECT iter, bin, ac_case_pheno, ac_control_pheno, {sr('log2_pheno')} AS log2_pheno FROM top WHERE sum_case_pheno > 10 AND sum_control_pheno > 10 AND n_case_pheno > 1 AND n_control_pheno > 1"))
def burden_events(spark, d):
    events = resample.burden_events(Run(spark, d).logs)
    return rounded(events.select("iter", "bin", "ac_case_pheno", "ac_control_pheno", "log2_pheno"))


PAIRS = f"""{CONTRIB}, focus AS ({TOP_GENES.format(25)}),
    members AS (SELECT t.iter, g.gene FROM listed_top t JOIN listed_sets s ON t.iter = s.iter
                JOIN listed g ON s.gene_idx = g.gene_idx JOIN focus f ON g.gene = f.gene WHERE t.bin = 'total_burden'),
    pairs AS (SELECT a.gene AS gene_1, b.gene AS gene_2, count(*) AS co_occurrence_count
              FROM members a JOIN members b ON a.iter = b.iter AND a.gene < b.gene GROUP BY 1, 2)"""


def pairs_of(spark, d):
    run = Run(spark, d, listed=True)
    top = stored(resample.top_sets(run.in_bin()).select("iter", "bin", "log2_pheno"), "top")
    focus = resample.rank_contributors(resample.contributions(top, run.drawn, run.genes), 25)
    return resample.gene_pairs(top, run.drawn, run.genes, focus)


@query("J13_A15_gene_pairs", extended("listed_top", PAIRS, "SELECT * FROM pairs"))
def gene_pairs(spark, d):
    return pairs_of(spark, d)


@query("O07_pairs_ranked", extended("listed_top", PAIRS, "SELECT * FROM pairs"))
def pairs_ranked(spark, d):
    return resample.rank_pairs(pairs_of(spark, d))


@query("A16_network_nodes", extended("listed_top", PAIRS, "SELECT gene, count(*) AS degree, count(*) * 500 + 500 AS node_size, gene = 'CAPN3' AS is_hub FROM (SELECT gene_1 AS gene FROM pairs UNION ALL SELECT gene_2 FROM pairs) GROUP BY gene"))
def network_nodes(spark, d):
    return resample.network_nodes(pairs_of(spark, d))


@query("A16_network_edges", extended("listed_top", PAIRS, f"SELECT gene_1, gene_2, co_occurrence_count AS weight, {sr('1 + co_occurrence_count::DOUBLE / (SELECT max(co_occurrence_count) FROM pairs) * 5')} AS edge_width FROM pairs"))
def network_edges(spark, d):
    return rounded(resample.network_edges(pairs_of(spark, d)))


@query("A20_retention", with_("ratios", "SELECT bin, count(*) AS n_total, count(*) FILTER (WHERE valid_pheno) AS n_pheno, count(*) FILTER (WHERE valid_null) AS n_null, count(*) FILTER (WHERE valid_pheno AND valid_null) AS n_both FROM ratios GROUP BY bin"))
def retention(spark, d):
    return resample.retention(Run(spark, d).ratios)


LABELLED = """, stacked AS (
    SELECT bin, 1 AS y, ratio_pheno AS x FROM ratios WHERE valid_pheno
    UNION ALL SELECT bin, 0, ratio_null FROM ratios WHERE valid_null)"""


@query("U05_labelled_ratios", extended("ratios", LABELLED, f"SELECT bin, y, {sr('x')} AS x FROM stacked"))
def labelled_ratios(spark, d):
    return rounded(resample.labelled_ratios(Run(spark, d).ratios))


@query("A17_standardise", extended("ratios", LABELLED, f"SELECT bin, y, {sr('(x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END')} AS z FROM stacked WINDOW w AS (PARTITION BY bin)"))
def standardise(spark, d):
    scaled = resample.standardise(resample.labelled_ratios(Run(spark, d).ratios))
    return scaled.select("bin", "y", r("z").alias("z"))


FIRTH_STEPS = 25


def firth_sql() -> str:
    """Newton steps as a chain of expressions, with plain logistic sums; the null fit in closed form."""
    sums = "sum(p * (1 - p)) AS w0, sum(p * (1 - p) * z) AS w1, sum(p * (1 - p) * z * z) AS w2, sum(y - p) AS r0, sum((y - p) * z) AS r1"
    sums += "".join(f", sum(p * (1 - p) * (0.5::DOUBLE - p) * z ** {k}) AS s{k}" for k in range(4))
    sums += ", sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll"
    steps = f"""{LABELLED}, big AS (
        SELECT bin FROM stacked GROUP BY bin HAVING sum(y) >= 5 AND count(*) - sum(y) >= 5),
    scaled AS MATERIALIZED (
        SELECT bin, y, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END AS z
        FROM stacked WHERE bin IN (SELECT bin FROM big) WINDOW w AS (PARTITION BY bin)),
    coef0 AS (SELECT bin, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM big)"""
    for k in range(FIRTH_STEPS + 1):
        steps += f""",
    sums{k} AS MATERIALIZED (
        SELECT bin, any_value(b0) AS b0, any_value(b1) AS b1, {sums}
        FROM (SELECT s.bin, y, z, b0, b1, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM scaled s JOIN coef{k} c ON s.bin = c.bin) GROUP BY bin),
    coef{k + 1} AS MATERIALIZED (
        SELECT bin, b0 + (a * u0 + b * u1) / greatest(1, abs(a * u0 + b * u1) / 5, abs(b * u0 + c * u1) / 5) AS b0,
               b1 + (b * u0 + c * u1) / greatest(1, abs(a * u0 + b * u1) / 5, abs(b * u0 + c * u1) / 5) AS b1
        FROM (SELECT *, r0 + a * s0 + 2 * b * s1 + c * s2 AS u0, r1 + a * s1 + 2 * b * s2 + c * s3 AS u1
              FROM (SELECT *, w2 / det AS a, -w1 / det AS b, w0 / det AS c
                    FROM (SELECT *, w0 * w2 - w1 * w1 AS det FROM sums{k}))))"""
    steps += f""",
    nulls AS (
        SELECT bin, ones * ln(p) + (n - ones) * ln(1 - p) + 0.5::DOUBLE * ln((p * (1 - p)) ** 2 * (n * z2 - z1 * z1)) AS ll0
        FROM (SELECT bin, sum(y) AS ones, count(*) AS n, sum(z) AS z1, sum(z * z) AS z2, (sum(y) + 1.0::DOUBLE) / (count(*) + 2) AS p
              FROM scaled GROUP BY bin)),
    fits AS (
        SELECT f.bin, b1 AS log_odds, sqrt(w0 / (w0 * w2 - w1 * w1)) AS se, 2 * (ll + 0.5::DOUBLE * ln(w0 * w2 - w1 * w1) - ll0) AS lr
        FROM sums{FIRTH_STEPS} f JOIN nulls n ON f.bin = n.bin)"""
    p = erfc("sqrt(greatest(lr, 0) / 2)")
    out = f"""SELECT bin, {sr('log_odds')} AS log_odds, {sr('se')} AS se, {sr(p)} AS pval, {sr('exp(log_odds)')} AS odds_ratio,
        {sr('1 / (1 + exp(-log_odds)) - 0.5::DOUBLE')} AS prob_change, {sr('log_odds / ln(2)')} AS log2_or,
        {sr('(log_odds - 1.96::DOUBLE * se) / ln(2)')} AS ci_lower_log2, {sr('(log_odds + 1.96::DOUBLE * se) / ln(2)')} AS ci_upper_log2,
        true AS converged FROM fits"""
    return extended("ratios", steps, out)


@query("A18_firth_regression", firth_sql())
def firth_regression(spark, d):
    return rounded(firth.firth_by_bin(resample.labelled_ratios(Run(spark, d).ratios)).drop("n_iter", "reason"))


SIDES = """, v AS (
    SELECT bin, 'pheno' AS side, log2_pheno AS v FROM logs WHERE log2_pheno IS NOT NULL
    UNION ALL SELECT bin, 'null', log2_null FROM logs WHERE log2_null IS NOT NULL),
    spans AS (SELECT bin, min(v) - 1 AS lo, max(v) + 1 AS hi FROM v GROUP BY bin),
    shapes AS (SELECT bin, side, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2::DOUBLE) AS h FROM v GROUP BY bin, side
               HAVING count(*) > 1),
    grid AS (SELECT unnest(range(500)) AS i),
    points AS (SELECT bin, i, lo + (hi - lo) * i / 499.0::DOUBLE AS x FROM spans, grid)"""


@query("A19_density", extended("logs", SIDES, f"SELECT v.bin, v.side, CAST(p.i AS INTEGER) AS grid_idx, {sr('any_value(p.x)')} AS x, {sr('sum(exp(-0.5::DOUBLE * ((p.x - v.v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} AS density FROM v JOIN shapes s ON v.bin = s.bin AND v.side = s.side JOIN points p ON v.bin = p.bin WHERE h > 0 GROUP BY v.bin, v.side, p.i"))
def density_curves(spark, d):
    return rounded(density.ratio_densities(Run(spark, d).logs))
