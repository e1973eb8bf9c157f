"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from burdenframe.operators import firth, kinship, resample
from burdenframe.plans import star_cohort as star
from burdenframe.plans.catalog import QUERIES
from burdenframe.plans.catalog.resample_queries import Run
from burdenframe.plans.workspace import stored

ITERATIONS = 100_000


class Resampling(Run):
    """As the registered queries, with a fixed number of sets in place of one per sample."""

    def __init__(self, spark, d, iterations=ITERATIONS):
        super().__init__(spark, d)
        self.drawn = resample.draw_sets(resample.counters(spark, iterations), self.genes)
        self.sets = resample.set_rows(self.drawn)
        self.ratios = resample.simulate(self.drawn, self.genes)


def resampling(spark, d):
    return Resampling(spark, d).ratios


def published_resampling(spark, d):
    return Resampling(spark, d, resample.ITERATIONS).ratios


def empirical_p(spark, d):
    return resample.empirical_p(Resampling(spark, d).logs)


def firth_regression(spark, d):
    return firth.firth_by_bin(resample.labelled_ratios(stored(Resampling(spark, d).ratios, "ratios")))


def kinship_one_contig(spark, d):
    return kinship.kinship(star.entries(spark, d), "2")


REGISTERED = (
    "A01_burden_by_impact", "A01_A04_case_control_tables", "A05_sample_counts", "J03_null_cohort",
    "J06_four_cohorts_one_pass", "T02_two_proportion_z", "T04_log_odds_difference_z", "W01_first_per_prefix",
    "W03c_fdr_two_stage", "P02_interval_table", "S01_vcf_scan", "ST1_incremental_ingest",
)
HEADLINES = {
    **{name: QUERIES[name] for name in REGISTERED},
    "A08_kinship_one_contig": kinship_one_contig,
    "A08_kinship": QUERIES["A08_kinship"],
    f"A10_resampling_{ITERATIONS}x10": resampling,
    f"A10_resampling_{resample.ITERATIONS}x10": published_resampling,
    f"A13_empirical_p_{ITERATIONS}x10": empirical_p,
    f"A18_firth_{ITERATIONS}x10": firth_regression,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("burdenframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    QUERIES["A01_burden_by_impact"](spark, sf_dir).count()  # starts the JVM's compilers, not timed
    seconds = {}
    for name, run in HEADLINES.items():
        if only and not any(o in name for o in only):
            continue
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
