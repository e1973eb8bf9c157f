"""Operators against brute force on small tables."""

from __future__ import annotations

import itertools
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burdenframe.functions import numeric, ordering, sampling
from burdenframe.operators import burden, cohort, density, filters, firth, gene_tests, genetable, genotypes
from burdenframe.operators import kinship, multitest, resample


def column(df, name):
    return [r[name] for r in df.collect()]


# --- numbers and ordering -------------------------------------------------------------------------------


def test_normal_tail(spark):
    zs = [0.0, 0.1, 1.0, 1.96, -3.0, 5.0, 10.0, 20.0, 37.0, *np.linspace(0, 38, 400).tolist()]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", numeric.two_sided_p(F.col("z")).alias("p"))
    for r in df.collect():
        assert math.isclose(r["p"], math.erfc(abs(r["z"]) / math.sqrt(2)), rel_tol=1e-12)


@pytest.mark.parametrize("values", [[1.0], [0.5, 0.5, 0.5], list(np.random.default_rng(1).normal(size=501)), [float(i % 3) for i in range(100)]])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, values, q):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 2.0), ("b", None)], "g string, v double")
    got = {r["g"]: (r["x"], r["n_values"]) for r in ordering.exact_quantile(df, "v", ["g"], q, "x").collect()}
    assert math.isclose(got["a"][0], np.percentile(values, q * 100), abs_tol=1e-12)
    assert got["a"][1] == len(values) and got["b"] == (2.0, 1)


@pytest.mark.parametrize("accuracy,most", [(10_000, 10**6), (100, 10**6), (400, 40)])
def test_exact_quantile_of_large_groups(spark, accuracy, most):
    rng = np.random.default_rng(accuracy)
    values = {"wide": np.exp(rng.normal(size=20_000) * 100), "ties": np.floor(rng.normal(size=9000) * 2), "one": np.ones(700), "few": rng.normal(size=3) * 1e300}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double").repartition(6)
    for q in (0.0, 0.013, 0.5, 0.99, 1.0):
        got = {r["g"]: r["x"] for r in ordering.exact_quantile(df, "v", ["g"], q, "x", accuracy, most).collect()}
        for g, vs in values.items():
            assert math.isclose(got[g], np.percentile(vs, q * 100), rel_tol=1e-12)


def test_dense_index_is_a_permutation(spark):
    df = spark.createDataFrame([(f"g{i}",) for i in range(500)], "gene string")
    one = {r["gene"]: r["i"] for r in ordering.dense_index(df.repartition(1), "gene", "i").collect()}
    many = {r["gene"]: r["i"] for r in ordering.dense_index(df.repartition(7), "gene", "i").collect()}
    assert one == many and sorted(one.values()) == list(range(500))


@pytest.mark.parametrize("n,k", [(500, 10), (30, 10), (15, 10), (10, 10), (21, 10)])
def test_distinct_draws(spark, n, k):
    df = spark.range(400).select(
        "id", sampling.distinct_draws(7, F.col("id"), F.lit(n).cast("bigint"), F.lit(k)).alias("d")
    )
    one, many = [{r["id"]: tuple(r["d"]) for r in df.repartition(p).collect()} for p in (1, 5)]
    assert one == many
    counts = np.zeros(n)
    for d in one.values():
        assert len(set(d)) == k and 0 <= min(d) and max(d) < n
        counts[list(d)] += 1
    expected = 400 * k / n
    chi2 = ((counts - expected) ** 2 / (expected * max(1 - k / n, 1e-9))).sum() if n > k else 0
    assert chi2 < n + 5 * math.sqrt(2 * n)


# --- filters and cohorts -----------------------------------------------------------------------------------


def test_intervals(spark):
    assert filters.parse_interval("chrX") == ("X", 1, filters.LAST_POSITION)
    assert filters.parse_interval("1:12,000-20000") == ("1", 12000, 20000)
    assert filters.parse_interval("2:start-2:end") == ("2", 1, filters.LAST_POSITION)
    with pytest.raises(ValueError):
        filters.parse_interval("1:5-2:9")
    rnd = random.Random(3)
    sites = [(str(rnd.randint(1, 3)), rnd.randint(1, 3_000_000)) for _ in range(400)]
    spans = []
    for _ in range(80):
        start = rnd.randint(1, 3_000_000)
        spans.append((str(rnd.randint(1, 3)), start, start + rnd.choice([1, 50, 20_000, 1_500_000])))
    spans.append((sites[0][0], sites[0][1], sites[0][1]))
    sites += [(c, s) for c, s, _ in spans[:20]] + [(c, e) for c, _, e in spans[:20]]
    expected = sorted(s for s in sites if any(c == s[0] and a <= s[1] < b for c, a, b in spans))
    df = spark.createDataFrame(sites, "contig string, pos int")
    for bin_size in (64, 1 << 14):
        table = spark.createDataFrame(spans, "contig string, start int, end int")
        got = filters.in_interval_table(df, table, bin_size)
        assert sorted(tuple(r) for r in got.collect()) == expected
    texts = [f"chr{c}:{a}-{b}" for c, a, b in spans]
    assert sorted(tuple(r) for r in filters.in_intervals(df, texts).collect()) == expected
    odd = spark.createDataFrame([("1", 0), ("1", 5), ("1", None), ("2", 5), (None, 5)], "contig string, pos int")
    for more in ([], [f"2:{10 * i + 10}-{10 * i + 15}" for i in range(70)]):
        kept = sorted(str(r["pos"]) for r in filters.in_intervals(odd, ["1", *more]).collect())
        assert kept == ["0", "5", "None"]
    few = filters.in_intervals(df, texts[:3])
    assert few.count() == sum(any(c == s[0] and a <= s[1] < b for c, a, b in spans[:3]) for s in sites)


@pytest.mark.parametrize("stretch", [100, 1000, 1 << 20])
def test_merged_intervals(spark, stretch):
    rnd = random.Random(stretch)
    spans = [(c, a, a + rnd.choice([0, 1, 30, 200, 2500])) for c in "12" for a in (rnd.randint(1, 20_000) for _ in range(60))]
    spans += [("2", 5, 5), ("3", 1, filters.LAST_POSITION), ("3", 7, 9)]
    table = spark.createDataFrame(spans, "contig string, start int, end int")
    got = sorted((r.contig, r.start, r.end, r.whole) for r in filters.merged_intervals(table, stretch).collect())
    want = []
    for c, a, b in sorted(s for s in spans if s[2] > s[1]):
        if want and want[-1][0] == c and a <= want[-1][2]:
            want[-1][2] = max(want[-1][2], b)
        else:
            want.append([c, a, b])
    assert got == [(c, a, b, (a, b) == (1, filters.LAST_POSITION)) for c, a, b in want]


def test_null_cohort(spark):
    rows = [(f"s{i}", "A,B" if i < 3 else "AB") for i in range(20)]
    samples = spark.createDataFrame(rows, "s string, phenotype string")
    got = cohort.label_null_cohort(samples, "A").collect()
    assert sum(r["is_case"] for r in got) == 3 and sum(r["is_null_case"] for r in got) == 3
    assert not any(r["is_case"] and r["is_null_case"] for r in got)
    for bad, n in (("Z", None), ("A", 18)):
        with pytest.raises(Exception, match="phenotype Z|not enough controls"):
            cohort.label_null_cohort(samples, bad, n).collect()


def test_required_rows(spark):
    df = spark.createDataFrame([("s", "AB")], "s string, phenotype string")
    assert filters.require_rows(filters.phenotype_matches(df, "A."), "none").count() == 1
    with pytest.raises(Exception, match="none here"):
        filters.require_rows(filters.phenotype_matches(df, "A"), "none here").collect()


# --- burden and genotypes --------------------------------------------------------------------------------------


def random_entries(spark, n=600, seed=2):
    rnd = random.Random(seed)
    rows = [
        (
            f"s{rnd.randint(0, 7)}", f"g{min(rnd.randint(0, 9), 4)}", rnd.choice(burden.IMPACTS),
            rnd.choice([0.00005, 0.0001, 0.0005, 0.001, 0.005]), rnd.randint(0, 2),
        )
        for _ in range(n)
    ]
    return rows, spark.createDataFrame(rows, "s string, gene string, impact string, MAX_AF double, AC int")


def test_counts_add_up_over_any_batches(spark):
    _, entries = random_entries(spark)
    whole = burden.to_long(burden.burden_by_impact(entries))
    per_sample = burden.add_counts([burden.sample_counts(entries)])
    halves = [entries.filter(F.col("s") < "s4"), entries.filter(F.col("s") >= "s4")]
    parts = burden.add_counts([burden.to_long(burden.burden_by_impact(h)) for h in halves])
    rows = [sorted(tuple(r) for r in df.select("gene", "bin", "ac").collect()) for df in (whole, per_sample, parts)]
    assert rows[0] == rows[1] == rows[2]


def test_four_cohorts_agree_with_separate_tables(spark):
    _, entries = random_entries(spark)
    labelled = entries.withColumns(
        {"is_case": F.col("s").isin("s0", "s1"), "is_null_case": F.col("s").isin("s2", "s3")}
    )
    sides = ("is_case", "NOT is_case", "is_null_case", "NOT is_null_case")
    separate = {
        c: genetable.with_total(genetable.drop_matching_columns(burden.frequency_table(labelled.filter(f))))
        for c, f in zip(genetable.COHORTS, sides)
    }
    a = sorted(tuple(r) for r in genetable.align_tables(separate).collect())
    b = sorted(tuple(r) for r in genetable.four_cohort_long(labelled).collect())
    assert a == b and len(a) > 0


def test_genotype_duplicates(spark):
    rows = [("1", 5, ["A", "T"], "s1", 1), ("1", 5, ["A", "T"], "s2", 2), ("1", 5, ["A", "T"], "s1", 2)]
    df = spark.createDataFrame(rows, "contig string, pos int, alleles array<string>, s string, AC int")
    with pytest.raises(Exception, match="several entries"):
        genotypes.genotype_long(df).collect()
    long = genotypes.genotype_long(df, "max")
    wide = genotypes.genotype_matrix(long, ["s1", "s2", "s3"]).first()
    assert tuple(wide) == ("1:5_['A', 'T']", 2, 2, 0)


def test_unions_by_site_and_block(spark):
    rnd = random.Random(3)
    every = [("2", v, ["A", "T"], s, rnd.randint(0, 2), rnd.choice("xyz")) for v in range(30) for s in range(40) if v == 0 or rnd.random() < 0.2]
    every += [("X", None, ["A", "T", "G"], 7, 1, "x"), ("X", None, ["A", "T", "G"], 7, 2, "x")]
    df = spark.createDataFrame(every, "contig string, pos int, alleles array<string>, s long, AC int, t string")
    for names in ("x", "xy", "xyz"):
        tables = {n: cohort.store_by_site(df.filter(F.col("t") == n), F.floor(F.col("s") / 8)) for n in names}
        found = cohort.union_sites(tables)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        want = {}
        for contig, pos, alleles, s, ac, t in every:
            if t in names:
                want.setdefault((contig, pos, tuple(alleles), s // 8), {n: [] for n in names})[t].append((s, ac))
        got = {(r.contig, r.pos, tuple(r.alleles), r.block): r for r in found.collect()}
        assert got.keys() == want.keys()
        for key, calls in want.items():
            assert got[key].n_entries == sum(map(len, calls.values()))
            assert all([tuple(c) for c in got[key][n] or []] == sorted(calls[n]) for n in names)


def test_genotype_blocks_hold_the_matrix(spark, tmp_path):
    rnd = random.Random(6)
    calls = [(f"v{v}", s, rnd.randint(0, 2)) for v in range(20) for s in range(50) if rnd.random() < 0.3]
    long = spark.createDataFrame(calls, "variant_id string, s long, AC int")
    index = genotypes.sample_index(spark.range(45).withColumnRenamed("id", "s"), F.floor(F.col("s") / 16))
    path = str(tmp_path / "blocks")
    genotypes.write_blocks(genotypes.genotype_blocks(long, index), path)
    got = {(r.variant_id, r.block * 16 + p): c for r in spark.read.parquet(path).collect() for p, c in zip(r.positions, r.counts)}
    assert got == {(v, s): c for v, s, c in calls if s < 45}
    assert {r["size"] for r in spark.read.parquet(path).filter("block = 2").collect()} == {13}
    for fill in (0, None):
        wide = genotypes.export_block(spark, path, index, 1, fill).collect()
        assert wide[0].asDict().keys() == {"variant_id", *map(str, range(16, 32))}
        assert all(r[str(s)] == got.get((r.variant_id, s), fill) for r in wide for s in range(16, 32))
        assert {r.variant_id for r in wide} == {v for v, s in got if 16 <= s < 32}


def test_genotype_blocks_make_no_folder_per_block(spark, tmp_path):
    long = spark.range(4000).selectExpr("concat('v', id % 7) variant_id", "id s", "1 AC")
    index = genotypes.sample_index(long.select("s"), F.floor(F.col("s") / 4))
    path = str(tmp_path / "many")
    genotypes.write_blocks(genotypes.genotype_blocks(long, index), path)
    assert sum(len(files) for _, _, files in os.walk(path)) < 200
    assert {r.variant_id for r in genotypes.export_block(spark, path, index, 999).collect()} == {f"v{s % 7}" for s in range(3996, 4000)}


# --- kinship ---------------------------------------------------------------------------------------------------


def king_brute(calls):
    by_sample = {}
    for site, s, g in calls:
        by_sample.setdefault(s, {})[site] = g
    out = {}
    for a, b in itertools.combinations(sorted(by_sample), 2):
        shared = by_sample[a].keys() & by_sample[b].keys()
        if shared:
            p = [(by_sample[a][v], by_sample[b][v]) for v in shared]
            out[a, b] = (
                len(p), p.count((1, 1)), p.count((0, 2)) + p.count((2, 0)),
                sum(x == 1 for x, _ in p), sum(y == 1 for _, y in p),
            )
    return out


@pytest.mark.parametrize("density_,blocks,chunks", [(0.95, 3, 2), (0.05, 3, 2), (0.3, 1, 1), (0.02, 4, 5)])
def test_kinship_counts(spark, density_, blocks, chunks):
    rnd = random.Random(5)
    calls = [
        (v, f"s{s}", rnd.randint(0, 2)) for v in range(150) for s in range(25)
        if rnd.random() < density_ or v == 0  # site 0 is called in everyone
    ]
    df = spark.createDataFrame(calls, "site long, s string, g byte")
    got = {(r["s_i"], r["s_j"]): tuple(r)[2:] for r in kinship.pair_counts(df, blocks, chunks).collect()}
    assert got == king_brute(calls)


@pytest.mark.parametrize("density_,blocks,chunks", [(0.95, 3, 4), (0.1, 1, 1), (0.03, 4, 5), (0.4, 2, 60)])
def test_find_duplicates_without_the_other_pairs(spark, density_, blocks, chunks):
    rnd = random.Random(7)
    truth = [[rnd.choice((0, 1, 1, 2)) for _ in range(150)] for _ in range(8)]
    calls = [(v, f"s{s:02}", rnd.choice((0, 1, 2)) if rnd.random() < 0.03 else truth[s // 3][v]) for v in range(150) for s in range(24) if rnd.random() < density_]
    entries = entries_from(spark, calls)
    every = kinship.kinship(entries, None, blocks, chunks)
    for limit in (0.4, 0.2, -1.0):
        want = sorted(tuple(r) for r in kinship.likely_duplicates(every, limit).collect())
        assert sorted(tuple(r) for r in kinship.find_duplicates(entries, None, limit, blocks, chunks).collect()) == want
    assert kinship.likely_duplicates(every).count() >= 5


def test_tile_forms_agree():
    rng = np.random.default_rng(4)
    codes = rng.choice(4, (70, 130), p=[0.7, 0.1, 0.1, 0.1]).astype(np.uint8)
    codes[-1, -1] = 1
    row, column = np.nonzero(codes)
    listed = row.astype("<u2").tobytes() + column.astype("<u2").tobytes() + codes[row, column].tobytes()
    a, b = kinship.Tile(70, 130, len(row), listed), kinship.Tile(70, 130, None, kinship._bits(codes))
    assert all((x == y).all() for x, y in zip(a.planes(5), b.planes(5)))
    assert all((x == y).all() for x, y in zip(a.listed(), b.listed()))
    assert (a.hets(80) == b.hets(80)).all()
    one, two = kinship.Pairs(70, 70, True), kinship.Pairs(70, 70, True)
    one._scatter(a.listed(), a.listed(), np.bincount(a.listed()[1], minlength=130))
    two._combine(b.planes(), b.planes())
    assert (np.triu(one.counts, 1) == np.triu(two.counts, 1)).all()


def entries_from(spark, calls):
    rows = [("2", v + 1, ["A", "T"], s, g) for v, s, g in calls]
    return spark.createDataFrame(rows, "contig string, pos int, alleles array<string>, s string, AC int")


@pytest.mark.parametrize("listed", [1, 6, 100])
def test_kinship_counts_by_lists_and_tiles(spark, listed):
    rnd = random.Random(7)
    names = ["a", "a\x1fb", "a\x1b", "\x1bm", "\x1be", "b,c", "", "10", "9", "é", "aa", "2"]
    calls = [("1" if v % 3 else None, v, s, rnd.randint(0, 2)) for v in range(40) for s in names if rnd.random() < (0.2 if v % 2 else 0.8)]
    df = spark.createDataFrame(calls, "contig string, pos int, s string, g byte")
    want = {}
    for c, v, s, g in calls:
        for c2, v2, s2, g2 in calls:
            if (c, v) == (c2, v2) and s.encode() < s2.encode():
                own = want.setdefault((s, s2), [0] * 5)
                for k, x in enumerate((True, g == g2 == 1, abs(g - g2) == 2, g == 1, g2 == 1)):
                    own[k] += x
    got = kinship.pair_counts(df, listed=listed)
    assert got.dtypes == kinship.pair_counts(df).dtypes
    rows = got.collect()
    assert {(r.s_i, r.s_j): list(r)[2:] for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("pair_slice", [1, 5, 1000])
def test_lists_counted_in_slices(monkeypatch, pair_slice):
    monkeypatch.setattr(kinship, "PAIR_SLICE", pair_slice)
    monkeypatch.setattr(kinship, "OUTPUT_ROWS", 3)
    rnd = random.Random(3)
    rows = [(s, rnd.randint(0, 2), [(rnd.randint(0, 2), rnd.choice(["x", "y", "", "\x1bm", "\x1be"])) for _ in range(rnd.randint(1, 6))])
            for s in ["a"] * 7 + ["b"] + ["c"] * 4 + ["d"]]
    want = {}
    for s, g, later in rows:
        for g2, name in later:
            own = want.setdefault((s, name.replace("\x1bm", "\x1f").replace("\x1be", "\x1b")), [0] * 5)
            for k, x in enumerate((True, g == g2 == 1, abs(g - g2) == 2, g == 1, g2 == 1)):
                own[k] += x
    batches = [
        pa.RecordBatch.from_pydict({"s_i": pa.array([r[0] for r in some], pa.string()), "g_i": pa.array([r[1] for r in some], pa.int8()),
                                    "later": pa.array([kinship.MARK.join(f"{g}{n}" for g, n in r[2]) for r in some], pa.string())})
        for some in (rows[:2], [], rows[2:6], rows[6:9], rows[9:])
    ]
    got = [tuple(r.values()) for b in kinship._count_lists(iter(batches)) for r in b.to_pylist()]
    assert {r[:2]: list(r[2:]) for r in got} == want and len(got) == len(want)


def test_listed_pairs_are_counted_as_numbers(spark, monkeypatch, capsys):
    monkeypatch.setattr(kinship, "NAMES_PER_ROW", 2)
    calls = [("1", v, f"s{(v + 3 * k) % 11}", k % 3) for v in range(20) for k in range(9)]
    got = kinship.pair_counts(spark.createDataFrame(calls, "contig string, pos int, s string, g byte"), listed=100)
    assert sum(r.n_shared for r in got.collect()) == 20 * 36
    got.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "split(later" not in plan  # no row per pair of calls


def test_listed_kinship_copies_no_call_to_every_block(spark, monkeypatch):
    monkeypatch.setattr(kinship, "SAMPLES_PER_BLOCK", 10)
    monkeypatch.setattr(kinship, "_tiles", lambda keyed: pytest.fail("tiles of sites with few calls"))
    calls = [("1", v, f"s{(v * 5 + k) % 300}", k % 3) for v in range(300) for k in range(4)]
    got = kinship.pair_counts(spark.createDataFrame(calls, "contig string, pos int, s string, g byte")).collect()
    assert sum(r.n_shared for r in got) == 300 * 6


def test_kinship_of_duplicates_and_absent_calls(spark):
    rnd = random.Random(9)
    base = [rnd.randint(0, 2) for _ in range(200)]
    other = [rnd.randint(0, 2) for _ in range(200)]
    full = [(v, s, g) for s, gs in (("a", base), ("b", base), ("c", other)) for v, g in enumerate(gs)]
    phi = {(r["s_i"], r["s_j"]): r["phi"] for r in kinship.kinship(entries_from(spark, full)).collect()}
    assert phi["a", "b"] == 0.5 and phi["a", "c"] < 0.3
    listed = [c for c in full if c[2] > 0]
    sparse = kinship.kinship_absent_as_homref(entries_from(spark, listed)).collect()
    assert {(r["s_i"], r["s_j"]): r["phi"] for r in sparse} == pytest.approx(phi)
    assert kinship.likely_duplicates(kinship.kinship(entries_from(spark, full))).count() == 1
    assert kinship.kinship(entries_from(spark, full), "3").count() == 0


# --- tests and corrections ------------------------------------------------------------------------------------------


def two_stage_brute(ps, alpha):
    m = len(ps)
    order = np.argsort(ps)

    def bh(level):
        sorted_p = np.array(ps)[order]
        adj = np.minimum.accumulate((sorted_p * m / np.arange(1, m + 1))[::-1])[::-1]
        return adj, adj <= level

    adj, rej = bh(alpha)
    r1 = rej.sum()
    share = 1.0
    if 0 < r1 < m:
        share = (m - r1) / m
        _, rej = bh(alpha / share)
    out = np.empty(m), np.empty(m, dtype=bool)
    out[0][order], out[1][order] = np.minimum(adj, 1) * share, rej
    return out


@pytest.mark.parametrize("case", ["mixed", "uniform", "tiny", "ties"])
def test_two_stage_fdr(spark, case):
    rng = np.random.default_rng(4)
    ps = {
        "mixed": np.concatenate([rng.uniform(size=150), rng.uniform(size=60) * 1e-4, [0.0, 1e-300]]),
        "uniform": rng.uniform(size=100), "tiny": rng.uniform(size=40) * 1e-6,
        "ties": np.concatenate([np.full(50, 0.01), np.full(100, 1.0), rng.uniform(size=10)]),
    }[case]
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "i int, p_val double")
    got = {r["i"]: (r["pval_bonferroni"], r["significant_bonferroni"]) for r in multitest.fdr_two_stage(df).collect()}
    adj, rej = two_stage_brute(list(ps), 0.05)
    for i in range(len(ps)):
        assert math.isclose(got[i][0], adj[i], rel_tol=1e-9, abs_tol=1e-300) and got[i][1] == rej[i]


def counts(spark, *rows):
    return spark.createDataFrame(
        [(g, "b", *c) for g, c in rows], "gene string, bin string, " + ", ".join(f"{c} long" for c in genetable.COUNTS)
    )


SIZES = {"case_pheno": 100, "control_pheno": 200, "case_null": 100, "control_null": 200}


def test_gene_tests_closed_form(spark):
    long = counts(spark, ("g", (30, 20, 12, 25)), ("low", (4, 0, 3, 0)), ("all", (200, 400, 200, 400)))
    z = {r["gene"]: r for r in gene_tests.two_proportion_z(long, SIZES).collect()}
    pooled = 42 / 400
    expected = (30 / 200 - 12 / 200) / math.sqrt(pooled * (1 - pooled) * 2 / 200)
    assert set(z) == {"g"} and math.isclose(z["g"]["z_score"], expected)
    d = {r["gene"]: r for r in gene_tests.diff_of_proportions_z(long, SIZES, 1, 1).collect()}
    p = [30 / 200, 20 / 400, 12 / 200, 25 / 400]
    se = math.sqrt(sum(x * (1 - x) / n for x, n in zip(p, (200, 400, 200, 400))))
    assert math.isclose(d["g"]["z_score"], ((p[0] - p[1]) - (p[2] - p[3])) / se) and "all" not in d
    o = {r["gene"]: r for r in gene_tests.log_odds_difference_z(long, SIZES, 1, 1).collect()}
    lp = math.log(30.5 * 380.5 / (170.5 * 20.5))
    assert math.isclose(o["g"]["log_or_pheno"], lp) and len(o) == 3
    assert math.isclose(o["g"]["pval_bonferroni"], min(1, o["g"]["p_val"] * 3), rel_tol=1e-12)
    f = gene_tests.fold_change(long).collect()
    fold = {r["gene"]: r["log2_fold_change"] for r in f}
    assert math.isclose(fold["g"], math.log2((30 / 20) / (12 / 25))) and "low" not in fold
    assert column(genetable.infinite_ratio_genes(long), "gene") == ["low"]


def test_published_odds_ratios(spark):
    df = spark.createDataFrame([(13, 26), (433, 5071)], "x long, y long")
    got = df.select(gene_tests.odds_ratio(F.col("x"), F.lit(639), F.col("y"), F.lit(9059)).alias("o"))
    assert [round(o, 6) for o in column(got, "o")] == [7.214856, 1.653036]


# --- resampling -----------------------------------------------------------------------------------------------------


def test_firth_against_direct_fit(spark):
    rng = np.random.default_rng(8)
    rows = []
    for b, shift in (("even", 0.0), ("shifted", 0.6), ("separated", 8.0)):
        rows += [(b, 1, float(v)) for v in rng.normal(shift, 1, 60)] + [(b, 0, float(v)) for v in rng.normal(0, 1, 80)]
    rows += [("few", 1, 0.1)] * 3 + [("few", 0, 0.2)] * 9 + [("flat", i % 2, 1.0) for i in range(20)]
    got = {r["bin"]: r for r in firth.firth_by_bin(spark.createDataFrame(rows, "bin string, y int, x double")).collect()}
    assert set(got) == {"even", "shifted", "separated", "flat"}
    flat = got.pop("flat")
    assert flat["log_odds"] is None and flat["pval"] is None and flat["reason"] == "degenerate" and not flat["converged"]
    assert all(r["converged"] and r["reason"] is None and 0 < r["n_iter"] < firth.MAX_ITER for r in got.values())
    for b, r in got.items():
        x = np.array([v for n, _, v in rows if n == b])
        y = np.array([k for n, k, _ in rows if n == b])
        design = np.column_stack([np.ones(len(x)), (x - x.mean()) / x.std()])

        def fit(free):
            beta = np.zeros(2)
            for _ in range(500):
                p = 1 / (1 + np.exp(-design @ beta))
                w = p * (1 - p)
                info = design.T @ (design * w[:, None])
                hat = np.einsum("ij,jk,ik->i", design, np.linalg.inv(info), design) * w
                score = design.T @ (y - p + hat * (0.5 - p))
                step = np.zeros(2)
                step[free] = np.linalg.solve(info[np.ix_(free, free)], score[free])
                beta += step * min(1, 1 / max(np.abs(step).max(), 1e-12))
            ll = np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5 * np.linalg.slogdet(info)[1]
            return beta, ll, info

        beta, ll, info = fit([0, 1])
        _, ll0, _ = fit([0])
        assert math.isclose(r["log_odds"], beta[1], rel_tol=1e-5, abs_tol=1e-7)
        assert math.isclose(r["se"], math.sqrt(np.linalg.inv(info)[1, 1]), rel_tol=1e-5)
        p_value = math.erfc(math.sqrt(max(ll - ll0, 0)))
        assert math.isclose(r["pval"], p_value, rel_tol=1e-4, abs_tol=1e-7)


def test_density_against_direct_sum(spark):
    rng = np.random.default_rng(6)
    data = {"pheno": rng.normal(1, 1, 70), "null": rng.normal(0, 2, 50)}
    rows = [("b", side, float(v)) for side, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "bin string, side string, v double").repartition(5)
    got = density.density_curves(df, 50).collect()
    both = np.concatenate(list(data.values()))
    grid = np.linspace(both.min() - 1, both.max() + 1, 50)
    for r in got:
        v = data[r["side"]]
        h = v.std(ddof=1) * len(v) ** -0.2
        u = (grid[r["grid_idx"]] - v) / h
        direct = np.exp(-0.5 * u * u).sum() / (len(v) * h * math.sqrt(2 * math.pi))
        assert math.isclose(r["density"], direct, rel_tol=1e-9) and math.isclose(r["x"], grid[r["grid_idx"]])
    assert len(got) == 100


@pytest.mark.parametrize("most", [10**6, 10])
def test_looked_up_sums_are_the_joined_ones(spark, monkeypatch, most):
    rnd = random.Random(2)
    names = [f"{c}_{b}" for c in genetable.COHORTS for b in range(3)]
    wide = spark.createDataFrame([(f"g{i:03d}", *[rnd.choice([0, 0, 1, 5, None]) for _ in names]) for i in range(120)], "gene string, " + ", ".join(f"{c} long" for c in names))
    numbered = resample.index_genes(wide)
    genes = spark.createDataFrame(numbered.collect(), numbered.schema)
    drawn = resample.draw_sets(resample.counters(spark, 500), genes, 7)
    joined = resample.set_sums(resample.set_rows(drawn), genes, 3)
    monkeypatch.setattr(resample, "MOST_CELLS", most)
    looked = resample.set_sums(drawn, genes, 3)
    zero = {c: 0 for c in joined.columns}
    assert sorted(tuple(r) for r in looked.fillna(zero).select(joined.columns).collect()) == sorted(tuple(r) for r in joined.fillna(zero).collect())
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan) == (most == 10)
    named = {r["gene_idx"]: r["gene"] for r in genes.collect()}
    rows = resample.genes_of_sets(drawn, genes, ["gene", "case_pheno_1"]).collect()
    assert len(rows) == 3500 and all(named[r["gene_idx"]] == r["gene"] for r in rows)
    assert resample.set_sums(drawn.limit(0), genes, 3).count() == 0


def test_resampling_against_direct_sums(spark):
    rnd = random.Random(1)
    n, k, bins = 40, 5, ("x", "y")
    values = {i: [rnd.randint(0, 4) for _ in range(8)] for i in range(n)}
    names = [f"{c}_{b}" for c in genetable.COHORTS for b in range(2)]
    wide = spark.createDataFrame([(f"g{i:02d}", *v) for i, v in values.items()], "gene string, " + ", ".join(f"{c} long" for c in names))
    genes = resample.index_genes(wide)
    sets = resample.sample_gene_sets(resample.counters(spark, 60), genes, k)
    logs = resample.with_log_ratio(resample.simulate(sets, genes, bins), 0.5, 1.0)
    by_idx = {r["gene_idx"]: r.asDict() for r in genes.collect()}
    members = {}
    for r in sets.collect():
        members.setdefault(r["iter"], []).append(by_idx[r["gene_idx"]])
    rows = logs.collect()
    assert len(rows) == 120
    for r in rows:
        b = bins.index(r["bin"])
        case, control = (sum(m[f"{c}_{b}"] + 0.01 for m in members[r["iter"]]) for c in ("case_pheno", "control_pheno"))
        assert math.isclose(r["ratio_pheno"], case / control) and r["valid_pheno"] == (case > 1 and control > 1)
        if r["valid_pheno"]:
            assert math.isclose(r["log2_pheno"], math.log2(case / control / 0.5))
    p = {r[0]: r[1] for r in resample.empirical_p(logs).collect()}
    top = resample.top_sets(logs).collect()
    for b in bins:
        pheno = [r["log2_pheno"] for r in rows if r["bin"] == b and r["log2_pheno"] is not None]
        null = [r["log2_null"] for r in rows if r["bin"] == b and r["log2_null"] is not None]
        cut = np.percentile(pheno, 99)
        assert math.isclose(p[b], (sum(v >= cut for v in null) + 1) / (len(null) + 1))
        assert {r["iter"] for r in top if r["bin"] == b} == {
            r["iter"] for r in rows if r["bin"] == b and r["log2_pheno"] is not None and r["log2_pheno"] > cut
        }
    with pytest.raises(Exception, match="larger than the population"):
        resample.sample_gene_sets(resample.counters(spark, 2), genes, 41).collect()
    assert resample.sample_gene_sets(resample.counters(spark, 2), genes, 41, shrink=True).count() == 80


def test_pairs(spark):
    top = spark.createDataFrame([(0,), (1,), (2,)], "iter long")
    sets = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1), (1, 0), (2, 2), (3, 0), (3, 1)], "iter long, gene_idx int")
    genes = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "gene_idx int, gene string")
    pairs = resample.gene_pairs(top, sets, genes, genes)
    assert {tuple(r) for r in pairs.collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    assert {tuple(r) for r in resample.network_nodes(pairs, "a").collect()} == {
        ("a", 2, 1500, True), ("b", 2, 1500, False), ("c", 2, 1500, False),
    }
    assert resample.rank_pairs(pairs, 1).first()["gene_1"] == "a"


def test_top_sets_meet_drawn_sets_by_sorting(spark):
    """The counters' size stands for that of the sets, so Spark alone would send all sets to every task."""
    genes = spark.createDataFrame([(i, f"g{i}", i) for i in range(30)], "gene_idx int, gene string, case_pheno_0 long")
    drawn = resample.draw_sets(spark.range(50).select(F.when(F.col("id") < 40, F.col("id")).alias("iter")).union(spark.range(5)), genes, 4)
    top = spark.createDataFrame([(i, "x", float(i)) for i in (0, 1, 7, 7, 45)] + [(None, "x", 1.0)], "iter long, bin string, log2_pheno double")
    rows, got = (sorted(tuple(r) for r in resample.contributions(top, s, genes, ["x"]).collect()) for s in (resample.set_rows(drawn), drawn))
    assert got == rows and sum(r[2] for r in got) == 4 * (2 + 2 + 1 + 1)
    assert sorted(resample.gene_pairs(top, drawn, genes, genes).collect()) == sorted(resample.gene_pairs(top, resample.set_rows(drawn), genes, genes).collect())
    plan = resample._of_top_sets(top, drawn)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_statistics_of_bins_are_what_is_sent(spark, tmp_path):
    spark.range(2000).selectExpr("concat('b', id % 3) bin", "id * 1.0 x").write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    plan = resample.standardise(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "SortMergeJoin" not in plan
    ahead = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "BuildRight" in resample.standardise(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", ahead)


def test_sets_are_drawn_by_many_tasks(spark):
    from burdenframe.plans.catalog import resample_queries

    drawn = resample_queries.iterations(spark, "/root/testdata/sf0.001")
    assert drawn.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
