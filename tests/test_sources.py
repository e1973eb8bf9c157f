"""Readers and writers on small hand-made files."""

from __future__ import annotations

import gzip
import json
import os
import pickle

import pytest
from pyspark.sql import functions as F

from burdenframe.functions import genotype as G
from burdenframe.operators import burden, filters
from burdenframe.plans import commands, workspace
from burdenframe.plans.catalog import source_queries
from burdenframe.sources import inventory, metadata, tables, vcf, vcf_format
from burdenframe.streaming import ingest

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def site(contig, pos, alt, csq, fmt, *cells):
    return "\t".join([contig, str(pos), ".", "A", alt, "50", "PASS", f"DP=9;CSQ={csq};DB", fmt, *cells])


def write_sample(folder, name, sample, sites):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([f"{HEAD}\t{sample}", *sites]) + "\n")


FMT = "GT:AD:DP"
GOOD = "0/1:20,20:40"
AFS = {"": None, "0.00005": 0, "0.0001": None, "0.0005": 1, "0.001": None, "0.005": 2, "0.01": None, "0.05": None}


@pytest.fixture
def cohort_dir(tmp_path):
    """Every frequency boundary, and one site for each filter, in sample E1; a subset in E2."""
    sites = [site("chr1", i + 1, "T", f"HIGH|G1|7|{af},LOW|X|1|0.5", FMT, GOOD) for i, af in enumerate(AFS)]
    dropped = [
        site("chrM", 50, "T", "HIGH|G1||0.00005", FMT, GOOD),
        site("chr1", 51, "*", "HIGH|G1||0.00005", FMT, GOOD),
        site("chr1", 52, "T", "HIGH|G1||0.00005", FMT, "0/1:20,20:30"),
        site("chr1", 53, "T", "HIGH|G1||0.00005", FMT, "0/1:80,20:100"),
        site("chr1", 54, "T", "HIGH|G1||0.00005", FMT, "0/1:0,0:0"),
        site("chr1", 55, "T", "HIGH|G1||0.00005", "GT:AD", "0/1:20,20"),
        site("chr1", 56, "T", "HIGH|G1||0.00005", FMT, "./.:20,20:40"),
    ]
    multi = [site("chrX", 60, "T,G", "LOW|G2||0.00005", FMT, "1|2:5,20,20:45")]
    write_sample(tmp_path / "a", "E1_x.vcf", "E1", sites + dropped + multi)
    write_sample(tmp_path / "a" / "b", "E2.genome.vcf", "E2", [sites[1], multi[0]])
    (tmp_path / "meta.tsv").write_bytes("E1.vcf\tLIHAS,N\tm\xfc\nE2\tN\nE1_y\tOTHER\tlate\n".encode("latin-1"))
    return tmp_path


def test_entries_and_filters(spark, cohort_dir):
    entries = commands.read_entries(spark, str(cohort_dir / "a"))
    assert {r["s"] for r in entries.select("s").distinct().collect()} == {"E1", "E2"}
    kept = filters.burden_filters(entries).collect()
    assert {(r["s"], r["contig"], r["pos"]) for r in kept} == {
        ("E1", "1", 2), ("E1", "1", 3), ("E1", "1", 4), ("E1", "1", 5), ("E1", "1", 6), ("E1", "1", 56),
        ("E1", "X", 60), ("E2", "1", 2), ("E2", "X", 60),
    }
    ac = {(r["s"], r["pos"]): r["AC"] for r in kept}
    assert ac[("E1", 60)] == 2 and ac[("E1", 56)] is None and ac[("E1", 2)] == 1
    phased = entries.filter("pos = 60").select("GT_call").first()["GT_call"]
    assert phased["alleles"] == [1, 2] and phased["phased"]
    by_header = vcf.annotate_from_csq(vcf.read_vcf(spark, str(cohort_dir / "a"), "header"))
    assert by_header.count() == entries.count()


def write_multi(folder, samples=7, sites=300):
    """Two files of several samples, one of them compressed in two members, and what they hold."""
    folder.mkdir()
    calls = lambda k: [f"0/{(v * 7 + s + k) % 2}:1,{s}:{v}" for v in range(sites) for s in range(samples)]
    want = {}
    for k, name in enumerate(("one.vcf", "two.vcf.gz")):
        names, cells = [f"f{k}s{s}" for s in range(samples)], calls(k)
        rows = [site(f"chr{1 + v % 3}", v, "T", "HIGH|G||", FMT, *cells[v * samples : (v + 1) * samples]) for v in range(sites)]
        want |= {(n, str(1 + v % 3), v): cells[v * samples + s].split(":")[0] for v in range(sites) for s, n in enumerate(names)}
        text = "\n".join(["\t".join([HEAD, *names]), *rows]) + "\n" * (k == 0)
        if name.endswith(".gz"):
            half = len(text) // 2
            (folder / name).write_bytes(gzip.compress(text[:half].encode()) + gzip.compress(text[half:].encode()))
        else:
            (folder / name).write_text(text)
    (folder / "_hidden.vcf").write_text("chr1\t1\n")
    (folder / "empty.vcf").write_text("")
    (folder / "other.txt").write_text("chr1\t1\n")
    return want


@pytest.mark.parametrize("options", [{}, {"partitionBytes": 999, "samplesPerRow": 3}, {"partitionBytes": 5000, "samplesPerRow": 1}])
def test_vcf_source_reads_each_call_once(spark, tmp_path, options):
    want = write_multi(tmp_path / "m")
    vcf_format.register(spark)
    rows = spark.read.format("vcf").options(**options).load(str(tmp_path / "m")).collect()
    got = [((s, r.contig, r.pos), c.split(":")[0]) for r in rows for s, c in zip(r.sample_names, r.cells, strict=True)]
    assert len(got) == len(want) and dict(got) == want
    assert max(len(r.cells) for r in rows) <= options.get("samplesPerRow", 7)


def test_vcf_source_takes_filters(spark, tmp_path):
    want = write_multi(tmp_path / "m")
    expect = {k for k in want if k[1] == "2" and 100 <= k[2] < 200 or k[1] == "3"}
    found = vcf.read_vcf(spark, str(tmp_path / "m"), glob="*.{vcf,vcf.gz}", intervals=["chr2:100-chr2:200", "chr3"])
    assert {(r.s, r.contig, r.pos) for r in found.collect()} == expect
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Join" not in plan and "Exchange" not in plan
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = vcf.read_sites(spark, str(tmp_path / "m")).filter("contig = '2' AND pos > 100 AND pos <= 200 AND block = 0")
        assert sorted(r.pos for r in few.collect()) == sorted(2 * [v for v in range(101, 201) if v % 3 == 1])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = vcf_format.FilteringVcfReader({"path": str(tmp_path / "m")})
    from pyspark.sql.datasource import EqualTo, LessThan

    assert len(list(reader.pushFilters([EqualTo(("contig",), "2"), LessThan(("pos",), 50)]))) == 2
    read = [pos for part in reader.partitions() for batch in reader.read(part) for pos in batch.column("pos").to_pylist()]
    assert sorted(set(read)) == [v for v in range(50) if v % 3 == 1]


def by_line(name, data, per_row, low=-1 << 31):
    """Rows of a file, a line at a time."""
    samples, out = [], []
    for raw in data.split(b"\n"):
        text = raw.rstrip(b"\r").decode("utf-8", "replace")
        cells = text.split("\t")
        if raw.startswith(b"#"):
            samples = cells[9:] if raw.startswith(b"#CHROM") else samples
        elif raw.count(b"\t"):
            pos = int(cells[1]) if cells[1].strip().lstrip("-").isdigit() else None
            fixed, own = (cells[2:9] + [None] * 7)[:7], cells[9:]
            for block, at in enumerate(range(0, max(len(own), 1), per_row)):
                if pos is None or pos >= low:
                    out.append((name, vcf_format.plain_contig(cells[0]), pos, *fixed, block, samples[at : at + per_row], own[at : at + per_row]))
    return out


ODD = [
    b"", b"\n\n", b"#CHROM\n", b"##x\n#CHROM\tP\tI\tR\tA\tQ\tF\tN\tFO\ta\tb\tc\r\nchr1\t5\t.\tA\tT\t1\tPASS\tx\tGT\t0/1\t1/1\t0/0\r\nchrM\t 7 \t.\tA",
    b"chr2\t1\tr\tA\tT\t1\tP\tx\tGT\tearly\n#CHROM\tP\tI\tR\tA\tQ\tF\tN\tFO\ta\n1\t0x1F\t\xff\tA\tT\t\t\t\t\tz\tbeyond\tmore\n\nshort\nchr3\tno\n"
    b"#CHROM\tP\tI\tR\tA\tQ\tF\tN\tFO\tn\xc3\xa9\n4\t-9\t\n5\t12\t\t",
]


@pytest.mark.parametrize("read_bytes", [1, 7, 1000])
def test_vcf_lines_taken_apart_together(tmp_path, monkeypatch, read_bytes):
    monkeypatch.setattr(vcf_format, "READ_BYTES", read_bytes)
    monkeypatch.setattr(vcf_format, "BATCH_CELLS", 9)
    for k, data in enumerate(ODD):
        (tmp_path / f"{k}.vcf").write_bytes(data)
    expected = [r for k, data in enumerate(ODD) for r in by_line(f"{k}.vcf", data, 2)]
    reader = vcf_format.VcfReader({"path": str(tmp_path), "samplesPerRow": "2"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [tuple(r.values())[1:] for r in rows] == expected
    size = len(ODD[3])
    for step in (1, 5, size):  # a line is read by the stretch in which it begins
        whole = vcf_format.Stretches([vcf_format.Stretch(str(tmp_path / "3.vcf"), b, min(b + step, size)) for b in range(0, size, step)])
        assert [tuple(r.values())[1:] for b in reader.read(whole) for r in b.to_pylist()] == by_line("3.vcf", ODD[3], 2)
    reader.low = 6
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [tuple(r.values())[1:] for r in rows] == [r for k, data in enumerate(ODD) for r in by_line(f"{k}.vcf", data, 2, 6)]


def test_sample_files_in_a_folder_per_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "FILES_PER_TASK", 20)
    tables_dir = str(tmp_path / "tables")
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tables_dir}/{name}.parquet")
    make("customer", [(k,) for k in range(300)], "c_custkey long")
    make("orders", [(k, k % 250 if k else None) for k in range(400)], "o_orderkey long, o_custkey long")
    make("lineitem", [(k, 1 + k % 7, 1 + k % 5, 4.0) for k in range(400)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    make("part", [(k, "b", "t", 1) for k in range(1, 8)], "p_partkey long, p_brand string, p_type string, p_size int")
    root = source_queries.write_sample_vcfs(spark, tables_dir)
    files = [(folder, name) for folder, _, names in os.walk(root) for name in names]
    names = sorted(name for _, name in files)
    assert names == sorted([f"sample={k}_x.vcf.txt" for k in range(300)] + [f"sample={source_queries.NO_NAME}.txt"])
    assert len({folder for folder, _ in files}) <= 15
    text = open(next(f"{folder}/{name}" for folder, name in files if name == "sample=5_x.vcf.txt")).read()
    assert text.startswith("##fileformat=VCFv4.2\n#CHROM\t") and text.endswith("\n") and text.count("\n") == 4
    calls = source_queries.vcf_scan_files(spark, tables_dir)
    assert calls.count() == 400 and calls.filter("s = '5'").count() == 2 and calls.filter("s = ''").count() == 1


def test_tasks_do_not_get_the_list_of_paths(tmp_path):
    paths = [str(tmp_path / f"{k}.vcf") for k in range(500)]
    for p in paths:
        open(p, "w").write("chr1\t1\n")
    source = vcf_format.VcfSource({"paths": json.dumps(paths), "pathGlobFilter": "*.vcf"})
    reader = source.reader(None)
    assert len(pickle.dumps((reader, source))) < 2000
    assert [f for f, _ in reader.files()] == sorted(paths)


def test_listing_of_many_files_has_few_tasks(spark, tmp_path):
    for k in range(1200):
        (tmp_path / f"{k}.txt").write_text("x")
    files = inventory.list_files(spark, str(tmp_path))
    assert files.count() == 1200 and files.rdd.getNumPartitions() <= inventory.TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def test_vcf_source_lists_files(spark, tmp_path):
    write_multi(tmp_path / "m")
    paths = [str(tmp_path / "m" / n) for n in ("one.vcf", "two.vcf.gz")]
    assert vcf.read_sites(spark, paths).filter("block = 0").count() == 600
    with pytest.raises(Exception, match="nowhere"):
        vcf.read_sites(spark, str(tmp_path / "nowhere")).count()
    assert vcf_format.VcfReader({"path": str(tmp_path), "recursive": "false"}).files() == []
    assert vcf_format.Limits.of("chrM,1:5-9").ranges == {"MT": [(-1 << 31, 1 << 31)], "1": [(5, 8)]}


def test_burden_tables_by_phenotype(spark, cohort_dir):
    found = commands.burden_tables(spark, str(cohort_dir / "a"), str(cohort_dir / "meta.tsv"), "LIHAS")
    case = {r["gene"]: r.asDict() for r in found["positive"].collect()}
    assert [case["G1"][f"HIGH.{b}"] for b in burden.AF_BINS] == [1, 1, 1]
    assert case["G2"]["LOW.gnomad_001"] == 2 and case["G2"]["HIGH.gnomad_001"] == 0
    control = {r["gene"]: r.asDict() for r in found["negative"].collect()}
    assert control["G1"]["HIGH.gnomad_001"] == 1 and control["G2"]["LOW.gnomad_001"] == 2
    assert set(commands.burden_tables(spark, str(cohort_dir / "a"))) == {"all"}


def test_metadata_rules(spark, tmp_path):
    text = "E1.vcf\tA,B\tx\nE2\tonly\nE1_2\tC\ty\nE3\t\tz\nE4\tp\t \nE5\t p \t m \textra\n"
    (tmp_path / "m.tsv").write_text(text)
    got = {r["s"]: tuple(r)[1:] for r in metadata.read_metadata(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {
        "E1": ("A,B", "x", 1), "E2": ("NA", "NA", 0), "E3": ("", "z", 0), "E4": ("NA", "NA", 0), "E5": ("p", "m", 0),
    }


def test_reference_config_and_pca(spark, tmp_path):
    genome = {
        "name": "g", "contigs": [{"name": "1", "length": 10}, {"name": "MT", "length": 5}], "xContigs": ["X"],
        "yContigs": ["Y"], "mtContigs": ["MT"],
        "par": [{"start": {"contig": "X", "position": 1}, "end": {"contig": "X", "position": 2}}],
    }
    (tmp_path / "g.json").write_text(json.dumps(genome, indent=1))
    contigs, par = metadata.read_reference_genome(spark, str(tmp_path / "g.json"))
    assert {tuple(r) for r in contigs.collect()} == {("1", 10, "autosome"), ("MT", 5, "MT")}
    assert [tuple(r) for r in par.collect()] == [("X", 1, 2)]
    df = spark.createDataFrame([("1",), ("9",)], "contig string")
    assert vcf.check_contigs(df, contigs, "drop").count() == 1
    with pytest.raises(Exception, match="unknown contig 9"):
        vcf.check_contigs(df, contigs).collect()
    (tmp_path / "c.json").write_text(json.dumps({"a": ["G1", "G2"], "b.c": ["G1"]}, indent=1))
    sets = metadata.read_gene_config(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in sets.collect()} == {("a", "G1"), ("a", "G2"), ("b.c", "G1")}
    (tmp_path / "pca.txt").write_text("SampleID S1 S2 S3\nPC1 0.1 0.2 0.3\nPC2 1 2 3\nPC3 9 9 9\n")
    (tmp_path / "loc.tsv").write_text("genotype_id\tpopulation_code\nS1\tP\nS3\tQ\n")
    scores = commands.pca_scores(spark, str(tmp_path / "pca.txt"), str(tmp_path / "loc.tsv"))
    assert {tuple(r) for r in scores.collect()} == {("S1", 0.1, 1.0, "P"), ("S3", 0.3, 3.0, "Q")}


def test_inventory(spark, tmp_path):
    for name in ("d1/E1.vcf", "d2/E1.vcf", "d2/E2.genome.vcf", "d2/E2_1.vcf", "x.bam"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("a\n")
    tagged = commands.inventory(spark, str(tmp_path), ".vcf", "d2")
    status = {(r["path"].split("/")[-2], r["name"]): r["status"] for r in tagged.collect()}
    assert status == {
        ("d1", "E1.vcf"): "rejected", ("d2", "E1.vcf"): "unique",
        ("d2", "E2.genome.vcf"): "unique", ("d2", "E2_1.vcf"): "duplicate",
    }
    files = inventory.list_files(spark, str(tmp_path))
    assert inventory.with_suffix(files, ".vcf", unique_only=True).count() == 3
    assert {r["prefix"] for r in inventory.clean_prefixes(files, "vcf").collect()} == {"E1", "E2_1"}
    assert inventory.find_file(files, "x.bam").count() == 1 and inventory.find_file(files, "y").count() == 0
    assert inventory.line_count(spark, str(tmp_path / "x.bam")).first()[0] == 1
    lines = spark.createDataFrame([("a|b",), ("c|b",)], "value string")
    assert inventory.count_unique_names(lines, 1, "|").first()[0] == 1
    with pytest.raises(Exception, match="too few columns"):
        inventory.count_unique_names(lines, 2, "|").collect()
    counts = inventory.inventory_counts(tagged).first()
    assert tuple(counts) == (4, 2, 1, 1)


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, "s", 1), ("2", 6, "t", 2)], "contig string, pos int, s string, AC int")
    path = str(tmp_path / "cohort")
    tables.save_cohort(df, path)
    with pytest.raises(Exception, match="already exists"):
        tables.save_cohort(df, path)
    tables.save_cohort(df, path, overwrite=True)
    assert tables.load_cohort(spark, [path]).count() == 2
    assert tables.cohort_size_of("/x/frequency_table_639_L_12.csv", spark) == 639
    assert tables.cohort_size_of("/x/none.csv", spark) is None


def test_call_text(spark):
    rows = [("0/1",), ("1|1",), ("./.",), ("0/.",), ("1",), ("2/1",), (None,)]
    df = spark.createDataFrame(rows, "gt string")
    assert [r[0] for r in df.select(G.alt_allele_count(F.col("gt"))).collect()] == [1, 2, None, None, 1, 2, None]
    names = ["chr1", "chr22", "chrX", "chrM", "chrUn", "MT", "chr23"]
    recoded = spark.createDataFrame([(n,) for n in names], "c string").select(G.recode_contig(F.col("c"))).collect()
    assert [r[0] for r in recoded] == ["1", "22", "X", "MT", "chrUn", "MT", "chr23"]


def test_incremental_ingest_is_idempotent(spark, cohort_dir):
    root, store, mark = (str(cohort_dir / n) for n in ("a", "store", "mark"))

    def annotate(entries):
        return filters.burden_filters(vcf.annotate_from_csq(entries))

    def totals():
        return {tuple(r) for r in ingest.cohort_counts(ingest.stored_counts(spark, store)).collect()}

    def run():
        ingest.ingest_vcf(spark, root, annotate, store, mark).awaitTermination()

    run()
    first = totals()
    run()
    assert totals() == first and ("G1", "HIGH.gnomad_001", 2) in first
    good = site("chr1", 2, "T", "HIGH|G1|7|0.00005", FMT, GOOD)
    write_sample(cohort_dir / "a", "E3.vcf", "E3", [good])
    run()
    assert ("G1", "HIGH.gnomad_001", 3) in totals()
    ingest.append_batch(spark.createDataFrame([("E3", "E3.vcf", "G1", "HIGH.gnomad_001", 1)], "s string, file string, gene string, bin string, ac long"), store, 1)
    assert ("G1", "HIGH.gnomad_001", 3) in totals()
    write_sample(cohort_dir / "a" / "again", "E3.vcf", "E3", [good, site("chr1", 3, "T", "HIGH|G1|7|0.00005", FMT, GOOD)])
    run()
    by_sample = ingest.cohort_counts(ingest.stored_counts(spark, store, one_file_per_sample=True))
    assert ("G1", "HIGH.gnomad_001", 4) in {tuple(r) for r in by_sample.collect()}


@pytest.mark.parametrize("fold_at", [(), (0,), (1, 3), (0, 1, 2, 3, 4)])
def test_folded_stores_read_the_same(spark, tmp_path, fold_at):
    store = str(tmp_path / "store")
    deliveries = [
        [("a", "a1", "G", "x", 1), ("a", "a1", "H", "x", 2), ("b", "b1", "G", "x", 4)],
        [("c", "c1", "G", "x", 8), ("a", "a1", "G", "x", 16)],  # a1 again: its H is gone
        [("a", "a2", "G", "x", 32)],
        [("b", "b1", "G", "x", 64), ("d", "d1", "H", "x", 128)],
        [("c", "c0", "G", "x", 256)],
    ]
    schema = "s string, file string, gene string, bin string, ac long"
    latest = {}
    for i, rows in enumerate(deliveries):
        ingest.append_batch(spark.createDataFrame(rows, schema), store, i)
        if i in fold_at:
            ingest.fold(spark, store)
            if i == 3:
                ingest.sweep(spark, store)
        ingest.append_batch(spark.createDataFrame(rows, schema), store, i)  # run again, before and after a fold
        for key in {r[:2] for r in rows}:
            latest[key] = (i, sorted(r[2:] for r in rows if r[:2] == key))
        got = sorted(tuple(r) for r in ingest.stored_counts(spark, store).collect())
        assert got == sorted((s, *x) for (s, _), (_, own) in latest.items() for x in own)
        last = {s: max((i, f) for (t, f), (i, _) in latest.items() if t == s) for s, _ in latest}
        one = sorted(tuple(r) for r in ingest.stored_counts(spark, store, one_file_per_sample=True).collect())
        assert one == sorted((s, *x) for s, (_, f) in last.items() for x in latest[s, f][1])
    if fold_at:
        plan = ingest.current(spark, store)._jdf.queryExecution().toString()
        assert ("Join" in plan) == (max(fold_at) < 4)  # nothing to look for where the base has all


def test_scratch_removes_what_was_made_inside(spark):
    outside = workspace.stored(spark.range(3), "outside")
    with workspace.scratch(spark):
        inside = workspace.stored(spark.range(5), "inside")
        files = inside.inputFiles()
        assert inside.count() == 5 and files
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert outside.count() == 3


def test_commands_over_a_cohort(spark, cohort_dir):
    root = str(cohort_dir / "a")
    meta = metadata.read_metadata(spark, str(cohort_dir / "meta.tsv"))
    entries = commands.read_entries(spark, root)
    side = {r["gene"]: r.asDict() for r in commands.case_control_counts(entries, meta, "LIHAS").collect()}
    assert side["G1"]["HIGH.gnomad_001_case"] == 1 and side["G1"]["HIGH.gnomad_001_control"] == 1
    assert side["G1"]["HIGH.gnomad_01_1_control"] == 0
    null = commands.label(entries, meta, "*LIHAS").entries
    assert {(r["s"], r["cohort"]) for r in null.select("s", "cohort").distinct().collect()} == {
        ("E1", "negative"), ("E2", "positive"),
    }
    legacy = {r["gene"]: r for r in commands.legacy_gene_table(entries, meta, "LIHAS.*").collect()}
    assert (legacy["G1"]["high"]["gnomad_1_5"], legacy["G1"]["high"]["gnomad_5_100"]) == (0, 0)
    assert legacy["G2"]["low"]["gnomad_1"] == 2
    assert commands.legacy_gene_table(entries, min_dp=44).filter("gene = 'G2'").first()["low"]["gnomad_1"] == 4
    with pytest.raises(Exception, match="no sample matches"):
        commands.legacy_gene_table(entries, meta, "none").collect()
    stored = str(cohort_dir / "stored")
    tables.save_cohort(filters.select_core(entries), stored)
    again = commands.burden_tables_from(spark, stored, meta, "LIHAS")["positive"]
    direct = commands.burden_tables(spark, root, str(cohort_dir / "meta.tsv"), "LIHAS")["positive"]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, direct.collect()))
    long, vector = commands.genotype_matrix(filters.burden_filters(entries), spark.createDataFrame(
        [("E1", True), ("E2", False)], "s string, is_case boolean"))
    assert long.count() == 9 and {tuple(r) for r in vector.collect()} == {("E1", 1), ("E2", 0)}
    with pytest.raises(ValueError, match="metadata"):
        commands.label(entries, None, "LIHAS")


def test_table_writers(spark, tmp_path):
    table = spark.createDataFrame([("G1", 1, 0), (None, 2, 3)], "gene string, `HIGH.a` long, `LOW.a` long")
    target = tables.write_frequency_table(table, str(tmp_path), "frequency_table_2", "L_positive", stamp=False)
    assert target.endswith("frequency_table_2_L_positive.csv")
    tables.write_frequency_table(table.limit(1), str(tmp_path), "frequency_table_2", "L_positive", stamp=False)
    got = tables.read_frequency_table(spark, target)
    assert {tuple(r) for r in got.collect()} == {("G1", 1, 0), (None, 2, 3)}
    assert tables.timestamped("/a.b/t.csv", tables.datetime(2024, 1, 2, 3, 4, 5)) == "/a.b/t-20240102-030405.csv"
    run = spark.createDataFrame([("G1", 1.0)], "gene string, x double")
    for k in (10, 10, 5):
        tables.write_run(run, str(tmp_path / "runs"), 100, k, 6, 9)
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_labels_need_both_sides(spark, cohort_dir):
    root, meta = str(cohort_dir / "a"), str(cohort_dir / "meta.tsv")
    with pytest.raises(Exception, match="no sample matches phenotype NOPE"):
        commands.burden_tables(spark, root, meta, "NOPE")
    with pytest.raises(Exception, match="NOPE|empty side|not enough controls"):
        commands.burden_tables(spark, root, meta, "*NOPE")
