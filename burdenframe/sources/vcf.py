"""VCF text files as DataFrames.

``read_sites`` gives one row per site and block of samples, ``read_vcf`` one row per site and sample. Both read through the ``vcf`` data
source, in one scan: sample names come with the rows, from the headers or, with ``sample_from="file"``, from the file names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.functions import genotype as G
from burdenframe.functions import text as X
from burdenframe.operators.filters import LAST_POSITION, parse_interval
from burdenframe.sources import vcf_format

VCF_GLOB = "*.vcf"
VCF_GZ_GLOB = "*.{vcf,vcf.gz}"


def paths_from_list(spark: SparkSession, list_file: str) -> list[str]:
    """Paths named in a text file, one per line; the reader needs them on the driver to list files."""
    rows = spark.read.text(list_file).select(F.trim("value").alias("p")).filter("p <> ''").collect()
    return [r["p"] for r in rows]


def write_files(lines: DataFrame, path: str) -> int:
    """Write ``value`` as text lines to files ``name``, and count the files. Each partition makes a folder; the lines of a name stand together in one of them.

    A file is moved to its name when it is whole, so a repeated task only puts the same file there again. Spark's own writer takes a folder, a checksum file
    and several calls of the driver or of a shell for each.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, top, _ = vcf_format.located(path, {})
        folder = f"{top}/part-{task.partitionId():05d}"
        fs.create_dir(folder)
        part, name, out, files = f"{folder}/.part-{task.taskAttemptId()}", None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("line").cast(pa.large_string())  # neighbours in memory: the lines of a file are one stretch
            offsets, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :], memoryview(texts.buffers()[2])
            runs = pc.run_end_encode(batch.column("name"))
            low = 0
            for own, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if own != name:
                    if out is not None:
                        out.close()
                        fs.move(part, f"{folder}/{name}")
                    name, out, files = own, fs.open_output_stream(part), files + 1
                out.write(data[offsets[low] : offsets[high]])
                low = high
        if out is not None:
            out.close()
            fs.move(part, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    whole = lines.select("name", F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).alias("line"))
    return whole.mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


def read_sites(
    spark: SparkSession, paths: str | Sequence[str], recursive: bool = True, glob: str = VCF_GZ_GLOB, intervals: str | Sequence[str] | None = None
) -> DataFrame:
    """Sites of every matching file under ``paths``, with the parallel arrays ``sample_names`` and ``cells`` of one block of samples each; block 0
    is there for every site. ``intervals`` as in ``filters.in_intervals``."""
    vcf_format.register(spark)
    reader = spark.read.format(vcf_format.FORMAT).option("recursive", str(recursive).lower()).option("pathGlobFilter", glob)
    reader = reader.option("minPartitions", spark.sparkContext.defaultParallelism)
    reader = reader.option("pushFilters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if intervals is not None:
        parsed = [parse_interval(t) for t in ([intervals] if isinstance(intervals, str) else intervals)]
        spans = [c if (a, b) == (1, LAST_POSITION) else f"{c}:{a}-{b}" for c, a, b in parsed]
        reader = reader.option("intervals", ",".join(spans))
    if not isinstance(paths, str):
        reader = reader.option("paths", json.dumps(list(paths)))
    rows = reader.load(paths) if isinstance(paths, str) else reader.load()
    return rows.select(
        "file",
        X.trim_prefix(X.file_stem(F.col("file_name"))).alias("file_id"),
        "contig", "pos",
        F.nullif(F.col("id"), F.lit(".")).alias("rsid"),
        F.concat(F.array("ref"), F.split("alt", ",")).alias("alleles"),
        F.col("qual").try_cast("double").alias("qual"),
        F.split("filter", ";").alias("filters"),
        "info",
        F.split("format", ":").alias("format"),
        "block", "sample_names", "cells",
    )


def sites_of_lines(lines: DataFrame, sample_from: str = "header") -> DataFrame:
    """As ``read_sites``, from ``value, file, file_name`` of text lines that a stream brings, with all samples in one block. Names from headers take a
    join on the file here; names from files don't."""
    part = F.split("value", "\t")
    at = lambda i: F.get(part, F.lit(i))
    after = lambda text: F.slice(F.split(text, "\t"), vcf_format.FIXED_COLUMNS + 1, 1 << 30)
    sites = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        "file",
        X.trim_prefix(X.file_stem(F.col("file_name"))).alias("file_id"),
        G.recode_contig(at(0)).alias("contig"),
        at(1).try_cast("int").alias("pos"),
        F.nullif(at(2), F.lit(".")).alias("rsid"),
        F.concat(F.array(at(3)), F.split(at(4), ",")).alias("alleles"),
        at(5).try_cast("double").alias("qual"),
        F.split(at(6), ";").alias("filters"),
        at(7).alias("info"),
        F.split(at(8), ":").alias("format"),
        F.lit(0).alias("block"),
        after(F.col("value")).alias("cells"),
    )
    if sample_from == "file":
        return sites
    return sites.join(lines.filter(F.col("value").startswith("#CHROM")).select("file", after(F.col("value")).alias("sample_names")), "file")


def explode_entries(sites: DataFrame) -> DataFrame:
    """One row per site and sample from ``cells`` and the parallel ``sample_names``."""
    pairs = F.explode(F.arrays_zip("sample_names", "cells"))
    long = sites.withColumn("_pair", pairs).withColumns(
        {"s": F.col("_pair.sample_names"), "_cell": F.split("_pair.cells", ":")}
    )
    gt = G.sample_field(F.col("format"), F.col("_cell"), "GT")
    return long.select(
        "file", "file_id", "contig", "pos", "rsid", "alleles", "qual", "filters", "info", "s",
        gt.alias("gt"),
        G.call_struct(gt).alias("GT_call"),
        G.int_list(G.sample_field(F.col("format"), F.col("_cell"), "AD")).alias("AD"),
        G.sample_field(F.col("format"), F.col("_cell"), "DP").try_cast("int").alias("DP"),
    )


def add_call_fields(entries: DataFrame) -> DataFrame:
    """``AC`` (non-reference alleles in the call) and ``VF`` (share of alternate reads)."""
    return entries.withColumns(
        {"AC": G.alt_allele_count(F.col("gt")), "VF": G.variant_fraction(F.col("AD"), F.col("DP"))}
    )


def entries_of(sites: DataFrame, sample_from: str = "header") -> DataFrame:
    """Entries of already read sites, see the module text for ``sample_from``."""
    if sample_from == "file":
        one = F.when(F.size("cells") == 1, F.array("file_id")).otherwise(
            F.raise_error("sample_from='file' needs one sample per file").cast("array<string>")
        )
        sites = sites.withColumn("sample_names", one)
    elif sample_from != "header":
        raise ValueError("sample_from must be 'header' or 'file'")
    return add_call_fields(explode_entries(sites))


def read_vcf(
    spark: SparkSession,
    paths: str | Sequence[str],
    sample_from: str = "header",
    recursive: bool = True,
    glob: str = VCF_GLOB,
    intervals: str | Sequence[str] | None = None,
) -> DataFrame:
    """Entries of one or more VCF files or folders."""
    return entries_of(read_sites(spark, paths, recursive, glob, intervals), sample_from)


def check_contigs(df: DataFrame, contigs: DataFrame, invalid: str = "error") -> DataFrame:
    """Rows whose contig is missing from the reference table raise an error or are dropped."""
    if invalid == "drop":
        return df.join(contigs.select("contig"), "contig", "left_semi")
    known = contigs.select("contig").distinct().withColumn("_known", F.lit(True))
    checked = df.join(known, "contig", "left")
    return checked.filter(
        F.coalesce(
            F.col("_known"), F.raise_error(F.concat(F.lit("unknown contig "), "contig")).cast("boolean")
        )
    ).drop("_known")


def annotate_from_csq(entries: DataFrame, positions: tuple[int, int, int, int] = (0, 1, 2, 3)) -> DataFrame:
    """impact, gene, HGNC_ID, MAX_AF from the annotation text already in INFO; INFO is dropped."""
    return entries.withColumns(G.csq_fields(F.col("info"), positions)).drop("info")


def annotate_from_table(entries: DataFrame, annotations: DataFrame) -> DataFrame:
    """Left join of an annotation table on contig, position, reference and first alternate allele."""
    keyed = entries.withColumns({"ref": F.get("alleles", F.lit(0)), "alt": F.get("alleles", F.lit(1))})
    joined = keyed.join(annotations, ["contig", "pos", "ref", "alt"], "left").drop("ref", "alt")
    return joined.drop("info") if "info" in joined.columns else joined
