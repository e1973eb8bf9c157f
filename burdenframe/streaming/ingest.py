"""Incremental cohort ingest.

Burden sums are additive over samples, so each micro-batch only adds gene-bin counts per sample and file to a
Parquet store and the cohort table is summed from the store. The checkpoint remembers finished
files; a batch that is run again replaces its own partition, so a restart never counts twice. What is delivered
again, a file or, with one sample per file, a sample under another name, replaces what came before.

The store has two parts. Batches are deltas, ``batch_id=N`` each. From time to time they are folded into a base that holds the last delivery of
each sample and file only; its folder names the last batch in it, and readers take the newest finished base and the deltas after it. So a
reading costs the cohort and a few batches, however many there were, and only samples of those few batches are looked for in the base.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from burdenframe.operators.burden import AF_BINS, Bins, sample_counts
from burdenframe.sources.vcf import VCF_GLOB, entries_of, sites_of_lines

COUNT_COLUMNS = ("s", "file", "gene", "bin", "ac")
KEY = ("s", "file")
#: Batches after the base that call for a new one.
FOLD_AFTER = 4


def vcf_stream(spark: SparkSession, path: str, glob: str = VCF_GLOB, files_per_batch: int = 1000) -> DataFrame:
    """Lines of VCF files as they arrive, with file path and name."""
    return (
        spark.readStream.format("text")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name")
        )
    )


def append_batch(counts: DataFrame, store: str, batch_id: int) -> None:
    """Write the counts of one micro-batch under its own id, replacing an earlier attempt. If the base has the batch, it stays as it is there."""
    counts.select(*COUNT_COLUMNS).write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


def _append_and_fold(counts: DataFrame, store: str, batch_id: int, fold_after: int) -> None:
    append_batch(counts, store, batch_id)
    base = base_of(counts.sparkSession, store)
    if batch_id - (base[0] if base else -1) >= fold_after:
        fold(counts.sparkSession, store)


def ingest(
    stream: DataFrame,
    to_counts: Callable[[DataFrame], DataFrame],
    store: str,
    checkpoint: str,
    fold_after: int = FOLD_AFTER,
) -> StreamingQuery:
    """Run ``to_counts`` on every micro-batch that is available now, append to ``store`` and fold it every ``fold_after`` batches."""
    return (
        stream.writeStream.foreachBatch(lambda df, i: _append_and_fold(to_counts(df), store, i, fold_after))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_vcf(
    spark: SparkSession,
    path: str,
    annotate: Callable[[DataFrame], DataFrame],
    store: str,
    checkpoint: str,
    sample_from: str = "file",
    bins: Bins = AF_BINS,
    glob: str = VCF_GLOB,
) -> StreamingQuery:
    """Count new VCF files; ``annotate`` adds gene and frequency fields and applies the filters."""
    return ingest(
        vcf_stream(spark, path, glob),
        lambda lines: sample_counts(annotate(entries_of(sites_of_lines(lines, sample_from), sample_from)), bins, ("s", "file")),
        store,
        checkpoint,
    )


def _numbers(spark: SparkSession, pattern: str, name: str) -> list[tuple[int, str]]:
    """Numbers and addresses of the folders ``name=N...`` that hold a finished write, ascending."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    folders = [str(f.getPath().getParent().toString()) for f in found]
    return sorted((int(f.rsplit(f"{name}=", 1)[1].split("-")[0]), f) for f in folders)


def base_of(spark: SparkSession, store: str) -> tuple[int, str] | None:
    """The last batch in the newest finished base, and the base's folder."""
    return max(_numbers(spark, f"{store}-base/upto=*/_SUCCESS", "upto"), default=None)


def _parts(spark: SparkSession, store: str) -> tuple[DataFrame | None, DataFrame | None, list[int]]:
    """The base, the deltas after it with their ``batch_id``, and the numbers of these."""
    base = base_of(spark, store)
    after = base[0] if base else -1
    later = [(n, f) for n, f in _numbers(spark, f"{store}/batch_id=*/_SUCCESS", "batch_id") if n > after]
    deltas = [spark.read.parquet(f).withColumn("batch_id", F.lit(n).cast("long")) for n, f in later]
    return (spark.read.parquet(base[1]) if base else None, reduce(lambda a, b: a.unionByName(b), deltas) if deltas else None, [n for n, _ in later])


def current(spark: SparkSession, store: str) -> DataFrame:
    """The last delivery of each sample and file, with its ``batch_id``."""
    base, deltas, _ = _parts(spark, store)
    if base is None and deltas is None:
        raise ValueError(f"nothing was ingested into {store}")
    if deltas is None:
        return base
    last = deltas.groupBy(*KEY).agg(F.max("batch_id").alias("batch_id"))
    newest = deltas.join(last, [*KEY, "batch_id"], "left_semi")
    return newest if base is None else base.join(last, list(KEY), "left_anti").unionByName(newest)


def fold(spark: SparkSession, store: str) -> None:
    """Write a new base of all finished batches. Readers go over to it once it is complete; a fold that is cut short leaves no trace in what they
    see. Folders of deltas and older bases stay until ``sweep``."""
    numbers = _parts(spark, store)[2]
    if numbers:
        rows = current(spark, store)
        rows.select(*COUNT_COLUMNS, "batch_id").write.parquet(f"{store}-base/upto={numbers[-1]}-{uuid.uuid4().hex[:8]}")


def sweep(spark: SparkSession, store: str) -> None:
    """Delete older bases, and the deltas in the newest one. Not while a reader that began before is still at work."""
    base = base_of(spark, store)
    if base is None:
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    old = [f for _, f in _numbers(spark, f"{store}-base/upto=*/_SUCCESS", "upto") if f != base[1]]
    old += [f for n, f in _numbers(spark, f"{store}/batch_id=*/_SUCCESS", "batch_id") if n <= base[0]]
    for folder in old:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_counts(spark: SparkSession, store: str, one_file_per_sample: bool = False) -> DataFrame:
    """Counts from the last batch that delivered each sample and file; with ``one_file_per_sample``, from each sample's last
    file in its last batch."""
    rows = current(spark, store)
    if one_file_per_sample:
        last = rows.groupBy("s").agg(F.max(F.struct("batch_id", "file")).alias("l")).select("s", "l.batch_id", "l.file")
        rows = rows.join(last, ["s", "batch_id", "file"], "left_semi")
    return rows.select("s", "gene", "bin", "ac")


def cohort_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gene-bin counts of a cohort from per-sample counts."""
    return counts.groupBy(*by, "gene", "bin").agg(F.sum("ac").alias("ac"))
