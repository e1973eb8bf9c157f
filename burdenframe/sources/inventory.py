"""File inventories and text-file checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.functions import text as X

TASKS_PER_CORE = 4


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``name, path, length, modified`` of every file below ``root``; contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            X.base_name(F.col("path")).alias("name"),
            "path",
            "length",
            F.col("modificationTime").alias("modified"),
        )
        # Spark deals few files to a task, as if it opened them
        .coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    )


def with_suffix(files: DataFrame, suffix: str, unique_only: bool = False) -> DataFrame:
    """Files whose name ends with ``suffix``, with ``is_duplicate`` for repeated names.

    The first path of a name counts as the original; ``unique_only`` drops the others.
    """
    kept = files.filter(F.col("name").endswith(suffix))
    firsts = kept.groupBy("name").agg(F.min("path").alias("_first"))
    flagged = kept.join(firsts, "name").withColumn("is_duplicate", F.col("path") != F.col("_first")).drop("_first")
    return flagged.filter(~F.col("is_duplicate")) if unique_only else flagged


def find_file(files: DataFrame, name: str) -> DataFrame:
    """First path with exactly this name, at most one row."""
    return (
        files.filter(F.col("name") == name).groupBy("name").agg(F.min("path").alias("path"))
    )


def clean_prefixes(files: DataFrame, extension: str) -> DataFrame:
    """Prefixes of names that hold nothing but one prefix and the extension."""
    limit = 2 + len(extension.split("."))
    parts = F.split("name", r"\.")
    return files.filter(F.col("name").endswith(extension) & (F.size(parts) < limit)).select(
        F.get(parts, F.lit(0)).alias("prefix")
    )


def file_list(files: DataFrame, regex: str | None = None) -> DataFrame:
    """Tag each file ``unique``, ``duplicate`` or ``rejected`` by its prefix, in name order.

    The first file of a prefix that passes the regex is the unique one and every later file of that
    prefix is a duplicate; files before it, and prefixes without any match, are rejected. The first
    match is a partially aggregated minimum, so a prefix shared by many files is never sorted in one
    task.
    """
    tagged = files.withColumns(
        {
            "prefix": X.trim_prefix(F.col("name")),
            "_at": F.struct("name", "path"),
            "_ok": X.regex_found(F.col("path"), regex) if regex is not None else F.lit(True),
        }
    )
    first = tagged.filter("_ok").groupBy("prefix").agg(F.min("_at").alias("_first"))
    return (
        tagged.join(first, "prefix", "left")
        .withColumn(
            "status",
            F.when(F.col("_at") == F.col("_first"), "unique")
            .when(F.col("_at") > F.col("_first"), "duplicate")
            .otherwise("rejected"),
        )
        .drop("_at", "_first")
        .withColumnRenamed("_ok", "regex_match")
    )


def file_list_lines(tagged: DataFrame, include_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines of the main list (``prefix, path``) and of the duplicate list (``prefix, name, path``)."""
    main = (F.col("status") == "unique") | (
        F.lit(include_duplicates) & (F.col("status") == "duplicate") & F.col("regex_match")
    )
    return (
        tagged.filter(main).select(F.concat_ws("\t", "prefix", "path").alias("value"), "name"),
        tagged.filter(F.col("status") == "duplicate").select(
            F.concat_ws("\t", "prefix", "name", "path").alias("value"), "name"
        ),
    )


def write_file_list(tagged: DataFrame, path: str, include_duplicates: bool = False) -> None:
    """Write the list, sorted by name, and the duplicates beside it when they are not included."""
    main, dup = file_list_lines(tagged, include_duplicates)
    main.orderBy("name", "value").select("value").write.mode("overwrite").text(path)
    if not include_duplicates:
        dup.orderBy("name", "value").select("value").write.mode("overwrite").text(f"{path}.duplicates")


def inventory_counts(tagged: DataFrame) -> DataFrame:
    """Totals printed beside a file list."""
    return tagged.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("status") == "unique").alias("n_unique"),
        F.count_if(F.col("status") == "duplicate").alias("n_duplicates"),
        F.count_if(F.col("status") == "rejected").alias("n_regexed_out"),
    )


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """Number of lines of a text file."""
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))


def count_unique_names(lines: DataFrame, col: int, sep: str = "\t", column: str = "value") -> DataFrame:
    """Distinct values of a delimited column; a line that is too short raises an error."""
    cell = F.get(F.split(F.col(column), re.escape(sep)), F.lit(col))
    checked = F.coalesce(cell, F.raise_error(F.concat(F.lit("too few columns: "), F.col(column))).cast("string"))
    return lines.select(checked.alias("name")).agg(F.countDistinct("name").alias("n_unique"))
