"""Sample metadata, reference contigs, gene-set configuration and PCA inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.functions import text as X

WHOLE_LINE = "\u0001"  # separator that occurs in no metadata line, so each line stays one column


def metadata_lines(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 lines with an ``at`` struct that sorts in file order."""
    return (
        spark.read.schema("line string")
        .option("sep", WHOLE_LINE)
        .option("encoding", "ISO-8859-1")
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
        .select(
            "line",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("at"),
        )
    )


def parse_metadata(lines: DataFrame, line: str = "line") -> DataFrame:
    """``s, phenotype, mutation``; with fewer than three fields both values are ``NA``."""
    part = F.split(X.python_strip(F.col(line)), "\t")
    full = F.size(part) >= 3

    def field(i: int):
        return F.when(full, X.python_strip(F.get(part, F.lit(i)))).otherwise(F.lit("NA"))

    return lines.withColumns(
        {
            "s": X.trim_prefix(F.get(part, F.lit(0))),
            "phenotype": field(1),
            "mutation": field(2),
        }
    ).drop(line)


def first_per_sample(rows: DataFrame, order: str = "at") -> DataFrame:
    """First line of each sample; an aggregate, so a repeated key is never gathered in one task."""
    kept = F.min_by(F.struct("phenotype", "mutation"), F.col(order))
    return rows.groupBy("s").agg(kept.alias("_k"), F.count(F.lit(1)).alias("n_lines")).select(
        "s", "_k.phenotype", "_k.mutation", (F.col("n_lines") - 1).alias("n_duplicates")
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``s, phenotype, mutation, n_duplicates`` of a tab-separated metadata file."""
    return first_per_sample(parse_metadata(metadata_lines(spark, path)))


def read_reference_genome(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(contig, length, kind)`` and the pseudo-autosomal regions of a reference JSON file."""
    raw = spark.read.option("multiLine", True).json(path)
    contigs = raw.select(
        F.explode("contigs").alias("c"), "xContigs", "yContigs", "mtContigs"
    ).select(
        F.col("c.name").alias("contig"),
        F.col("c.length").cast("long").alias("length"),
        F.when(F.array_contains("xContigs", F.col("c.name")), "X")
        .when(F.array_contains("yContigs", F.col("c.name")), "Y")
        .when(F.array_contains("mtContigs", F.col("c.name")), "MT")
        .otherwise("autosome")
        .alias("kind"),
    )
    par = raw.select(F.explode("par").alias("p")).select(
        F.col("p.start.contig").alias("contig"),
        F.col("p.start.position").cast("long").alias("start"),
        F.col("p.end.position").cast("long").alias("end"),
    )
    return contigs, par


def read_gene_config(spark: SparkSession, path: str) -> DataFrame:
    """``(set_name, gene)`` rows of a JSON object whose values are gene lists."""
    raw = spark.read.option("multiLine", True).json(path)
    named = [F.struct(F.lit(c).alias("set_name"), F.col(f"`{c}`").alias("genes")) for c in raw.columns]
    return (
        raw.select(F.explode(F.array(*named)).alias("n"))
        .select("n.set_name", F.explode("n.genes").alias("gene"))
    )


def read_pca(spark: SparkSession, pca_path: str, locations_path: str) -> tuple[DataFrame, DataFrame]:
    """First two component rows of a space-separated file, and the sample location table."""
    pca = spark.read.option("header", True).option("sep", " ").csv(pca_path)
    order = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    first_two = (
        pca.withColumn("_at", order).orderBy("_at").limit(2).drop("_at")
    )
    return first_two, spark.read.option("header", True).option("sep", "\t").csv(locations_path)


def pca_scores_long(scores: DataFrame, locations: DataFrame) -> DataFrame:
    """``genotype_id, PC1, PC2`` with sample locations, from ``genotype_id, component, score`` rows."""
    wide = scores.groupBy("genotype_id").agg(
        *[F.max(F.when(F.col("component") == i, F.col("score").cast("double"))).alias(f"PC{i}") for i in (1, 2)]
    )
    return wide.join(locations, "genotype_id")


def pca_scores(components: DataFrame, locations: DataFrame) -> DataFrame:
    """Turn a component-by-sample file, one column per sample, and join the sample locations.

    The first component row is the one ``read_pca`` gives first.
    """
    names = [r["SampleID"] for r in components.select("SampleID").collect()]  # two rows
    number = F.when(F.col("SampleID") == names[0], 1).otherwise(2)
    samples = [c for c in components.columns if c != "SampleID"]
    long = components.unpivot("SampleID", samples, "genotype_id", "score").withColumn("component", number)
    return pca_scores_long(long, locations)
