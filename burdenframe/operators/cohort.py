"""Case/control labels, null cohorts and merging of cohort tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenframe.functions import text as X
from burdenframe.functions.ordering import hash_bucket, running_total
from burdenframe.functions.sampling import hash_hex
from burdenframe.plans.workspace import work_folder

NULL_SEED = "null-cohort"


def attach_metadata(inputs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of phenotype and mutation on ``s``; unknown samples and empty values become ``NA``."""
    joined = inputs.join(metadata.select("s", "phenotype", "mutation"), "s", "left")
    return joined.withColumns({c: X.na_if_blank(F.col(c)) for c in ("phenotype", "mutation")})


def is_case(phenotype: str, column: str = "phenotype") -> Column:
    """The phenotype is an exact member of the sample's comma list."""
    return F.coalesce(X.in_delimited_list(F.col(column), phenotype), F.lit(False))


def label_cases(samples: DataFrame, phenotype: str) -> DataFrame:
    return samples.withColumn("is_case", is_case(phenotype))


def split_cohort(inputs: DataFrame, metadata: DataFrame, phenotype: str) -> DataFrame:
    """Every input with ``cohort`` positive or negative; inputs without metadata are negative."""
    flags = label_cases(metadata, phenotype).select("s", "is_case")
    return (
        inputs.join(flags, "s", "left")
        .withColumn("is_case", F.coalesce("is_case", F.lit(False)))
        .withColumn("cohort", F.when(F.col("is_case"), "positive").otherwise("negative"))
    )


def cases_only(inputs: DataFrame, metadata: DataFrame, phenotype: str) -> DataFrame:
    """Inputs of case samples, by semi join on the exploded phenotype list."""
    return inputs.join(_members(metadata, phenotype), "s", "left_semi")


def controls_only(inputs: DataFrame, metadata: DataFrame, phenotype: str) -> DataFrame:
    """All inputs that are not cases."""
    return inputs.join(_members(metadata, phenotype), "s", "left_anti")


def _members(metadata: DataFrame, phenotype: str) -> DataFrame:
    exploded = metadata.select("s", F.explode(F.split("phenotype", ",")).alias("p"))
    return exploded.filter(F.col("p") == phenotype).select("s")


def hash_sample(df: DataFrame, key: str, n: Column, seed: str = NULL_SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement: the first ``n`` keys in hash order."""
    order = [hash_hex(seed, F.col(key)), F.col(key)]
    ranked = running_total(df, F.lit(1), hash_bucket(F.col(key), seed), order, "_rank")
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def label_null_cohort(
    samples: DataFrame, phenotype: str, n: int | None = None, seed: str = NULL_SEED
) -> DataFrame:
    """Add ``is_null_case``: as many sampled controls as there are cases, or ``n`` of them.

    Raises at run time when there are no cases, no controls, or fewer controls than asked for.
    """
    labelled = label_cases(samples, phenotype)
    sizes = labelled.agg(
        F.count_if("is_case").alias("cases"), F.count_if(~F.col("is_case")).alias("controls")
    )
    wanted = F.col("cases") if n is None else F.lit(n)

    def fail(message: str) -> Column:
        return F.raise_error(F.lit(message)).cast("bigint")

    guarded = sizes.select(
        F.when(F.col("cases") == 0, fail(f"no sample has phenotype {phenotype}"))
        .when(F.col("controls") == 0, fail("no sample without the phenotype"))
        .when(F.col("controls") < wanted, fail("not enough controls to sample"))
        .otherwise(wanted)
    ).scalar()
    drawn = hash_sample(labelled.filter(~F.col("is_case")).select("s"), "s", guarded, seed)
    return labelled.join(drawn.withColumn("is_null_case", F.lit(True)).hint("merge"), "s", "left").withColumn(
        "is_null_case", F.coalesce("is_null_case", F.lit(False))
    )


def null_split(inputs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Inputs with ``cohort`` match or anti_match; inputs without metadata are in neither."""
    return inputs.join(labelled.select("s", "is_null_case"), "s").withColumn(
        "cohort", F.when(F.col("is_null_case"), "match").otherwise("anti_match")
    )


def union_entries(tables: Sequence[DataFrame]) -> DataFrame:
    """Row union of cohort tables; columns missing on one side become NULL."""
    if not tables:
        raise ValueError("no tables to be joined")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


SITE_BLOCK = ("site", "block")


def store_by_site(entries: DataFrame, block: Column, buckets: int | None = None) -> DataFrame:
    """A cohort table laid out for unions: ``site, block, calls``, one row per site and sample block with the block's calls there, an array of sample
    and allele count ordered by sample.

    ``block`` deals samples into blocks of bounded size, which bounds a row whatever the number of carriers. The table is bucketed and sorted by site
    and block; tables with equally many ``buckets`` (by default the session's shuffle partitions) are joined without a shuffle. It is registered in
    the session's catalog, with its files in the work folder.
    """
    n = buckets or _shuffle_partitions(entries.sparkSession)
    keyed = entries.select(_site_key().alias("site"), block.cast("long").alias("block"), F.struct("s", "AC").alias("call"))
    rows = keyed.repartition(n, *SITE_BLOCK).groupBy(*SITE_BLOCK).agg(F.sort_array(F.collect_list("call")).alias("calls"))
    return _bucketed(rows, n)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` written in buckets by site and block; a write task has the rows of one bucket."""
    spark, path = rows.sparkSession, work_folder(rows.sparkSession, "sites")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    rows.write.bucketBy(buckets, *SITE_BLOCK).sortBy(*SITE_BLOCK).option("path", path).saveAsTable(name)
    return spark.table(name)


def _site_key() -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(part(F.col("contig")), F.lit("\t"), part(F.col("pos")), F.lit("\t"), F.array_join("alleles", ","))


def union_sites(tables: Mapping[str, DataFrame], buckets: int | None = None) -> DataFrame:
    """Outer join of tables made by ``store_by_site`` on their sites: ``contig, pos, alleles, block``, one row per site and sample block with a column
    for each table, its calls there, NULL for a table without any, and ``n_entries`` over all.

    A sample missing from the array has no call. Two tables are joined as they lie. For more, the sites of all are stored once in the same
    buckets, narrow rows, and each table is joined to them: an outer join of outer joins would need its result dealt anew.
    """
    if not tables:
        raise ValueError("no tables to be joined")
    named = [t.withColumnRenamed("calls", name) for name, t in tables.items()]
    if len(named) <= 2:
        joined = reduce(lambda a, b: a.join(b, [*SITE_BLOCK], "full_outer"), named)
    else:
        keys = reduce(lambda a, b: a.union(b), [t.select(*SITE_BLOCK) for t in named])
        n = buckets or _shuffle_partitions(keys.sparkSession)
        keys = _bucketed(keys.repartition(n, *SITE_BLOCK).distinct(), n)
        joined = reduce(lambda a, b: a.join(b, [*SITE_BLOCK], "left"), named, keys)
    part = F.split("site", "\t")
    pos = F.when(part[1] != "", part[1]).cast("int")
    entries = reduce(lambda a, b: a + b, [F.coalesce(F.size(F.col(n)), F.lit(0)) for n in tables])
    return joined.select(F.when(part[0] != "", part[0]).alias("contig"), pos.alias("pos"), F.split(part[2], ",").alias("alleles"), "block",
                         entries.cast("long").alias("n_entries"), *tables)



def _shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
