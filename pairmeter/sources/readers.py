"""Readers: observations, documents, evidence tables, catalogs, manifests."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairmeter.plans.local import constant_table
from pairmeter.sources import schemas

BASELINE_FLOOR = 20.0


class MissingEvidence(RuntimeError):
    """An evidence table is absent, unreadable or empty."""


def keep(df: DataFrame, drop_near_random=True, verified_only=False) -> DataFrame:
    """The modelling filters; plain predicates, so they reach the scan."""
    if verified_only:
        df = df.where(F.col("verified") == 1)
    if drop_near_random:
        df = df.where(F.col("acc_before") >= BASELINE_FLOOR)
    return df


def read_observations(spark: SparkSession, path: str, fmt="parquet", **filters) -> DataFrame:
    reader = spark.read.schema(schemas.OBSERVATIONS)
    d = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return keep(d, **filters)


def read_evidence(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Fail closed: a missing or empty evidence table raises instead of reading as no evidence."""
    try:
        d = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
        empty = d.isEmpty()
    except AnalysisException as e:
        raise MissingEvidence(f"{path} is missing or unreadable: {e}") from e
    if empty:
        raise MissingEvidence(f"{path} holds no rows")
    return d


def doc_id_from_name(name: Column) -> Column:
    """``Pub_name.md`` -> ``Pub/name``: only the first underscore is a separator."""
    return F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), "^([^_]*)_", "$1/")


def read_documents(spark: SparkSession, folder: str, glob="*.md") -> DataFrame:
    """One row per file: (doc_id, text, n_bytes)."""
    d = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder))
    name = F.element_at(F.split("path", "/"), -1)
    return d.select(doc_id_from_name(F.url_decode(name)).alias("doc_id"), F.decode("content", "UTF-8").alias("text"),
                    F.col("length").alias("n_bytes"))


def read_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of every file, hashed where it is read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def catalog_filter(ids: DataFrame, pattern: str, whitelist, group: Column, top=15) -> DataFrame:
    """Listed / matching / targeted / excluded counts and the largest excluded name groups.

    A whitelist entry matches anywhere in the id, ignoring case, so it becomes one alternation.
    """
    low = F.lower("id")
    wanted = F.lit(False)
    for w in whitelist:
        wanted = wanted | low.contains(w.lower())
    d = ids.select("id", group.alias("name_group"), F.col("id").rlike(pattern).alias("m"), wanted.alias("w"))
    n = lambda c: F.sum(c.cast("long"))
    row = d.agg(F.count("*").alias("listed"), n(F.col("m")).alias("matching"), n(F.col("m") & F.col("w")).alias("targeted"),
                n(F.col("m") & ~F.col("w")).alias("excluded"))
    stages = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.lit("*").alias("name_group"), F.col(c).alias("n"))
                                            for c in row.columns])).alias("s")).select("s.*")
    groups = (d.where("m and not w").groupBy("name_group").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "name_group").limit(top).select(F.lit("excluded_group").alias("stage"), "name_group", "n"))
    return stages.unionByName(groups)


def manifest(spark: SparkSession, lines) -> DataFrame:
    """Parsed ``sha256  path`` lines; comments and blanks skipped."""
    rows = [x.strip().split("  ", 1) for x in lines if x.strip() and not x.startswith("#")]
    return constant_table(spark, {"path": [r[1].strip() for r in rows], "sha256": [r[0] for r in rows]})
