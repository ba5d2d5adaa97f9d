"""Bundles of tables: gzip Parquet, with counts of every table and the size and SHA-256 of every file.

A bundle is a folder of table folders and `_bundle`, which holds the two lists. Files are hashed by tasks, each whole (a
file is one row of at most 2 GB, so the writer keeps them below `ROWS_PER_FILE` rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.io import manifest, shared_columns

ROWS_PER_FILE = 5_000_000
FILES = "path string, table string, bytes long, sha256 string"
TABLES = "name string, n long, checksum long"


def file_list(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), table, bytes and sha256 of the data files of a bundle."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    path = F.regexp_extract("path", f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/(.*)$", 1)
    return found.select(path.alias("path"), F.substring_index(path, "/", 1).alias("table"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Write tables and what proves them. The folder is new, so a bundle that is half written has no lists."""
    for name, df in tables.items():
        df.write.option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    file_list(spark, folder).write.json(f"{folder}/_bundle/files")
    manifest({name: spark.read.parquet(f"{folder}/{name}") for name in tables}).write.json(f"{folder}/_bundle/tables")


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """path, table, problem (missing, changed, unexpected) of the files that are not as the bundle's list says."""
    listed = spark.read.schema(FILES).json(f"{folder}/_bundle/files")
    there = file_list(spark, folder).select("path", F.col("table").alias("_t"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    both = listed.join(there, "path", "full_outer")
    problem = F.when(F.col("_s").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("_s") != F.col("sha256")) | (F.col("_b") != F.col("bytes")), "changed")
    return both.select("path", F.coalesce("table", "_t").alias("table"), problem.alias("problem")).where("problem IS NOT NULL")


def restored(spark: SparkSession, folder: str, name: str, target: DataFrame | None = None) -> DataFrame:
    """A table of a bundle whose files and counts are proven; with a target, the columns that both have, in the target's types."""
    wrong = problems(spark, folder).where(F.col("table") == name).limit(5).collect()
    if wrong:
        raise ValueError(f"{name}: " + ", ".join(f"{r['path']} {r['problem']}" for r in wrong))
    df = spark.read.parquet(f"{folder}/{name}")
    told = spark.read.schema(TABLES).json(f"{folder}/_bundle/tables").where(F.col("name") == name)
    if not told.exceptAll(manifest({name: df})).isEmpty():
        raise ValueError(f"{name}: rows differ from the bundle's list")
    return shared_columns(df, target) if target is not None else df


def copy_into(target: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of the target, then those of the source as far as the target has its columns; others of the target are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [target, shared_columns(source, target)])
