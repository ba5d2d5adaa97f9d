"""Sources and sinks. Schemas are explicit, blanks become NULL on read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.columns import blank_to_null, content_key


def payload_rows(df: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Parse a JSON text column and keep the rows that parse; other columns stay."""
    parsed = df.withColumn("_p", F.from_json(payload, schema, {"mode": "PERMISSIVE"})).where(F.try_parse_json(payload).isNotNull() & F.col("_p").isNotNull())
    return parsed.select(*[c for c in df.columns if c != payload], "_p.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line ends and doubled quotes; blank text is NULL."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(*[blank_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=not lines)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame itself; an error names the mandatory columns that it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def promote_header(rows: DataFrame, order: str, cells: str = "cells") -> DataFrame:
    """Rows of a sheet as arrays of cells -> columns named by the first row; blank headings and blank rows go."""
    names = rows.orderBy(order).select(cells).first()[cells]  # one row
    kept = [(i, n.strip()) for i, n in enumerate(names) if n and n.strip()]
    first = rows.agg(F.min(order)).first()[0]
    out = rows.where(F.col(order) != first).select(*[blank_to_null(F.get(cells, F.lit(i))).alias(n) for i, n in kept])
    return out.where(F.coalesce(*[F.col(f"`{n}`") for _, n in kept]).isNotNull())


def keyed_rows(df: DataFrame, columns: list[str], name: str = "id") -> DataFrame:
    """Adds a stable id made of the mandatory columns, and leaves out rows in which all of them are blank."""
    require_columns(df, columns)
    filled = df.where(F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in columns]).isNotNull())
    return filled.withColumn(name, content_key(*[F.col(c) for c in columns]))


def snapshot(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write tables as compressed Parquet into a folder, and their manifest beside them."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    made = manifest({name: spark.read.parquet(f"{folder}/{name}") for name in tables})
    made.write.mode("overwrite").json(f"{folder}/_manifest")
    return made


def long_to_wide(df: DataFrame, key: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """One row per key from (key, field, value) rows."""
    return df.groupBy(key).pivot(field, fields).agg(F.first(value, ignorenulls=True))


def shared_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """The source's columns that the target has too, cast to its types."""
    kinds = {f.name: f.dataType for f in target.schema.fields}
    return source.select(*[F.col(c).cast(kinds[c]) for c in source.columns if c in kinds])


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of every table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n, checksum of every table; the checksum does not depend on row order."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("checksum")).select(F.lit(name).alias("name"), "n", "checksum")

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def catalog(tables) -> DataFrame:
    """source, name: the names of several tables in one list."""
    parts = [(tables.supplier, "supplier", "s_name"), (tables.part, "part", "p_name"), (tables.customer, "customer", "c_name"), (tables.nation, "nation", "n_name")]
    return reduce(DataFrame.unionByName, [df.select(F.lit(source).alias("source"), F.col(column).alias("name")) for df, source, column in parts])
