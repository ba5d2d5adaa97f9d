"""Tables written once to the folder that driver and executors share, so that their rows do not change between uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and Spark runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Whether Spark drops the shuffle files of a query when it ends, on all executors.
DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table of its own, split into folders by some columns: cuts lineage, survives lost executors.

    What was shuffled to write it is not read again, so its files go at once and not when the driver collects its garbage.
    """
    conf = df.sparkSession.conf
    path = f"{shared_dir(df.sparkSession)}/larkspur-{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd")
    before = conf.get(DROPS, "false")
    conf.set(DROPS, "true")
    try:
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        conf.set(DROPS, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
