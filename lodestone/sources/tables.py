"""Readers of the given Parquet tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; only Spark opens the path, so any Hadoop file system works."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL = 64_000_000  #: bytes under which a table is dealt out over all cores before long work on its rows


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; if its files are small, over as many partitions as there are cores, since a small file may be one row group and with
    that one task. Larger tables are left as their files are, so no more than SMALL bytes are ever shuffled for this."""
    rows = table(spark, sf_dir, name)
    size = spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet").agg(F.sum("length")).first()[0]
    return rows.repartition(spark.sparkContext.defaultParallelism) if (size or 0) < SMALL else rows
