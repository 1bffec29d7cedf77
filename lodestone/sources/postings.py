"""Postings as stored tables, laid out by term, so that a search reads the files of its terms only."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  #: folders of a store


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def store(posts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes postings (with a column term), each bucket of terms in a folder. A frequent term's rows are dealt out over tasks by
    what they hold, so no bucket is one task's."""
    rows = posts.withColumn("bucket", _bucket("term", buckets))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*posts.columns), F.lit(4)))
    rows.repartition("bucket", "part").drop("part").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stored postings; with stated terms, only theirs, from their folders."""
    rows = spark.read.parquet(path)
    if terms is None:
        return rows.drop("bucket")
    numbers = {r["b"] for r in spark.createDataFrame([(t,) for t in terms] or [("",)], "term string").select(_bucket("term", buckets).alias("b")).collect()}
    return rows.where(F.col("bucket").isin(*numbers) & F.col("term").isin(*terms)).drop("bucket")
