"""Structured Streaming forms of the series, dedup, sessions and the job state machine.

Each takes a streaming DataFrame. `drain` runs a stream over all that is there now (trigger availableNow), with its
checkpoint and its result in the shared folder, and returns the result; a lost executor or a restart repeats a batch,
and each batch overwrites or is keyed by its number, so nothing counts twice.
"""

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

RANKS = {"view": 0, "click": 1, "error": 2, "signup": 3, "purchase": 4}  #: the higher is the later state of life


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")  # one machine, as in tests
    return f"{base}/lodestone/stream-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream, be it one file or a folder of files (hence the glob)."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result: of the last batch in complete mode, else of all batches, with their number as batch_id."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    schema = stream.schema if mode == "complete" else StructType([*stream.schema.fields, StructField("batch_id", LongType())])

    def put(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{folder}/out/last")
        else:
            batch.withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/b{number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if not run.recentProgress:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/out/*")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n, total): tumbling windows; what comes later than the watermark allows is left out when state is let go."""
    at = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    rows = at.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, n): runs of a user's events with no pause as long as the gap."""
    at = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id").withWatermark("ts", late)
    rows = at.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("s.start").alias("start"), "n")


def first_claims(events: DataFrame, late: str = "40 days") -> DataFrame:
    """One event of each (user, type) within the watermark's reach: later requests with the key are replays."""
    at = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").withWatermark("ts", late)
    return at.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the highest state seen of a job; says so when it changes."""
    best = state.get[0] if state.exists else -1
    new = max([best, *(RANKS.get(x, -1) for f in frames for x in f["event_type"])])
    if new > best:
        state.update((new,))
        yield pd.DataFrame({"user_id": [key[0]], "rank": [new]})


def settled(events: DataFrame) -> DataFrame:
    """(user_id, rank) whenever a job's state moves on; a terminal state is never left."""
    rows = events.select("user_id", "event_type").groupBy("user_id")
    return rows.applyInPandasWithState(settle, "user_id long, rank long", "rank long", "update", GroupStateTimeout.NoTimeout)


def admitted(docs: DataFrame, most: int) -> DataFrame:
    """Streamed intake: (doc_id, source_hash, error) of each document; the error is null where it is admitted."""
    error = F.when(F.length(F.coalesce("text", F.lit(""))) == 0, "empty file").when(F.length("text") > most, "file too large")
    return docs.select("doc_id", F.sha2("text", 256).alias("source_hash"), error.alias("error"))
