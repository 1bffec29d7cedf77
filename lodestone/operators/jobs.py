"""Operational analytics over jobs: queues, failures, hourly series with backlog, durations, reapers, retention, footprints.

jobs: job_id, collection_id, document_id, status, created_at, finished_at, error_type. `now` is a parameter, so results repeat.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("pending", "running")
RANKS = {"pending": 0, "running": 1, "cancelled": 2, "failed": 3, "done": 4}


def seconds(start: str | Column, end: str | Column) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.unix_micros(end.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6


def status_counts(jobs: DataFrame, group: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return jobs.groupBy(group).agg(n("pending").alias("pending"), n("running").alias("running"), n("failed").alias("failed"), n("done").alias("done"))


def last_success(jobs: DataFrame, group: str) -> DataFrame:
    return jobs.groupBy(group).agg(F.max(F.when(F.col("status") == "done", F.col("finished_at"))).alias("last_success"))


def failure_breakdown(jobs: DataFrame, since: str, by: list[str], top: int) -> DataFrame:
    """(dimension, value, n): failures in total and by each dimension, in one pass over the jobs (one row set per dimension)."""
    failed = jobs.where((F.col("status") == "failed") & (F.col("created_at") >= F.lit(since).cast("timestamp")))
    parts = [F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value"))]
    parts += [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in by]
    counts = failed.select(F.explode(F.array(*parts)).alias("e")).groupBy("e.dimension", "e.value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("value")))
    return counts.withColumn("__nth", nth).where(F.col("__nth") <= top).drop("__nth")


def failures_after(jobs: DataFrame, cursor: str) -> DataFrame:
    late = jobs.where((F.col("status") == "failed") & (F.col("finished_at") > F.lit(cursor).cast("timestamp")))
    return late.agg(F.count("*").alias("n"), F.max("finished_at").alias("latest"))


def hourly_backlog(jobs: DataFrame, start: str, end: str) -> DataFrame:
    """(hour, arrivals, completions, backlog), a row for every hour of [start, end); the backlog starts with what was open
    before, runs unclamped, and only the shown value is at least 0. The series is one row per hour, whatever the jobs."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")

    def per_hour(c: str, name: str) -> DataFrame:
        hit = jobs.where((F.col(c) >= low) & (F.col(c) < high))
        return hit.groupBy(F.date_trunc("hour", c).alias("hour")).agg(F.count("*").alias(name))

    hours = jobs.sparkSession.range(1).select(F.explode(F.sequence(low, high - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    open_before = jobs.agg(F.count_if((F.col("created_at") < low) & (F.col("finished_at").isNull() | (F.col("finished_at") >= low))).alias("base"))
    series = hours.join(per_hour("created_at", "a"), "hour", "left").join(per_hour("finished_at", "c"), "hour", "left")
    series = series.select("hour", F.coalesce("a", F.lit(0)).alias("arrivals"), F.coalesce("c", F.lit(0)).alias("completions")).join(F.broadcast(open_before), F.lit(True))
    running = F.sum(F.col("arrivals") - F.col("completions")).over(Window.orderBy("hour"))
    return series.select("hour", "arrivals", "completions", F.greatest(F.lit(0), F.col("base") + running).alias("backlog"))


def stage_durations(stages: DataFrame, group: str, start: str, end: str) -> DataFrame:
    return stages.groupBy(group).agg(F.round(F.avg(seconds(start, end)), 6).alias("avg_seconds"), F.count("*").alias("n"))


def histogram_quantile(buckets: DataFrame, group: str, quantile: float) -> DataFrame:
    """(group, bound): the first bucket's upper bound that reaches the share of all; the largest finite bound if only the open one does."""
    w = Window.partitionBy(group).orderBy(F.col("bound").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    c = buckets.withColumns({"seen": F.sum("n").over(w), "total": F.sum("n").over(whole), "largest": F.max("bound").over(whole)})
    return c.where(F.col("seen") >= quantile * F.col("total")).groupBy(group).agg(F.coalesce(F.min("bound"), F.max("largest")).alias("bound"))


def stale(jobs: DataFrame, heartbeats: DataFrame, now: str, idle_seconds: int, heartbeat_seconds: int) -> DataFrame:
    """Active jobs idle for long whose worker's heartbeat is missing or old. heartbeats: worker_id, last_seen."""
    at = F.lit(now).cast("timestamp")
    idle = jobs.where(F.col("status").isin(*ACTIVE) & (seconds("updated_at", at) > idle_seconds))
    beat = idle.join(heartbeats, "worker_id", "left")
    return beat.where(F.col("last_seen").isNull() | (seconds("last_seen", at) > heartbeat_seconds)).drop("last_seen")


def over_time(jobs: DataFrame, limits: DataFrame, now: str, default_seconds: int, grace_seconds: int) -> DataFrame:
    """Active jobs beyond their collection's own limit (or the default) and a grace. limits: collection_id, limit_seconds."""
    at = F.lit(now).cast("timestamp")
    rows = jobs.where(F.col("status").isin(*ACTIVE)).join(limits, "collection_id", "left")
    limit = F.coalesce("limit_seconds", F.lit(default_seconds)) + grace_seconds
    return rows.where(seconds("created_at", at) > limit).drop("limit_seconds")


def active_conflicts(jobs: DataFrame, key: str) -> DataFrame:
    """Keys with more than one active job."""
    return jobs.where(F.col("status").isin(*ACTIVE)).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def settled(events: DataFrame, key: str) -> DataFrame:
    """The state of each job from its unordered state events: a terminal state wins, the later in life first."""
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return events.groupBy(key).agg(F.max_by("status", F.element_at(rank, F.col("status"))).alias("status"))


def vector_bytes(points: DataFrame, group: str, dimensions: int, sparse_terms: float) -> DataFrame:
    """Bytes of dense vectors (4 a number) and of sparse ones (8 a term, by the mean number of terms)."""
    n = points.groupBy(group).agg(F.count("*").alias("points"))
    return n.select(group, "points", (F.col("points") * dimensions * 4).alias("dense_bytes"), F.round(F.col("points") * sparse_terms * 8, 3).alias("sparse_bytes"))


def estimate_cost(documents: DataFrame, group: str, tokens: Column, calls: Column, rates: DataFrame) -> DataFrame:
    """(group, calls, tokens, cost, lower_bound): cost is null where a document's model has no rate; the bound counts what is priced.
    rates: model, per_million."""
    rows = documents.select(group, "model", tokens.alias("tokens"), calls.alias("calls")).join(F.broadcast(rates), "model", "left")
    cost = F.col("tokens") * F.col("per_million") / 1e6
    known = F.round(F.sum(cost), 6)
    return rows.groupBy(group).agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.when(F.count_if(F.col("per_million").isNull()) == 0, known).alias("cost"), F.coalesce(known, F.lit(0.0)).alias("lower_bound"))
