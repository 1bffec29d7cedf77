"""Registered streaming queries over events and documents, each with the batch SQL it must equal."""

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.streaming import idempotency, streams


@query("stream_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf_dir):
    out = streams.drain(streams.hourly(streams.stream_table(spark, sf_dir, "events")), "complete")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    out = streams.drain(streams.sessions(streams.stream_table(spark, sf_dir, "events")), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_claims", "SELECT DISTINCT user_id, event_type FROM events")
def stream_claims(spark, sf_dir):
    return streams.drain(streams.first_claims(streams.stream_table(spark, sf_dir, "events")), "append").drop("batch_id")


@query("stream_settled", "SELECT user_id, max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END)::BIGINT AS rank FROM events GROUP BY 1")
def stream_settled(spark, sf_dir):
    moves = streams.drain(streams.settled(streams.stream_table(spark, sf_dir, "events")), "update")
    return moves.groupBy("user_id").agg(F.max("rank").alias("rank"))


@query("stream_intake", "SELECT doc_id, sha256(text) AS source_hash, CASE WHEN length(text) = 0 THEN 'empty file' WHEN length(text) > 5000 THEN 'file too large' END AS error FROM documents")
def stream_intake(spark, sf_dir):
    return streams.drain(streams.admitted(streams.stream_table(spark, sf_dir, "documents"), 5000), "append").drop("batch_id")


IDEMPOTENCY = """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_ms(ts) AS t, CASE WHEN event_type IN ('signup', 'purchase') THEN 'complete' ELSE 'request' END AS kind, CASE WHEN event_type = 'error' THEN 'b' ELSE 'a' END AS f,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
 -- what the record is before row n: null without one, 0 open, 1 done
 s AS (SELECT user_id, 0::BIGINT AS n, NULL::INTEGER AS state, NULL::VARCHAR AS f, NULL::BIGINT AS since, NULL::BIGINT AS until, NULL::BIGINT AS answer, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, NULL::BIGINT AS given FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, n, CASE WHEN o IN ('claimed', 'reclaimed') THEN 0 WHEN o = 'completed' THEN 1 ELSE old END, CASE WHEN o IN ('claimed', 'reclaimed') THEN rf ELSE f END, CASE WHEN o IN ('claimed', 'reclaimed') THEN t ELSE since END,
   CASE WHEN o IN ('claimed', 'reclaimed') THEN t + 172800000 ELSE until END, CASE WHEN o IN ('claimed', 'reclaimed') THEN NULL WHEN o = 'completed' THEN event_id ELSE answer END, event_id, o, CASE WHEN o = 'completed' THEN event_id WHEN o = 'replayed' THEN answer END
  FROM (SELECT *, CASE WHEN kind = 'complete' THEN CASE WHEN old = 0 THEN 'completed' ELSE 'ignored' END WHEN old IS NULL THEN 'claimed' WHEN old = 0 AND since < t - 14400000 THEN 'reclaimed' WHEN f <> rf THEN 'mismatch' WHEN old = 1 THEN 'replayed' ELSE 'in_flight' END AS o
   FROM (SELECT s.user_id, r.n, r.event_id, r.t, r.kind, r.f AS rf, s.f, s.since, s.until, s.answer, CASE WHEN s.until <= r.t THEN NULL ELSE s.state END AS old FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1)))
 SELECT id AS event_id, outcome, given::VARCHAR AS response FROM s WHERE n > 0"""


@query("stream_idempotency", IDEMPOTENCY)
def stream_idempotency(spark, sf_dir):
    """What becomes of every event as a request under its user's key: signups and purchases complete, errors ask for something else."""
    e = streams.stream_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "complete").otherwise("request")
    asked = F.when(F.col("event_type") == "error", "b").otherwise("a")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), asked.alias("fingerprint"), F.col("event_id").cast("string").alias("response"))
    out = streams.drain(idempotency.outcomes(rows, ttl="48 hours", stale="4 hours", late="1 hour"), "append")
    return out.select(F.col("id").alias("event_id"), "outcome", "response")
