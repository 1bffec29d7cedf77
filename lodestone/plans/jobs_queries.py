"""Registered grid and job queries. Relations: jobs from orders, workers from customer, stage runs from lineitem, state events from
events, documents with metadata from documents and labels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import grid, jobs
from lodestone.plans.registry import query
from lodestone.sources.tables import table

NOW = "2001-08-02 00:00:00"

JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey % 25 AS collection_id, o_custkey AS document_id, o_custkey % 40 AS worker_id,
 CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'running' END END AS status,
 o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_hours(o_orderkey % 72) END AS finished_at,
 o_orderdate + to_hours(o_orderkey % 30) AS updated_at, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS error_type, o_totalprice AS cost FROM orders)"""


def job_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    hours = lambda n: F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % n).cast("int"))
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "done").when(F.col("o_orderkey") % 2 == 0, "pending").otherwise("running")
    return o.select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 25).alias("collection_id"), F.col("o_custkey").alias("document_id"), (F.col("o_custkey") % 40).alias("worker_id"),
        state.alias("status"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "P", hours(72)).alias("finished_at"), hours(30).alias("updated_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("error_type"), F.col("o_totalprice").alias("cost"),
    )


@query("job_status_counts", f"WITH {JOBS} SELECT collection_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'done') AS done FROM jobs GROUP BY 1")
def job_status_counts(spark, sf_dir):
    return jobs.status_counts(job_rows(spark, sf_dir), "collection_id")


@query("job_last_success", f"WITH {JOBS} SELECT collection_id, max(finished_at) FILTER (status = 'done') AS last_success FROM jobs GROUP BY 1")
def job_last_success(spark, sf_dir):
    return jobs.last_success(job_rows(spark, sf_dir), "collection_id")


_FAILED = "SELECT * FROM jobs WHERE status = 'failed' AND created_at >= '2000-01-01'"


@query("job_failure_breakdown", f"""WITH {JOBS}, f AS ({_FAILED}), c AS (SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM f UNION ALL SELECT 'error_type', error_type, count(*) FROM f GROUP BY 2
 UNION ALL SELECT 'collection_id', collection_id::VARCHAR, count(*) FROM f GROUP BY 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) <= 10""")
def job_failure_breakdown(spark, sf_dir):
    return jobs.failure_breakdown(job_rows(spark, sf_dir), "2000-01-01", ["error_type", "collection_id"], 10)


@query("job_failures_after", f"WITH {JOBS} SELECT count(*) AS n, max(finished_at) AS latest FROM jobs WHERE status = 'failed' AND finished_at > '2001-06-01'")
def job_failures_after(spark, sf_dir):
    return jobs.failures_after(job_rows(spark, sf_dir), "2001-06-01")


@query("job_hourly_backlog", f"""WITH {JOBS}, h AS (SELECT unnest(generate_series(TIMESTAMP '2001-06-01', TIMESTAMP '2001-07-31 23:00:00', INTERVAL 1 HOUR)) AS hour),
 a AS (SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM jobs GROUP BY 1), c AS (SELECT date_trunc('hour', finished_at) AS hour, count(*) AS n FROM jobs GROUP BY 1),
 base AS (SELECT count(*) AS b FROM jobs WHERE created_at < '2001-06-01' AND (finished_at IS NULL OR finished_at >= '2001-06-01')),
 s AS (SELECT hour, coalesce(a.n, 0) AS arrivals, coalesce(c.n, 0) AS completions FROM h LEFT JOIN a USING (hour) LEFT JOIN c USING (hour))
 SELECT hour, arrivals, completions, greatest(0, b + sum(arrivals - completions) OVER (ORDER BY hour))::BIGINT AS backlog FROM s, base""")
def job_hourly_backlog(spark, sf_dir):
    return jobs.hourly_backlog(job_rows(spark, sf_dir), "2001-06-01", "2001-08-01")


@query("job_sorted_by_duration", f"WITH {JOBS} SELECT job_id, status, epoch(coalesce(finished_at, TIMESTAMP '{NOW}')) - epoch(created_at) AS seconds FROM jobs ORDER BY seconds DESC NULLS LAST, job_id LIMIT 40 OFFSET 20")
def job_sorted_by_duration(spark, sf_dir):
    rows = job_rows(spark, sf_dir).select("job_id", "status", jobs.seconds("created_at", F.coalesce("finished_at", F.lit(NOW).cast("timestamp"))).alias("seconds"))
    return grid.page(rows, "seconds", "job_id", 40, 20, descending=True)


@query("job_latest_per_document", f"WITH {JOBS} SELECT document_id, job_id, status, created_at FROM jobs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) = 1")
def job_latest_per_document(spark, sf_dir):
    rows = job_rows(spark, sf_dir).select("document_id", "job_id", "status", "created_at")
    return grid.latest(rows, "document_id", [F.desc("created_at"), F.desc("job_id")])


@query("job_active_conflicts", f"WITH {JOBS} SELECT document_id, count(*) AS n FROM jobs WHERE status IN ('pending', 'running') GROUP BY 1 HAVING count(*) > 1")
def job_active_conflicts(spark, sf_dir):
    return jobs.active_conflicts(job_rows(spark, sf_dir), "document_id")


_BEATS = "beats AS (SELECT worker_id, max(updated_at) AS last_seen FROM jobs WHERE worker_id % 3 <> 0 GROUP BY 1)"


@query("job_stale", f"""WITH {JOBS}, {_BEATS} SELECT job_id FROM jobs LEFT JOIN beats USING (worker_id) WHERE status IN ('pending', 'running')
 AND epoch(TIMESTAMP '{NOW}') - epoch(updated_at) > 864000 AND (last_seen IS NULL OR epoch(TIMESTAMP '{NOW}') - epoch(last_seen) > 90000)""")
def job_stale(spark, sf_dir):
    rows = job_rows(spark, sf_dir)
    beats = rows.where("worker_id % 3 <> 0").groupBy("worker_id").agg(F.max("updated_at").alias("last_seen"))
    return jobs.stale(rows, beats, NOW, 864_000, 90_000).select("job_id")


@query("job_over_time", f"""WITH {JOBS} SELECT job_id FROM jobs LEFT JOIN (SELECT n_nationkey::BIGINT AS collection_id, n_regionkey * 40000000 AS lim FROM nation WHERE n_nationkey < 20) USING (collection_id)
 WHERE status IN ('pending', 'running') AND epoch(TIMESTAMP '{NOW}') - epoch(created_at) > coalesce(lim, 90000000) + 600""")
def job_over_time(spark, sf_dir):
    limits = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("collection_id"), (F.col("n_regionkey") * 40_000_000).alias("limit_seconds"))
    return jobs.over_time(job_rows(spark, sf_dir), limits, NOW, 90_000_000, 600).select("job_id")


@query("job_worker_fleet", f"""WITH {JOBS}, {_BEATS} SELECT worker_id, count(*) AS active, coalesce(max(last_seen) >= TIMESTAMP '2001-07-30', false) AS alive FROM jobs LEFT JOIN beats USING (worker_id)
 WHERE status IN ('pending', 'running') GROUP BY 1""")
def job_worker_fleet(spark, sf_dir):
    rows = job_rows(spark, sf_dir)
    beats = rows.where("worker_id % 3 <> 0").groupBy("worker_id").agg(F.max("updated_at").alias("last_seen"))
    active = rows.where(F.col("status").isin(*jobs.ACTIVE)).join(beats, "worker_id", "left")
    return active.groupBy("worker_id").agg(F.count("*").alias("active"), F.coalesce(F.max("last_seen") >= F.lit("2001-07-30").cast("timestamp"), F.lit(False)).alias("alive"))


@query("job_names", f"WITH {JOBS} SELECT job_id, status, c_name AS document, n_name AS collection FROM jobs LEFT JOIN customer ON c_custkey = document_id LEFT JOIN nation ON n_nationkey = collection_id WHERE contains(lower(c_name), '00012')")
def job_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("document"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("collection_id"), F.col("n_name").alias("collection"))
    rows = job_rows(spark, sf_dir).select("job_id", "status", "document_id", "collection_id").join(c, "document_id", "left").join(F.broadcast(n), "collection_id", "left")
    return rows.where(F.lower("document").contains("00012")).select("job_id", "status", "document", "collection")


@query("job_keyset_page", f"WITH {JOBS} SELECT created_at, job_id, status FROM jobs WHERE status IN ('failed', 'done') AND created_at >= '1996-01-01' AND created_at < '2001-01-01' AND (created_at, job_id) < (TIMESTAMP '2000-06-01', 5000) ORDER BY created_at DESC, job_id DESC LIMIT 51")
def job_keyset_page(spark, sf_dir):
    """Newest first; half-open time range; the row beyond the page tells that there is more."""
    rows = job_rows(spark, sf_dir).where("status IN ('failed', 'done') AND created_at >= '1996-01-01' AND created_at < '2001-01-01'").select("created_at", "job_id", "status")
    cursor = F.struct(F.lit("2000-06-01").cast("timestamp").alias("created_at"), F.lit(5000).cast("long").alias("job_id"))
    return rows.where(F.struct("created_at", "job_id") < cursor).orderBy(F.desc("created_at"), F.desc("job_id")).limit(51)


@query("job_cost_rollup", f"WITH {JOBS} SELECT collection_id, count(*) AS n, round(coalesce(sum(cost) FILTER (status = 'done'), 0), 2) AS cost FROM jobs GROUP BY 1")
def job_cost_rollup(spark, sf_dir):
    return job_rows(spark, sf_dir).groupBy("collection_id").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("cost"))), F.lit(0.0)), 2).alias("cost"))


@query("job_retention_prune", f"WITH {JOBS} SELECT job_id FROM jobs WHERE finished_at < '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_returnflag = 'R') AND job_id NOT IN (SELECT max(job_id) FROM jobs GROUP BY document_id)")
def job_retention_prune(spark, sf_dir):
    """Old jobs that neither a trace refers to nor are their document's last."""
    rows = job_rows(spark, sf_dir)
    traces = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))
    last = rows.groupBy("document_id").agg(F.max("job_id").alias("job_id"))
    return grid.unreferenced(rows.where("finished_at < '1996-01-01'").select("job_id"), "job_id", [traces, last])


@query("stage_durations", "SELECT l_returnflag AS stage, round(avg(epoch(l_shipdate) - epoch(o_orderdate)), 6) AS avg_seconds, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1")
def stage_durations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", F.col("l_returnflag").alias("stage")).join(o, "l_orderkey")
    return jobs.stage_durations(runs, "stage", "o_orderdate", "l_shipdate")


@query("settled_states", """SELECT user_id, max_by(event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END) AS status FROM events GROUP BY 1""")
def settled_states(spark, sf_dir):
    names = {"view": "pending", "click": "running", "error": "cancelled", "signup": "failed", "purchase": "done"}
    back = F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, k)])
    there = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rows = table(spark, sf_dir, "events").select("user_id", F.element_at(there, F.col("event_type")).alias("status"))
    return jobs.settled(rows, "user_id").select("user_id", F.element_at(back, F.col("status")).alias("status"))


_BOUNDS = [25.0, 50.0, 100.0, 200.0]


@query("histogram_p95", """WITH b AS (SELECT event_type, CASE WHEN value <= 25 THEN 25e0 WHEN value <= 50 THEN 50e0 WHEN value <= 100 THEN 100e0 WHEN value <= 200 THEN 200e0 END AS bound, count(*) AS n FROM events GROUP BY ALL),
 s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bound NULLS LAST) AS seen, sum(n) OVER (PARTITION BY event_type) AS total, max(bound) OVER (PARTITION BY event_type) AS largest FROM b)
 SELECT event_type, coalesce(min(bound), max(largest)) AS bound FROM s WHERE seen >= 0.95 * total GROUP BY 1""")
def histogram_p95(spark, sf_dir):
    bound = F.coalesce(*[F.when(F.col("value") <= b, F.lit(b)) for b in _BOUNDS])
    buckets = table(spark, sf_dir, "events").groupBy("event_type", bound.alias("bound")).agg(F.count("*").alias("n"))
    return jobs.histogram_quantile(buckets, "event_type", 0.95)


@query("search_health", """SELECT date_trunc('day', ts) AS day, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END), 6) AS error_rate,
 round(avg(CASE WHEN json_extract_string(props, '$.k')::BIGINT < 5 THEN 1e0 ELSE 0e0 END), 6) AS zero_rate, round(avg(json_extract_string(props, '$.k')::BIGINT), 6) AS avg_hits FROM events GROUP BY 1""")
def search_health(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    rows = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day"), "event_type", k.alias("k"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.groupBy("day").agg(F.count("*").alias("n"), share(F.col("event_type") == "error").alias("error_rate"), share(F.col("k") < 5).alias("zero_rate"), F.round(F.avg("k"), 6).alias("avg_hits"))


# documents with metadata ---------------------------------------------------------------------------------------------

META = """meta AS (SELECT doc_id, field, value FROM (SELECT doc_id, 'quality' AS field, quality::VARCHAR AS value FROM labels UNION ALL SELECT doc_id, 'source', source FROM documents
 UNION ALL SELECT doc_id, 'title', CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE upper(lang) || ' ' || source END FROM documents) WHERE value IS NOT NULL)"""


def metadata(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    title = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.upper("lang"), F.lit(" "), "source"))
    rows = docs.select("doc_id", "source", title.alias("title"))
    return grid.unpivot_metadata(labels, "doc_id", ["quality"]).unionByName(grid.unpivot_metadata(rows, "doc_id", ["source", "title"]))


@query("grid_filtered_page", "SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(source), 'src1') AND lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 5000 ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 10")
def grid_filtered_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.lower("source").contains("src1") & F.col("lang").isin("en", "de") & F.col("n_chars").between(200, 5000))
    return grid.page(docs.select("doc_id", "source", "n_chars"), "n_chars", "doc_id", 20, 10, descending=True)


@query("grid_metadata_exists", f"WITH {META} SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM meta m WHERE m.doc_id = d.doc_id AND field = 'quality' AND TRY_CAST(value AS BIGINT) >= 1) AND EXISTS (SELECT 1 FROM meta m WHERE m.doc_id = d.doc_id AND field = 'source' AND contains(lower(value), '2'))")
def grid_metadata_exists(spark, sf_dir):
    m = metadata(spark, sf_dir)
    docs = grid.having(table(spark, sf_dir, "documents").select("doc_id", "lang"), m, "doc_id", "quality", grid.typed("value", "integer") >= 1)
    return grid.having(docs, m, "doc_id", "source", F.lower("value").contains("2"))


@query("grid_metadata_sort", f"WITH {META} SELECT d.doc_id, TRY_CAST(value AS BIGINT) AS quality FROM documents d LEFT JOIN meta m ON m.doc_id = d.doc_id AND field = 'quality' ORDER BY quality DESC NULLS LAST, d.doc_id LIMIT 50 OFFSET 340")
def grid_metadata_sort(spark, sf_dir):
    rows = grid.with_value(table(spark, sf_dir, "documents").select("doc_id"), metadata(spark, sf_dir), "doc_id", "quality", "value")
    return grid.page(rows.select("doc_id", grid.typed("value", "integer").alias("quality")), "quality", "doc_id", 50, 340, descending=True)


@query("grid_display_title", f"WITH {META} SELECT d.doc_id, coalesce(nullif(trim(value), ''), split_part(text, chr(10), 1)) AS title FROM documents d LEFT JOIN meta m ON m.doc_id = d.doc_id AND field = 'title'")
def grid_display_title(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("parsed"))
    rows = grid.with_value(docs, metadata(spark, sf_dir), "doc_id", "title", "value")
    return rows.select("doc_id", grid.display_title("value", "parsed").alias("title"))


@query("grid_total", "SELECT count(*) AS total FROM documents WHERE lang = 'fr' AND n_chars > 800")
def grid_total(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'fr' AND n_chars > 800").agg(F.count("*").alias("total"))


@query("values_top", f"WITH {META} SELECT value, count(*) AS n FROM meta WHERE field = 'source' GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def values_top(spark, sf_dir):
    return grid.value_counts(metadata(spark, sf_dir), "source").orderBy(F.desc("n"), "value").limit(10)


@query("values_distinct", f"WITH {META} SELECT field, count(DISTINCT value) AS n FROM meta GROUP BY 1")
def values_distinct(spark, sf_dir):
    return metadata(spark, sf_dir).groupBy("field").agg(F.countDistinct("value").alias("n"))


@query("values_suggest", f"WITH {META} SELECT value, count(*) AS n FROM meta WHERE field = 'title' AND contains(lower(value), 'src1') GROUP BY 1 ORDER BY starts_with(lower(value), 'src1') DESC, n DESC, length(value), value LIMIT 12")
def values_suggest(spark, sf_dir):
    return grid.suggest(grid.value_counts(metadata(spark, sf_dir), "title"), "Src1", 12)


@query("values_similar", f"WITH {META} SELECT value, count(*) AS n, round(1 - levenshtein(lower(value), 'src12')::DOUBLE / greatest(length(value), 5), 6) AS ratio FROM meta WHERE field = 'source' GROUP BY 1 HAVING ratio >= 0.6 ORDER BY ratio DESC, value LIMIT 8")
def values_similar(spark, sf_dir):
    return grid.similar(grid.value_counts(metadata(spark, sf_dir), "source"), "SRC12", 8)


@query("values_case_variants", "WITH v AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS value FROM documents) SELECT value, lower(value) AS folded, row_number() OVER (PARTITION BY lower(value) ORDER BY value) AS nth FROM v QUALIFY nth <= 1")
def values_case_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("s").alias("field"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("value"))
    return grid.case_variants(docs, "s", 1)


@query("selector_minus_excluded", "SELECT doc_id FROM documents WHERE source = 'src4' AND doc_id NOT IN (4, 24, 44)")
def selector_minus_excluded(spark, sf_dir):
    return grid.select_documents(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", F.col("source") == "src4", [4, 24, 44]).select("doc_id")


@query("bulk_enable_changes", "SELECT count(*) AS matched, count(*) FILTER (quality = 0) AS changed, count(*) FILTER (quality IS NULL) AS skipped FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en'")
def bulk_enable_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("matched"), F.count_if(F.col("quality") == 0).alias("changed"), F.count_if(F.col("quality").isNull()).alias("skipped"))


@query("metadata_upsert", "SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'new' END, quality::VARCHAR) AS value FROM (SELECT doc_id FROM documents WHERE doc_id % 5 = 0 UNION SELECT doc_id FROM labels) LEFT JOIN labels USING (doc_id)")
def metadata_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    new = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("value"))
    return grid.upsert(old, new, ["doc_id"], "value")


@query("blobs_unreferenced", "SELECT DISTINCT sha256(source) AS content_hash FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def blobs_unreferenced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("source", 256).alias("content_hash"))
    used = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return grid.unreferenced(docs.select("content_hash").distinct(), "content_hash", [used])


@query("config_diff", "WITH a AS (SELECT doc_id, lang AS v FROM documents WHERE doc_id < 600), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS v FROM documents WHERE doc_id >= 100) SELECT doc_id, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS before, b.v AS after FROM a FULL JOIN b USING (doc_id) WHERE a.v IS DISTINCT FROM b.v")
def config_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    b = docs.where("doc_id >= 100").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")).alias("v"))
    return grid.diff(docs.where("doc_id < 600").select("doc_id", F.col("lang").alias("v")), b, "doc_id", "v")


@query("cache_evictions", "SELECT source, doc_id, kept_bytes FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS kept_bytes FROM documents) WHERE kept_bytes > 60000")
def cache_evictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return grid.within_budget(docs, "source", ["doc_id"], "n_chars", 60_000).select("source", "doc_id", "kept_bytes")


@query("storage_footprint", """WITH u AS (SELECT doc_id, 'text' AS bucket, length(text) AS b FROM documents UNION ALL SELECT doc_id, 'meta', length(source) + length(lang) FROM documents UNION ALL SELECT doc_id, 'labels', 8 FROM labels)
 SELECT doc_id, sum(b) FILTER (bucket = 'text')::BIGINT AS text_bytes, sum(b)::BIGINT AS total_bytes FROM u GROUP BY 1 ORDER BY total_bytes DESC, doc_id LIMIT 100""")
def storage_footprint(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = lambda d, name, b: d.select("doc_id", F.lit(name).alias("bucket"), b.cast("long").alias("b"))
    rows = part(docs, "text", F.length("text")).unionByName(part(docs, "meta", F.length("source") + F.length("lang"))).unionByName(part(labels, "labels", F.lit(8)))
    total = rows.groupBy("doc_id").agg(F.sum(F.when(F.col("bucket") == "text", F.col("b"))).alias("text_bytes"), F.sum("b").alias("total_bytes"))
    return total.orderBy(F.desc("total_bytes"), "doc_id").limit(100)


@query("blob_bytes", """WITH o AS (SELECT doc_id, sha256(text) AS h, length(text) AS n, 0 AS rendered FROM documents), r AS (SELECT doc_id, sha256(substr(text, 1, 80)) AS h, length(substr(text, 1, 80)) AS n, 1 AS rendered FROM documents WHERE lang <> 'en'),
 u AS (SELECT * FROM o UNION SELECT * FROM r), b AS (SELECT h, min(n) AS n FROM u GROUP BY 1) SELECT count(*) AS refs, sum(b.n) FILTER (rendered = 0)::BIGINT AS original, sum(b.n) FILTER (rendered = 1)::BIGINT AS rendered, (SELECT sum(n)::BIGINT FROM b) AS unique_bytes FROM u JOIN b USING (h)""")
def blob_bytes(spark, sf_dir):
    """Bytes of original and rendered blobs by reference, and of all blobs once; a text may be both."""
    docs = table(spark, sf_dir, "documents")
    blob = lambda d, text, rendered: d.select("doc_id", F.sha2(text, 256).alias("h"), F.length(text).cast("long").alias("n"), F.lit(rendered).alias("rendered"))
    refs = blob(docs, F.col("text"), 0).union(blob(docs.where("lang <> 'en'"), F.substring("text", 1, 80), 1)).distinct()
    blobs = refs.groupBy("h").agg(F.min("n").alias("n"))
    total = blobs.agg(F.sum("n").alias("unique_bytes"))
    by = lambda k: F.sum(F.when(F.col("rendered") == k, F.col("n")))
    joined = refs.drop("n").join(blobs, "h").agg(F.count("*").alias("refs"), by(0).alias("original"), by(1).alias("rendered"))
    return joined.join(F.broadcast(total), F.lit(True))  # one row each


@query("vector_bytes", "SELECT label, count(*) AS points, count(*) * 64 * 4 AS dense_bytes, round(count(*) * 37.5e0 * 8, 3) AS sparse_bytes FROM embeddings GROUP BY 1")
def vector_bytes(spark, sf_dir):
    return jobs.vector_bytes(table(spark, sf_dir, "embeddings"), "label", 64, 37.5)


@query("cost_estimate", """WITH d AS (SELECT source, CASE WHEN lang = 'es' THEN 'none' ELSE lang END AS model, n_chars // 4 AS tokens, (n_chars + 1999) // 2000 AS calls FROM documents), r AS (SELECT * FROM (VALUES ('en', 2.5e0), ('fr', 1.0e0), ('de', 4.0e0)) t(model, rate))
 SELECT source, sum(calls)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, CASE WHEN count(*) FILTER (rate IS NULL) = 0 THEN round(sum(tokens * rate / 1e6), 6) END AS cost, coalesce(round(sum(tokens * rate / 1e6), 6), 0) AS lower_bound FROM d LEFT JOIN r USING (model) GROUP BY 1""")
def cost_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("model", F.when(F.col("lang") == "es", "none").otherwise(F.col("lang")))
    rates = spark.createDataFrame([("en", 2.5), ("fr", 1.0), ("de", 4.0)], "model string, per_million double")
    return jobs.estimate_cost(docs, "source", F.expr("n_chars DIV 4"), F.expr("(n_chars + 1999) DIV 2000"), rates)


@query("idempotent_claims", "SELECT user_id, event_type, min(event_id) AS claimed_by, count(*) AS attempts FROM events GROUP BY 1, 2")
def idempotent_claims(spark, sf_dir):
    """The first request with a key claims it; later ones are replays."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("claimed_by"), F.count("*").alias("attempts"))


@query("config_versions_page", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 3")
def config_versions_page(spark, sf_dir):
    """Numbered from the oldest; the newest three of each."""
    up, down = Window.partitionBy("source").orderBy("doc_id"), Window.partitionBy("source").orderBy(F.desc("doc_id"))
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(up).cast("long").alias("version"), F.row_number().over(down).alias("n"))
    return rows.where("n <= 3").drop("n")
