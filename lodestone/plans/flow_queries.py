"""Registered queries on flow and transfer."""

from pyspark.sql import functions as F

from lodestone.operators import flow
from lodestone.plans.registry import query
from lodestone.sources.bundle import remap, round_trip
from lodestone.sources.tables import table


@query("fallback_chain", """SELECT doc_id, CASE WHEN n_chars % 3 <> 0 AND n_chars / 2000e0 >= 0.5 THEN lang WHEN source <> 'src5' THEN source WHEN n_chars % 3 <> 0 THEN lang END AS answer,
 CASE WHEN n_chars % 3 <> 0 AND n_chars / 2000e0 >= 0.5 THEN 'first' WHEN source <> 'src5' THEN 'second' WHEN n_chars % 3 <> 0 THEN 'first' END AS answer_step FROM documents""")
def fallback_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    steps = [("first", F.when(F.col("n_chars") % 3 != 0, F.col("lang")), F.col("n_chars") / 2000), ("second", F.when(F.col("source") != "src5", F.col("source")), None)]
    return flow.fallback(docs, steps, "answer").select("doc_id", "answer", "answer_step")


@query("denormalized_filters", "SELECT conv_id, turn, coalesce(CASE WHEN turn = 0 THEN 'own' END, lang) AS lang, source FROM conversations LEFT JOIN documents ON doc_id = conv_id")
def denormalized_filters(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, "own").alias("lang"))
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "conv_id")
    return flow.denormalize(turns, docs, "conv_id", ["lang", "source"]).select("conv_id", "turn", "lang", "source")


@query("replace_on_reingest", "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 4 <> 0 UNION ALL SELECT conv_id, turn, 'anew' FROM conversations WHERE conv_id % 4 = 0 AND turn < 2")
def replace_on_reingest(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    fresh = turns.where("conv_id % 4 = 0 AND turn < 2").withColumn("role", F.lit("anew"))
    return flow.replace_documents(turns, fresh, "conv_id")


@query("ancestry", "WITH RECURSIVE n AS (SELECT doc_id AS node, CASE WHEN doc_id > 0 THEN doc_id // 3 END AS parent FROM documents), up AS (SELECT node, parent AS ancestor, 1 AS steps FROM n WHERE parent IS NOT NULL UNION ALL SELECT up.node, n.parent, steps + 1 FROM up JOIN n ON n.node = up.ancestor WHERE n.parent IS NOT NULL) SELECT node, min(steps)::INTEGER AS steps, ancestor FROM up GROUP BY node, ancestor")
def ancestry(spark, sf_dir):
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.when(F.col("doc_id") > 0, F.expr("doc_id DIV 3")).alias("parent"))
    return flow.ancestors(spark, nodes)


@query("failure_breadcrumb", "WITH t AS (SELECT l_orderkey AS job_id, l_linenumber AS depth, l_shipmode AS path FROM (SELECT *, l_partkey::VARCHAR AS l_shipmode FROM lineitem) WHERE l_returnflag = 'R') SELECT job_id, min_by(path, (-depth, path)) AS path FROM t GROUP BY 1")
def failure_breadcrumb(spark, sf_dir):
    trace = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").cast("string").alias("path"), F.col("l_linenumber").alias("depth"), F.when(F.col("l_returnflag") == "R", "failed").alias("status"))
    return flow.deepest_failure(trace)


@query("bundle_round_trip", "SELECT CASE WHEN doc_id < 100 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, lang, n_chars, md5(text) AS digest FROM documents")
def bundle_round_trip(spark, sf_dir):
    """Export, checked import, and new ids for some documents."""
    docs = round_trip(spark, {"documents": table(spark, sf_dir, "documents")})["documents"]
    ids = docs.where("doc_id < 100").select(F.col("doc_id").alias("old"), (F.col("doc_id") + 1_000_000).alias("new"))
    return remap(docs, ids, "doc_id").select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"))
