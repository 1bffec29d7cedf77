"""distances are made where both texts are, and no frame runs up to the end of a document."""

from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine_distance
from lodestone.operators import chunks, passages


def test_distance_is_that_of_the_vectors(spark):
    texts = ["a b c a", "A b d", "x", " ", "", "a b c a"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    vector = chunks.hashed_terms()
    rows = rows.withColumns({"v": vector("a"), "w": vector("b")}).select(cosine_distance("v", "w").alias("want"), chunks.hashed_distance()("a", "b").alias("got"))
    assert all(r["want"] == r["got"] for r in rows.collect())


def test_plan_has_no_vectors_and_no_frames_to_the_end(spark):
    blocks = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(0).alias("ord"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("page"), F.lit("One two. Three four. Five.").alias("text"))
    p = passages.passages(blocks)
    plan = chunks.semantic(p)._jdf.queryExecution().toString()
    assert "hashed" not in plan and "vector(" not in plan and "currentrow$(), unboundedfollowing$()" not in plan
    assert sorted(r["text"] for r in chunks.semantic(p).collect()) == sorted(r["text"] for r in chunks.semantic(p, vectors=chunks.hashed_terms()).collect())
