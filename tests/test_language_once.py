"""Language by function words: the words are cut once a text, not once for each use."""

from pyspark.sql import functions as F

from lodestone.functions.text import detect_language


def test_words_are_cut_once(spark):
    rows = [(1, "the of and to in"), (2, "le la les des et"), (3, "el der"), (4, None), (5, ""), (6, "the " + "x " * 30), (7, "der die das und von zu the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", detect_language("text").alias("l"))
    assert {r["doc_id"]: r["l"] for r in df.collect()} == {1: "en", 2: "fr", 3: "", 4: "", 5: "", 6: "", 7: "de"}
    plan = spark.range(1).select(detect_language(F.col("id").cast("string")).alias("l"))._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("regexp_extract_all") == 1, plan
