"""Row-level flow: fallback chains, joins that denormalise, replacement on re-ingest, closures of parent links."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.streaming.streams import shared_folder


def fallback(df: DataFrame, steps: list[tuple[str, Column, Column | None]], name: str, accept: float = 0.5) -> DataFrame:
    """Runs steps (label, value, score or none) in turn for each row: a null value or a score under `accept` passes the row
    on; the last step that gave a value wins. Adds `name` and `name`_step."""
    value, label, settled = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for text, out, score in steps:
        take = ~settled & out.isNotNull()
        value, label = F.when(take, out).otherwise(value), F.when(take, F.lit(text)).otherwise(label)
        good = out.isNotNull() if score is None else out.isNotNull() & (score >= accept)
        settled = settled | F.coalesce(good, F.lit(False))
    return df.withColumns({name: value, f"{name}_step": label})


def denormalize(chunks: DataFrame, documents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """chunks with the documents' values of the fields; a chunk's own value wins."""
    d = documents.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    rows = chunks.join(d, key, "left")
    return rows.select(*[c for c in chunks.columns if c not in fields], *[F.coalesce(*([f] if f in chunks.columns else []), f"__{f}").alias(f) for f in fields])


def replace_documents(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of the documents that came anew are replaced by their new rows."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def ancestors(spark, nodes: DataFrame) -> DataFrame:
    """(node, steps, ancestor) of every node over its parents, at any depth, by the shortest way. nodes: node, parent.

    Each round joins what is known with itself, so it reaches twice as far; rounds are written to the shared folder and end
    when no pair is new, which cycles do not hinder."""
    folder = shared_folder(spark)

    def kept(rows: DataFrame, number: int) -> DataFrame:
        rows.write.parquet(f"{folder}/{number}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{number}")

    pairs = kept(nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")).distinct(), 0)
    known, number = pairs.count(), 0
    while True:
        on = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("steps").alias("more"))
        far = pairs.join(on, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        number += 1
        pairs = kept(pairs.unionByName(far).groupBy("node", "ancestor").agg(F.min("steps").alias("steps")), number)
        n = pairs.count()
        if n == known:
            return pairs.select("node", "steps", "ancestor")
        known = n


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def deepest_failure(trace: DataFrame) -> DataFrame:
    """(job_id, path): the failed node that lies deepest, first by path. trace: job_id, path, depth, status."""
    failed = trace.where("status = 'failed'")
    return failed.groupBy("job_id").agg(F.min_by("path", F.struct(-F.col("depth"), "path")).alias("path"))
