"""What runs used and what is stored: usage of nested records priced by leaf, bytes of every kind of row by document."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 16  #: deeper records are left out, and counted as such


def usage_leaves(runs: DataFrame, key: str, record: str, levels: int = LEVELS) -> DataFrame:
    """(key, model, prompt_tokens, completion_tokens, pages) of every record with usage in trees of records (JSON with usage and
    children). The tree is walked within its row, a level a step."""
    of = "from_json(r, 'usage struct<model:string,prompt_tokens:bigint,completion_tokens:bigint,pages:bigint>')"
    children = "coalesce(transform(try_variant_get(try_parse_json(r), '$.children', 'array<variant>'), x -> to_json(x)), cast(array() as array<string>))"
    start = f"named_struct('open', array(nullif({record}, '')), 'seen', cast(array() as array<string>))"
    step = f"named_struct('open', flatten(transform(acc.open, r -> {children})), 'seen', concat(acc.seen, acc.open))"
    rows = runs.where(F.col(record).isNotNull()).select(key, F.expr(f"aggregate(sequence(1, {levels}), {start}, (acc, i) -> IF(size(acc.open) = 0, acc, {step}))").alias("w"))
    rows = rows.select(key, F.explode("w.seen").alias("r")).select(key, F.expr(of)["usage"].alias("u")).where("u IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0)).alias(c)
    return rows.select(key, "u.model", zero("prompt_tokens"), zero("completion_tokens"), zero("pages"))


def usage_totals(leaves: DataFrame, key: str, rates: DataFrame) -> DataFrame:
    """(key, prompt_tokens, completion_tokens, cost, leaves): sums of the leaves and their cost at the rates (model, per_prompt,
    per_completion, per_page; per million tokens, and per page). A leaf with pages is priced by pages. A leaf without a rate costs
    nothing; where none has one the cost is null."""
    priced = leaves.join(rates, "model", "left")
    cost = F.when(F.col("pages") > 0, F.col("pages") * F.col("per_page")).otherwise((F.col("prompt_tokens") * F.col("per_prompt") + F.col("completion_tokens") * F.col("per_completion")) / 1e6)
    return priced.groupBy(key).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum(cost), 6).alias("cost"), F.count("*").alias("leaves"))


def row_bytes(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """Bytes of a row: of texts and binaries their own, of arrays and structs those of their JSON, of a number eight."""

    def size(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("string", "binary"):
            own = F.octet_length(c)
        elif kind.startswith(("array", "struct", "map")):
            own = F.octet_length(F.to_json(c))
        else:
            own = F.lit(1 if kind == "boolean" else 8)
        return F.when(c.isNotNull(), own).otherwise(0).cast("long")

    return reduce(lambda a, b: a + b, [size(n, k) for n, k in df.dtypes if n not in without], F.lit(0).cast("long"))


def footprint(parts: list[tuple[str, DataFrame]], document: str) -> DataFrame:
    """(document, bucket, rows, bytes) of all tables that hold rows of documents, several a bucket; sums are partial before the one shuffle."""
    each = [df.select(document, F.lit(bucket).alias("bucket"), row_bytes(df).alias("b")) for bucket, df in parts]
    return reduce(DataFrame.unionByName, each).groupBy(document, "bucket").agg(F.count("*").alias("rows"), F.sum("b").alias("bytes"))
