"""Why a filtered search found less than was meant: values that nothing has, filters that leave nothing, queries without terms."""

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.grid import similar_pairs

SUGGESTIONS = 3


def unmatched(asked: DataFrame, stored: DataFrame, most: int = SUGGESTIONS, cutoff: float = 0.6) -> DataFrame:
    """(field, value, excluded, suggestions, message) of the asked values (field, value, excluded) that no stored value (field, value, n)
    equals, whatever the case; with at most so many of the closest stored ones, best first."""
    folded = stored.select("field", F.lower("value").alias("low")).distinct()
    open_ = asked.withColumn("low", F.lower("value")).join(folded, ["field", "low"], "left_anti").drop("low").distinct()
    # candidates share pairs of characters; the field keeps them apart
    needles = open_.select(F.col("value").alias("needle")).distinct()
    close = similar_pairs(needles, stored.groupBy("value").agg(F.sum("n").alias("n")), cutoff).select(F.col("needle").alias("value"), F.col("value").alias("other"), "ratio")
    own = stored.select("field", F.col("value").alias("other")).distinct()
    ranked = open_.select("field", "value").distinct().join(close, "value").join(own, ["field", "other"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("field", "value").orderBy(F.desc("ratio"), "other"))
    best = ranked.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("field", "value").agg(F.array_sort(F.collect_list(F.struct("nth", "other"))).alias("s"))
    rows = open_.join(best, ["field", "value"], "left").withColumn("suggestions", F.coalesce(F.transform("s", lambda x: x["other"]), F.array().cast("array<string>")))
    head = F.concat(F.lit("No document has "), "field", F.lit(' = "'), "value", F.lit('"'), F.when(F.col("excluded"), ", so this exclusion removes nothing.").otherwise("."))
    tail = F.when(F.size("suggestions") > 0, F.concat(F.lit(" Closest stored values: "), F.array_join("suggestions", ", "), F.lit("."))).otherwise(" No stored value of this field is close to it.")
    return rows.select("field", "value", "excluded", "suggestions", F.concat(head, tail).alias("message"))


def zero_hits(filters: dict[str, object], hits: int, explained: set[str] = frozenset(), verified: set[str] = frozenset(), text_fields: set[str] = frozenset()) -> list[tuple[str, str]]:
    """(field, message) for each filter of a search that found nothing, unless a hint explains it already. verified: fields whose value
    is known to be there."""
    if hits or not filters or explained:
        return []
    out = []
    for name, value in filters.items():
        shown = json.dumps(value, ensure_ascii=False, default=str)
        said = f"{name} {shown}" if isinstance(value, dict) else f"{name} {'matches text' if name in text_fields else '='} {shown}"
        if len(filters) == 1:
            text = f"No hit matched the filter {said}. It is the only filter: retry without it, or with a broader value."
        elif set(filters) <= set(verified):
            text = f"No hit matched all {len(filters)} filters together, including {said}. Each value exists, so their combination is too narrow: retry without one at a time."
        else:
            text = f"No hit matched all {len(filters)} filters together, including {said}: retry without one at a time."
        out.append((name, text))
    return out


def termless(query: str, fields: list[str], analyzer) -> list[tuple[str, str]]:
    """(field, message) for each lexical field that a query without terms leaves unsearched."""
    if analyzer(query)[0]:
        return []
    return [(f, f"The query has no searchable term for {f} (stop words or punctuation only), so nothing was searched there.") for f in fields]
