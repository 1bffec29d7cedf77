"""Grids over entities: predicates, typed sort keys with nulls last, pages, facets, value suggestions, selectors, upserts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_by(df: DataFrame, key: str | Column, tie: str, descending: bool = False) -> DataFrame:
    """Nulls last in either direction; ties to the smaller id."""
    c = F.col(key) if isinstance(key, str) else key
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.asc(tie))


def page(df: DataFrame, key: str | Column, tie: str, limit: int, offset: int = 0, descending: bool = False) -> DataFrame:
    return sort_by(df, key, tie, descending).offset(offset).limit(limit)


def typed(value: str, kind: str) -> Column:
    """A stored text column by its declared kind; what does not convert is null ("3.0" is an integer, "3.5" is none)."""
    c = F.trim(value)
    if kind == "integer":
        n = c.try_cast("double")
        return F.when(n == F.floor(n), n.cast("long"))
    return c.try_cast(kind)


def unpivot_metadata(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value string) of the named columns, a row for each value that is there."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("e"))
    return long.select(key, "e.field", "e.value").where("value IS NOT NULL")


def having(df: DataFrame, metadata: DataFrame, key: str, field: str, predicate: Column) -> DataFrame:
    """Rows of df for which a metadata value of the field meets the predicate (a semi join)."""
    return df.join(metadata.where((F.col("field") == field) & predicate).select(key), key, "left_semi")


def with_value(df: DataFrame, metadata: DataFrame, key: str, field: str, name: str) -> DataFrame:
    """df with the field's value beside it (a left join; one value per key)."""
    return df.join(metadata.where(F.col("field") == field).select(key, F.col("value").alias(name)), key, "left")


def display_title(value: Column | str, title: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.col(title) if isinstance(title, str) else title)


def value_counts(metadata: DataFrame, field: str) -> DataFrame:
    return metadata.where(F.col("field") == field).groupBy("value").agg(F.count("*").alias("n"))


def suggest(counts: DataFrame, needle: str, limit: int) -> DataFrame:
    """Values that contain the needle: those that begin with it, the frequent, the short, then by value."""
    low, x = F.lower("value"), needle.lower()
    return counts.where(low.contains(x)).orderBy(F.desc(low.startswith(x)), F.desc("n"), F.length("value"), "value").limit(limit)


def similar(counts: DataFrame, needle: str, limit: int, cutoff: float = 0.6) -> DataFrame:
    """Values by edit likeness to the needle."""
    ratio = 1 - F.levenshtein(F.lower("value"), F.lit(needle.lower())) / F.greatest(F.length("value"), F.lit(len(needle)))
    return counts.withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), "value").limit(limit)


def similar_pairs(needles: DataFrame, counts: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(needle, value, n, ratio) of all values at an edit likeness of the cutoff or more to each of any number of needles.

    Texts d edits apart share all but 2d of their pairs of neighbouring characters (with a mark at both ends), so candidates come
    from a join on those pairs, each with its number among equal ones; above a cutoff of one half, like texts share one at
    least. Lengths bound d within the join, and the count of shared pairs before any distance is taken."""
    if not 0.5 < cutoff <= 1:
        raise ValueError("the cutoff must be above 0.5 and at most 1")

    def pairs(df: DataFrame, c: str) -> DataFrame:
        marked = F.concat(F.lit("\u0002"), F.lower(c), F.lit("\u0003"))
        all_ = F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(marked, i, F.lit(2)))
        numbered = F.transform("p", lambda x, i: F.concat(x, F.size(F.filter(F.slice("p", F.lit(1), i), lambda y: y == x)).cast("string")))
        return df.where(F.length(c) > 0).withColumn("p", all_).withColumns({"l": F.length(c), "p": numbered}).select(c, F.col("l").alias(f"l_{c}"), F.explode("p").alias("pair"))

    # length of the longer text, times what may differ
    longest = F.greatest("l_needle", "l_value")
    edits = F.floor((1 - cutoff) * longest + 1e-9)
    near = pairs(needles.select("needle").distinct(), "needle").join(pairs(counts.select("value"), "value"), "pair").where(F.abs(F.col("l_needle") - F.col("l_value")) <= edits)
    some = near.groupBy("needle", "value", "l_needle", "l_value").agg(F.count("*").alias("shared")).where(F.col("shared") >= longest + 1 - 2 * edits)
    ratio = F.round(1 - F.levenshtein(F.lower("value"), F.lower("needle")) / longest, 6)
    return some.withColumn("ratio", ratio).where(F.col("ratio") >= cutoff).join(counts, "value").select("needle", "value", "n", "ratio")


def case_variants(metadata: DataFrame, field: str, most: int) -> DataFrame:
    """At most so many spellings of each value without regard to case."""
    values = metadata.where(F.col("field") == field).select("value").distinct().withColumn("folded", F.lower("value"))
    nth = F.row_number().over(Window.partitionBy("folded").orderBy("value")).cast("long")
    return values.withColumn("nth", nth).where(F.col("nth") <= most)


def select_documents(df: DataFrame, key: str, chosen: Column, excluded: list) -> DataFrame:
    return df.where(chosen).where(~F.col(key).isin(excluded)) if excluded else df.where(chosen)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New values win, old ones without a new value stay."""
    a, b = old.withColumnRenamed(value, "__old"), new.withColumnRenamed(value, "__new")
    return a.join(b, keys, "full").select(*keys, F.coalesce("__new", "__old").alias(value))


def unreferenced(df: DataFrame, key: str, references: list[DataFrame]) -> DataFrame:
    """Rows that none of the frames refers to (a chain of anti joins)."""
    return reduce(lambda d, r: d.join(r.select(key), key, "left_anti"), references, df)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, before, after) of what was added, removed or changed."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    both = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), key, "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select(key, change.alias("change"), "before", "after").where("change IS NOT NULL")


def within_budget(df: DataFrame, owner: str, used: list[str], size: str, most: int) -> DataFrame:
    """Rows to evict, least recently used first, until what stays is at most so many bytes per owner."""
    newest = Window.partitionBy(owner).orderBy(*[F.desc(c) for c in used]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("kept_bytes", F.sum(size).over(newest)).where(F.col("kept_bytes") > most)
