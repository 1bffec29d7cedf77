"""Metadata contracts: validation, canonical spellings, differences between two schemas and what they cost; usage and gates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata_errors(values: str, required: list[str], types: dict[str, str], enums: dict[str, list[str]], reject_unknown: bool = True) -> Column:
    """array<string> of what is wrong with a map of values: missing, unknown, wrong type, not in the enumeration; in this
    order, by field within each."""
    value = lambda k: F.try_element_at(F.col(values), F.lit(k))
    blank = lambda k: F.coalesce(F.trim(value(k)), F.lit("")) == ""
    checks = [F.when(blank(k), F.lit(f"{k} is required")) for k in sorted(required)]
    tail = [F.when(~blank(k) & value(k).try_cast(t).isNull(), F.lit(f"{k} is no {t}")) for k, t in sorted(types.items()) if t != "string"]
    tail += [F.when(~blank(k) & ~value(k).isin(*v), F.lit(f"{k} is none of its values")) for k, v in sorted(enums.items())]
    known = F.array(*[F.lit(k) for k in sorted({*required, *types, *enums})])
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys(values), known)), lambda k: F.concat(k, F.lit(" is unknown")))
    parts = [F.array(*checks) if checks else F.array().cast("array<string>"), unknown if reject_unknown else F.array().cast("array<string>"), F.array(*tail) if tail else F.array().cast("array<string>")]
    return F.filter(F.concat(*parts), lambda x: x.isNotNull())


def canonical(c: Column | str, spellings: list[str]) -> Column:
    """The declared spelling whatever the case; null for a value that is not declared."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.when(F.lower(value) == s.lower(), F.lit(s)) for s in spellings])


ATTRIBUTES = ("type", "searchable")


def schema_diff(before: DataFrame, after: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(field, change, was, changed): each field added, removed, renamed or modified, with the attributes that changed.
    before, after: field and ATTRIBUTES; renames: (was, field)."""
    if renames is not None:
        old = before.join(renames, before["field"] == renames["was"], "left").select(F.coalesce(renames["field"], before["field"]).alias("field"), renames["was"].alias("was"), *ATTRIBUTES)
    else:
        old = before.select("field", F.lit(None).cast("string").alias("was"), *ATTRIBUTES)
    a = old.select("field", "was", *[F.col(x).alias(f"old_{x}") for x in ATTRIBUTES], F.lit(True).alias("in_old"))
    b = after.select("field", *[F.col(x).alias(f"new_{x}") for x in ATTRIBUTES], F.lit(True).alias("in_new"))
    both = a.join(b, "field", "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old_{x}").eqNullSafe(F.col(f"new_{x}")), F.lit(x)) for x in ATTRIBUTES]))
    kept = F.col("in_old") & F.col("in_new")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("was").isNotNull(), "renamed").when(F.size(changed) > 0, "modified")
    out = both.select("field", change.alias("change"), "was", F.when(kept, F.array_join(changed, ",")).otherwise("").alias("changed"), (F.coalesce("old_searchable", F.lit(False)) | F.coalesce("new_searchable", F.lit(False))).alias("searchable"))
    return out.where("change IS NOT NULL")


def schema_effects(diff: DataFrame, values: DataFrame) -> DataFrame:
    """diff with values_lost (rows of values (field) under a removed field) and reindex (a searchable field that is new, renamed or changed)."""
    counts = values.groupBy("field").agg(F.count("*").alias("n"))
    lost = F.when(F.col("change") == "removed", F.coalesce("n", F.lit(0))).otherwise(0)
    return diff.join(counts, "field", "left").select("field", "change", "was", "changed", lost.alias("values_lost"), (F.col("searchable") & (F.col("change") != "removed")).alias("reindex"))


def regression_gate(current: DataFrame, baseline: DataFrame, gated: list[str], tolerance: float = 0.05) -> DataFrame:
    """(metric, current, baseline, drop, gated, failed) of two tables (metric, value); a metric missing on a side fails if gated."""
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "full")
    drop = F.col("baseline") - F.col("current")
    is_gated = F.col("metric").isin(*gated)
    return both.select("metric", "current", "baseline", F.round(drop, 6).alias("drop"), is_gated.alias("gated"), (is_gated & F.coalesce(drop > tolerance + 1e-9, F.lit(True))).alias("failed"))


def usage_cost(leaves: DataFrame, group: str, rates: DataFrame) -> DataFrame:
    """(group, tokens, cost): summed tokens of the leaves (group, kind, tokens) and their cost at the rates (kind, rate); a leaf
    without a rate costs nothing, and where no leaf has one the cost is null."""
    priced = leaves.join(F.broadcast(rates), "kind", "left")  # rates: a row a kind, written by hand
    return priced.groupBy(group).agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * F.col("rate")), 6).alias("cost"))


def latest_values(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One value a key: what later groups say wins."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))
