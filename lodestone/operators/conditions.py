"""Conditions on metadata values that are stored as JSON, by the declared type of their field."""

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTUAL, NUMERIC = ("string", "text", "enum"), ("integer", "float", "datetime")
TEXT_LISTS, NUMBER_LISTS = ("keyword_list", "text_list"), ("integer_list", "float_list")
# what may be asked of a field of each type
OPERATORS = {t: ("eq", "contains", "in") for t in TEXTUAL} | {t: ("eq", "gte", "lte", "in") for t in NUMERIC} | {t: ("in", "contains") for t in (*TEXT_LISTS, *NUMBER_LISTS)} | {"bool": ("eq",)}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object


def _bound_error(c: Condition, kind: str) -> str | None:
    if c.op not in ("gte", "lte"):
        return None
    try:
        if c.value is None or isinstance(c.value, bool):
            raise ValueError
        datetime.fromisoformat(str(c.value).replace("Z", "+00:00")) if kind == "datetime" and not isinstance(c.value, datetime) else kind == "datetime" or float(c.value)
    except (TypeError, ValueError):
        return f"{c.field}: {c.value!r} is no {kind}"
    return None


def errors(conditions: list[Condition], types: dict[str, str]) -> list[str]:
    """All that is wrong with the conditions: unknown fields, operators that do not fit, bounds that are none."""
    out = []
    for c in conditions:
        kind = types.get(c.field)
        if kind is None:
            out.append(f"{c.field} is unknown")
        elif c.op not in OPERATORS[kind]:
            out.append(f"{c.field}: {c.op} does not go with {kind}")
        elif error := _bound_error(c, kind):
            out.append(error)
    return out


def predicate(value: Column, c: Condition, kind: str) -> Column:
    """Whether a stored JSON value meets a condition. Of a list, one wanted element is enough; numbers are compared as numbers."""
    tree = F.try_parse_json(value)
    text = F.try_variant_get(tree, "$", "string")
    said = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    wanted = list(c.value) if isinstance(c.value, (list, tuple)) else [c.value]
    if c.op == "contains":
        whole = F.when(F.schema_of_variant(tree).startswith("ARRAY"), F.to_json(tree)).otherwise(text)
        return F.lower(whole).contains(said(c.value).lower())
    if c.op == "in" and kind in TEXT_LISTS:
        return F.arrays_overlap(F.try_variant_get(tree, "$", "array<string>"), F.array(*[F.lit(said(v)) for v in wanted]))
    if c.op == "in" and kind in NUMBER_LISTS:
        return F.arrays_overlap(F.try_variant_get(tree, "$", "array<double>"), F.array(*[F.lit(float(v)) for v in wanted]))
    if c.op in ("gte", "lte"):
        to = "timestamp_ntz" if kind == "datetime" else "decimal(38,10)"
        have, bound = text.try_cast(to), F.lit(str(c.value)).try_cast(to)
        return have >= bound if c.op == "gte" else have <= bound
    return text.isin(*[said(v) for v in wanted])


def meeting(df: DataFrame, metadata: DataFrame, key: str, conditions: list[Condition], types: dict[str, str]) -> DataFrame:
    """Rows of df whose metadata (key, field, value as JSON) meet all conditions, each by a semi join; ValueError names all that is
    wrong with them."""
    if wrong := errors(conditions, types):
        raise ValueError("; ".join(wrong))
    step = lambda d, c: d.join(metadata.where((F.col("field") == c.field) & predicate(F.col("value"), c, types[c.field])).select(key), key, "left_semi")
    return reduce(step, conditions, df)


def selected(df: DataFrame, key: str, ids: list | None, chosen: Column | None, excluded: list, most: int) -> DataFrame:
    """The rows that a selector names: ids or a filter (one of them, not both), without the excluded ones; ValueError if they are more
    than `most`, rather than some of them."""
    if (ids is None) == (chosen is None):
        raise ValueError("a selector has either ids or a filter")
    rows = df.where(F.col(key).isin(ids) if ids is not None else chosen)
    rows = rows.where(~F.col(key).isin(excluded)) if excluded else rows
    if rows.select(key).limit(most + 1).count() > most:
        raise ValueError(f"the selector names more than {most} rows")
    return rows
