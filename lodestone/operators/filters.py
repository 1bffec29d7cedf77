"""The search filter grammar as Columns.

A filter maps a field to a value (equal), a list (any of), bounds (gte, gt, lte, lt) or one operator object (eq, in, not, not_in,
exists, contains, prefix). Fields combine by AND. A negation holds for rows without a value. Text kinds compare without
regard to case. Errors are collected, as a list of messages, before any Column is built.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import words

BOUNDS = ("gte", "gt", "lte", "lt")
LEGAL = {
    "keyword": {"eq", "in", "not", "not_in", "exists", "contains", "prefix"},
    "keyword_list": {"eq", "in", "not", "not_in", "exists", "contains", "prefix"},
    "text": {"eq", "in", "not", "not_in", "exists", "contains"},
    "integer": {"eq", "in", "not", "not_in", "exists", *BOUNDS},
    "float": {"exists", *BOUNDS},
    "bool": {"eq", "not", "exists"},
    "datetime": {"exists", *BOUNDS},
}
MOST_VALUES = 100


def errors(filters: dict, kinds: dict[str, str]) -> list[str]:
    """What is wrong with the filters, all of it."""
    out = []
    for field, spec in filters.items():
        kind = kinds.get(field)
        if kind is None:
            out.append(f"{field}: unknown field")
            continue
        ops = _operators(spec)
        if not ops:
            out.append(f"{field}: empty filter")
        if len(set(ops) - set(BOUNDS)) > 1 or (set(ops) & set(BOUNDS) and set(ops) - set(BOUNDS)):
            out.append(f"{field}: one operator at a time")
        for op, value in ops.items():
            if op not in LEGAL[kind]:
                out.append(f"{field}: {op} does not apply to {kind}")
            elif op in ("in", "not_in") and not (isinstance(value, list) and 0 < len(value) <= MOST_VALUES):
                out.append(f"{field}: {op} takes 1 to {MOST_VALUES} values")
            elif op in ("contains", "prefix") and not (isinstance(value, str) and value.strip()):
                out.append(f"{field}: {op} takes a text that is not blank")
            elif value is None or any(x is None or isinstance(x, (dict, list)) for x in (value if isinstance(value, list) else [value])):
                out.append(f"{field}: {op} takes no null and nothing nested")
            elif op in BOUNDS and isinstance(value, bool):
                out.append(f"{field}: {op} takes no boolean")
            elif op == "exists" and not isinstance(value, bool):
                out.append(f"{field}: exists takes a boolean")
        low = [ops[b] for b in ("gte", "gt") if b in ops]
        high = [ops[b] for b in ("lte", "lt") if b in ops]
        if len({type(x) for x in low + high} - {int, float}) > 1:
            out.append(f"{field}: bounds of different kinds")
        elif low and high and type(low[0]) is type(high[0]) and max(low) > min(high):
            out.append(f"{field}: the lower bound is above the upper")
    return out


def _operators(spec) -> dict:
    if isinstance(spec, dict):
        return spec
    return {"in": spec} if isinstance(spec, list) else {"eq": spec}


def _equal(column: Column, value, kind: str) -> Column:
    if kind == "keyword_list":
        return F.exists(column, lambda x: F.lower(x) == F.lower(F.lit(value)))
    if kind == "text":
        return F.size(F.array_except(words(F.lit(value)), words(column))) == 0
    return F.lower(column) == F.lower(F.lit(value)) if kind == "keyword" else column == F.lit(value)


def condition(field: str, spec, kind: str) -> Column:
    column = F.col(field)
    parts = []
    for op, value in _operators(spec).items():
        if op == "eq":
            parts.append(_equal(column, value, kind))
        elif op in ("in", "not_in"):
            any_of = reduce(Column.__or__, [_equal(column, v, kind) for v in value])
            parts.append(any_of if op == "in" else ~F.coalesce(any_of, F.lit(False)))
        elif op == "not":
            parts.append(~F.coalesce(_equal(column, value, kind), F.lit(False)))
        elif op == "exists":
            there = column.isNotNull() & (F.size(column) > 0) if kind == "keyword_list" else column.isNotNull()
            parts.append(there if value else ~there)
        elif op in ("contains", "prefix"):
            if kind == "text":
                parts.append(_equal(column, value, kind))
                continue
            needle = F.lower(F.lit(value))
            holds = (lambda x, needle=needle: F.lower(x).contains(needle)) if op == "contains" else (lambda x, needle=needle: F.lower(x).startswith(needle))
            parts.append(_any(column, op, value) if kind == "keyword_list" else holds(column))
        else:
            bound = F.lit(value).cast("timestamp") if kind == "datetime" else F.lit(value)
            parts.append({"gte": column >= bound, "gt": column > bound, "lte": column <= bound, "lt": column < bound}[op])
    return reduce(Column.__and__, parts)


def _any(column: Column, op: str, value: str) -> Column:
    needle = F.lower(F.lit(value))
    return F.exists(column, lambda x: F.lower(x).contains(needle)) if op == "contains" else F.exists(column, lambda x: F.lower(x).startswith(needle))


def build(filters: dict, kinds: dict[str, str]) -> Column:
    """The whole filter; ValueError with every message if something is wrong."""
    wrong = errors(filters, kinds)
    if wrong:
        raise ValueError("; ".join(wrong))
    return reduce(Column.__and__, [condition(f, s, kinds[f]) for f, s in filters.items()], F.lit(True))
