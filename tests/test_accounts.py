"""Typed conditions on metadata, selectors, nested usage, row sizes, layout items."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import accounts, conditions
from lodestone.operators.conditions import Condition
from lodestone.sources import sidecar

TYPES = {"s": "string", "i": "integer", "f": "float", "b": "bool", "d": "datetime", "e": "enum", "k": "keyword_list", "n": "integer_list", "g": "float_list"}


def test_conditions(spark):
    values = {
        1: {"s": '"Hello World"', "i": "7", "b": "true", "d": '"2024-01-02T00:00:00"', "k": '["a","B"]', "n": "[1,2]", "g": "[1.5,2]"},
        2: {"s": '"7"', "i": "7.5", "b": "false", "d": '"later"', "k": "[]", "n": "[12]", "g": "[2.0]"}, 3: {"s": "null", "i": '"x"', "k": '"a"', "n": "1"}, 4: {}, 5: {"s": "{bad", "i": "-1e3"},
    }
    meta = spark.createDataFrame([(k, f, v) for k, m in values.items() for f, v in m.items()], "id int, field string, value string")
    df = spark.createDataFrame([(k,) for k in values], "id int")
    ask = lambda *c: sorted(r["id"] for r in conditions.meeting(df, meta, "id", [Condition(*x) for x in c], TYPES).collect())
    assert ask(("s", "contains", "o w")) == [1] and ask(("s", "eq", 7)) == [2] and ask(("s", "in", ["7", "Hello World"])) == [1, 2]
    assert ask(("i", "gte", 7)) == [1, 2] and ask(("i", "lte", "7")) == [1, 5] and ask(("i", "in", [7, 8])) == [1] and ask(("b", "eq", True)) == [1]
    assert ask(("d", "lte", datetime(2024, 1, 2))) == [1] and ask(("d", "gte", "2024-01-03")) == []
    assert ask(("k", "in", ["a", "z"])) == [1] and ask(("k", "contains", "b")) == [1] and ask(("n", "in", [2, 3])) == [1] and ask(("n", "in", 12)) == [2] and ask(("g", "in", [2])) == [1, 2]
    assert ask() == [1, 2, 3, 4, 5] and ask(("i", "gte", 0), ("k", "in", ["B"])) == [1]
    wrong = [Condition("x", "eq", 1), Condition("b", "in", [True]), Condition("i", "gte", "many"), Condition("d", "lte", "soon"), Condition("f", "gte", None), Condition("k", "eq", "a"), Condition("i", "lte", True)]
    assert [e.split(":")[0].split()[0] for e in conditions.errors(wrong, TYPES)] == ["x", "b", "i", "d", "f", "k", "i"]
    with pytest.raises(ValueError, match="x is unknown; b"):
        conditions.meeting(df, meta, "id", wrong, TYPES)


def test_selectors(spark):
    df = spark.range(10).withColumnRenamed("id", "doc")
    got = lambda *a: sorted(r["doc"] for r in conditions.selected(df, "doc", *a).collect())
    assert got([1, 2, 99], None, [2], 5) == [1] and got(None, F.col("doc") > 6, [], 3) == [7, 8, 9] and got([], None, [], 0) == []
    for bad in ((None, None, [], 5), ([1], F.col("doc") > 1, [], 5), (None, F.col("doc") > 6, [], 2)):
        with pytest.raises(ValueError):
            got(*bad)


def test_nested_usage(spark):
    use = lambda m, p, c, pages=0: {"model": m, "prompt_tokens": p, "completion_tokens": c, "pages": pages}
    deep = {"usage": use("a", 1, 1)}
    for _ in range(9):
        deep = {"children": [deep, {"name": "no usage", "children": []}]}
    rows = [(1, json.dumps({"usage": use("a", 1_000_000, 0), "children": [{"usage": use("?", 5, 5)}, {"usage": use("b", 0, 0, 4), "children": [{"usage": use("a", 0, 500_000)}]}]})), (2, json.dumps(deep)), (3, json.dumps({"usage": use("?", 3, 4)})), (4, "{bad"), (5, None), (6, "{}")]
    rates = spark.createDataFrame([("a", 2.0, 4.0, None), ("b", 1.0, 1.0, 0.5)], "model string, per_prompt double, per_completion double, per_page double")
    got = {r["id"]: tuple(r)[1:] for r in accounts.usage_totals(accounts.usage_leaves(spark.createDataFrame(rows, "id int, record string"), "id", "record"), "id", rates).collect()}
    assert got == {1: (1_000_005, 500_005, 6.0, 4), 2: (1, 1, 6e-06, 1), 3: (3, 4, None, 1)}


def test_row_sizes(spark):
    df = spark.createDataFrame([(1, "é", b"abc", True, [1, 2]), (1, None, None, None, None)], "doc long, t string, b binary, x boolean, a array<int>")
    assert [r[0] for r in df.select(accounts.row_bytes(df)).collect()] == [8 + 2 + 3 + 1 + 5, 8]
    other = spark.createDataFrame([(1, "zz"), (2, "")], "doc long, note string")
    got = {(r["doc"], r["bucket"]): (r["rows"], r["bytes"]) for r in accounts.footprint([("a", df), ("b", other), ("a", other)], "doc").collect()}
    assert got == {(1, "a"): (3, 19 + 8 + 10), (1, "b"): (1, 10), (2, "a"): (1, 8), (2, "b"): (1, 8)}


def test_layout_items(spark):
    answer = {
        "pages": {"1": {"width": 100, "height": 200}},
        "items": [
            {"label": "title", "text": "T", "page_no": 1, "bbox": {"l": 10, "t": 180, "r": 60, "b": 100, "origin": "BOTTOMLEFT"}}, {"label": "Section_Header", "level": 1, "text": "S", "page_no": 1, "bbox": {"l": 10, "t": 20, "r": 60, "b": 100, "origin": "TOPLEFT"}},
            {"label": "unknown", "text": "x"}, {"label": "text", "text": "", "page_no": 2, "bbox": {"l": 0.1, "t": 0.9, "r": 0.5, "b": 0.2}}, {"label": "chart"},
        ],
    }
    rows = sorted(sidecar.item_blocks(spark.createDataFrame([(1, json.dumps(answer)), (2, None)], "id long, a string"), "id", "a").collect(), key=lambda r: r["ord"])
    assert [(r["block_type"], r["level"], r["page"], r["text"], [round(x, 6) for x in r["box"]]) for r in rows] == [
        ("heading", 1, 0, "T", [0.1, 0.1, 0.6, 0.5]), ("heading", 2, 0, "S", [0.1, 0.1, 0.6, 0.5]), ("paragraph", None, 1, None, [0.1, 0.1, 0.5, 0.8]), ("figure", None, 0, None, [0.0, 0.0, 1.0, 1.0]),
    ]
