"""Small hand-made cases of the operators, and of their invariants."""

import pytest
from pyspark.sql import functions as F

from lodestone import plans
from lodestone.functions import text, vectors
from lodestone.operators import assemble, blocks, chunks, filters, flow, grid, jobs, retrieval, schema
from lodestone.sources import bundle, pages
from lodestone.sources.tables import table


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"] if values else spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.normalize(lit("  A\t b\n\nC "))) == "a b c"
    assert one(spark, text.words(lit("Œuvre Naïve, straße!"))) == ["oeuvre", "naive", "strasse"]
    assert one(spark, text.terms(lit("The cat et le chien"))) == ["cat", "chien"]
    assert one(spark, text.sentences(lit("One. Two! three? Four"))) == ["One.", "Two! three?", "Four"]
    assert one(spark, text.hard_cut(lit("a b c d e"), 2)) == ["a b", "c d", "e"]
    assert one(spark, text.strip_nul(lit("a\u0000b"))) == "ab"
    assert one(spark, text.detect_language(lit("the cat is on the mat and it is not for you"))) == "en"
    assert one(spark, text.detect_language(lit("zzz qqq"))) == ""
    assert one(spark, text.like_escape(lit("a_b%c\\"))) == "a\\_b\\%c\\\\"


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vectors.cosine(a(1, 0), a(1, 1))) == pytest.approx(2**-0.5)
    assert one(spark, vectors.cosine_distance(a(0, 0), a(1, 1))) == 1
    assert one(spark, vectors.common_prefix(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "abd")))) == ["a", "b"]
    assert one(spark, vectors.normalize_box(a(300, 50, 100, 900), F.lit(200.0), F.lit(100.0))) == [0.5, 0.5, 1.0, 1.0]
    assert one(spark, vectors.normalize_box(a(1, 2), F.lit(200.0), F.lit(100.0))) == [0.0, 0.0, 1.0, 1.0]


def test_filters(spark):
    rows = [(1, "Ann", ["x", "Y"], 5, "2024-01-02"), (2, "ann", [], 7, None), (3, None, None, None, "2023-05-05"), (4, "Bob", ["z"], 9, "2025-01-01")]
    df = spark.createDataFrame(rows, "id int, author string, tags array<string>, n int, at string").withColumn("at", F.col("at").cast("timestamp"))
    kinds = {"author": "keyword", "tags": "keyword_list", "n": "integer", "at": "datetime"}
    ids = lambda f: sorted(r["id"] for r in df.where(filters.build(f, kinds)).collect())
    assert ids({"author": "ANN"}) == [1, 2] and ids({"author": {"not": "ann"}}) == [3, 4]
    assert ids({"tags": "y"}) == [1] and ids({"tags": {"exists": False}}) == [2, 3] and ids({"tags": {"not_in": ["x"]}}) == [2, 3, 4]
    assert ids({"n": {"gt": 5, "lte": 9}}) == [2, 4] and ids({"n": [5, 9]}) == [1, 4] and ids({"at": {"gte": "2024-01-01"}}) == [1, 4]
    assert ids({"author": {"prefix": "B"}}) == [4] and ids({}) == [1, 2, 3, 4]
    for bad in ({"x": 1}, {"n": {}}, {"n": {"gte": 2, "eq": 3}}, {"n": {"contains": "1"}}, {"n": {"gte": 5, "lt": 1}}, {"n": {"gte": True}}, {"tags": {"in": []}}):
        assert filters.errors(bad, kinds)
        with pytest.raises(ValueError):
            filters.build(bad, kinds)


def test_fusion_and_caps(spark):
    a = retrieval.ranked(spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.9), (0, 3, 0.1)], "query_id int, id int, score double"), "id")
    b = retrieval.ranked(spark.createDataFrame([(0, 3, 7.0), (0, 9, 6.0)], "query_id int, id int, score double"), "id")
    assert [(r["id"], r["rank"]) for r in a.orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    fused = {r["id"]: r["score"] for r in retrieval.fuse_ranks([a, b], "id").collect()}
    assert fused == {1: 0.5, 2: pytest.approx(1 / 3), 3: pytest.approx(0.25 + 0.5), 9: pytest.approx(1 / 3)} or fused[3] > fused[1]
    assert {r["id"]: r["score"] for r in retrieval.fuse_ranks([a], "id").collect()} == {1: 0.9, 2: 0.9, 3: 0.1}
    assert retrieval.contribution(a, b, "id").first()[1:] == (1, 2, 1)
    hits = retrieval.ranked(spark.createDataFrame([(0, i, 1.0 / (1 + i), "d" if i < 5 else f"e{i}") for i in range(10)], "query_id int, id int, score double, doc string"), "id")
    assert [r["id"] for r in retrieval.cap_per_document(hits, "doc", 4, 2).orderBy("rank").collect()] == [0, 1, 5, 6]


def test_grid(spark):
    df = spark.createDataFrame([(1, 3), (2, None), (3, 1), (4, 3)], "id int, v int")
    order = lambda d: [r["id"] for r in grid.sort_by(df, "v", "id", d).collect()]
    assert order(False) == [3, 1, 4, 2] and order(True) == [1, 4, 3, 2]
    values = spark.createDataFrame([("3.0",), ("3.5",), ("x",), (" 7 ",)], "v string")
    assert [r[0] for r in values.select(grid.typed("v", "integer")).collect()] == [3, None, None, 7]
    d = {r["id"]: r["change"] for r in grid.diff(df, spark.createDataFrame([(1, 3), (2, 5), (9, 1)], "id int, v int"), "id", "v").collect()}
    assert d == {2: "changed", 3: "removed", 4: "removed", 9: "added"}


def test_backlog_and_quantile(spark):
    rows = [(1, "2024-01-01 00:10:00", "2024-01-01 01:10:00"), (2, "2024-01-01 02:00:00", None), (3, "2023-12-31 00:00:00", None)]
    df = spark.createDataFrame(rows, "job_id int, created_at string, finished_at string").selectExpr("job_id", "to_timestamp(created_at) created_at", "to_timestamp(finished_at) finished_at")
    out = jobs.hourly_backlog(df, "2024-01-01", "2024-01-01 03:00:00").orderBy("hour").collect()
    assert [tuple(r)[1:] for r in out] == [(1, 0, 2), (0, 1, 1), (1, 0, 2)]
    buckets = spark.createDataFrame([("a", 1.0, 90), ("a", 2.0, 6), ("a", None, 4), ("b", 1.0, 1), ("b", None, 9)], "g string, bound double, n int")
    assert {r["g"]: r["bound"] for r in jobs.histogram_quantile(buckets, "g", 0.95).collect()} == {"a": 2.0, "b": 1.0}


def test_heading_tree_and_outline(spark):
    rows = [(0, "heading", 1, "A"), (1, "paragraph", None, "a"), (2, "heading", 3, "B"), (3, "heading", 2, "C"), (4, "paragraph", None, "c"), (5, "heading", 1, "D"), (6, "heading", 3, "E")]
    df = spark.createDataFrame([(1, o, t, lv, 0, x) for o, t, lv, x in rows], pages.BLOCKS)
    assert {r["ord"]: r["parent"] for r in blocks.heading_tree(df).collect()} == {0: None, 1: 0, 2: 0, 3: 0, 4: 3, 5: None, 6: 5}
    assert blocks.first_heading(df).first()["title"] == "A"
    md = blocks.to_markdown(df).first()["markdown"]
    assert md.startswith("# A\n\na\n\n### B") and blocks.to_html(df).first()["html"].startswith("<article><h1>A</h1><p>a</p>")
    c = spark.createDataFrame([(1, 0, 1), (1, 1, 4)], "doc_id long, chunk int, last_ord int")
    assert {r["ord"]: r["chunk"] for r in blocks.outline(df.where("block_type = 'heading'"), c).collect()} == {0: 0, 2: 1, 3: 1, 5: None, 6: None}


def test_chrome(spark):
    lines = ["Home", "About us", "News", "A full sentence stands here.", "Home", "One more sentence stands right here.", "Accept cookies!", "a | b | c | d", "On 1/2/2024 and 3/4/2024 we met", "Skip to content!"]
    df = spark.createDataFrame([(1, i, "paragraph", None, i, x) for i, x in enumerate(lines)], pages.BLOCKS)
    assert sorted(r["ord"] for r in blocks.chrome_runs(df).collect()) == [0, 1, 2]
    got = {r["ord"]: r["role"] for r in blocks.roles(df).collect()}
    # a cookie banner is none of the fixed texts of chrome
    assert got[3] == got[4] == got[5] == got[6] == got[8] == "body" and got[0] == got[7] == got[9] == "boilerplate"


def test_html_parser(spark):
    html = "<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><nav><ul><li>Menu</li></ul></nav><h2>Head &amp; more</h2><p>One <b>bold</b><p>Two<br>Three<li>Item</body>"
    rows = pages.parse_html(spark.createDataFrame([(1, html), (2, None), (3, "plain")], "page_id long, html string")).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["block_type"], r["level"], r["text"]) for r in rows] == [(1, "header_footer", None, "Menu"), (1, "heading", 2, "Head & more"), (1, "paragraph", None, "One bold"), (1, "paragraph", None, "Two"), (1, "paragraph", None, "Three"), (1, "list_item", None, "Item"), (3, "paragraph", None, "plain")]
    probe = spark.createDataFrame([(b"%PDF-1.7", "a"), (b"PK\x03\x04", "x.docx"), (b"hi", "x.md"), (b"\xff\xfe\x00", "q"), (b"<!DOCTYPE html>", "q")], "c binary, n string")
    assert [r[0] for r in probe.select(pages.probe_format("c", "n")).collect()] == ["pdf", "docx", "md", "unknown", "html"]


def test_chunkers_lose_nothing(spark):
    rows = [(1, i, " ".join(f"w{i}x{j}" for j in range(n)), str(i // 4), i == 3) for i, n in enumerate([5, 40, 3, 90, 12, 30, 30, 2])]
    df = spark.createDataFrame(rows, "doc_id long, ord int, text string, section string, atomic boolean")
    for chunked, most in ((chunks.fixed_size(df, 32, 8), 32), (chunks.structure_aware(df, 32, 64, 6, 8), 64)):
        out = chunked.orderBy("chunk").collect()
        assert [r["chunk"] for r in out] == list(range(len(out)))
        have = " ".join(r["text"] for r in out).split()
        assert {w for r in rows for w in r[2].split()} == set(have)
        assert all(r["tokens"] <= most or "w3x" in r["text"] for r in out)
    with pytest.raises(ValueError):
        chunks.fixed_size(df, 8, 8)


def test_spans_against_plain_packing(spark):
    import random

    rng = random.Random(3)
    cases = [(k, [(rng.choice([0, 1, 5, 9, 30]), rng.randrange(3)) for _ in range(rng.randrange(1, 25))]) for k in range(60)]

    def plain(items, size, overlap):
        out, a = [], 0
        for i in range(1, len(items)):
            if items[i][1] != items[i - 1][1]:
                out, a = [*out, (a, i)], i
            elif sum(n for n, _ in items[a : i + 1]) > size:
                out.append((a, i))
                fits = [j for j in range(a + 1, i + 1) if sum(n for n, _ in items[j:i]) <= overlap]
                a = fits[0] if sum(n for n, _ in items[fits[0] : i + 1]) <= size else i
        return [*out, (a, len(items))]

    rows = []
    for k, items in cases:
        total = 0
        one = []
        for n, s in items:
            total += n
            one.append((n, total, s))
        rows.append((k, one))
    df = spark.createDataFrame(rows, "k int, items array<struct<tokens:int,upto:int,section:int>>")
    got = {r["k"]: [(x["a"], x["b"]) for x in r["s"]] for r in df.select("k", chunks.size_spans(F.col("items"), 20, 8, True).alias("s")).collect()}
    assert got == {k: plain(items, 20, 8) for k, items in cases}
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [(0, 1), (1, 2), (2, 3)]])
    one = spark.createDataFrame([(1, [(3, 3, 0), (10, 13, 0), (10, 23, 1)])], "k int, items array<struct<tokens:int,upto:int,section:int>>")
    assert [tuple(x) for x in one.select(chunks.join_small(F.col("items"), spans, 5, 15)).first()[0]] == [(0, 2), (2, 3)]


def test_provider_halves_failing_batches(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 5 else f"t{i}") for i in range(9)], "i int, t string").coalesce(1)
    got = {r["i"]: r["y"] for r in chunks.provide(df, "t", model, "y", 4).collect()}
    assert got[5] is None and got[4] == "T4" and len(got) == 9


def test_flow_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.1), (3, None, 0.0)], "id int, x string, s double")
    got = {r["id"]: (r["y"], r["y_step"]) for r in flow.fallback(df, [("one", F.col("x"), F.col("s")), ("two", F.when(F.col("id") != 3, "z"), None)], "y").collect()}
    assert got == {1: ("a", "one"), 2: ("z", "two"), 3: (None, None)}
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "node long, parent long")
    assert sorted(map(tuple, flow.ancestors(spark, nodes).select("node", "ancestor", "steps").collect())) == [(2, 1, 1), (3, 1, 2), (3, 2, 1)]
    bundle.export_bundle({"d": df}, str(tmp_path))
    assert bundle.import_bundle(spark, str(tmp_path), {"d": df.schema})["d"].count() == 3
    spark.createDataFrame([(9, "q", 1.0)], df.schema).write.mode("append").json(f"{tmp_path}/d.jsonl")
    with pytest.raises(ValueError):
        bundle.import_bundle(spark, str(tmp_path), {"d": df.schema})


def test_unknown_table(spark):
    with pytest.raises(ValueError):
        table(spark, "/nowhere", "nothing")


def test_evidence_coverage_of_every_source(spark, tmp_path):
    import re

    texts = ["the red fox ran over the hill", "red fox", "a hill far away", "The red fox ran", None, ""]
    docs = [(i, texts[i % len(texts)], f"src{i % 5}") for i in range(30)]
    items = [(1, "the red fox ran far"), (2, "the the the hill"), (3, "nothing known"), (4, "...")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    want = {}
    for i, t in items:
        shares = [sum(w in set(words(d)) for w in words(t)) / len(words(t)) if words(t) else 0 for _, d, _ in docs]
        want[i] = (sum(s >= 0.6 for s in shares), round(max(shares), 6))
    got = {r["item_id"]: (r["covering"], r["best"]) for r in plans.QUERIES["evidence_coverage_all"](spark, str(tmp_path)).collect()}
    assert got == want and want[1][0] == 10


def test_dense_search_of_every_hundredth_row(spark, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK", 64)  # several blocks of rows
    rng = np.random.RandomState(3)
    rows = [(i, [float(x) for x in rng.randn(8)], 0) for i in range(700)] + [(1000 + i, [1.0] * 8, 0) for i in range(30)] + [(2000, [0.0] * 8, 0), (2001, None, 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in plans.QUERIES["dense_search_all"](spark, str(tmp_path)).collect())
    known = {i: np.array(v) for i, v, _ in rows if v is not None and any(v)}
    want = []
    for q in (i for i in known if i % 100 == 0):
        like = lambda i, q=q: round(float(known[i] @ known[q] / np.sqrt(known[i] @ known[i]) / np.sqrt(known[q] @ known[q])), 6)
        want += [(q, n + 1, i, round(s, 5)) for n, (s, i) in enumerate(sorted(((like(i), i) for i in known), key=lambda x: (-x[0], x[1]))[:10])]
    assert got == sorted(want)
    assert {q for q, *_ in got} == {*range(0, 700, 100), 1000}


def test_contracts(spark):
    rows = [({"a": "1", "b": "x", "z": "?"},), ({"a": "no", "b": "Y"},), ({},), (None,)]
    df = spark.createDataFrame(rows, "m map<string,string>")
    got = [r[0] for r in df.select(schema.metadata_errors("m", ["a"], {"a": "int"}, {"b": ["x"]})).collect()]
    assert got[:3] == [["z is unknown"], ["a is no int", "b is none of its values"], ["a is required"]]
    old = spark.createDataFrame([("a", "int", True), ("b", "int", False), ("c", "int", False)], "field string, type string, searchable boolean")
    new = spark.createDataFrame([("a", "text", True), ("d", "int", False), ("e", "int", True)], "field string, type string, searchable boolean")
    renames = spark.createDataFrame([("b", "d")], "was string, field string")
    diff = schema.schema_diff(old, new, renames)
    values = spark.createDataFrame([("c",), ("c",), ("a",)], "field string")
    assert sorted(tuple(r) for r in schema.schema_effects(diff, values).fillna("-").collect()) == [("a", "modified", "-", "type", 0, True), ("c", "removed", "-", "", 2, False), ("d", "renamed", "b", "", 0, False), ("e", "added", "-", "", 0, True)]
    gate = schema.regression_gate(spark.createDataFrame([("x", 0.5), ("y", 0.2)], "metric string, value double"), spark.createDataFrame([("x", 0.55), ("y", 0.3), ("w", 1.0)], "metric string, value double"), ["x", "y", "w"])
    assert {r["metric"]: r["failed"] for r in gate.collect()} == {"x": False, "y": True, "w": True}


def test_page_selectors():
    assert assemble.page_numbers("5,7-9, 8", 9) == [5, 7, 8, 9]
    for bad in ("", "0", "3-2", "8-10", "a", "1-"):
        with pytest.raises(ValueError):
            assemble.page_numbers(bad, 9)


def test_grid_payload_and_points(spark):
    import uuid

    df = spark.createDataFrame([([["a", "b|c"], ["d\ne"]],), ([],), (None,)], "c array<array<string>>")
    assert [r[0] for r in df.select(assemble.markdown_grid("c")).collect()] == ["| a | b\\|c |\n| --- | --- |\n| d e |  |", None, None]
    page = '{"page": 2, "width": 10, "height": 20, "blocks": [{"label": "Title", "bbox": [5, 0, 1, 30], "text": "t"}, {"label": "text", "bbox": null, "text": null}, {"label": "?", "bbox": null, "text": "skipped"}]}'
    got = assemble.sidecar_blocks(spark.createDataFrame([(1, page), (2, None), (3, "{bad")], "k int, p string"), "k", "p").where("k = 1").orderBy("ord").collect()
    assert [(r["block_type"], [round(x, 6) for x in r["box"]]) for r in got] == [("heading", [0.1, 0.0, 0.5, 1.0]), ("paragraph", [0.0, 0.0, 1.0, 1.0])]
    names = ["a:1", "é", ""]
    ids = spark.createDataFrame([(n,) for n in names], "n string").select(assemble.point_id(str(uuid.NAMESPACE_URL), "n")).collect()
    assert [r[0] for r in ids] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_rerank_degrades_to_fusion_order(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1, 0.1), (1, 11, 0.8, 2, 0.7), (2, 10, 0.9, 1, None), (2, 11, 0.8, 2, 0.7)], "query_id int, doc_id int, score double, rank int, new double")
    got = [(r["query_id"], r["doc_id"], r["fusion_score"], r["score"]) for r in assemble.reranked(hits, F.col("new"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, 0.8, 0.7), (1, 10, 0.9, 0.1), (2, 10, 0.9, 0.9), (2, 11, 0.8, 0.8)]
    assert retrieval.score_kind(["dense"]) == "raw_dense" and retrieval.score_kind(["dense", "sparse"], "dbsf") == "dbsf_fusion"


def test_ancestors_of_long_chains_and_cycles(spark):
    nodes = [(i, i - 1 if i else None) for i in range(130)] + [(200, 201), (201, 202), (202, 200)]
    got = {(r["node"], r["ancestor"]): r["steps"] for r in flow.ancestors(spark, spark.createDataFrame(nodes, "node int, parent int")).collect()}
    assert {k: v for k, v in got.items() if k[0] < 200} == {(i, j): i - j for i in range(130) for j in range(i)}
    assert got[200, 202] == 2 and got[200, 200] == 3 and len(got) == 130 * 129 // 2 + 9
