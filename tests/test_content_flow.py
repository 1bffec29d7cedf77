"""Figures, parser answers, anchors, scopes, retrieval options, finalising and projecting hits."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from lodestone.operators import assemble, figures, retrieval
from lodestone.sources import sidecar

GRID = "array<array<string>>"


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", width, height) + b"rest"


def figure_blocks(spark):
    rows = [
        (1, 0, "figure", png(500, 400), [0.0, 0.0, 1.0, 0.9], None, "scan"), (1, 1, "figure", png(500, 47), [0.0, 0.0, 0.5, 0.1], "fr", "tiny"), (1, 2, "figure", png(48, 48), [0.6, 0.6, 0.1, 0.1], None, "chart"),
        (1, 3, "figure", b"JFIF", None, None, "none"), (1, 4, "figure", None, [0.0, 0.0, 1.0, 1.0], None, "no crop"), (1, 5, "paragraph", png(9, 9), [0.0, 0.0, 1.0, 1.0], None, "no figure"), (2, 0, "figure", png(2**31 + 5, 60), [0.0, 0.0, 3.0, 3.0], None, "huge"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, ord int, block_type string, crop binary, box array<double>, language string, name string")
    return df.withColumn("figure", F.when((F.col("block_type") == "figure") & (F.col("ord") != 3), F.struct(F.lit("old").alias("description"), F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast(GRID).alias("data"))))


def test_figures(spark):
    blocks = figure_blocks(spark)
    items = figures.figure_items(blocks, "en")
    got = {(r["doc_id"], r["ord"]): (round(r["coverage"], 6), r["language"]) for r in items.collect()}
    assert got == {(1, 0): (0.9, "en"), (1, 1): (0.05, "fr"), (1, 2): (0.25, "en"), (1, 3): (0.0, "en"), (2, 0): (1.0, "en")}
    size = {r[0]: r[1] for r in blocks.select("name", figures.png_size("crop")).collect()}
    assert tuple(size["huge"]) == (2**31 + 5, 60) and size["none"] is None and size["no crop"] is None
    asked = []

    def answer(rows):
        asked.append(sorted(r["ord"] for r in rows.collect()))
        return rows.withColumn("answer", F.when(F.col("ord") == 2, "It is a CHART, or a diagram"))

    kinds = figures.classify(items, answer)
    got = {(r["doc_id"], r["ord"]): (r["kind"], r["kind_score"]) for r in kinds.collect()}
    assert got == {(1, 0): ("scanned_text", 0.9), (1, 1): ("decorative", 0.9), (1, 2): ("chart", 1.0), (1, 3): ("photo", 0.3), (2, 0): ("scanned_text", 0.9)} and asked == [[2, 3]]
    assert {r["kind"]: r["family"] for r in figures.routed(kinds).collect()} == {"scanned_text": "ocr", "decorative": None, "chart": "vlm", "photo": "vlm"}
    found = figures.entries(kinds, lambda rows: rows.withColumn("ocr_text", F.lit("words")), lambda rows: rows.withColumns({"description": F.col("kind"), "data": F.lit(None).cast(GRID)}))
    out = {(r["doc_id"], r["ord"]): r for r in figures.apply_entries(blocks, found).collect()}
    assert out[1, 0]["figure"]["ocr_text"] == "words" and out[1, 0]["figure"]["description"] is None and out[1, 2]["figure"]["description"] == "chart"
    assert out[1, 1]["kind"] == "decorative" and out[1, 1]["figure"]["description"] is None  # a skipped one is emptied
    assert out[1, 3]["figure"] is None and out[1, 3]["kind"] is None and out[1, 4]["figure"]["description"] == "old" and len(out) == 7
    assert figures.classifier_prompt().count("\n- ") == 5


def test_parser_answers(spark):
    pages = [
        {"page_index": 3, "image_width": 100, "image_height": 200, "blocks": [
            {"label": " Title ", "text": "T", "bbox": [0, 0, 50, 100], "reading_order": 5}, {"label": "seal", "text": "skipped", "reading_order": 0}, {"label": "Section_Header", "text": "S", "reading_order": 6},
            {"label": "formula", "latex": "a^2", "text": "a2", "reading_order": 1}, {"label": "formula", "latex": "", "text": "b", "reading_order": 1}, {"label": "text", "text": ""}]},
        {"blocks": [{"label": "table", "html": "<table><tr><th>h</th><td>i</td></tr></table>", "text": "not used"}, {"label": "table", "html": None}, {"label": "table", "html": "<p>"}, {"label": "figure", "text": "x"}, {"label": "footer", "text": "p"}]},
    ]
    df = spark.createDataFrame([(1, json.dumps({"pages": pages})), (2, None), (3, "{bad"), (4, '{"pages": []}')], "id long, answer string")
    rows = sorted(sidecar.document_blocks(df, "id", "answer").collect(), key=lambda r: r["ord"])
    assert [(r["block_type"], r["level"], r["page"], r["text"]) for r in rows] == [
        ("paragraph", None, 3, None), ("formula", None, 3, "a^2"), ("formula", None, 3, "b"), ("heading", 1, 3, "T"), ("heading", 2, 3, "S"), ("table", None, 0, None), ("table", None, 0, None), ("table", None, 0, None), ("figure", None, 0, None), ("header_footer", None, 0, "p"),
    ]
    assert rows[3]["box"] == [0.0, 0.0, 0.5, 0.5] and rows[3]["block_id"] == "1:p3:b3" and rows[8]["figure"] is not None
    assert rows[5]["cells"] == [["h", "i"]] and rows[5]["has_header"] and rows[6]["cells"] is None and rows[6]["has_header"] is None and rows[7]["cells"] is None
    other = sidecar.Labels({"title": "heading"}, level=4)
    assert [(r["level"], r["ord"]) for r in sidecar.document_blocks(df, "id", "answer", other).collect()] == [(4, 0)]


def test_anchors(spark):
    docs = spark.createDataFrame([(1, "Declared"), (2, " "), (3, None), (4, None), (5, None)], "doc_id int, title string")
    chunks = spark.createDataFrame([(1, 0, ["P"]), (2, 1, ["Late"]), (2, 0, ["First", "Sub"]), (3, 0, []), (4, 0, [])], "doc_id int, chunk int, heading_path array<string>")
    heads = spark.createDataFrame([(1, "h1"), (3, "h3")], "doc_id int, title string")
    anchor = lambda **kw: {r["doc_id"]: r["anchor"] for r in assemble.document_anchors(docs, chunks, **kw).collect()}
    assert anchor(headings=heads) == {1: "Declared", 2: "First", 3: "h3", 4: None, 5: None}
    assert anchor() == {1: "Declared", 2: "First", 3: None, 4: None, 5: None} and anchor(fall_back=False) == {1: "Declared", 2: None, 3: None, 4: None, 5: None}


def test_scopes(spark):
    rows = [(1, 0, "a b", ["S"]), (1, 1, "c", []), (1, 2, "d", ["S"]), (1, 3, "e  f\ng", ["S", "T"]), (1, 4, "h", None), (2, 0, "z", ["S"])]
    df = spark.createDataFrame(rows, "doc_id int, chunk int, text string, heading_path array<string>")
    scope = lambda *a: {(r["doc_id"], r["chunk"]): r["scope"] for r in assemble.scoped(df, *a).collect()}
    assert scope("section", 1) == {(1, 0): "a b\n\nd", (1, 1): "a b\n\nc\n\nd", (1, 2): "a b\n\nd", (1, 3): "e  f\ng", (1, 4): "e  f\ng\n\nh", (2, 0): "z"}
    assert set(scope("full", 1, 100).values()) == {"a b\n\nc\n\nd\n\ne  f\ng\n\nh", "z"} and scope("full", 1, 3)[1, 2] == "a b c"
    assert scope("window", 1)[1, 0] == "a b\n\nc" and scope("window", 0, 2)[1, 3] == "e f"
    with pytest.raises(ValueError):
        assemble.scoped(df, "page")


def test_retrieval_options(spark):
    ranked = lambda rows: retrieval.ranked(spark.createDataFrame(rows, "query_id int, id int, score double"), "id")
    a, b = ranked([(0, 1, 9.0), (0, 2, 5.0), (0, 3, 1.0)]), ranked([(0, 3, 0.9), (0, 4, 0.1)])
    hits, kind = retrieval.retrieved({"dense": a}, "id", 2, "dbsf")
    assert kind == "raw_dense" and [(r["id"], r["score"]) for r in hits.orderBy("rank").collect()] == [(1, 9.0), (2, 5.0)]
    hits, kind = retrieval.retrieved({"dense": a, "sparse": b}, "id", 10)
    assert kind == "rrf_fusion" and {r["id"]: r["score"] for r in hits.collect()} == {1: 0.5, 2: round(1 / 3, 6), 3: 0.75, 4: round(1 / 3, 6)}
    assert retrieval.retrieved({"dense": a, "sparse": b}, "id", 10, "dbsf")[1] == "dbsf_fusion"
    with pytest.raises(ValueError):
        retrieval.retrieved({"dense": a, "sparse": b}, "id", 10, "sum")


def test_finalised_and_projected_hits(spark):
    rows = [(0, f"c{i}", f"d{i // 3}", 1.0 - i / 10, i + 1, {"a": "1", "b": str(i)}, "t") for i in range(9)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id string, document_id string, score double, rank long, metadata map<string,string>, text string")
    got = lambda **kw: [(r["chunk_id"], r["rank"]) for r in retrieval.finalized(hits, "document_id", 4, **kw).orderBy("rank").collect()]
    assert got() == [("c0", 1), ("c1", 2), ("c2", 3), ("c3", 4)]
    assert got(per_document=1) == [("c0", 1), ("c3", 2), ("c6", 3)] and got(per_document=1, least=0.65) == [("c0", 1), ("c3", 2)]
    assert got(least=0.85) == [("c0", 1), ("c1", 2)] and got(least=2.0) == []
    one = retrieval.projected(hits, ["metadata.b", "text"])
    assert one.columns == ["query_id", "chunk_id", "document_id", "metadata", "text"] and one.first()["metadata"] == {"b": "0"}
    assert retrieval.projected(hits, ["metadata", "metadata.b"]).first()["metadata"] == {"a": "1", "b": "0"}
    assert retrieval.projected(hits, None, withheld=("text", "chunk_id")).columns == ["query_id", "chunk_id", "document_id", "score", "rank", "metadata"]
    assert retrieval.projected(hits, []).columns == ["query_id", "chunk_id", "document_id"]
    with pytest.raises(ValueError, match="nope, x"):
        retrieval.projected(hits, ["x", "nope", "text"])


def test_corpora(spark, tmp_path):
    from lodestone.sources import corpora

    passage = "five words of real evidence"
    papers = [
        {"id": "a", "title": "T & <t>", "full_text": {"section_name": ["Intro", None, " "], "paragraphs": [["One 'x'.", " "], ["Two."], None]},
         "qas": {"question": [" Q1? ", "Q2?", "", "Q4?"], "answers": [{"answer": [{"unanswerable": False, "evidence": [passage, f" {passage} ", "too short", f"FLOAT SELECTED: {passage}"]}, {"unanswerable": True, "evidence": ["never used at all here"]}]}, {"answer": [{"unanswerable": True, "evidence": [passage]}]}, {"answer": [{"evidence": [passage]}]}, {"answer": []}]}},
        {"id": "b", "title": None, "full_text": None, "qas": {"question": ["Q?"], "answers": [{"answer": [{"unanswerable": False, "evidence": None}]}]}}, {"id": "c"},
    ]
    (tmp_path / "papers.jsonl").write_text("\n".join(map(json.dumps, papers)))
    rows = corpora.read(spark, str(tmp_path / "papers.jsonl"))
    html = {r["id"]: r["html"] for r in corpora.pages(rows).collect()}
    assert html["a"] == "<!doctype html><html><head><title>T &amp; &lt;t&gt;</title></head><body>\n<h1>T &amp; &lt;t&gt;</h1>\n<h2>Intro</h2>\n<p>One &#x27;x&#x27;.</p>\n<p>Two.</p>\n</body></html>" and set(html) == {"a", "b", "c"}
    assert [tuple(r) for r in corpora.questions(rows).collect()] == [("a", 0, "Q1?", [passage])]
    assert [r["id"] for r in corpora.answerable(rows).collect()] == ["a"]


def test_hints(spark):
    from lodestone.functions.text import surface
    from lodestone.operators import hints

    stored = spark.createDataFrame([("lang", "en", 5), ("lang", "eng", 1), ("city", "Paris", 3), ("city", "Parma", 2), ("city", "engi", 1)], "field string, value string, n long")
    asked = spark.createDataFrame([("city", "PARIS", False), ("city", "Pariss", False), ("lang", "engi", True), ("city", "xxxxxx", True)], "field string, value string, excluded boolean")
    got = {(r["field"], r["value"]): r for r in hints.unmatched(asked, stored).collect()}
    assert set(got) == {("city", "Pariss"), ("lang", "engi"), ("city", "xxxxxx")} and got["city", "Pariss"]["suggestions"] == ["Paris"] and got["lang", "engi"]["suggestions"] == ["eng"]
    assert got["lang", "engi"]["message"] == 'No document has lang = "engi", so this exclusion removes nothing. Closest stored values: eng.' and got["city", "xxxxxx"]["message"].endswith("No stored value of this field is close to it.")
    assert hints.zero_hits({"a": 1}, 3) == hints.zero_hits({}, 0) == hints.zero_hits({"a": 1}, 0, {"a"}) == []
    assert "only filter" in hints.zero_hits({"a": "é"}, 0)[0][1] and '"é"' in hints.zero_hits({"a": "é"}, 0)[0][1]
    both = hints.zero_hits({"a": {"gte": 1}, "b": "x"}, 0, verified={"a", "b"}, text_fields={"b"})
    assert [n for n, _ in both] == ["a", "b"] and 'a {"gte": 1}' in both[0][1] and "too narrow" in both[0][1] and "b matches text" in both[1][1]
    assert hints.termless("the of", ["x", "y"], surface)[1][0] == "y" and hints.termless("cats", ["x"], surface) == []
