"""Tables, captions, sections, passages and their chunks against plain sequential versions."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import chunks, linear, passages, tables

BLOCK = "doc_id long, ord int, block_type string, level int, page int, text string, cells array<array<string>>, has_header boolean, figure struct<description:string,ocr_text:string,data:array<array<string>>>"
norm = lambda t: " ".join((t or "").lower().split())


def blocks(spark, rows):
    """rows: (doc_id, ord, block_type, level, page, text) and maybe cells, has_header, figure."""
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], BLOCK)


# tables -------------------------------------------------------------------------------------------------------------------------


def plain_grid(rows, most=200_000):
    taken = {}
    height = width = 0
    for r, row in enumerate(rows):
        height, width = max(height, r + 1), max(width, 1)
        c = 0
        for text, down, right in row:
            while (r, c) in taken:
                c += 1
            if (r + down) * (c + right) > most:
                return None
            for y in range(r, r + down):
                for x in range(c, c + right):
                    taken.setdefault((y, x), text if (y, x) == (r, c) else "")
            height, width = max(height, r + down), max(width, c + right)
            c += right
    return [[taken.get((y, x), "") for x in range(width)] for y in range(height)] if height else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 4), st.integers(1, 4)), max_size=5), max_size=6))
def test_grid(rows):
    assert tables.grid(rows) == plain_grid(rows)


def test_grid_is_bounded():
    assert tables.grid([[("x", 10**9, 1)]]) is None and tables.grid([[("x", 1, 10**9)]]) is None
    assert tables.grid([[("x", 400, 500)]]) is not None and tables.grid([[("x", 400, 501)]]) is None
    assert tables.grid([[("a", 300, 1)], [("b", 1, 900)]]) is not None


def test_page_tables(spark):
    html = {
        1: "<table><tr><th>a<td rowspan=2>b|<tr><td>c</table>",
        2: "no table",
        3: "<table><tr><td>x<table><tr><td>in</td></tr></table> y</td></tr></table><table><tr><td colspan='z'>1\n 2</td></tr><tr></tr></table>",
        4: None,
        5: "<table></table><td>stray</td>",
        6: "<table><tr><td>open",
        7: "<table><tr><td rowspan=200001>x</td></tr></table><table><tr><td>&lt;ok&gt;</td></tr></table>",
    }
    df = spark.createDataFrame(list(html.items()), "page_id long, html string")
    got = {(r["page_id"], r["table"]): (r["has_header"], r["cells"]) for r in tables.page_tables(df).collect()}
    assert got == {
        (1, 0): (True, [["a", "b|"], ["c", ""]]), (3, 0): (False, [["xin y"]]), (3, 1): (False, [["1 2"], [""]]), (6, 0): (False, [["open"]]), (7, 0): (False, [["<ok>"]]),
    }
    one = tables.page_tables(df.where("page_id = 1")).select(tables.markdown("cells").alias("m"), tables.markdown("cells", False).alias("n"), tables.html("cells").alias("h")).collect()[0]
    assert one["m"] == "| a | b\\| |\n| --- | --- |\n| c |  |" and one["n"] == "| a | b\\| |\n| c |  |"
    assert one["h"] == "<table><thead><tr><th>a</th><th>b|</th></tr></thead><tbody><tr><td>c</td><td></td></tr></tbody></table>"
    assert tables.page_tables(df.limit(0)).count() == 0


# captions and sections ----------------------------------------------------------------------------------------------------------


def plain_captions(kinds, texts):
    owner = {}
    for i, (k, t) in enumerate(zip(kinds, texts, strict=True)):
        if k == "caption" and t.strip():
            for j in (i + 1, i - 1):
                if 0 <= j < len(kinds) and kinds[j] in ("figure", "table") and j not in owner:
                    owner[j] = i
                    break
    return owner


def plain_sections(rows):
    """Keys of the open headings of each block."""
    open_, out = [], []
    for _, i, kind, level, *_ in rows:
        if kind == "heading":
            open_ = [(n, j) for n, j in open_ if n < (level or 1)] + [(level or 1, i)]
        out.append([j for _, j in open_])
    return out


def some_blocks(seed, doc, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice("heading paragraph paragraph caption table figure list_item".split())
        text = rng.choice(["", " ", "Alpha one two. Beta three.", "A title", "Sommaire", "gamma delta epsilon words here that are more than four", f"Unique {i} text. More of it follows, and 7 words. End."])
        text = text if kind != "heading" else rng.choice(["A title", f"Head {i}", "Sommaire", "Other"])
        cells = [["a", str(i)], ["b"]] if kind == "table" and rng.random() < 0.8 else None
        figure = (rng.choice([None, f"shows {i}"]), rng.choice([None, "read"]), rng.choice([None, [["k", "v"]]])) if kind == "figure" and rng.random() < 0.8 else None
        out.append((doc, i, kind, rng.choice([None, 1, 2, 3]) if kind == "heading" else None, i // 12, None if kind in ("table", "figure") else text, cells, True if cells else None, figure))
    return out


def test_captions_and_sections(spark):
    docs = [some_blocks(s, s) for s in range(30)]
    docs.append([(99, i, k, None, 0, t) for i, (k, t) in enumerate(zip("caption table caption table caption caption figure caption".split(), "abcdef g h".split(" ") + ["i"], strict=False))])
    df = blocks(spark, [r for d in docs for r in d])
    got = {}
    for r in passages.with_captions(passages.with_sections(df)).collect():
        got[r["doc_id"], r["ord"]] = r
    for rows in docs:
        owner = plain_captions([r[2] for r in rows], [r[5] or "" for r in rows])
        for r, key in zip(rows, plain_sections(rows), strict=True):
            g = got[r[0], r[1]]
            assert g["section_key"] == key and g["heading_path"] == [rows[j][5] for j in key]
            assert g["caption_ord"] == owner.get(r[1]) and g["consumed"] == (r[1] in owner.values())


def plain_figure(f, caption, text):
    head = " ".join(x.strip() for x in (caption, text) if x and x.strip())
    out = [head] if head else []
    out += [f[0]] if f[0] else []
    out += [f"[OCR] {f[1]}"] if f[1] else []
    return "\n".join(out + (["[Data]", "| k | v |\n| --- | --- |"] if f[2] else [])) or None


def plain_passages(rows):
    owner, sections, out = plain_captions([r[2] for r in rows], [r[5] or "" for r in rows]), plain_sections(rows), []
    for r, key in zip(rows, sections, strict=True):
        if r[1] in owner.values():
            continue
        caption = rows[owner[r[1]]][5].strip() if r[1] in owner else None
        said = None
        if r[2] == "table":
            said = "\n".join(filter(None, (caption, f"| a | {r[1]} |\n| --- | --- |\n| b |  |"))) if r[6] else None
        elif r[2] == "figure":
            said = plain_figure(r[8], caption, r[5]) if r[8] else None
        text = said if r[2] in ("table", "figure") else (r[5] or "").strip() or None
        if text is None and caption:
            text = caption
        if text is None:
            continue
        own = sorted({r[1], owner.get(r[1], r[1])})
        toc = any(rows[j][5].strip().lower() in ("contents", "table of contents", "toc", "sommaire", "table des matières", "índice") for j in key)
        out.append({"ord": r[1], "text": text, "block_ords": own, "section_key": key, "heading_path": [rows[j][5] for j in key], "atomic": said is not None, "toc": toc, "heading_only": r[2] == "heading", "pages": (min(rows[j][4] for j in own), max(rows[j][4] for j in own))})
    return out


def test_passages(spark):
    docs = [some_blocks(s + 100, s) for s in range(25)]
    rows = passages.passages(blocks(spark, [r for d in docs for r in d])).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        got.setdefault(r["doc_id"], []).append(r)
    for d in docs:
        want = plain_passages(d)
        assert [r["ord"] for r in got[d[0][0]]] == [w["ord"] for w in want]
        for r, w in zip(got[d[0][0]], want, strict=True):
            assert all(r[k] == w[k] for k in ("text", "block_ords", "section_key", "heading_path", "atomic", "heading_only"))
            assert (r["page_start"], r["page_end"]) == w["pages"] and (r["role"] == "toc") == w["toc"]
    only = passages.passages(blocks(spark, docs[0]), keep_tables=False, keep_figures=False)
    assert only.where("atomic").count() == 0 and passages.passages(blocks(spark, [])).count() == 0


def test_roles(spark):
    rows = [(1, 0, "heading", 1, 0, "Search"), (1, 1, "paragraph", None, 0, "Search"), (1, 2, "heading", 1, 0, "Sommaire"), (1, 3, "paragraph", None, 0, "one long enough line of text here"), (1, 4, "heading", 1, 0, "Real")]
    rows += [(1, 5 + i, "paragraph", None, i, "Same  line of several words") for i in range(3)] + [(1, 8 + i, "list_item", None, 4, t) for i, t in enumerate("Home|About us|Log in".split("|"))]
    rows += [(1, 11, "heading", 1, 4, "Short"), (1, 12, "paragraph", None, 4, "Lone label"), (1, 13, "header_footer", None, 4, "Page 4"), (1, 14, "paragraph", None, 4, "A · B · C · D"), (1, 15, "paragraph", None, 4, "Rechercher une application"), (1, 16, "paragraph", None, 5, "No results.")]
    got = {r["ord"]: r["role"] for r in passages.passages(blocks(spark, rows)).collect()}
    want = dict.fromkeys(range(17), "body") | {1: "boilerplate", 2: "toc", 3: "toc"} | dict.fromkeys((5, 6, 7, 8, 9, 10, 14, 15, 16), "boilerplate") | {13: "header_footer"}
    assert got == want


def plain_absorb(rows):
    owned = {k for p in rows if not p["heading_only"] for k in p["section_key"]}
    kept, pending, carried = [], None, []
    for p in rows:
        if p["heading_only"]:
            if p["section_key"][-1] in owned:
                carried += p["block_ords"]
            elif pending is None:
                pending = [p["text"], list(p["block_ords"]), p["ord"]]
            elif norm(pending[0]) != norm(p["text"]):
                pending = [pending[0] + "\n" + p["text"], pending[1] + p["block_ords"], pending[2]]
            continue
        text, ids = p["text"], list(p["block_ords"])
        if pending:
            text = text if norm(pending[0]) == norm(text.split("\n")[0]) else pending[0] + "\n\n" + text
            ids = pending[1] + ids
        kept.append([text, carried + ids])
        pending, carried = None, []
    if pending and kept:
        kept[-1] = [kept[-1][0] + "\n\n" + pending[0], kept[-1][1] + pending[1]]
    elif pending:
        kept.append(pending[:2])
    if carried and kept:
        kept[-1][1] = carried + kept[-1][1]
    return [tuple(map(str, k)) for k in kept]


def test_absorbed_headings(spark):
    rng, rows = random.Random(4), []
    for doc in range(40):
        for i in range(rng.randrange(1, 14)):
            head = rng.random() < (1 if doc % 5 == 0 else 0.6)
            rows.append((doc, i, "heading" if head else "paragraph", rng.choice([1, 2, 3]) if head else None, 0, rng.choice(["Same", "same", "Other one", f"T{i}"]) if head else rng.choice(["Same", f"long body text number {i} with words"])))
    p = passages.passages(blocks(spark, rows)).where("role = 'body'")
    plain, got = {}, {}
    for r in sorted(p.collect(), key=lambda r: (r["doc_id"], r["ord"])):
        plain.setdefault(r["doc_id"], []).append(r.asDict())
    for r in sorted(passages.absorb_headings(p).collect(), key=lambda r: (r["doc_id"], r["ord"])):
        got.setdefault(r["doc_id"], []).append((r["text"], str(r["block_ords"])))
    assert got == {d: plain_absorb(x) for d, x in plain.items()}


# chunks -------------------------------------------------------------------------------------------------------------------------

count = lambda t: len(re.findall(r"[^\W_]+|[^\w\s]|_", t))


def plain_section_groups(items, target, most, least, overlap, hard=True):
    groups, cur = [], []
    size = lambda g: sum(x["tokens"] for x in g)

    def close(seed):
        nonlocal cur
        if cur:
            groups.append(cur)
            tail = []
            for x in reversed(cur if seed and overlap else []):
                if size(tail) + x["tokens"] > overlap:
                    break
                tail.insert(0, x)
            cur = tail

    for x in items:
        if cur and x["section_key"] != cur[-1]["section_key"] and (hard or size(cur) >= least):
            close(False)
        if x["tokens"] > target:
            close(False)
            groups.append([x])
            continue
        if cur and size(cur) + x["tokens"] > target:
            close(True)
        cur.append(x)
    close(False)
    out, kind, under, running = [], None, [], 0
    for g in groups:
        tiny, titled, parent = size(g) < least, any(h.strip() for x in g for h in x["heading_path"]), g[0]["section_key"][:-1]
        own = "fragment" if tiny and not titled else "sibling" if tiny and parent else None
        if out and own and own == kind and (own == "fragment" or parent == under) and running + size(g) <= min(target, most):
            out[-1] += [x for x in g if x not in out[-1]]
            running += size(g)
            continue
        out.append(list(g))
        kind, under, running = own, parent, size(g)
    return out


def plain_text(group):
    keys = [x["section_key"] for x in group]
    depth = next((n for n in range(len(keys[0]), 0, -1) if all(k[:n] == keys[0][:n] for k in keys)), 0)
    parts, last = [], None
    for x in group:
        label = " › ".join(h for h in x["heading_path"][depth:] if h.strip())
        parts += [label, x["text"]] if x["section_key"] != last and label else [x["text"]]
        last = x["section_key"]
    return "\n\n".join(parts), group[0]["heading_path"][:depth]


@pytest.mark.parametrize(("target", "most", "least", "overlap", "hard"), [(40, 80, 12, 12, True), (40, 60, 30, 0, False), (25, 25, 10, 24, True)])
def test_section_chunks(spark, target, most, least, overlap, hard):
    p = passages.passages(blocks(spark, [r for s in range(12) for r in some_blocks(s + 300, s)])).where("role IN ('body', 'toc')")
    pieces, got, furniture = {}, {}, set()
    for r in sorted(chunks.explode_oversize(passages.absorb_headings(p), most).collect(), key=lambda r: (r["doc_id"], r["ord"], r["piece"])):
        pieces.setdefault(r["doc_id"], []).append(r.asDict())
    for r in sorted(chunks.by_section(p, target, most, least, overlap, hard).collect(), key=lambda r: (r["doc_id"], r["chunk"])):
        assert r["chunk_id"] == f"{r['doc_id']}#c{r['chunk']}"
        if r["role"] == "body":
            got.setdefault(r["doc_id"], []).append((r["text"], r["heading_path"], sorted(r["block_ords"])))
        else:
            furniture.add((r["doc_id"], r["role"], r["page_start"]))
    want = {d: [(*plain_text(g), sorted({b for x in g for b in x["block_ords"]})) for g in plain_section_groups(x, target, most, least, overlap, hard)] for d, x in pieces.items()}
    assert got == want
    assert furniture == {(r["doc_id"], r["role"], r["page_start"]) for r in p.where("role <> 'body'").collect()}


def plain_semantic(units, buffer, quantile, least, most):
    if len(units) <= 2:
        return [units] if units else []
    vectors = []
    for i in range(len(units)):
        v = np.zeros(256)
        for w in " ".join(u["text"] for u in units[max(0, i - buffer) : i + buffer + 1]).lower().split():
            v[zlib.crc32(w.encode()) % 256] += 1
        vectors.append(v)
    norms = [np.sqrt(v @ v) for v in vectors]
    d = [1 - vectors[i] @ vectors[i + 1] / (norms[i] * norms[i + 1]) for i in range(len(units) - 1)]
    high = np.quantile(d, quantile) + 1e-9
    groups = [[]]
    for i, u in enumerate(units):
        groups[-1].append(u)
        if i < len(d) and d[i] > high:
            groups.append([])
    merged = []
    for g in groups:
        if merged and sum(u["tokens"] for u in g) < least:
            merged[-1] += g
        else:
            merged.append(g)
    out = []
    for g in merged:
        cur = []
        for u in g:
            if cur and sum(x["tokens"] for x in cur) + u["tokens"] > most:
                out.append(cur)
                cur = []
            cur.append(u)
        out.append(cur)
    return out


def test_semantic_chunks(spark):
    rng = random.Random(8)
    subjects = [[f"{s}{i}" for i in range(9)] for s in ("tree", "ship", "coin")]
    rows = []
    for doc in range(12):
        text = ". ".join(" ".join(rng.choices(subjects[(i // 5) % 3], k=rng.randrange(2, 9))).capitalize() for i in range(1 + doc * 2))
        rows.append((doc, 0, "paragraph", None, 0, text + "."))
    p = passages.passages(blocks(spark, rows))
    units, got = {}, {}
    for r in sorted(chunks.explode_oversize(passages.absorb_headings(p), 30, whole=False).collect(), key=lambda r: (r["doc_id"], r["ord"], r["piece"])):
        units.setdefault(r["doc_id"], []).append(r.asDict())
    for r in sorted(chunks.semantic(p, quantile=0.8, least=6, most=30).collect(), key=lambda r: (r["doc_id"], r["chunk"])):
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {d: ["\n\n".join(u["text"] for u in g) for g in plain_semantic(x, 1, 0.8, 6, 30)] for d, x in units.items()}
    assert len(got[0]) == 1 and any(len(g) > 2 for g in got.values())
    assert all(count(t) > 0 for g in got.values() for t in g)


def test_linear_forms(spark):
    rows = [
        (1, 0, "heading", 9, 0, " Top <1> "), (1, 1, "list_item", None, 0, "a"), (1, 2, "list_item", None, 0, " "), (1, 3, "list_item", None, 0, "b"), (1, 4, "header_footer", None, 0, "p 1"),
        (1, 5, "list_item", None, 0, "c"), (1, 6, "caption", None, 0, "Fig"), (1, 7, "figure", None, 0, None, None, None, ("what", "read", [["x"]])), (1, 8, "code", None, 0, "f(x)\n  y"), (1, 9, "formula", None, 0, "a=b"),
        (1, 10, "table", None, 0, None, [["h", "i"], ["j"]], True, None), (1, 11, "caption", None, 0, "Tab & le"), (1, 12, "caption", None, 0, "alone"), (1, 13, "figure", None, 0, None, None, None, (None, None, None)), (2, 0, "paragraph", None, 0, " "),
    ]
    md = {r["doc_id"]: r["markdown"] for r in linear.to_markdown(blocks(spark, rows)).collect()}
    assert md == {1: "###### Top <1>\n\n- a\n- b\n- c\n\n*Fig*\n\nwhat\n\nread\n\n| x |\n| --- |\n\n```\nf(x)\n  y\n```\n\n$$\na=b\n$$\n\n*Tab & le*\n| h | i |\n| --- | --- |\n| j |  |\n\n*alone*"}
    html = {r["doc_id"]: r["html"] for r in linear.to_html(blocks(spark, rows)).collect()}
    assert html[1].split("\n")[:3] == ["<h6>Top &lt;1&gt;</h6>", "<ul><li>a</li><li>b</li><li>c</li></ul>", "<figure><p>what</p><p>read</p><table><thead><tr><th>x</th></tr></thead><tbody></tbody></table><figcaption>Fig</figcaption></figure>"]
    assert html[1].split("\n")[-1] == "<figure><figcaption>alone</figcaption></figure>" and "<table><caption>Tab &amp; le</caption><thead>" in html[1]
