"""Components, near duplicates, line dedup, neighbours and the pipeline against brute force."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import line_dedup, links, near_dup, neighbours


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (3, 3)], [(i, i + 1) for i in range(40)], [(100, i) for i in range(20)] + [(200, 201)], [(9, 1), (8, 1), (8, 7), (7, 30), (30, 2)]])
def test_components(spark, edges):
    got = {r["node"]: r["comp"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == components({x for e in real for x in e}, real)


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_near(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    edges = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)]
    return components({i for i, _ in sets}, edges)


def make_texts(seed=0):
    rng = np.random.RandomState(seed)
    word = lambda: "w" + str(rng.randint(0, 5000))
    shared = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):  # near copies with few to many edits
        t = list(base)
        for at in rng.randint(0, len(t), rng.randint(0, 9)):
            t[at] = word()
        rows.append(" ".join(t))
    for _ in range(40):  # a common passage among other words
        rows.append(" ".join([word() for _ in range(rng.randint(5, 60))] + shared + [word() for _ in range(10)]))
    rows += ["", None, " \n ", "one two", "one  TWO", "two one", rows[3], rows[3].upper()]
    ids = rng.permutation(len(rows)) * 3
    return [(int(i), t) for i, t in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    rows = make_texts()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, node int, key string, n int")
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(df, words, 80).collect()}
    want = brute_near(rows, words, 80)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingles(t, words)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_dup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(5, text), (5, text), (5, "other words stand here now"), (9, "other words stand here now"), (None, text), (7, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, None, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]


def test_bit_estimates():
    rng = np.random.RandomState(1)
    for share in (0.5, 0.8, 0.95):
        a = rng.randint(1, 1 << 62, 3000).astype(np.uint64)
        b = a.copy()
        m = int(3000 * (1 - share) / (1 + share))
        b[:m] = rng.randint(1, 1 << 62, m).astype(np.uint64)
        x, y = (near_dup.mix(near_dup.minima(np.unique(v))) & np.uint64(3) for v in (a, b))
        assert abs(((x == y).mean() - 0.25) / 0.75 - share) < near_dup._margin(80)


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def norm(line):
    return tuple(re.findall("[^\\s" + re.escape(line_dedup.MARKS) + "]+", line.lower()))


def brute_lines(rows):
    """Links by edit similarity alone."""
    rows = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0))
    occ = [(i, k, norm(line)) for i, t in rows for k, line in enumerate(t.split("\n")) if norm(line)]
    first = {}
    for n, (_, _, w) in enumerate(occ):
        first.setdefault(w, n)
    near = [(first[a], first[b]) for a, b in itertools.combinations(first, 2) if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) + 1e-9 and edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    comp = components(set(first.values()), near)
    gone = {(i, k) for n, (i, k, w) in enumerate(occ) if comp[first[w]] != n}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}, len(near)


def test_line_dedup(spark):
    rng = np.random.RandomState(4)
    long = [f"word{i}" for i in rng.randint(0, 900, 400)]
    lines = [" ".join(f"w{x}" for x in rng.randint(0, 500, rng.randint(1, 40))) for _ in range(30)]
    for at in (5, 100, 390):
        other = list(long)
        other[at] = "changed"
        lines.append(" ".join(other))
    lines += [" ".join(long), "Same line, here!", "same  LINE here", "", "  ", "..."]
    rows = [(i, "\n".join(lines[x] for x in rng.randint(0, len(lines), rng.randint(1, 12)))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "Same line, here!\nfresh line of a row without id")]
    want, n_near = brute_lines(rows)
    df = spark.createDataFrame([(i, t, 7, "g") for i, t in rows], "doc_id long, text string, n_lines int, __gone string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert n_near > 0 and {i: r["text"] for i, r in got.items()} == want | {100: None}
    assert got[100]["n_lines"] == 0 and got[101]["n_lines"] == 1 and len(got) == len(rows)
    assert line_dedup.dedup_lines(df.where("doc_id < 0")).count() == 0


def test_neighbours(spark):
    rng = np.random.RandomState(0)
    centres = rng.randn(20, 16) * 4
    v = [(i, [float(x) for x in centres[i % 20] + rng.randn(16)]) for i in range(3000)]
    v += [(3000 + i, v[7][1]) for i in range(400)]  # a very common vector
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] + [1.0] * 15), (5400, [1.0, 2.0]), (None, [1.0] * 16), (5500, [])]
    df = spark.createDataFrame([(i, x, 1) for i, x in v + odd], "vec_id long, embedding array<double>, part int")
    got = {}
    for r in neighbours.nearest(df, "vec_id % 100 = 0").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids, m = np.array([i for i, _ in v]), np.array([x for _, x in v])
    hit = 0
    assert sorted(got) == [i for i in range(0, 3400, 100)]
    for q, found in got.items():
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert sorted(found) == list(range(1, 11))
        assert all(abs(s - d[ids == i][0]) < 1e-12 for i, s in found.values())
        hit += len({int(ids[i]) for i in best} & {i for i, _ in found.values()})
    assert hit >= 0.9 * 10 * len(got)
    same = [i for i, s in got[3000].values() if s == 0]
    assert same == [7, *range(3001, 3010)]
    few = neighbours.nearest(df.where("vec_id < 5"), "vec_id % 100 = 0").collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4] and neighbours.nearest(df.where("vec_id < 0"), "vec_id % 100 = 0").count() == 0


def test_neighbours_of_repeated_rows(spark):
    """Thirty rows of one vec_id near the query take one place only."""
    rng = np.random.RandomState(1)
    v = [(i, [float(x) for x in rng.randn(8)]) for i in range(40)]
    rows = v + [(7, v[0][1])] * 30 + v[:20]
    got = {r["rank"]: r["vec_id"] for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0").collect()}
    m = np.array([x for _, x in v])
    d = np.sqrt(((m - m[0]) ** 2).sum(axis=1))
    d[7], d[0] = 0, np.inf
    assert [got[i] for i in range(1, 11)] == list(np.lexsort((np.arange(40), d))[:10])


def test_pipeline(spark, tmp_path):
    text = " ".join(f"x{i}" for i in range(40))
    near = text.replace("x20 ", "y20 ")
    rows = [(1, text), (2, near + "\nanother line of words here"), (3, "clean page\nwrite to a@b.cd today"), (4, None), (5, "grub grub you grub")]
    rows += [(100 + i, f"a clean page number{i} of its own{i}") for i in range(30)] + [(200 + i, f"this grub{i} page has grub in it{i}") for i in range(30)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(100 + i, 1, 0) for i in range(30)] + [(200 + i, 1, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 5 not in kept["toxicity"] and not any(200 <= i < 230 for i in kept["toxicity"]) and all(100 + i in kept["toxicity"] for i in range(30))
    assert 3 in kept["near_dedup"] and "<EMAIL>" in kept["pii"][3] and kept["pii"][4] is None
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == set(kept["pii"])
    empty = df.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_line_dedup_links_all_lines_at_the_similarity(spark):
    """Planted edits in lines of 4 to 100 words, against edit similarity alone: recall 1."""
    rng = np.random.RandomState(11)
    word = lambda: f"w{rng.randint(0, 3000)}"
    lines = []
    for n in (4, 5, 6, 8, 9, 10, 14, 16, 17, 20, 30, 50, 100):
        for share in (0.0, 0.5, 1.0):
            base = [word() for _ in range(n)]
            other = list(base)
            for _ in range(max(1, int(0.2 * n * share + 1e-9))):
                at, kind = rng.randint(0, len(other)), rng.randint(0, 3)
                other[at : at + (kind != 1)] = [] if kind == 2 and len(other) > 1 else [word()]
            lines += [base, other]
    repeated = ["of"] * 10
    lines += [repeated, ["of"] * 4 + ["x1"] + ["of"] * 3 + ["x2", "of"], ["a1", "b1"] * 5, ["a1", "b1"] * 4 + ["b1", "a1"], ["b1", "a1"] * 5]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    near = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(lines), 2) if edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    comp = components(range(len(lines)), near)
    gone = {r["doc_id"] for r in line_dedup.duplicate_lines(df).collect()}
    assert len(near) > 30
    assert gone == {i for i, c in comp.items() if c != i}


def test_blocks_of_edited_lines_meet(spark):
    """With a fifth of its words edited, at random, a line of up to 23 words always shares a block with the original, a longer one in 97 % of cases at least."""
    from pyspark.sql import functions as F

    rng = np.random.RandomState(5)
    rows = []
    for n in [*range(4, 24), *[24, 30, 40, 60, 100, 200] * 60]:
        base = [f"w{'x' * rng.randint(0, 6)}{x}" for x in rng.randint(0, 3000, n)]
        other = list(base)
        for at in rng.permutation(n)[: int(0.2 * n + 1e-9)]:
            other[at] = f"unseen{at}"
        rows.append((n, base, other))
    df = spark.createDataFrame(rows, "n int, a array<string>, b array<string>")
    meet = F.arrays_overlap(line_dedup.blocks_of(F.col("a"), 0.8), line_dedup.blocks_of(F.col("b"), 0.8))
    got = [(r["n"], r["meet"]) for r in df.select("n", meet.alias("meet")).collect()]
    assert all(m for n, m in got if n < 24)
    long = [m for n, m in got if n >= 24]
    assert sum(long) >= 0.97 * len(long)


def test_line_dedup_of_repeated_ids(spark):
    """Rows of one doc_id with other texts keep their own lines; rows without doc_id are like others."""
    rows = [(1, "alpha beta\nonly here"), (1, "other text\nalpha beta"), (None, "first of all lines stands here with no id\nx y"), (2, "first of all lines stands there with no id")]
    got = sorted(r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(x for t in got for x in t.split("\n") if x) == ["alpha beta", "first of all lines stands here with no id", "only here", "other text", "x y"]
