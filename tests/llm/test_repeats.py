"""Filter audit, periodic runs and substring dedup against brute-force versions."""

import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import entries, filter_audit, licenses, period_runs, substring_dedup

SF = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


# filter audit -------------------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    first, fails = {}, []
    for d in docs:
        if d["doc_id"] is not None:
            first[d["text"] or ""] = min(first.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    good = {x["doc_id"] for x in labels if x["quality"] == 1}
    toxic = {x["doc_id"] for x in labels if x["toxic"] == 1}
    for d in docs:
        t, w = d["text"] or "", split(d["text"])
        f = {x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), d["doc_id"] is not None and d["doc_id"] > first[t])) if bad}
        fails.append((d["lang"] or "", f, d["doc_id"] in good, d["doc_id"] in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone, stay = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                out[part, "".join(order), k + 1] = [len(stay), len(gone), sum(x in d[1] for d in own) - len(gone), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[x] += len(gone)
                left = stay
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


AUDIT = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in AUDIT] for r in df.collect()}


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "A b", long, long, long + " $", "x " * 250, "ÉA" * 5, long.upper(), "a\x0bb c | d", "", long]
    docs = [{"doc_id": i, "text": t, "lang": ("en", None, "")[i % 3]} for i, t in enumerate(texts)]
    docs += [{"doc_id": 3, "text": long, "lang": "fr"}, {"doc_id": None, "text": long, "lang": "fr"}, {"doc_id": 4, "text": long, "lang": "en"}]
    labels = [{"doc_id": i, "quality": i % 2, "toxic": (i // 2) % 2} for i in range(9)] + [{"doc_id": 2, "quality": 1, "toxic": None}, {"doc_id": None, "quality": 1, "toxic": 1}]
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], "z") for d in docs], "doc_id long, text string, lang string, part string")
    lf = spark.createDataFrame([tuple(x.values()) for x in labels], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, lf)
    assert audited(got) == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), lf.limit(0)).count() == 0


def test_audit_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_A_RUN", 3)
    docs = [{"doc_id": i, "text": "X" * (i % 4), "lang": f"l{i % 8}"} for i in range(40)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, text string, lang string")
    lf = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert audited(filter_audit.audit(df, lf)) == plain_audit(docs, [{"doc_id": 1, "quality": 1, "toxic": 1}])


@given_tables
def test_op11(spark):
    got = audited(entries.QUERIES["op11_filter_audit"](spark, SF))
    assert got == plain_audit(documents(), pq.read_table(f"{SF}/labels.parquet").to_pylist())


# periodic runs ------------------------------------------------------------------------------------------------------------------


def plain_runs(words):
    """Every stretch equal to itself q words on, by trying every q; of one stretch the smallest q counts."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in out.items())


def found(x):
    return [(int(s), int(q), int(n)) for s, n, q in period_runs.runs(np.array(x, np.int64))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 4)), max_size=5))
def test_runs_of_repeated_pieces(pieces):
    x = [w for piece, n in pieces for w in piece * n]
    assert found(x) == plain_runs(x)


@pytest.mark.parametrize("x", [[0] * 500, ([0, 1] * 60 + [0]) * 2, ([0] * 50 + [1]) * 6, [i % 97 for i in range(300)], list(range(300)), ([0, 1, 2] * 30 + [3]) * 4 + [9] + ([0, 1, 2] * 30 + [3]) * 3])
def test_runs_of_regular_sequences(x):
    assert found(x) == plain_runs(x)


def test_runs_of_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert found(b) == plain_runs(b)


def test_runs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(period_runs, "BATCH", 50)
    texts = [None, "", "  ", "a " * 30, "a b " * 6, "a b " * 5, "x\x0by " * 9 + " ", "same line here now. " * 40, "same line here now. " * 40]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "q r s " * 5, 1)], "doc_id long, text string, runs int")
    got = {r["doc_id"]: r for r in period_runs.find_runs(df).collect()}
    for i, t in [*enumerate(texts), (None, "q r s " * 5)]:
        w, want = split(t), plain_runs(split(t))
        assert [(r["start"], r["period"], r["length"]) for r in got[i]["runs"]] == want and got[i]["n_words"] == len(w)
        gone = {k for s, q, n in want for k in range(s + q, s + n)}
        assert got[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert period_runs.find_runs(df.limit(0)).count() == 0


@given_tables
def test_op12(spark):
    got = {r["doc_id"]: r for r in entries.QUERIES["op12_period_runs"](spark, SF).collect()}
    planted = 0
    for d in documents():
        w, h = split(d["text"]), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if len(w) > 1500 and h % 10:
            continue  # the plain version takes n * n steps
        runs = plain_runs(w)
        gone = {k for s, q, n in runs for k in range(s + q, s + n)}
        best = min(((-n, s, q) for s, q, n in runs), default=None)
        want = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
        r = got[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted


# substring dedup ----------------------------------------------------------------------------------------------------------------


def plain_dedup(docs, window=20):
    """(doc_id, words, kept words) of every row: windows in order of (doc_id, start)."""
    first, rows = {}, [(i, split(t)) for i, t in docs]
    for i, w in rows:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < (i, k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def deduped(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, place int")
    return sorted((tuple(r) for r in substring_dedup.dedup_substrings(df, **kw).collect()), key=repr)


def passages(seed, n):
    rng = np.random.RandomState(seed)
    pool = [rng.randint(0, 40 if j % 3 else 3, rng.randint(5, 90)).tolist() for j in range(12)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            p = list(pool[rng.randint(len(pool))]) if rng.rand() < 0.7 else rng.randint(0, 500, rng.randint(1, 60)).tolist()
            if p and rng.rand() < 0.4:
                p[rng.randint(len(p))] = 999
            w += p
        out.append(" ".join(map(str, w)))
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
@pytest.mark.parametrize("shard", [1_000_000, 60])
def test_dedup_of_passages(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    docs = list(enumerate(passages(3, 120)))
    assert deduped(spark, docs) == plain_dedup(docs)


def test_dedup_of_odd_rows(spark):
    long = " ".join(f"w{i % 37}" for i in range(120))
    docs = [(5, long), (2, long + " end"), (None, long), (7, None), (8, ""), (9, "a b c"), (5, long), (5, "x " + long), (1, "z " * 200), (3, long.upper()), (4, "y\x0b" * 19), (6, "y\n" * 21), (-3, "y\t" * 20)]
    assert deduped(spark, docs) == plain_dedup(docs)
    assert deduped(spark, []) == []


def test_index_finds_what_stands_in_it():
    rng = np.random.RandomState(0)
    text = np.concatenate((rng.randint(1, 4, 400), [0]))
    marks = np.arange(len(text))
    index = substring_dedup.FMIndex(text, marks, 6)
    asked = np.concatenate((text[100:160], rng.randint(1, 6, 200), text[5:90]))
    got = index.stream(asked, np.array([0, 50]), np.array([50, len(asked) - 50]))
    places = {}
    for i in range(len(text) - 5):
        places.setdefault(tuple(text[i : i + 6]), i)
    for i in range(len(asked)):
        whole = i + 6 <= (50 if i < 50 else len(asked))
        assert got[i] == (places.get(tuple(asked[i : i + 6]), -1) if whole else -1)


@given_tables
def test_op13(spark):
    got = sorted((tuple(r) for r in entries.QUERIES["op13_substring_dedup"](spark, SF).collect()), key=repr)
    want = plain_dedup([(d["doc_id"], d["text"]) for d in documents()])
    assert got == sorted(((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in want), key=repr)
    assert sum(r[2] for r in got)


# licence spans ------------------------------------------------------------------------------------------------------------------


def plain_anchors(text, templates, least):
    out = []
    for t, template in enumerate(templates):
        for i in range(len(text)):
            for e in range(len(template)):
                k = 0
                while k <= min(i, e) and text[i - k] == template[e - k]:
                    k += 1
                grows = i + 1 < len(text) and e + 1 < len(template) and text[i + 1] == template[e + 1]
                if k >= least and not grows:
                    out.append((t, e, i, k))
    return sorted(out)


def plain_best(anchors, gap):
    """The most words that a chain of anchors covers, over all chains."""

    def grow(last, covered):
        best = covered
        for e, i, k in anchors:
            if i > last[1] and e > last[0] and i - k - last[1] <= gap and e - k - last[0] <= gap and (more := k + min(0, i - k - last[1], e - k - last[0])) > 0:
                best = max(best, grow((e, i), covered + more))
        return best

    return max((grow((e, i), k) for e, i, k in anchors), default=0)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25), st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=3, max_size=9), min_size=1, max_size=3))
def test_anchors_are_all_matches(text, templates):
    assert sorted(licenses.SuffixAutomaton(templates).anchors(text)) == plain_anchors(text, templates, licenses.MIN_MATCH)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=18), st.lists(st.sampled_from("abcd"), min_size=4, max_size=12))
def test_chains_cover_most(text, template):
    anchors = [x[1:] for x in plain_anchors(text, [template], 2)]
    anchors.sort(key=lambda x: x[1])
    found = licenses.chains(anchors)
    assert max((c for *_, c in found), default=0) == plain_best(anchors, licenses.MAX_GAP)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_licences_within_other_text(spark):
    mit, bsd = (next(t for label, t in licenses.TEMPLATES if label == x) for x in ("mit", "bsd-3"))
    words = mit.split()
    edited = " ".join("changed" if i % 23 == 5 else w for i, w in enumerate(words))
    texts = {1: f"Copyright me. {mit} The end. {bsd}", 2: edited, 3: " ".join(words[:60]), 4: "permission is hereby granted free of charge", 5: f"{mit}\n{mit}", 6: None, 7: "this work is licensed under a creative commons attribution noncommercial 4 0 international license"}
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "bsd-3,mit" and got[1]["score"] == 1.0 and got[2]["labels"] == "mit" and 0.8 < got[2]["score"] < 1
    assert got[3]["labels"] == got[4]["labels"] == got[6]["labels"] == "" and got[4]["score"] == 0
    n = len(licenses.words(mit.encode()))
    assert [(s["start"], s["end"]) for s in got[5]["spans"]] == [(0, n), (n, 2 * n)] and got[7]["labels"] == "cc-by-nc"
