"""The registered queries on the smallest tables, each against a brute-force version of what it must return."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.llm import entries, licenses
from test_text_operators import plain_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def run(spark, name):
    return {r["doc_id"]: r for r in entries.QUERIES[name](spark, SF).collect()}


def test_op1(spark, documents):
    import public_tokenizers
    import tiktoken

    from lodestone.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    got = run(spark, "op1_bpe")
    assert got.keys() == documents.keys()
    for i, d in documents.items():
        text = d["text"] or ""
        ids = plain.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op3(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    rows = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in entries.QUERIES["op3_neighbours"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = {int(x) for x in ids[np.lexsort((ids, d))[:10]]}
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in found)
        hits += len(best & {v for _, v, _ in found})
    assert hits >= 9 * len(got)


def test_op4(spark, documents):
    from tokenizers import Tokenizer

    from lodestone.llm import packing

    t = Tokenizer.from_file(packing.word_tokenizer())
    want, volume = set(), 0
    for i, d in documents.items():
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        volume += len(ids)
        want |= {(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    out = entries.QUERIES["op4_packing"](spark, SF).collect()
    assert len(out) == len(want) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) <= 1.02 * -(-volume // 2048) + 1


def test_op5(spark, documents):
    got, order = run(spark, "op5_fingerprint"), sorted(documents)
    same = {}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, u = documents[i]["text"] or "", documents[j]["text"] or ""
        n = len(t)
        assert got[i]["n_chars"] == n
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: n - n // 2] + u[: n // 2]).encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_op6(spark, documents):
    got = run(spark, "op6_language")
    langs = {d["lang"] for d in documents.values()} | {"und"}
    right = []
    for i, d in documents.items():
        held = zlib.crc32(str(i).encode()) % 3 == 1
        assert got[i]["held_out"] == held and got[i]["lang_pred"] in langs and 0 <= got[i]["score"] <= 1
        letters = any(c.isalpha() for c in d["text"] or "")
        assert (got[i]["lang_pred"] == "und") >= (not letters)
        right += [got[i]["lang_pred"] == d["lang"]] * (held and letters)
    assert sum(right) >= 0.95 * len(right)


def test_op7(spark, documents):
    got = run(spark, "op7_pii")
    for i, d in documents.items():
        spans = plain_spans(d["text"] or "")
        for k in ("email", "ip", "card", "phone"):
            assert got[i][f"n_{k}"] == sum(s[0] == k for s in spans)
        base = [f"{k}:{s}:{e}" for k, s, e in spans]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}


def test_op8(spark, documents):
    got = run(spark, "op8_toxicity")
    for i in documents:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_op9(spark, documents):
    got = run(spark, "op9_licenses")
    for i, d in documents.items():
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (d["text"] or "").encode()))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.encode().split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(at))
        assert got[i]["first_word"] == min((k for k, _ in at), default=None) and got[i]["last_word"] == max((k for k, _ in at), default=None)
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= got[i]["score"] <= 1


def test_op2(spark, documents):
    """No two kept lines of the result have the same words, and every line that went has its like among the kept ones."""
    from lodestone.llm import line_dedup

    got = run(spark, "op2_line_dedup")
    words = lambda line: tuple(re.findall("[^\\s" + re.escape(line_dedup.MARKS) + "]+", line.lower()))
    kept = [w for r in got.values() for line in (r["text"] or "").split("\n") if (w := words(line))]
    assert len(kept) == len(set(kept))
    for i, d in documents.items():
        before, after = (d["text"] or "").split("\n"), (got[i]["text"] or "").split("\n")
        assert got[i]["n_removed"] == len(before) - (len(after) if got[i]["text"] or got[i]["n_removed"] < len(before) else 0)
        rest = iter(before)
        assert all(line in rest for line in after if got[i]["text"])  # in order, unchanged
