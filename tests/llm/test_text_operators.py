"""Small cases of the operators on texts: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import re

import numpy as np
import pytest

from lodestone.llm import bpe, fingerprint, hashing, language, licenses, packing, pii, toxicity

SCHEMA = "doc_id long, text string, ids int, __text string, score double, part int, n long, lang string"
LONG = "word " * 3000 + "x" * 5000


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "no", 0.5, 3, 9, "en") for i, t in rows], SCHEMA)


ROWS = [(1, "Hello you're there, 12 ünïts\n\n  of  text"), (2, None), (3, ""), (4, "   "), (5, LONG), (6, "Hello you're there"), (6, "Hello you're there"), (None, "no id"), (7, "日本語 текст 😀!!"), (8, "\x00\x1c a b")]


def rank_file(tmp_path):
    toks = [bytes([i]) for i in range(256)] + [b"he", b"ll", b"hell", b"hello", b" w", b" wo", b"or", b" wor", b"rd", b" word", b"th", b"re", b"ere", b"there", b" there"]
    p = tmp_path / "ranks"
    p.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(toks)))
    return str(p), toks


def plain_bpe(word, rank):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        r, i = min((rank.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if r == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [rank[p] for p in parts]


@pytest.mark.parametrize("cache", [1000, 1])
def test_bpe_matches_plain_merges_and_round_trips(spark, tmp_path, cache):
    import regex

    import public_tokenizers

    path, toks = rank_file(tmp_path)
    rank = {t: i for i, t in enumerate(toks)}
    cut = regex.compile(bpe.public_pattern(public_tokenizers.PATTERN))
    got = bpe.decoded(bpe.encode(docs(spark, ROWS), path, public_tokenizers.PATTERN, cache), path).collect()
    want = sorted((t or "").encode() for _, t in ROWS)
    assert sorted(bytes(r["bytes"]) for r in got) == want
    for r in got:
        text = bytes(r["bytes"]).decode()
        ids = [i for w in cut.findall(text) for i in plain_bpe(w.encode(), rank)]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
    assert bpe.encode(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


def brute_shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_shingle_hashes_are_one_for_each_shingle():
    for _, t in ROWS:
        assert len(hashing.shingle_hashes((t or "").encode(), 4)) == len(brute_shingles(t, 4))
    a, b = "the quick brown fox jumps over it", "THE quick brown\tfox jumps over him"
    inter, union = hashing.jaccard_counts(hashing.shingle_hashes(a.encode(), 4), hashing.shingle_hashes(b.encode(), 4))
    x, y = brute_shingles(a, 4), brute_shingles(b, 4)
    assert (inter, union) == (len(x & y), len(x | y))


def test_words_hash_alike_wherever_pieces_are_cut(monkeypatch):
    text = ("alpha beta  gamma\n" * 500).encode()
    whole = hashing.word_hashes(text)
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert (hashing.word_hashes(text) == whole).all()


def test_fingerprints_estimate_and_merge():
    rng = np.random.RandomState(0)
    words = [f"w{i}" for i in rng.randint(0, 10**9, 3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    s, t = fingerprint.sketch(a.encode()), fingerprint.sketch(b.encode())
    x, y = brute_shingles(a, 5), brute_shingles(b, 5)
    assert abs(fingerprint.resemblance(s, t) - len(x & y) / len(x | y)) < 0.15
    assert abs(fingerprint.containment(s, t) - len(x & y) / len(x)) < 0.25
    assert abs(fingerprint.distinct(s) / len(x) - 1) < 0.35
    u = hashing.shingle_hashes(a.encode(), 5)
    assert (fingerprint.merge(u[::2][:128], u[1::2][:128]) == u[:128]).all()
    assert (fingerprint.load(fingerprint.dump(s)) == s).all()


@pytest.mark.parametrize("blocks", [1, 4, 1024])
def test_edited_texts_take_from_the_next_document(spark, blocks):
    rows = [r for r in ROWS if r[0] is not None]
    got = {}
    for r in fingerprint.edited_fingerprints(docs(spark, rows), blocks=blocks).collect():
        got.setdefault(r["doc_id"], []).append(r)
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert sum(map(len, got.values())) == len(rows)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        n = len(t)
        edited = t[: n - n // 2] + u[: n // 2]
        assert hashlib.sha256(edited.encode()).hexdigest() in {r["edited_sha256"] for r in got[i]}
        assert {r["n_chars"] for r in got[i]} == {n} and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got[i])
    assert fingerprint.edited_fingerprints(docs(spark, [])).count() == 0
    assert fingerprint.fingerprints(docs(spark, ROWS)).count() == len(ROWS)
    assert len(fingerprint.edited_fingerprints(docs(spark, [(None, "a"), (1, "b"), (None, None)])).collect()) == 3


def test_licenses_against_plain_search(spark):
    text = "Released under the MIT License. x the mit license; THE-MIT-LICENSE Licensed under CC BY-NC 4.0 Apache License, Version 2.0"
    rows = [*ROWS, (9, text), (10, "This work is licensed under the GNU General Public License, version 3."), (11, "the license"), (12, "the mit")]
    got = {}
    for r in licenses.scan_licenses(docs(spark, rows)).collect():
        got[r["doc_id"]] = r
    for i, t in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.encode().split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert r["first_word"] == min((k for k, _ in at), default=None) and r["last_word"] == max((k for k, _ in at), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[10]["labels"] == "gpl-3" and got[10]["score"] == 1 and got[11]["labels"] == "" and got[11]["score"] == 0
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_suffix_automaton_matching_statistics():
    rng = np.random.RandomState(1)
    templates = [[bytes([97 + x]) for x in rng.randint(0, 3, n)] for n in (7, 12, 9)]
    a = licenses.SuffixAutomaton(templates)
    inside = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(50):
        seq = [bytes([97 + x]) for x in rng.randint(0, 4, 30)]
        stat = [max((n for n in range(1, i + 2) if tuple(seq[i + 1 - n : i + 1]) in inside), default=0) for i in range(30)]
        want = [(i, stat[i]) for i in range(30) if stat[i] >= licenses.MIN_MATCH and (i == 29 or stat[i + 1] <= stat[i])]
        got = a.matches(seq)
        assert [(i, n) for i, n, _ in got] == want
        for i, n, s in got:
            assert a.ends[s] == {(t, e) for t, x in enumerate(templates) for e in range(n - 1, len(x)) if x[e - n + 1 : e + 1] == seq[i - n + 1 : i + 1]}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, x in enumerate(reversed(d)):
        v = int(x) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def plain_spans(t):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (14 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_match_the_plain_patterns():
    fixed = ["a@b.c", "a@b@c.de@f.gh", "@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.255", "4111 1111-1111 1111", "+1 (555) 555-0100 4111111111111111", "x.y@z", "..@a.b", "+12", "1.2.3.4+1 (555) 555-0100"]
    rng = np.random.RandomState(5)
    made = ["".join(rng.choice(list("0123456789.+- ()@ab"), 60)) for _ in range(3000)]
    for t in fixed + made:
        assert pii.base_spans(t) == plain_spans(t), t


def test_pii_bootstraps_from_contexts(spark):
    rows = [(i, f"please reach me: user{i}@mail.example.com today") for i in range(12)]
    rows += [(50, "please reach me: 77ab4410x now"), (51, "see figure 20240101x there"), (52, None), (53, ""), (None, "me: 12345678")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.detect(docs(spark, rows), ["doc_id"]).collect()}
    assert got[50] == [("id", 17, 26)] and got[51] == [] and got[52] == got[53] == [] and got[3][0][0] == "email"
    assert pii.detect(docs(spark, []), ["doc_id"]).count() == 0


def plain_bootstrap(texts):
    """The confident patterns, by plain counting over all words of all texts."""
    strip = lambda w: w.strip(pii._MARKS)
    uses, places, seeds = {}, {}, set()
    for t in texts:
        base = {t[s:e] for _, s, e in plain_spans(t)}
        words = t.split()
        for i in range(1, len(words)):
            low = [w.lower() for w in words]
            around = [" ".join(low[i - k : i]) for k in (2, 3) if i >= k] + [low[i - 1]] * (low[i - 1][-1] in ":=#") + [f"{low[i - 1]} _ {x}" for x in low[i + 1 : i + 2]]
            token = strip(words[i])
            for p in around:
                places[p] = places.get(p, 0) + 1
                if token in base or len(token) >= 6 and re.search("[0-9]", token):
                    uses.setdefault(p, []).append(token)
            seeds |= {token} & base
    sure = {x: 1.0 for x in seeds}
    while True:
        good = {}
        for p, tokens in uses.items():
            c = sum(sure.get(x, 0.0) for x in tokens) / places[p]
            if c >= pii.CONFIDENCE and len({x for x in tokens if sure.get(x, 0.0) >= pii.CONFIDENCE}) >= pii.MIN_SEEDS:
                good[p] = min(1.0, c)
        new = {x: 1.0 for x in seeds}
        for x in {x for tokens in uses.values() for x in tokens} - seeds:
            miss = np.prod([1 - min(0.999, c) for p, c in good.items() if x in uses[p]])
            new[x] = 1 - miss
        if set(good) == getattr(plain_bootstrap, "last", None):
            return good
        plain_bootstrap.last, sure = set(good), new


def test_pii_second_round_finds_what_the_first_cannot(spark):
    texts = [f"please reach me: user{i}@mail.example.com today" for i in range(24)]
    texts += [f"please reach me: kd77ab{i} today" for i in range(5)]  # sure after the first round
    texts += [f"entrance badge kd77ab{i} opens doors" for i in range(5)] + ["entrance badge zz90441 opens windows"]  # the second round's pattern
    texts += ["see figure 20240101x there", "see figure 20240102x there", "see figure 20240103x there", "no number"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.detect(docs(spark, rows), ["doc_id"]).collect()}
    assert got[34] == [("id", 15, 22)] and got[30] and got[35] == []
    confident = {r["pattern"]: r["confidence"] for r in pii.learn_patterns(docs(spark, rows)).collect()}
    want = plain_bootstrap(texts)
    assert set(confident) == set(want) and all(abs(confident[p] - want[p]) < 1e-9 for p in want)
    assert "entrance badge" in confident


def test_pii_patterns_in_several_passes(spark, monkeypatch):
    rows = [(i, f"please reach me: user{i}@mail.example.com or id: 9{i}aab77 today 1.2.3.4") for i in range(12)]
    want = sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.detect(docs(spark, rows), ["doc_id"]).collect())
    monkeypatch.setattr(pii, "PATTERNS_AT_ONCE", 2)
    assert sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.detect(docs(spark, rows), ["doc_id"]).collect()) == want


def test_pii_mask(spark):
    from pyspark.sql import functions as F

    rows = [(1, "x a@b.cd and 1.2.3.4, +1 (555) 555-0100; 4111111111111111"), (2, None), (3, "none"), (4, "a@b.cd")]
    out = pii.find_spans(docs(spark, rows), [], ["doc_id", "text", "score"]).select("doc_id", pii.mask(F.col("text"), F.col("spans")).alias("m"))
    got = {r["doc_id"]: r["m"] for r in out.collect()}
    assert got[1].startswith("x <EMAIL> and <IP>, <PHONE>") and "4111" not in got[1] and got[2] is None and got[3] == "none" and got[4] == "<EMAIL>"


def test_composed_automaton_equals_transducers_in_turn():
    rng = np.random.RandomState(8)
    for _ in range(500):
        symbols = [(toxicity.CLASSES[i], 2.0) for i in rng.randint(0, len(toxicity.CLASSES), rng.randint(0, 15))]
        states, total = ["plain"] * len(toxicity.GRAMMAR), 0.0
        for kind, weight in symbols:
            factor = 1.0
            for i, t in enumerate(toxicity.GRAMMAR):
                states[i], f = t[states[i]].get(kind, (states[i], 1.0))
                factor *= f
            total += weight * factor * (kind in ("insult", "threat"))
        assert abs(toxicity.clause_score(symbols)[0] - total) < 1e-9


def test_logistic_weights_are_not_below_zero():
    rng = np.random.RandomState(9)
    x = np.column_stack([np.ones(400), rng.rand(400, 3)])
    y = (x[:, 1] - x[:, 2] + 0.1 * rng.randn(400) > 0).astype(float)
    w = toxicity.fit_logistic(x, y)
    assert w[1] > 0 and w[2] == 0 and (w[1:] >= 0).all()


def test_toxicity_grammar_and_learning(spark):
    lex = toxicity.Lexicon({"idiot": 4.0}, {"scumb": 3.0})
    score = lambda t: toxicity.matches(t, lex)[0]
    assert score("you idiot") > score("an idiot") > score("he said idiot") > score("not an idiot") > 0 == score("nice day")
    assert score("i will kill you") == 0 or score("i will kill you") < score("you will kill")
    assert toxicity.matches("scumbags.", lex)[4] == 1
    rows = [(i, f"some clean words number{i} here") for i in range(60)] + [(100 + i, f"some grubly words grublyfied number{i}") for i in range(40)] + [(200, None), (201, "")]
    labels = spark.createDataFrame([(i, 0, 1) for i in range(60)] + [(100 + i, 1, 1) for i in range(40)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.learn(toxicity.labelled(docs(spark, rows), labels))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, [*rows, (300, "grubly here grublyness"), (301, "clean")]), *model).collect()}
    assert min(got[100], got[300]) > 0.5 and max(got[0], got[301], got[200], got[201]) < 0.3 and got[200] == got[201]
    nothing = toxicity.learn(toxicity.labelled(docs(spark, []), labels))
    assert toxicity.score(docs(spark, []), *nothing).count() == 0
    assert toxicity.score(docs(spark, rows), *nothing, keep=["doc_id", "score", "__text"], names=("s", "m")).where("s >= 0").count() == len(rows)


def test_language(spark):
    en, fr = "the cat and the dog are in this house", "le chat et le chien sont dans cette maison"
    rows = [(i, f"{en} {en[i:]}", *[0] * 0) for i in range(20)] + [(100 + i, f"{fr} {fr[i:]}") for i in range(20)]
    full = spark.createDataFrame([(i, t, "en" if i < 100 else "fr") for i, t in rows] + [(500, None, "en"), (501, "12 !", "fr"), (502, en, None)], "doc_id long, text string, lang string")
    model = language.learn(full)
    got = {r["doc_id"]: r for r in language.identify(docs(spark, [(1, "this house and the dog"), (2, "dans cette maison le chien"), (3, None), (4, " 12 --"), (5, LONG)]), model).collect()}
    assert got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "fr" and got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[3]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language.learn(full.where("doc_id < 0"))
    assert language.identify(docs(spark, [(1, en)]), none).first()["lang_pred"] == "und" and language.identify(docs(spark, []), model).count() == 0


def test_packing_pieces_and_plan(spark):
    rng = np.random.RandomState(2)
    rows = [*ROWS, (90, "two <|endoftext|>texts<|startoftext|> <|ENDOFTEXT|> \u00e9<|endoftext|"), *[(100 + i, "word " * int(n)) for i, n in enumerate(rng.randint(0, 40, 60))]]
    out = packing.pack(docs(spark, rows), packing.word_tokenizer(), capacity=32).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.word_tokenizer())
    want = sorted((i is not None, i or 0, k // 32, k, min(32, n - k)) for i, text in rows for n in [len(t.encode(text or "", add_special_tokens=False).ids) + 1] for k in range(0, n, 32))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["length"]) for r in out) == want
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 32
    assert packing.pack(docs(spark, []), packing.word_tokenizer()).count() == 0


def exact_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] >= items[i]:
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_plan_is_optimal_on_small_inputs():
    rng = np.random.RandomState(0)
    for _ in range(60):
        items = rng.randint(1, 31, rng.randint(1, 10)).tolist()
        hist = {x: items.count(x) for x in set(items)}
        p = packing.plan(hist, 30)
        used = {}
        for times, f in p:
            assert sum(x * n for x, n in f) <= 30
            for x, n in f:
                used[x] = used.get(x, 0) + n * times
        assert used == hist and sum(t for t, _ in p) == exact_bins(items, 30), items
    assert packing.plan({}, 30) == []


def test_special_tokens_get_their_ids():
    import numpy as np
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.word_tokenizer()), packing.Encoder(packing.word_tokenizer())
    for text in ("<|endoftext|>", "a<|endoftext|> b <|startoftext|>c", "\u4e2d<|endoftext|>\u6587", "<|endoftext|", "x <|EndOfText|> y"):
        assert np.frombuffer(e(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_words_equal_tiktoken():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rank = {t: i for i, t in enumerate(bpe.load_ranks(path))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank, special_tokens={})
    rng = np.random.RandomState(6)
    for n in (1, 2, 65, 300, 4000, 20_000):
        for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz"):
            w = "".join(rng.choice(list(letters), n))
            assert bpe.merge_long(w.encode(), rank) == plain.encode_ordinary(w)
    many = "".join(rng.choice(list("etaoinshrdlu"), 1 << 20))
    ids = bpe.merge_long(many.encode(), rank)
    tokens = bpe.load_ranks(path)
    assert b"".join(tokens[i] for i in ids) == many.encode()
