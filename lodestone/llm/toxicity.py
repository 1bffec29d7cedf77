"""Toxicity by a weighted finite-state grammar over clauses.

The grammar's words are lexicon entries of five classes: insults, threats, targets (words for a person), negations and
reported speech. Insult entries are learned: words and word stems that training texts marked toxic use far more than others,
weighted by their log odds; a small closed list gives the other classes and a few insults to start from.

The grammar is made of transducers, each a small automaton over word classes: negation (a negated insult or threat
within a few words loses most of its weight), reported speech (what follows a reporting word counts less), threat (threat
verb, then target), and insult (an insult's weight, more beside a target). They are composed into one automaton, which
reads each clause once and gives each match its weight. A document's score is a logistic function, fitted on training
texts, of its matches' sum, its strongest clause, and their number and share of the words, all as the grammar weighs
them; weights below zero are not allowed, so a match that the grammar weighs down never raises the score.

Defined cases: null and empty texts have no matches and get the score of a text without matches. Documents without a label
take no part in learning; without any usable label the closed list alone scores. Repeated rows give a row each (a repeated
label row counts once); extra columns are ignored.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, read, small, written

SAMPLE = 30_000  #: labelled documents that the lexicon and the logistic function are fitted on, at most
STEMS = (4, 5, 6, 7, 8)  #: lengths of word stems that may become entries
MIN_DOCS, MIN_ODDS = 5, 2.0  #: an entry's toxic training texts, and its log odds, at least
PRIOR_TEXTS = 2.0  #: texts, toxic at the usual rate, that each entry is taken to have besides its own
THRESHOLD = 0.3
MAX_ENTRIES = 20_000  #: learned entries at most, those of most toxic training texts first (part of the fitted model, like SAMPLE)

# Closed word classes of the grammar.
TARGETS = set("you your you're youre u he she they them him her his their".split())
NEGATIONS = set("not no never isn't isnt aren't arent wasn't don't dont doesn't didn't nobody nothing without".split())
REPORTING = set("said says say wrote writes claimed claims called reported quoted quote according asked alleged".split())
THREATS = set("kill killed hurt destroy murder shoot stab burn attack beat hang".split())
INSULTS = {w: 4.0 for w in "idiot moron stupid worthless pathetic scum loser".split()}

STRIP = ".,;:!?\"'()[]{}<>#$%&*|~`-_=+/\\"
ENDS = (".", "!", "?", ";", "\n")
_SKIP = 0


class Lexicon:
    """Classes and weights of words; whole words first, then the longest known stem."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.memo: dict[str, tuple | int] = {}

    def look(self, raw: str):
        """0 for a word without a class, else (class, weight)."""
        got = self.memo.get(raw)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[raw] = self._look(raw.strip(STRIP).lower())
        return got

    def _look(self, w: str):
        if w in self.words:
            return ("insult", self.words[w])
        for n in reversed(STEMS):
            if len(w) > n and w[:n] in self.stems:
                return ("insult", self.stems[w[:n]])
        for name, members in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("reporting", REPORTING)):
            if w in members:
                return (name, 1.0)
        return _SKIP


# Transducers: state -> {input class: (next state, output factor)}; "other" is any word without a class.
NEGATION = {"plain": {"negation": ("near3", 1.0)}, **{f"near{i}": {"insult": ("plain", 0.2), "threat": ("plain", 0.2), "negation": ("near3", 1.0), "other": (f"near{i - 1}" if i > 1 else "plain", 1.0)} for i in (1, 2, 3)}}
REPORTED = {"plain": {"reporting": ("reported", 1.0)}, "reported": {"insult": ("reported", 0.5), "threat": ("reported", 0.5)}}
THREAT = {"plain": {"threat": ("held", 0.1), "target": ("aimed", 1.0)}, "held": {"target": ("aimed", 1.0)}, "aimed": {"threat": ("aimed", 3.0)}}
AIMED = {"plain": {"target": ("aimed", 1.0)}, "aimed": {"insult": ("aimed", 1.3), "target": ("aimed", 1.0)}}
GRAMMAR = (NEGATION, REPORTED, THREAT, AIMED)


CLASSES = ("insult", "threat", "target", "negation", "reporting", "other")


def compose(grammar: tuple[dict, ...]) -> list[dict[str, tuple[int, float]]]:
    """One automaton for all transducers: by state, what each class leads to and the product of their factors. State 0 starts."""
    numbers = {("plain",) * len(grammar): 0}
    table: list[dict[str, tuple[int, float]]] = []
    todo = list(numbers)
    for states in todo:
        row = {}
        for kind in CLASSES:
            steps = [t[x].get(kind, (x, 1.0)) for t, x in zip(grammar, states, strict=True)]
            to = tuple(x for x, _ in steps)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row[kind] = (numbers[to], math.prod(f for _, f in steps))
        table.append(row)
    return table


AUTOMATON = compose(GRAMMAR)


def clause_score(symbols: list[tuple[str, float]], automaton: list[dict] = AUTOMATON) -> tuple[float, float, int]:
    """Weight of one clause, how much of a match its matches are together (a whole one each at most), and their number."""
    state = 0
    total, hits, n = 0.0, 0.0, 0
    for kind, weight in symbols:
        state, factor = automaton[state][kind]
        if kind == "insult" or kind == "threat":
            total += weight * factor
            if kind == "insult" or factor > 1:
                hits += min(1.0, factor)
                n += 1
    return total, hits, n


def matches(text: str, lexicon: Lexicon, automaton: list[dict] = AUTOMATON) -> tuple[float, float, float, float, int]:
    """Sum over clauses, strongest clause, share of matched words, matches as the grammar weighs them, and their number."""
    words = text.split()
    look = lexicon.look
    found = [look(w) for w in words]
    if not any(c and c[0] in ("insult", "threat") for c in found):
        return 0.0, 0.0, 0.0, 0.0, 0
    total, top, hits, n, clause = 0.0, 0.0, 0.0, 0, []
    for w, c in zip(words, found, strict=True):
        clause.append(c or ("other", 0.0))
        if w.endswith(ENDS):
            s, h, k = clause_score(clause, automaton)
            total, top, hits, n, clause = total + s, max(top, s), hits + h, n + k, []
    s, h, k = clause_score(clause, automaton)
    hits += h
    return total + s, max(top, s), hits / len(words), hits, n + k


def features(m: tuple[float, float, float, float, int]) -> list[float]:
    total, top, share, hits, _ = m
    return [1.0, math.log1p(total), math.log1p(top), min(1.0, 50 * share), min(hits, 3) / 3]


def _newton(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; features (all but the first, constant one) whose weight would be below
    zero are left out, the lowest first."""
    used = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, used], y)
        low = int(np.argmin(w[1:])) + 1 if len(w) > 1 else 0
        if not low or w[low] >= 0:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        del used[low]


PRIOR = np.array([-4.0, 2.0, 1.0, 1.0, 3.0])  #: weights of the logistic function where nothing can be fitted


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train: str | None = None) -> DataFrame:
    """text, toxic of at most `sample` labelled documents (the first by a hash of doc_id), one row per doc_id."""
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if train:
        rows = rows.where(train)
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def learn(examples: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """The lexicon's insult entries from document counts (summed by Spark), then the logistic function."""
    examples = written(examples.select("text", "toxic").dropDuplicates(["text"]), "toxic_examples")  # copies count once

    def entries(batches):
        for b in small(batches, 4096):
            pos, neg = Counter(), Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = {w.strip(STRIP).lower() for w in text.split()}
                keys = {w for w in seen if w} | {w[:n] + "*" for w in seen for n in STEMS if len(w) > n}
                (pos if toxic else neg).update(keys)
            keys = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["key", "pos", "neg"])

    n = {r["toxic"]: r["count"] for r in examples.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    n_pos, n_neg = n.get(True, 0), n.get(False, 0)
    if not n_pos or not n_neg:
        return Lexicon(dict(INSULTS), {}), PRIOR
    counts = examples.select("text", "toxic").mapInArrow(entries, "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = n_pos / (n_pos + n_neg)
    odds = F.log((F.col("pos") + PRIOR_TEXTS * rate) / (F.col("neg") + PRIOR_TEXTS * (1 - rate))) - math.log(rate / (1 - rate))
    best = counts.withColumn("odds", odds).where((F.col("pos") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS)).orderBy(F.desc("pos"), "key").limit(MAX_ENTRIES).collect()
    words, stems = dict(INSULTS), {}
    for r in best:
        (stems if r["key"].endswith("*") else words)[r["key"].removesuffix("*")] = min(8.0, r["odds"])
    lexicon = Lexicon(words, stems)

    def measure(batches):
        own = Lexicon(words, stems)
        for b in small(batches):
            f = [features(matches(t, own)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], ["f", "toxic"])

    # one row per distinct feature vector: at most one per example
    rows = examples.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measure, "f array<double>, toxic int").groupBy("f", "toxic").count().collect()
    x = np.array([r["f"] for r in rows for _ in range(r["count"])])
    y = np.array([float(r["toxic"] > 0) for r in rows for _ in range(r["count"])])
    return lexicon, fit_logistic(x, y)


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, keep: list[str] | None = None, names: tuple[str, str] = ("score", "n_matches")) -> DataFrame:
    """The columns `keep` (doc_id unless given), with a score double and the number of matches long of every whole text."""
    words, stems, w = lexicon.words, lexicon.stems, np.asarray(weights)
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.add(names[0], "double").add(names[1], "long")

    def run(batches):
        own = Lexicon(words, stems)
        for b in small(batches):
            m = [matches(t or "", own) for t in b.column(at).to_pylist()]
            z = np.array([features(x) for x in m]).reshape(-1, len(w)) @ w
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array([x[4] for x in m], pa.int64())], [*keep, *names])

    at = keep.index("text") if "text" in keep else len(keep)
    return docs.select(*keep, *([] if at < len(keep) else [F.col("text").alias(free_name(docs, "__text"))])).mapInArrow(run, schema)


def bucket(n: int):
    """crc32 of doc_id as text, modulo n: which documents are held out."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % n


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels of documents whose crc32 modulo 4 is 2 are never read for learning."""
    docs = read(spark, sf_dir, "documents")
    train = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2"
    lexicon, weights = learn(labelled(docs, read(spark, sf_dir, "labels"), train=train))
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon, weights)
    return out.select("doc_id", F.coalesce(bucket(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")
