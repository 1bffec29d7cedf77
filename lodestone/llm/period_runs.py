"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least two periods and LEAST words long, that no neighbouring word extends.
Periods below DIRECT are found by comparing the words with themselves q places on. For q from 2**k up to 2**(k+1) each window of
2**(k-1)+1 places chooses the leftmost place with the smallest hash of the 2**(k-1) words from there. The first such window of a
run lies wholly in its first period, so it stands again q words on and chooses the same words there: the two places, equal and
q apart, are a seed. A seed is extended both ways by exact ranks of all stretches of 1, 2, 4, ... words (no hash decides).
Equal places at most a quarter of the scale apart lie in one run of a shorter period and form a chain, of which all distances to
another chain are tried by its last place only; at most seven chains lie within a scale, so the seeds stay linear in the words.

Documents are taken together, about BATCH words at a time, with a separator that equals nothing; a longer one is taken alone, at some
100 bytes a word. Defined cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows give
a row each; extra columns are ignored; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read, texts
from lodestone.llm.hashing import mix

DIRECT, SCALE = 16, 4  #: periods below 2**SCALE are compared directly
LEAST = 12  #: words of the shortest run
BATCH = 100_000  #: words taken together
SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"


def _ranks(x: np.ndarray) -> list[np.ndarray]:
    """For each j, a rank for the 2**j words from every place: equal words have equal ranks; -1 where they stand once."""
    n, out, last, h = len(x), [], x.astype(np.int64), 1
    counts = np.bincount(last)
    last = np.where(counts[last] > 1, last, -1)
    while True:
        out.append(np.append(last, -1).astype(np.int32))
        m = n - 2 * h + 1
        if m <= 0:
            return out
        at = np.flatnonzero((last[:m] >= 0) & (last[h : h + m] >= 0))
        if not len(at):
            return out
        _, rank, counts = np.unique(last[at] * (n + 1) + last[at + h], return_inverse=True, return_counts=True)
        repeated = counts[rank] > 1
        if not repeated.any():
            return out
        last = np.full(n, -1, np.int64)
        last[at[repeated]] = rank[repeated]
        h *= 2


def _common(ranks: list[np.ndarray], p: np.ndarray, q: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from p on (or, back, before p) equal those at q."""
    length = np.zeros(len(p), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        r, step = ranks[j], 1 << j
        a, b = (p - length - step, q - length - step) if back else (p + length, q + length)
        inside = (a >= 0) if back else (b < len(r))
        got = r[np.where(inside, a, -1)]
        length += step * (inside & (got >= 0) & (got == r[np.where(inside, b, -1)]))
    return length


def _chosen(rank: np.ndarray, window: int, salt: int) -> np.ndarray:
    """Places that some window chooses: the leftmost of the smallest hashes."""
    with np.errstate(over="ignore"):
        hashed = mix(rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(33)
    key = np.where(rank >= 0, (hashed << np.uint64(32)) | np.arange(len(rank), dtype=np.uint64), np.iinfo(np.uint64).max)
    size = 1
    while 2 * size <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < window:
        key = np.minimum(key[: len(key) - (window - size)], key[window - size :])
    marked = np.zeros(len(rank), bool)
    marked[(key[key != np.iinfo(np.uint64).max] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return np.flatnonzero(marked)


def _seeds(rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal chosen places from 2**k up to 2**(k+1) words apart."""
    none = np.zeros(0, np.int64)
    at = _chosen(rank, (1 << (k - 1)) + 1, k)
    at = at[np.lexsort((at, rank[at]))]
    if len(at) < 2:
        return none, none
    value = rank[at]
    follows = (value[1:] == value[:-1]) & (at[1:] - at[:-1] <= 1 << (k - 2))
    chain = np.concatenate(([0], np.cumsum(~follows)))
    last = np.flatnonzero(np.append(chain[1:] != chain[:-1], True))  # by chain, its last place
    left, right = [none], [none]
    for j in range(1, 8):
        before, after = chain - j, chain + j
        for ok, p, q in ((before >= 0, last[np.maximum(before, 0)], np.arange(len(at))), (after < len(last), np.arange(len(at)), last[np.minimum(after, len(last) - 1)])):
            far = at[q] - at[p]
            ok = ok & (value[p] == value[q]) & (far >= 1 << k) & (far < 2 << k)
            left.append(at[p[ok]])
            right.append(at[q[ok]])
    pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right)), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def runs(x: np.ndarray) -> np.ndarray:
    """All runs of a sequence of small non-negative integers: rows (start, length, period) by start, then period."""
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(DIRECT, len(x) // 2 + 1)):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], x[q:] == x[:-q], [False])).view(np.int8)))
        start, same = edge[::2], edge[1::2] - edge[::2]
        ok = same >= max(q, LEAST - q)
        found.append(np.stack((start[ok], same[ok] + q, np.full(ok.sum(), q)), axis=1))
    ranks = _ranks(x) if len(x) >= 2 * DIRECT else []
    for k in range(SCALE, len(ranks) + 1):
        p, q = _seeds(ranks[k - 1][:-1], k)
        back, ahead = _common(ranks, p, q, True), _common(ranks, p, q)
        ok = back + ahead >= q - p
        found.append(np.stack((p - back, back + ahead + q - p, q - p), axis=1)[ok])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # of one stretch the smallest period counts
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _of_documents(lists: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words, found over all of them at once."""
    numbers, starts, base, at = [], [], 0, 0
    for words in lists:
        known: dict[bytes, int] = {}
        own = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        numbers += [own + base, np.array([base + len(known)])]  # and a separator
        base += len(known) + 1
        starts.append(at)
        at += len(words) + 1
    rows = runs(np.concatenate(numbers)) if numbers else np.zeros((0, 3), np.int64)
    cuts = np.searchsorted(rows[:, 0], [*starts, at])
    return [rows[a:b] - [s, 0, 0] for a, b, s in zip(cuts[:-1], cuts[1:], starts, strict=True)]


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without those that a run has after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0))


def find_runs(df: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every text; runs by start, then period."""

    def batch(ids: list, lists: list[list[bytes]]) -> pa.RecordBatch:
        found = _of_documents(lists)
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        kind = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"]))
        text = pa.array([collapse(w, f) for w, f in zip(lists, found, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in lists], pa.int64()), kind, text], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        ids, lists, held = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                if lists and held + len(words) > BATCH:
                    yield batch(ids, lists)
                    ids, lists, held = [], [], 0
                ids.append(i.as_py())
                lists.append(words)
                held += len(words)
        yield batch(ids, lists)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The longest run (ties: smallest start, then period); null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the checksum of their ids, with their words from some place on repeated."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    chosen = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return docs.select("doc_id", F.when(chosen, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(F.col("text")).alias("text"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them with planted repeats."""
    found = find_runs(with_repeats(read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.withColumn("best", longest(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
