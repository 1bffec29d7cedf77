"""Language identification by nearest centroid.

Character n-grams (one to three letters, within word bounds) are hashed to a fixed number of dimensions, weighted by TF-IDF
and normalised. Each language has several centroids, clustered by cosine, so that a language of mixed writing (upper case,
lists, junk between words) is not one blurred mean. A text gets the language of its nearest centroid; `rejected` marks
texts farther from it than nearly all training texts of that centroid are.

Defined cases: null texts and texts without a letter are `und` with score 0. With nothing to learn from every text is `und`. Repeated
rows give a row each; extra columns are ignored. Scores are cosines, 0 to 1.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read, small

SAMPLE = 6_000  #: labelled texts the centroids are fitted on, at most (the first by a hash of doc_id)
DIMENSIONS = 4096
CENTROIDS = 4  #: per language
REJECT = 0.995  #: share of a centroid's training texts that are nearer than the rejection distance
PIECE = 1 << 20
_U = np.uint32


def _classes(limit: int) -> np.ndarray:
    """For each code point of the first planes: its lower-case form if it is a letter, else 0."""
    out = np.zeros(limit, _U)
    for c in range(limit):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-case code points, 0 for all that is no letter, with a 0 at both ends."""
    if not _table:
        _table.append(_classes(0x110000))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate((np.zeros(1, _U), _table[0][points], np.zeros(1, _U)))


def counts(text: str) -> np.ndarray:
    """n-gram counts of a text, hashed to DIMENSIONS; all zero without a letter. Long texts are counted piece by piece."""
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(text), PIECE):
        a = letters(text[at : at + PIECE])
        is_letter = a > 0
        keys = [a[is_letter] * _U(0x9E3779B1)]
        two = (a[:-1] * _U(0x85EBCA77)) ^ (a[1:] * _U(0xC2B2AE3D)) + _U(1)
        keys.append(two[is_letter[:-1] | is_letter[1:]])
        if len(a) > 2:
            three = (a[:-2] * _U(0x27D4EB2F)) ^ (a[1:-1] * _U(0x165667B1)) ^ (a[2:] * _U(0x9E3779B1)) + _U(2)
            keys.append(three[is_letter[1:-1]])
        h = np.concatenate(keys)
        h = (h ^ (h >> _U(15))) * _U(0x2C1B3C6D)
        out += np.bincount((h >> _U(20)).astype(np.int64), minlength=DIMENSIONS)
    return out


def weigh(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as normalised TF-IDF vectors (log term frequency)."""
    v = np.log1p(c, dtype=np.float32) * idf.astype(np.float32)
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.maximum(n, 1e-12)


def cluster(v: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Centroids of unit vectors by cosine (spherical k-means, farthest-first start); deterministic."""
    k = min(k, len(v))
    c = v.mean(axis=0, keepdims=True)
    while len(c) < k:
        c = np.vstack([c, v[np.argmin((v @ c.T).max(axis=1))]])
    for _ in range(steps):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(v @ c.T, axis=1)
        c = np.vstack([v[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], reject: np.ndarray):
        self.idf, self.centroids, self.langs, self.reject = idf, centroids, langs, reject

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        c = np.array([counts(t) for t in texts]).reshape(-1, DIMENSIONS)
        none = c.sum(axis=1) == 0
        if not len(self.langs):
            return [("und", 0.0, True)] * len(texts)
        like = weigh(c, self.idf) @ self.centroids.T
        best = like.argmax(axis=1)
        score = np.clip(like[np.arange(len(best)), best], 0, 1)
        return [("und", 0.0, True) if none[i] else (self.langs[b], float(score[i]), bool(score[i] < self.reject[b])) for i, b in enumerate(best)]


def learn(examples: DataFrame, sample: int = SAMPLE) -> Model:
    """examples: doc_id, text, lang. Counts are taken in tasks; at most `sample` texts are used."""
    chosen = examples.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample).distinct()
    texts = examples.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")

    def run(batches):
        for b in small(batches):
            c = [counts(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.minimum(x, 65535).astype("<u2").tobytes() for x in c], pa.binary()), b.column(2)], ["lang", "counts", "doc_id"])

    langs, kept = [], []
    rows = texts.select("lang", "text", "doc_id").mapInArrow(run, "lang string, counts binary, doc_id long")
    for r in sorted(((r["doc_id"], r["lang"], r["counts"]) for r in rows.toLocalIterator()), key=lambda r: r[:2]):
        x = np.frombuffer(r[2], "<u2")
        at = np.flatnonzero(x).astype(np.uint16)
        if len(at):
            langs.append(r[1])
            kept.append((at, x[at]))
    if not langs:
        return Model(np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), [], np.zeros(0))
    seen = np.zeros(DIMENSIONS)
    for at, _ in kept:
        seen[at] += 1
    idf = np.log((1 + len(kept)) / (1 + seen)) + 1
    names, centroids, reject = [], [], []
    for lang in sorted(set(langs)):
        own = [kept[i] for i, x in enumerate(langs) if x == lang]
        v = np.zeros((len(own), DIMENSIONS), np.float32)
        for i, (at, n) in enumerate(own):
            v[i, at] = n
        v = weigh(v, idf).astype(np.float32)
        c = cluster(v, CENTROIDS)
        like = v @ c.T
        near = like.argmax(axis=1)
        for i in range(len(c)):
            mine = like[near == i, i]
            names.append(lang)
            reject.append(np.quantile(mine, 1 - REJECT) if len(mine) else 0.0)
        centroids.append(c)
    return Model(idf, np.vstack(centroids).astype(np.float64), names, np.array(reject))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every whole text."""

    def run(batches):
        for b in small(batches):
            out = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for at in range(0, len(texts), 256):
                out += model.predict(texts[at : at + 256])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document's language; documents whose crc32 modulo 3 is 1 are never learned from."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = learn(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
