"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the k smallest distinct 64-bit hashes. It is mergeable (the sketch of a union is the k smallest of
both sketches) and estimates resemblance, containment and the number of distinct shingles.

Defined cases: a null text counts as empty; an empty text (or one of white space only) has an empty sketch, and
two empty sketches have likeness 1, one empty and one not 0. With fewer than five words the whole sequence is one
shingle. Repeated rows each give a row. Extra columns are ignored.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, read, small, texts
from lodestone.llm.hashing import shingle_hashes

WORDS, K = 5, 128
BLOCKS = 1024


def sketch(text: bytes | None, k: int = K, words: int = WORDS) -> np.ndarray:
    return shingle_hashes(text, words)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the two shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    r = resemblance(a, b, k)
    union = distinct(merge(a, b, k), k)
    return min(1.0, r * union / distinct(a, k)) if len(a) else 1.0


def dump(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def load(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def fingerprints(df: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint string, n_shingles double (estimated) of every text."""

    def run(batches):
        for b in small(batches):
            s = [sketch(t, k, words) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([dump(x) for x in s]), pa.array([distinct(x, k) for x in s], pa.float64())], ["doc_id", "fingerprint", "n_shingles"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def beside_next(df: DataFrame, order: str, columns: list[str], blocks: int = BLOCKS) -> DataFrame:
    """Deals rows to blocks of neighbouring keys, sorted by (key, columns), each block closed by a guest row: the first
    row of the next block, and after the last block the very first row. Returns __block, __guest, the key and columns.

    Only block edges (at most `blocks` keys) reach the driver. A null key sorts first.
    """
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)))
    rows = df.select(F.col(order).cast("long").alias(order), *[c for c in columns if c != order], key.alias("__key"))
    edges = df.select(key.alias("k")).agg(F.percentile_approx("k", [i / blocks for i in range(1, blocks)], 100_000)).first()[0]
    splits = [float("-inf"), *sorted({float(x) for x in edges or [0]}), float("inf")]
    to_block = Bucketizer(splits=splits, inputCol="__at", outputCol="__b")
    placed = to_block.transform(rows.withColumn("__at", F.col("__key").cast("double"))).withColumn("__block", F.col("__b").cast("int")).drop("__at", "__b")
    firsts = sorted(tuple(r) for r in placed.groupBy("__block").agg(F.min("__key")).collect())
    guest_of = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    own = placed.withColumn("__guest", F.lit(0))
    guests = F.broadcast(df.sparkSession.createDataFrame(guest_of, "__key long, __to int"))
    more = placed.join(guests, "__key").drop("__block").withColumnRenamed("__to", "__block").withColumn("__guest", F.lit(1))
    return own.unionByName(more).repartition(partitions(df), "__block").sortWithinPartitions("__block", "__guest", "__key", *columns)


def edited_fingerprints(df: DataFrame, k: int = K, words: int = WORDS, blocks: int = BLOCKS) -> DataFrame:
    """Fingerprints every text, its edited text and the likeness to the next document's (see op5_fingerprint)."""

    def row(doc_id, text: str, s, following: str, t):
        n = len(text)
        edited = (text[: n - n // 2] + following[: n // 2]).encode("utf-8", "surrogatepass")
        e = sketch(edited, k, words)
        return doc_id, n, hashlib.sha256(edited).hexdigest(), dump(s), dump(e), resemblance(s, e, k), resemblance(s, t, k), distinct(s, k), containment(s, e, k)

    def run(batches):
        held, block = None, None
        for b in small(batches):
            out = []
            for doc_id, text, at, guest in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("__block").to_pylist(), b.column("__guest").to_pylist(), strict=True):
                if at != block:
                    held, block = None, at
                elif guest and held is None:
                    continue  # the block is closed
                text = text or ""
                s = sketch(text.encode("utf-8", "surrogatepass"), k, words)
                if held is not None:
                    out.append(row(*held, text, s))
                held = None if guest else (doc_id, text, s)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "contained_in_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    dealt = beside_next(df, "doc_id", ["text"], blocks)
    return dealt.select("doc_id", "text", "__block", "__guest").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained_in_edited double")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, its edited text (second half from the next document by doc_id) and the likeness of both pairs."""
    return edited_fingerprints(read(spark, sf_dir, "documents"))
