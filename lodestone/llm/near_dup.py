"""Near duplicates of documents by b-bit MinHash.

Texts with the same shingle set are one node. A node's 128 minima give 32 band keys of four rows (candidate buckets) and,
of each minimum, two low bits, packed into longs: bit counts of a pair estimate its similarity, corrected for the
quarter of bits that agree by chance. Pairs far below the threshold by that estimate (five standard deviations) or by
set sizes are dropped; the rest is confirmed on full sets. A pair at the threshold is missed by all bands with a
probability of (1 - 0.8**4)**32, 5e-8.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing. With fewer words
than a shingle has, the whole sequence is one shingle. Rows that repeat a doc_id are one document with several texts; a null
doc_id links with nothing and has a null component_id. Extra columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_broadcast, read, small, texts, written
from lodestone.llm.hashing import jaccard_counts, mix, shingle_hashes
from lodestone.llm.links import components, in_blocks, links

ROWS, BANDS, BITS = 4, 32, 2
PERMUTATIONS = ROWS * BANDS
BROADCAST_IDS = 4_000_000  #: at most so many ids (8 bytes each) are broadcast; beyond, the join shuffles
_rng = np.random.RandomState(11)
_XOR = _rng.randint(0, 1 << 62, PERMUTATIONS, dtype=np.int64).astype(np.uint64)[:, None]
_ODD = (_rng.randint(0, 1 << 62, PERMUTATIONS, dtype=np.int64).astype(np.uint64) | np.uint64(1))[:, None]
_CHUNK = 1024
BLOCK = 256  #: members of a large component that a task holds nodes against


def minima(h: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), _CHUNK):
            np.minimum(out, ((h[None, at : at + _CHUNK] ^ _XOR) * _ODD).min(axis=1), out=out)
    return out


def signature(text: bytes, words: int) -> tuple:
    """Set size, a 128-bit key of the set, band keys, and the bit planes of the minima's low bits."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0, 0, 0, None, None
    m = minima(h)
    with np.errstate(over="ignore"):
        keys = (int(h.sum().astype(np.int64)), int(mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)))
        weights = (np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        bands = mix((mix(m).reshape(BANDS, ROWS) * weights).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
    low = mix(m)
    planes = [np.packbits(((low >> np.uint64(i)) & np.uint64(1)).astype(np.uint8)).view(">i8") for i in range(BITS)]
    return len(h), *keys, bands.astype(np.int64), np.concatenate(planes)


def signatures(df: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for b in small(batches):
            n, k1, k2, bands, planes = zip(*(signature(t, words) for t in texts(b)), strict=True) if b.num_rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))], ["doc_id", "n", "k1", "k2", "bands", "planes"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, planes array<long>")


def estimate(x: Column, y: Column) -> Column:
    """Similarity estimated from two columns of bit planes: agreement of all bits, less what chance gives."""
    words = PERMUTATIONS // 64
    differ = sum(F.bit_count(_or([x[b * words + i].bitwiseXOR(y[b * words + i]) for b in range(BITS)])) for i in range(words))
    chance = 0.5**BITS
    return ((F.lit(1.0) - differ / F.lit(float(PERMUTATIONS))) - chance) / (1 - chance)


def _or(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out


def _margin(percent: int) -> float:
    """Five standard deviations of the estimate at the threshold."""
    agree = 0.5**BITS + (1 - 0.5**BITS) * percent / 100
    return 5 * math.sqrt(agree * (1 - agree) / PERMUTATIONS) / (1 - 0.5**BITS)


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the ids (node), which are counted before they are broadcast. docs: (node, text)."""
    ids = written(ids.distinct(), "ids")
    return written(docs.join(bounded_broadcast(ids, ids.count(), BROADCAST_IDS), "node", "left_semi").distinct(), "texts")


def confirm_on_sets(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    held = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs)
    a, b = (held.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(b, "b").join(a, "a")

    def run(batches):
        last, kept = None, None
        for part in small(batches, 128):
            keep = []
            for x, y, s, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part, "text_a"), texts(part, "text_b"), strict=True):
                if (x, s) != last:
                    last, kept = (x, s), shingle_hashes(s, words)
                inter, union = jaccard_counts(kept, shingle_hashes(t, words))
                if 100 * inter >= percent * union:
                    keep.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.int64())], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def sweep_on_sets(asks: DataFrame, members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Holds each asked node against all members of a component, block by block, on full sets; one link a block at most."""
    held = texts_of(asks.select(F.col("x").alias("node")).union(members.select("node")), docs)
    x, y = in_blocks(asks, members, BLOCK)
    x = x.join(held.select(F.col("node").alias("x"), F.col("text").alias("asked")), "x")
    y = y.join(held.select("node", F.col("text").alias("member")), "node")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        asked = left.num_rows and right.num_rows
        sets = [shingle_hashes(t, words) for t in texts(right, "member")] if asked else []
        if asked:
            flat = np.concatenate(sets)
            sizes = np.array([len(s) for s in sets])
            starts = np.cumsum(sizes) - sizes
            nodes = right.column("node").to_pylist()
            for i, t in zip(left.column("x").to_pylist(), texts(left, "asked"), strict=True):
                own = shingle_hashes(t, words)
                inter = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, starts, dtype=np.int64)
                hit = np.flatnonzero(100 * inter >= percent * (sizes + len(own) - inter))
                if len(hit):
                    out.append((i, nodes[hit[0]]))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    keys = ["comp", "m", "q"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, a row for each row of df."""
    sig = written(signatures(df, words), "signatures")
    known = sig.where("n > 0 AND doc_id IS NOT NULL")
    sets = written(known.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")), "sets")
    members = written(sig.join(sets, ["k1", "k2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "members")
    nodes = written(sig.join(sets.withColumnRenamed("node", "doc_id"), ["k1", "k2", "n", "doc_id"]).select(F.col("doc_id").alias("node"), "k1", "k2", "n", "bands", "planes").dropDuplicates(["node", "k1", "k2", "n"]), "nodes")
    # a document whose repeated rows have several texts
    several = members.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    same = written(members.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "same")
    docs = df.select(F.col("doc_id").cast("long").alias("node"), "text").where("node IS NOT NULL")
    least = percent / 100 - _margin(percent)

    def close(x: str, y: str) -> Column:
        n, m = F.col(x)["n"], F.col(y)["n"]
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (estimate(F.col(x)["planes"], F.col(y)["planes"]) >= least)

    keyed = nodes.select("node", F.col("bands").alias("keys"), F.struct("n", "planes").alias("trait"))
    found = links(keyed, close, lambda pairs: confirm_on_sets(pairs, docs, words, percent), lambda asks, members: sweep_on_sets(asks, members, docs, words, percent))
    comps = components(found.union(same))
    out = members.join(comps, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "node", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents on four-word shingles at 80 in 100."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)
