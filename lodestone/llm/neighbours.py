"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gives a neighbour graph, which is cut into balanced parts (recursive spectral bisection by
the median, then swaps that keep more neighbours together). A small network learns the parts and places every vector in its
most probable one; queries go to the several most probable parts and are ranked there by exact distances. Parts are dealt
out in blocks of bounded size, so a part that holds a third of all rows is searched by many tasks.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of another
length than most of the sample; rows without vec_id take no part as well. Rows that repeat a vec_id are candidates
under one id, nearest row first, and are never candidates of their own id. With fewer than k candidates all are returned. Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import read, written

SAMPLE = 4096  #: distinct vectors the partitioner is fitted on, at most
DEPTH = 5  #: 2**DEPTH parts, fewer where the sample is small
GRAPH = 10  #: neighbours in the graph
MASS, LEAST_PARTS = 0.95, 2  #: a query's parts: so many of its neighbours expected there, and so many parts at least
K = 10


def neighbour_graph(v: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """Indices of the k nearest others of each row."""
    k = min(k, len(v) - 1)
    norm = (v * v).sum(axis=1)
    out = np.zeros((len(v), k), np.int64)
    for at in range(0, len(v), 512):
        d = norm[None, :] - 2 * v[at : at + 512] @ v.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisect(edges: np.ndarray, n: int, rounds: int = 40) -> np.ndarray:
    """A balanced cut of a graph with n nodes (edges: pairs): spectral order, split at the median, then swaps."""
    a, b = np.concatenate((edges, edges[:, ::-1])).T
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    x = np.cos(np.arange(n) * 2.399963)  # a fixed start
    for _ in range(rounds):
        x -= (x * degree).sum() / degree.sum()
        x = (x + np.bincount(a, weights=x[b], minlength=n) / degree) / 2
        x /= max(np.abs(x).max(), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        other = np.bincount(a, weights=side[a] != side[b], minlength=n)
        gain = 2 * other - degree
        left = np.flatnonzero(~side & (gain > 0))
        right = np.flatnonzero(side & (gain > 0))
        m = min(len(left), len(right)) // 2 + (min(len(left), len(right)) == 1)
        if not m:
            break
        before = (side[a] != side[b]).sum()
        old = side.copy()
        side[left[np.argsort(-gain[left], kind="stable")[:m]]] = True
        side[right[np.argsort(-gain[right], kind="stable")[:m]]] = False
        if (side[a] != side[b]).sum() >= before:
            side = old
            break
    return side


def balanced_parts(near: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A part for each node of a neighbour graph, 2**depth parts of equal size (give or take one)."""
    edges = np.stack((np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()), axis=1)
    part = np.zeros(len(near), np.int64)
    for _ in range(depth):
        new = part * 2
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            index = np.full(len(near), -1)
            index[nodes] = np.arange(len(nodes))
            own = edges[(part[edges[:, 0]] == p) & (part[edges[:, 1]] == p)]
            new[nodes] += bisect(index[own].reshape(-1, 2), len(nodes))
        part = new
    return part


class Router:
    """A network of one hidden layer: vector -> how likely a near neighbour lies in each part."""

    def __init__(self, v: np.ndarray, part: np.ndarray, near: np.ndarray, hidden: int = 64, epochs: int = 80):
        rng = np.random.RandomState(3)
        self.parts = int(part.max()) + 1 if len(part) else 1
        self.mean, self.scale = v.mean(axis=0), max(float(v.std()), 1e-12)
        x, d = (v - self.mean) / self.scale, v.shape[1]
        # what is learned: the parts of a vector's neighbours
        y = np.stack([np.bincount(part[r], minlength=self.parts) for r in near]) / near.shape[1] if near.size else np.ones((len(v), 1))
        self.w = [rng.randn(d, hidden) / np.sqrt(d), np.zeros(hidden), rng.randn(hidden, self.parts) / np.sqrt(hidden), np.zeros(self.parts)]
        m, s, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        order = rng.permutation(len(x))
        checked, learned = order[: len(x) // 8], order[len(x) // 8 :]
        best, best_w, worse = np.inf, self.w, 0
        for _ in range(epochs if self.parts > 1 else 0):
            learned = rng.permutation(learned)
            for at in range(0, len(learned), 128):
                xb, yb = x[learned[at : at + 128]], y[learned[at : at + 128]]
                h = np.maximum(xb @ self.w[0] + self.w[1], 0)
                g = (self._softmax(h @ self.w[2] + self.w[3]) - yb) / len(yb)
                gh = (g @ self.w[2].T) * (h > 0)
                t += 1
                for i, grad in enumerate((xb.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    s[i] = 0.999 * s[i] + 0.001 * grad**2
                    self.w[i] = self.w[i] * (1 - 1e-5) - 0.002 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
            loss = -(y[checked] * np.log(self.probabilities(v[checked]) + 1e-12)).sum(axis=1).mean() if len(checked) else 0.0
            best, best_w, worse = (loss, [w.copy() for w in self.w], 0) if loss < best else (best, best_w, worse + 1)
            if worse == 4:
                break  # what was held out no longer gains
        self.w = best_w

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, v: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum((v - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(df: DataFrame) -> DataFrame:
    """vec_id, v array<double> of the vectors that take part, whatever their length."""
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> tuple[Router, int] | None:
    """The router and the vectors' length; None without vectors."""
    rows = vectors.dropDuplicates(["v"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not rows:
        return None
    sizes = [len(r["v"]) for r in rows]
    size = max(sorted(set(sizes)), key=sizes.count)
    v = np.array([r["v"] for r in rows if len(r["v"]) == size])
    depth = min(DEPTH, max(0, int(np.log2(max(1, len(v) / (4 * GRAPH))))))
    near = neighbour_graph(v) if depth else np.zeros((len(v), 0), np.int64)
    part = balanced_parts(near, depth) if depth else np.zeros(len(v), np.int64)
    return Router(v, part, near), size


def nearest(df: DataFrame, queries, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that the condition `queries` takes."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = df.sparkSession
    vectors = usable(df)
    fitted = fit(vectors, sample)
    if not fitted:
        return spark.createDataFrame([], schema)
    router, size = fitted

    def place(batches):
        for b in batches:
            p = router.probabilities(_matrix(b.column(1))) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p.argmax(axis=1).astype(np.int32))], ["vec_id", "v", "part"])

    index = written(vectors.where(F.size("v") == size).mapInArrow(place, "vec_id long, v array<double>, part int"), "vectors")
    found = index.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids")).collect()  # one row a part
    counts, distinct = ({r["part"]: r[c] for r in found} for c in ("n", "ids"))
    total = sum(counts.values())
    block = min(32768, max(512, total // 512))
    asked = index.where(queries)

    def route(batches):
        have = np.array([distinct.get(i, 0) for i in range(router.parts)])
        for b in batches:
            p = router.probabilities(_matrix(b.column(1))) if b.num_rows else np.zeros((0, 1))
            out = []
            for row in p:
                order = np.argsort(-row, kind="stable")
                n = int(np.searchsorted(np.cumsum(row[order]), MASS)) + 1
                n = min(max(n, LEAST_PARTS), len(order))
                while n < len(order) and have[order[:n]].sum() <= k:
                    n += 1  # too few candidates: on to the next part
                out.append([int(x) for x in order[:n] if have[x]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["query_id", "q", "parts"])

    routed = written(asked.select("vec_id", "v").mapInArrow(route, "query_id long, q array<double>, parts array<int>").select("query_id", "q", F.explode("parts").alias("part")), "routed")
    q_counts = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = spark.createDataFrame([(p, -(-n // block), -(-q_counts.get(p, 0) // block)) for p, n in sorted(counts.items())], "part int, d int, q int")
    blocks = F.broadcast(blocks)  # one row a part
    data = index.join(blocks, "part").where("q > 0").select("vec_id", "v", "part", F.pmod(F.xxhash64("vec_id", "v"), F.col("d")).cast("int").alias("d"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("q"))
    ask = routed.withColumnRenamed("q", "w").join(blocks, "part").select("query_id", "w", "part", F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("d"), F.pmod(F.xxhash64("query_id", "w"), F.col("q")).cast("int").alias("q"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qs, x, y, s = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy(), [], [], []
        repeated = len(np.unique(ids)) < len(ids)
        if len(ids) and len(qs):
            d, w = _matrix(left.column("v")), _matrix(right.column("w"))
            for q, row in zip(qs, w, strict=True):
                dist = np.sqrt(((d - row) ** 2).sum(axis=1))
                dist[ids == q] = np.inf
                if repeated:  # the nearest row of each vec_id, before the cut to k
                    order = np.lexsort((ids, dist))
                    near = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
                else:
                    m = min(k, len(dist))
                    near = np.flatnonzero(dist <= np.partition(dist, m - 1)[m - 1])
                near = near[np.isfinite(dist[near])]
                near = near[np.lexsort((ids[near], dist[near]))][:k]
                x += [q] * len(near)
                y += ids[near].tolist()
                s += dist[near].tolist()
        return pa.table({"query_id": pa.array(x, pa.int64()), "vec_id": pa.array(y, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["part", "d", "q"]
    found = data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every row whose vec_id is divisible by 100."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
