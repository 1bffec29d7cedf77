"""Pairs that need two shared buckets are counted by rows of their buckets: no row carries a node's buckets, which are dealt out once."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import links
from lodestone.llm.common import discard, written


def test_remaining_pairs_without_the_nodes_buckets(spark):
    rng = np.random.RandomState(1)
    rows = [(i, [int(k) for k in rng.choice(40, 4, replace=False)], (i, i % 3 == 0)) for i in range(60)] + [(90, [None, 3], (90, True)), (91, [], (91, True))]
    nodes = written(spark.createDataFrame(rows, "node long, keys array<long>, trait struct<n: long, short: boolean>"), "nodes")
    tried = []

    def confirm(pairs):
        tried.append({tuple(r) for r in pairs.select("a", "b").collect()})
        return pairs.where("false")

    close = lambda x, y: F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) < 30
    alone = lambda x, y: F.col(f"{x}.short") & F.col(f"{y}.short")
    links.links(nodes, close, confirm, lambda asks, members: asks.selectExpr("x AS a", "x AS b"), lambda: discard(nodes), 1, alone)
    shared = {(a[0], b[0]): len({*a[1]} & {*b[1]} - {None}) for a, b in itertools.combinations(rows, 2) if abs(a[0] - b[0]) < 30}
    want = {(a, b) for (a, b), n in shared.items() if n > 1 or n and a % 3 == b % 3 == 0}
    assert len(tried) == 2 and tried[0] | tried[1] >= want and not tried[0] & tried[1]
    assert tried[1] <= want and all(shared[p] for p in tried[0])
