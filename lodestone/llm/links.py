"""Links between nodes that share a bucket, and the components they form, without all pairs of a group.

`links` first compares each bucket's members with one member of the bucket only (a star); whatever links is one
component from then on. Another star with other centres merges what the first left over. Last come the buckets that still
hold several components: members of small components are compared pair by pair, and each node is held against every large
component of its buckets as a whole, in blocks, so that no linked pair of a bucket stays apart. Pairs inside one component
are never formed, nor pairs with the members of a large one.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import discard, written

LARGE = 16  #: members from which on a component is swept in blocks
STARS = 2  #: star rounds before the remaining pairs
ROWS = 2_000_000  #: rows of buckets whose pairs counted_links forms at once, about
ROUNDS = 16  #: times, at most, that it goes through them


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node of the edges (a, b), by hooking to the smallest neighbour,
    pointer jumping and contraction; the lineage is cut in each round. Edges to oneself and nulls are ignored."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("comp")), "labels")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        parent = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up")), "parents")
        jump = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        parent = written(parent.join(jump, "up", "left").select("node", F.coalesce("upper", "up").alias("up")), "parents")
        labels = written(labels.join(parent.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        a, b = (parent.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        edges = written(edges.where("a <> b").distinct(), "edges")
    return labels


def links(nodes: DataFrame, close: Callable[[str, str], Column], confirm: Callable[[DataFrame], DataFrame], sweep: Callable[[DataFrame, DataFrame], DataFrame], ready: Callable[[], None] = lambda: None, stars: int = STARS, alone: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Confirmed links (a, b) that connect everything which shares a bucket and links, directly or through others.

    nodes: (node, keys, trait), with the node's buckets as an array; cheap to compute again. close: a
    condition on two traits (column names) that every link meets; it is part of the joins, so pairs that fail it are never
    rows. confirm: takes distinct pairs (a, b) and returns those that link. sweep: takes (x, comp), nodes to be held against
    all of a large component, and its members (node, comp), and returns links (a, b): one at least for each x that links
    with a member; the pairs need not be rows. alone: whether one shared bucket is enough for a remaining pair of two traits, which
    needs two else; one always is if not given. ready: called once, when the buckets are dealt out; with alone, nodes are not read after that.
    """
    # dealt out by key once: a window, since a join would not share its shuffle with the counts
    alike = Window.partitionBy("key")
    buckets = nodes.select("node", F.explode("keys").alias("key")).where("key IS NOT NULL")
    buckets = buckets.withColumns({"lo": F.min("node").over(alike), "hi": F.max("node").over(alike)})
    keys = written(buckets.where("lo < hi").select("key", "node"), "shared", drop_shuffles=True)
    shared = written(keys.join(nodes.select("node", "trait"), "node"), "shared", drop_shuffles=True)
    discard(keys)
    ready()
    found = tried = labels = None
    for turn in range(stars):
        rows, labelled = _labelled(shared, labels)
        if rows is None:
            return found
        # the centre changes with each turn, so that one odd member does not decide for its bucket
        order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        hub = F.struct(order.alias("o"), F.col("node").alias("hub"), F.col("comp").alias("hub_comp"), F.col("trait").alias("hub_trait"))
        hubs = written(rows.groupBy("key").agg(F.min(hub).alias("h")).select("key", "h.hub", "h.hub_comp", "h.hub_trait"), "hubs", drop_shuffles=True)
        pairs = rows.join(hubs, (rows["key"] == hubs["key"]) & (F.col("comp") != F.col("hub_comp")) & close("trait", "hub_trait"))
        pairs = pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        new, pairs = _try(pairs, confirm, tried)
        labels = merged(labels, new)
        discard(hubs, labelled)
        found, tried = (new, pairs) if found is None else (found.union(new), tried.union(pairs))
    rows, labelled = _labelled(shared, labels)
    if rows is None:
        return found
    # what is left: pairs of small components one by one, all nodes against each large component in blocks
    sizes = written(labels.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") > LARGE), "sizes")
    rows = written(rows.join(sizes, "comp", "left").select("key", "node", "trait", "comp", F.coalesce("size", F.lit(0)).alias("size")), "rows", drop_shuffles=True)
    discard(shared, labelled)
    small = rows.where("size = 0").drop("size")
    apart = (F.col("key") == F.col("x_key")) & (F.col("comp") != F.col("x_comp")) & (F.col("node") < F.col("x")) & close("trait", "x_trait")
    if not alone:
        small = small.join(nodes.select("node", "keys"), "node")
        apart = apart & (F.col("key") == F.array_min(F.array_intersect("keys", "x_keys")))  # a pair is formed in one of its buckets only
    other = small.select(*[F.col(c).alias("x" if c == "node" else f"x_{c}") for c in small.columns])
    met = small.join(other, apart).select(F.col("node").alias("a"), F.col("x").alias("b"), (alone("trait", "x_trait") if alone else F.lit(True)).alias("alone"))
    # a row for each bucket that a pair shares, so no row carries a node's buckets
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("alone OR n > 1").select("a", "b")
    new, _ = _try(pairs, confirm, tried)
    found = found.union(new)
    return _swept(found, rows, sizes, labels, sweep)


def counted_links(nodes: DataFrame, close: Callable[[str, str], Column], confirm: Callable[[DataFrame], DataFrame], sweep: Callable[[DataFrame, DataFrame], DataFrame], ready: Callable[[], None], alone: Callable[[str, str], Column]) -> DataFrame:
    """links, with one star and `alone`, for many buckets a node and large traits: rows of buckets carry no trait, which is joined to the
    pairs of the star, and to the remaining rows a part of the buckets at a time, so that little is shuffled at once."""
    alike = Window.partitionBy("key")
    buckets = nodes.select("node", F.explode("keys").alias("key")).where("key IS NOT NULL")
    buckets = buckets.withColumns({"lo": F.min("node").over(alike), "hi": F.max("node").over(alike)})
    keys = written(buckets.where("lo < hi").select("key", "node", "lo"), "shared", drop_shuffles=True)
    traits = written(nodes.select("node", "trait"), "traits")
    ready()

    def with_traits(rows: DataFrame, node: str, trait: str) -> DataFrame:
        return rows.join(traits.select(F.col("node").alias(node), F.col("trait").alias(trait)), node)

    star = keys.where("lo < node").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    star = with_traits(with_traits(star, "a", "a_trait"), "b", "b_trait").where(close("a_trait", "b_trait")).select("a", "b")
    found, tried = _try(star, confirm, None)
    labels = components(found)
    sizes = labels.groupBy("comp").agg(F.count("*").alias("size")).select("comp", F.when(F.col("size") > LARGE, F.col("size")).otherwise(0).alias("size"))
    sized = written(labels.join(sizes, "comp"), "sizes", drop_shuffles=True)
    rows = keys.join(sized, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(0)).alias("size"))
    rows = rows.withColumns({"lo": F.min("comp").over(alike), "hi": F.max("comp").over(alike)}).where("lo < hi").drop("lo", "hi")
    rows = written(rows, "rows", drop_shuffles=True)
    discard(keys)
    rounds, met = max(1, min(ROUNDS, -(-rows.count() // ROWS))), []
    for r in range(rounds):
        small = with_traits(rows.where((F.col("size") == 0) & (F.pmod("key", F.lit(rounds)) == r)).select("key", "node", "comp"), "node", "trait")
        other = small.select(*[F.col(c).alias("x" if c == "node" else f"x_{c}") for c in small.columns])
        apart = (F.col("key") == F.col("x_key")) & (F.col("comp") != F.col("x_comp")) & (F.col("node") < F.col("x")) & close("trait", "x_trait")
        pairs = small.join(other, apart).select(F.col("node").alias("a"), F.col("x").alias("b"), alone("trait", "x_trait").alias("alone"))
        met.append(written(pairs, "met", drop_shuffles=True))
    # a row for each bucket that a pair shares
    pairs = reduce(DataFrame.union, met).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("alone OR n > 1").select("a", "b")
    new, _ = _try(pairs, confirm, tried)
    discard(*met, traits)
    return _swept(found.union(new), rows, sized.where("size > 0"), labels, sweep)


def _swept(found: DataFrame, rows: DataFrame, sizes: DataFrame, labels: DataFrame, sweep: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """found and the links of nodes with the large components of their buckets. rows: (key, node, comp, size), of small ones with size 0."""
    if sizes.isEmpty():
        return found
    large = rows.where("size > 0").select(F.col("key").alias("x_key"), F.col("comp").alias("into"), F.col("size").alias("into_size")).distinct()
    lesser = (F.col("size") < F.col("into_size")) | ((F.col("size") == F.col("into_size")) & (F.col("comp") < F.col("into")))
    asks = rows.join(large, (F.col("key") == F.col("x_key")) & (F.col("comp") != F.col("into")) & lesser).select(F.col("node").alias("x"), F.col("into").alias("comp")).distinct()
    asks = written(asks, "asks")
    members = written(labels.join(asks.select("comp").distinct(), "comp", "left_semi"), "members")
    return found.union(written(sweep(asks, members).select("a", "b"), "links"))


def merged(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """labels (node, comp) with the links (a, b) added; only the components that the links touch are worked on."""
    if labels is None:
        return components(new)
    a, b = (labels.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    edges = new.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    roots = components(edges)
    moved = labels.join(roots.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    return written(moved.union(roots.join(labels, "node", "left_anti")), "labels")


def _labelled(shared: DataFrame, labels: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(key, node, trait, comp) of the buckets that still hold several components, None if there are none; and the table it reads, if it
    is not `shared`."""
    if labels is None:
        return shared.select("key", "node", "trait", F.col("node").alias("comp")), None
    rows = shared.join(labels, "node", "left").select("key", "node", "trait", F.coalesce("comp", "node").alias("comp"))
    rows = written(rows, "labelled", drop_shuffles=True)
    mixed = written(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "mixed", drop_shuffles=True)
    return (None if mixed.isEmpty() else rows.join(mixed, "key")), rows


def _try(pairs: DataFrame, confirm: Callable[[DataFrame], DataFrame], tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The links among the pairs that were not tried before, and those pairs."""
    pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs", drop_shuffles=True)
    return written(confirm(pairs).select("a", "b"), "links", drop_shuffles=True), pairs


def in_blocks(asks: DataFrame, members: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """asks (x, comp, m, q) and members (node, comp, m, q), dealt so that each (comp, m, q) holds about `size` of either and
    each x meets each member of its component once."""
    counts = members.groupBy("comp").agg(F.count("*").alias("n")).join(asks.groupBy("comp").agg(F.count("*").alias("w")), "comp")
    counts = written(counts.select("comp", F.ceil(F.col("n") / size).cast("int").alias("ms"), F.ceil(F.col("w") / size).cast("int").alias("qs")), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = asks.join(counts, "comp").select("x", "comp", every("ms").alias("m"), F.pmod(F.xxhash64("x"), F.col("qs")).cast("int").alias("q"))
    y = members.join(counts, "comp").select("node", "comp", F.pmod(F.xxhash64("node"), F.col("ms")).cast("int").alias("m"), every("qs").alias("q"))
    return x, y
