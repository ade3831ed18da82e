"""Random walks, context windows and the skip-gram losses over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_checked, bucketed, discard, looked_up, lookups, written
from edgeloom.functions.hashing import draw, uniform
from edgeloom.functions.vectors import dot, minus_log_sigmoid
from edgeloom.operators import blocks
from edgeloom.operators.graph import Graph, in_order, numbered_neighbours

#: Steps after which the walks so far are written down, so that the plan stays short.
STEPS_PER_TABLE = 4


def _starts(g: Graph, walks_per_node: int) -> DataFrame:
    w = g.nodes().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(walks_per_node - 1))))
    return w.select((F.col("r").cast("long") * g.num_nodes + F.col("id")).alias("walk_id"), F.col("id").alias("at"), F.array("id").alias("walk"))


#: Neighbours that a node may have to be listed in one row; those of others are numbered edges.
LOOK = 64
#: Neighbours that a step of a biased walk draws at once at a node of more than LOOK; if none is accepted it draws up to LOOK.
DRAWS = 4


def _neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(near, far): near (at, dsts array<int>, hub) has a row for each node with neighbours, which lists up to LOOK of them
    in their order, in buckets by node; at hubs, which have more, the list is null, and far (src, i, dst, n) has their
    edges by number, in buckets by both. Without hubs far is none.

    Lists are cut after LOOK + 1 before the shuffle, so a hub sends few rows to its list, and only hubs are numbered."""
    cut = edges.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("dst")).alias("k")).where(F.col("k") <= LOOK + 1)
    lists = cut.groupBy(F.col("src").alias("at")).agg(F.sort_array(F.collect_list("dst")).alias("dsts"))
    hub = F.size("dsts") > LOOK
    near = bucketed(lists.select("at", F.when(~hub, F.col("dsts")).alias("dsts"), hub.alias("hub")), ["at"], "neighbours")
    hubs = near.where("hub").select(F.col("at").alias("src"))
    if hubs.isEmpty():
        return near, None
    some = edges.select("src", "dst").join(broadcast_checked(hubs), "src", "left_semi")
    return near, bucketed(numbered_neighbours(some).select("src", "i", "dst", "n"), ["src", "i"], "far")


def uniform_walks(g: Graph, length: int, walks_per_node: int = 1, seed: int = 0) -> DataFrame:
    """(walk_id, walk array<int> of length nodes): from every node walks_per_node walks, each step to a neighbour drawn
    by a hash of seed, walk and step; a node without neighbours stays where it is.

    A step takes the number drawn from the node's list or, at a hub, joins it with the one edge of that number, so walks
    at a hub spread over its edges. Lists and edges are written once in buckets, and a step shuffles the walkers alone."""
    near, far = _neighbours(g.edges)
    w = _starts(g, walks_per_node)
    last = None
    for step in range(1, length):
        number = lambda n: draw(n, seed, "walk_id", F.lit(step))  # noqa: B023, E731
        met = w.join(near, "at", "left").withColumn("to", F.get("dsts", number(F.greatest(F.size("dsts"), F.lit(1)).cast("long")).cast("int")))
        if far is not None:
            met = written(met.select("walk_id", "at", "walk", "to", F.coalesce("hub", F.lit(False)).alias("hub")), "steps")
            n = far.where("i = 0").select(F.col("src").alias("at"), F.col("n").cast("long").alias("n"))
            drawn = met.where("hub").drop("to").join(n, "at").withColumn("i", number(F.col("n")))
            drawn = drawn.join(far.select(F.col("src").alias("at"), "i", F.col("dst").alias("to")), ["at", "i"])
            discard(*([last] if last is not None else []))
            last, met = met, met.where("not hub").select("walk_id", "at", "walk", "to").unionByName(drawn.select("walk_id", "at", "walk", "to"))
        w = met.select("walk_id", F.coalesce("to", "at").alias("at"), "walk").select("walk_id", "at", F.concat("walk", F.array("at")).alias("walk"))
        if far is None and step % STEPS_PER_TABLE == 0:
            w = written(w, "walks")
            discard(*([last] if last is not None else []))
            last = w
    return w.select("walk_id", "walk")


def biased_walks(g: Graph, length: int, p: float, q: float, walks_per_node: int = 1, seed: int = 0) -> DataFrame:
    """As uniform_walks, by second-order weights: 1/p back to where the walk came from, 1 to its neighbours, 1/q to all
    others; the first step is uniform.

    At a node of up to LOOK neighbours a step looks at all of them and takes the first arrival of exponential races
    (the least of -log(u) / weight). The node's list comes to the walker, which brings along the list of the node before, so
    that both are compared in one row, and a step shuffles each walker once. At hubs it draws
    neighbours by number and takes the first that is accepted, with the chance of its weight over the largest: the same
    chances, at the cost of DRAWS rows for most and LOOK rows for those that accept none of these. The few walks that
    accept none at all look at all neighbours after all. What comes from a hub, whose list no walker brings along, is
    looked up in the hubs' edges. These are written in buckets by node and number, and once more by both ends, so that a
    step shuffles walkers and what they draw, and no edges.
    """
    once = written(g.edges.select("src", "dst").distinct(), "once")
    near, far = _neighbours(once)
    discard(once)
    if far is not None:
        edge = far.select(F.col("src").alias("at"), "i", F.col("dst").alias("x"))
        n = far.where("i = 0").select(F.col("src").alias("at"), F.col("n").cast("long").alias("n"))
        known = bucketed(far.select(F.col("src").alias("prev"), F.col("dst").alias("x")), ["prev", "x"], "known").withColumn("common", F.lit(True))
    most = max(1 / p, 1.0, 1 / q)

    def arrival(step: int, x: Column, weight: Column) -> Column:
        return -F.log(1 - uniform(seed, "walk_id", F.lit(step), x)) / weight

    def weighed(rows: DataFrame, first: bool) -> DataFrame:
        if first:
            return rows.withColumn("weight", F.lit(1.0))
        weight = F.when(F.col("x") == F.col("prev"), 1 / p).when(F.col("common") | F.array_contains("brought", F.col("x")), 1.0).otherwise(1 / q)
        return rows.join(known, ["prev", "x"], "left").withColumn("weight", weight)

    def race(walkers: DataFrame, step: int) -> DataFrame:
        wide = weighed(walkers, step == 1)
        return wide.groupBy("walk_id").agg(F.min_by("x", F.struct(arrival(step, F.col("x"), F.col("weight")), "x")).alias("x"))

    def drawn(walkers: DataFrame, step: int, first: int, last: int) -> DataFrame:
        tries = walkers.select("walk_id", "at", "prev", "brought", "n", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("t")).withColumn("i", draw(F.col("n"), seed, "walk_id", F.lit(step), "t"))
        met = weighed(tries.join(edge, ["at", "i"]), step == 1).where(uniform(seed, "walk_id", F.lit(step), "t", F.lit("accept")) * most < F.col("weight"))
        return met.groupBy("walk_id").agg(F.min_by("x", "t").alias("x"))

    def looked(step: int) -> Column:
        """The next node from the list of neighbours, with the list that the walker has brought; null without a list."""
        if step == 1:
            weight = lambda x: F.lit(1.0)
        else:
            weight = lambda x: F.when(x == F.col("prev"), 1 / p).when(F.array_contains("shared", x), 1.0).otherwise(1 / q)
        return F.array_min(F.transform("dsts", lambda x: F.struct(arrival(step, x, weight(x)).alias("a"), x.alias("x"))))["x"]

    # brought: the neighbours of prev; null at the start, and where prev is a hub, as from_hub tells
    w = _starts(g, walks_per_node).select("walk_id", F.lit(None).cast("int").alias("prev"), F.lit(None).cast("array<int>").alias("brought"), F.lit(False).alias("from_hub"), "at", "walk")
    last: list[DataFrame] = []
    for step in range(1, length):
        met = w.join(near, "at", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
        met = met.withColumn("other", F.col("hub") | F.col("from_hub") & F.col("dsts").isNotNull()).withColumn("shared", F.array_intersect("dsts", F.coalesce("brought", F.array().cast("array<int>"))))
        there = F.when(~F.col("other"), looked(step))
        kept = F.when(F.col("other"), F.col("brought"))  # what only the others still need
        met = written(met.select("walk_id", "prev", "at", "walk", "dsts", "hub", "other", kept.alias("brought"), there.alias("x")), "walks")
        done = met.where("not other")
        if far is not None:
            rest = met.where("other").drop("x")
            many, parts = rest.where("hub").select("walk_id", "at", "prev", "brought").join(n, "at"), []
            for first, end in ((1, min(DRAWS, LOOK)), (DRAWS + 1, LOOK)):
                if first <= end:
                    parts.append(written(drawn(many, step, first, end), "drawn"))
                    many = many.join(parts[-1].select("walk_id"), "walk_id", "left_anti")
            each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")
            wide = many.select("walk_id", "at", "prev", "brought", each).join(edge, ["at", "i"]).select("walk_id", "prev", "brought", "x")
            taken = race(wide.unionByName(rest.where("not hub").select("walk_id", "prev", "brought", F.explode("dsts").alias("x"))), step)
            for part in parts:
                taken = taken.unionByName(part)
            done = done.unionByName(rest.join(taken, "walk_id").select(*done.columns))
        w = done.select("walk_id", F.col("at").alias("prev"), F.col("dsts").alias("brought"), F.col("hub").alias("from_hub"), F.coalesce("x", "at").alias("at"), "walk")
        w = w.select("walk_id", "prev", "brought", "from_hub", "at", F.concat("walk", F.array("at")).alias("walk"))
        discard(*last)
        last = [met, *(parts if far is not None else [])]
    return w.select("walk_id", "walk")


def smallest_neighbour_walks(g: Graph, length: int) -> DataFrame:
    """Walks that draw nothing: step number i goes to the (i modulo degree)-th smallest neighbour. Neighbours are
    numbered in their order once, and a step is an equi-join by node and number, as that of uniform_walks."""
    rows = bucketed(in_order(g.edges.select("src", "dst"), ["dst"], ["src"], "i"), ["src", "i"], "neighbours")
    edge = rows.select(F.col("src").alias("at"), "i", F.col("dst").alias("to"))
    n = written(rows.groupBy(F.col("src").alias("at")).agg(F.count("*").alias("n")), "degrees")
    w = _starts(g, 1)
    for step in range(1, length):
        w = w.join(n, "at", "left").withColumn("i", F.pmod(F.lit(step).cast("long"), F.coalesce("n", F.lit(1)).cast("long")))
        w = w.join(edge, ["at", "i"], "left").select("walk_id", F.coalesce("to", "at").alias("at"), "walk").select("walk_id", "at", F.concat("walk", F.array("at")).alias("walk"))
        if step % STEPS_PER_TABLE == 0:
            w = written(w, "walks")
    return w.select("walk_id", "walk")


def windows(walks: DataFrame, context: int) -> DataFrame:
    """(walk_id, window_idx, window): every stretch of context nodes; walks shorter than that have none."""
    if context < 2:
        raise ValueError("a window has two nodes at least")
    n = F.size("walk") - context
    at = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("walk", i + 1, context))
    return walks.where(n >= 0).select("walk_id", F.posexplode(at).alias("window_idx", "window"))


def negative_windows(walks: DataFrame, num_nodes: int, context: int, per_walk: int = 1, seed: int = 0) -> DataFrame:
    """As windows, over walks of the same start and length whose other nodes are drawn from all nodes."""
    rows = walks.select("walk_id", "walk", F.explode(F.sequence(F.lit(0), F.lit(per_walk - 1))).alias("r"))
    drawn = F.transform(F.sequence(F.lit(2), F.size("walk")), lambda i: draw(num_nodes, seed, "walk_id", "r", i).cast("int"))
    fake = rows.where("size(walk) > 1").select((F.col("walk_id") * per_walk + F.col("r")).alias("walk_id"), F.concat(F.slice("walk", 1, 1), drawn).alias("walk"))
    return windows(fake, context)


def contexts(w: DataFrame) -> DataFrame:
    """(anchor, context): the first node of each window with each of the others."""
    return w.select(F.element_at("window", 1).alias("anchor"), F.explode(F.slice("window", 2, F.size("window"))).alias("context"))


def invalid_steps(walks: DataFrame, g: Graph) -> DataFrame:
    """Steps (walk_id, src, dst) along no edge, except that nodes without edges may stay."""
    steps = walks.select("walk_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("walk") - 1), lambda i: F.struct(F.element_at("walk", i).alias("src"), F.element_at("walk", i + 1).alias("dst")))).alias("s")).select("walk_id", "s.*")
    e = g.edges.select("src", "dst").distinct()
    off = written(steps.join(e, ["src", "dst"], "left_anti"), "off")
    return off.where("src <> dst").unionByName(off.where("src = dst").join(e, "src", "left_semi").select("walk_id", "src", "dst"))


def epoch_order(g: Graph, seed: int, epoch: int) -> DataFrame:
    """(id, key): nodes with the key that shuffles them for an epoch."""
    return g.nodes().select("id", F.xxhash64(F.lit(seed + epoch), "id").alias("key"))


def _with_vectors(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the vectors va and vb of their columns a and b, looked up by broadcast where that is allowed."""
    parts, out = lookups(vectors, "id", "embedding"), pairs
    for key, name in ((a, "va"), (b, "vb")):
        of = lambda t: t.select(F.col("id").alias(key), F.col("embedding").alias(name))  # noqa: B023, E731
        out = looked_up(out, of(vectors), key, name, None if parts is None else [of(t) for t in parts])
    return out


def skipgram_loss(positive: DataFrame, negative: DataFrame, vectors: DataFrame, num_nodes: int, nce_bias: bool = False) -> DataFrame:
    """(loss): the mean of -log sigmoid of the dot products of (anchor, context) pairs, plus that of the negated ones of
    negative pairs; with nce_bias after log(num_nodes) is taken off. Pairs are counted first, so that each different
    one is looked up once; vectors that lie in blocks are met there, by pairs as they come."""
    if blocks.place_of(vectors):
        bias = math.log(num_nodes) if nce_bias else 0.0
        signed = positive.select("anchor", "context", F.lit(1.0).alias("n")).unionByName(negative.select("anchor", "context", F.lit(-1.0).alias("n")))
        sums = blocks.summed(signed, vectors, lambda x, sign: blocks.minus_log_sigmoid(sign * (x - bias)))
        return sums.groupBy("sign").agg((F.sum("l") / F.sum("n")).alias("l")).agg(F.sum("l").alias("loss"))
    shift = F.log(F.lit(float(num_nodes))) if nce_bias else F.lit(0.0)
    both = positive.groupBy("anchor", "context").agg(F.count("*").alias("n")).withColumn("sign", F.lit(1.0)).unionByName(negative.groupBy("anchor", "context").agg(F.count("*").alias("n")).withColumn("sign", F.lit(-1.0)))
    scored = _with_vectors(both, vectors, "anchor", "context").select("sign", "n", minus_log_sigmoid(F.col("sign") * (dot("va", "vb") - shift)).alias("l"))
    return scored.groupBy("sign").agg((F.sum(F.col("n") * F.col("l")) / F.sum("n")).alias("l")).agg(F.sum("l").alias("loss"))


def shared_negative_loss(positive: DataFrame, pool: DataFrame, vectors: DataFrame, num_nodes: int, nce_bias: bool = False) -> DataFrame:
    """(loss): as skipgram_loss, with every window's anchor against all nodes of one pool (id), which must be small: it
    is gathered into one array that each anchor is held against. positive: (anchor, context, first boolean), first for
    one context of each window."""
    shift = F.log(F.lit(float(num_nodes))) if nce_bias else F.lit(0.0)
    pos = positive.groupBy("anchor", "context").agg(F.count("*").alias("n"))
    up = _with_vectors(pos, vectors, "anchor", "context").agg((F.sum(F.col("n") * minus_log_sigmoid(dot("va", "vb") - shift)) / F.sum("n")).alias("l"))
    anchors = positive.where("first").groupBy("anchor").agg(F.count("*").alias("n")).join(vectors.select(F.col("id").alias("anchor"), F.col("embedding").alias("va")), "anchor").withColumn("one", F.lit(1))
    held = pool.join(vectors, "id").agg(F.collect_list("embedding").alias("pool")).withColumn("one", F.lit(1))
    each = F.aggregate("pool", F.lit(0.0), lambda s, v: s + minus_log_sigmoid(-(dot(F.col("va"), v) - shift)))
    down = anchors.join(broadcast_checked(held, 1), "one").agg((F.sum(F.col("n") * each) / F.sum(F.col("n") * F.size("pool"))).alias("l"))
    return up.unionByName(down).agg(F.sum("l").alias("loss"))


def ranked_windows(w: DataFrame) -> DataFrame:
    """windows numbered within their walk, for checks of their order."""
    return w.withColumn("n", F.row_number().over(Window.partitionBy("walk_id").orderBy("window_idx")))
