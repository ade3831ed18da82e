"""Enclosing subgraphs of node pairs, and structural labels of their nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_checked, bucketed, discard, looked_up, lookups, shared_dir, written
from edgeloom.functions.hashing import draw, uniform
from edgeloom.operators import blocks
from edgeloom.operators.graph import in_order, numbered_neighbours, swapped


def k_hop_nodes(pairs: DataFrame, edges: DataFrame, hops: int, max_per_hop: int | None = None, ratio: float = 1.0, oversample: float | None = None, seed: int = 0) -> DataFrame:
    """(pair_id, node_id, dist): for each pair (pair_id, src, dst) the nodes within hops of either end, with the hop at
    which they are first met; the ends have 0.

    Every hop is a join of the frontier with the edges and an anti-join with what is known. ratio keeps that share of a
    hop's new nodes and max_per_hop so many at most, drawn by a hash of seed, pair and node. With oversample and
    max_per_hop a frontier node is expanded to ceil(max_per_hop * oversample / frontier) neighbours, drawn with
    repetition where it has more, so that hubs stay cheap.
    """
    ends = F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id")
    known = frontier = pairs.select("pair_id", ends).withColumn("dist", F.lit(0))
    rows = bucketed(numbered_neighbours(edges), ["src", "i"], "neighbours") if oversample and max_per_hop else None
    for hop in range(1, hops + 1):
        if rows is None:
            near = frontier.select("pair_id", F.col("node_id").alias("src")).join(edges.select("src", "dst"), "src").select("pair_id", F.col("dst").alias("node_id"))
        else:
            each = F.greatest(F.lit(1), F.ceil(F.lit(max_per_hop * oversample) / F.count("*").over(Window.partitionBy("pair_id")))).cast("int")
            wide = frontier.select("pair_id", F.col("node_id").alias("src"), each.alias("k")).join(rows.where("i = 0").select("src", "n"), "src")
            drawn = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: draw(F.col("n"), seed, "pair_id", "src", F.lit(hop), i))
            asked = wide.select("pair_id", "src", F.explode(F.when(F.col("n") <= F.col("k"), F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).otherwise(drawn)).alias("i"))
            near = asked.join(rows.select("src", F.col("i").cast("long").alias("i"), "dst"), ["src", "i"]).select("pair_id", F.col("dst").alias("node_id"))
        if ratio < 1 or max_per_hop is not None:
            # rows lie by pair, so that neither repeats nor known nodes nor the windows shuffle them again
            met = near.withColumn("dist", F.lit(hop)).unionByName(known.select("pair_id", "node_id", "dist")).repartition("pair_id")
            fresh = met.groupBy("pair_id", "node_id").agg(F.min("dist").alias("dist")).where(F.col("dist") == hop).select("pair_id", "node_id")
            w = Window.partitionBy("pair_id").orderBy(uniform(seed, "pair_id", "node_id", F.lit(hop)), "node_id")
            n = F.count("*").over(Window.partitionBy("pair_id"))
            most = F.floor(n * ratio) if ratio < 1 else n
            most = F.least(most, F.lit(max_per_hop)) if max_per_hop is not None else most
            fresh = fresh.select("*", F.row_number().over(w).alias("__n"), most.alias("__most")).where("__n <= __most").select("pair_id", "node_id")
        else:
            fresh = near.distinct().join(known.select("pair_id", "node_id"), ["pair_id", "node_id"], "left_anti")
        frontier = written(fresh.withColumn("dist", F.lit(hop)), "frontier")
        known = known.unionByName(frontier)
        if hop < hops and frontier.isEmpty():
            break
    return known


def _once(edges: DataFrame) -> DataFrame:
    """Each edge between different nodes once, as src < dst, whichever way and however often it is stored."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _low_end_first(edges: DataFrame) -> DataFrame:
    """The different edges (src, dst), as (low, high, ahead, w) by the end of fewer neighbours, as a written table: ahead
    says whether low is src, and w how often the edge is stored."""
    stored = edges.groupBy("src", "dst").agg(F.count("*").cast("int").alias("w"))
    n = stored.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    ends = stored.join(n.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
    ahead = F.col("a") <= F.col("b")
    return written(ends.select(F.when(ahead, F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(ahead, F.col("dst")).otherwise(F.col("src")).alias("high"), ahead.alias("ahead"), "w"), "oriented")


def _inside(pairs: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges (pair_id, u, v, w) between a pair's nodes, as they are stored, without the link between its ends. An edge
    is found from its end of fewer neighbours, so that a hub in many subgraphs isn't expanded for each."""
    first = nodes.select("pair_id", F.col("node_id").alias("low")).join(pairs.select("pair_id", "src", "dst"), "pair_id")
    target = ((F.col("low") == F.col("src")) & (F.col("high") == F.col("dst"))) | ((F.col("low") == F.col("dst")) & (F.col("high") == F.col("src")))
    out = first.join(ends, "low").where(~target).select("pair_id", "low", "high", "ahead", "w")
    both = out.join(nodes.select("pair_id", F.col("node_id").alias("high")), ["pair_id", "high"])
    return both.select("pair_id", F.when(F.col("ahead"), F.col("low")).otherwise(F.col("high")).alias("u"), F.when(F.col("ahead"), F.col("high")).otherwise(F.col("low")).alias("v"), "w")


def induced_pairwise(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, u, v, w): edges between different nodes of each pair's subgraph, both ways, each once with w = 1,
    whichever way and however often they are stored."""
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")
    return _inside(pairs, nodes, _low_end_first(_once(edges))).select("pair_id", both).select("pair_id", "x.u", "x.v", F.lit(1).alias("w"))


def induced_scan(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, u, v, w): edges as they are stored, self-loops too; w counts parallel ones."""
    return _inside(pairs, nodes, _low_end_first(edges))


#: Links of a node within a pair's subgraph that one bucket holds; those of a hub are dealt into slots of about so many.
SLOT_LINKS = 1 << 16

#: Labels that need distances in the subgraph: whether either end is taken out while the other's are measured, and
#: what a distance is held to, which also stands for nodes out of reach; DRNL has no such bound.
CAP_DE, CAP_DE_PLUS = 3, 100
DISTANCE_LABELS: dict[str, tuple[bool, int | None]] = {"drnl": (True, None), "de": (False, CAP_DE), "de+": (True, CAP_DE_PLUS)}


def end_distances(pairs: DataFrame, sub_edges: DataFrame, removed: bool, most: int | None = None) -> DataFrame:
    """(pair_id, node_id, s, t): how far each node of a pair's subgraph is from src and from dst along its edges,
    whichever way they are stored, up to most steps; null where there is no such way. With removed the ways from one
    end never meet the other end, which itself has distance 0 from it. Nodes that neither end reaches have no row.

    Breadth-first search from both ends of all pairs at once. A round joins the frontier (pair, end, node) with the
    pairs' edges, which are written once in buckets by pair and node, so that only the frontier is shuffled, and keeps
    what an anti-join with the rounds before leaves. A hub's links are dealt into slots, and its frontier row asks each. Rounds end with an empty frontier, so that they are as many as the
    longest of the shortest ways."""
    once = written(sub_edges.where("u <> v").select("pair_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "ways")
    both = F.array(F.struct(F.col("u").alias("at"), F.col("v").alias("node_id")), F.struct(F.col("v").alias("at"), F.col("u").alias("node_id")))
    ways = once.select("pair_id", F.explode(both).alias("x")).select("pair_id", "x.*")
    large = broadcast_checked(written(once.groupBy("pair_id").agg(F.count("*").alias("n")).where(F.col("n") > SLOT_LINKS).select("pair_id"), "large"))
    hubs = ways.join(large, "pair_id", "left_semi").groupBy("pair_id", "at").agg(F.count("*").alias("n")).where(F.col("n") > SLOT_LINKS)
    hubs = broadcast_checked(written(hubs.select("pair_id", "at", F.ceil(F.col("n") / SLOT_LINKS).cast("int").alias("slots")), "hubs"))
    dealt = ways.join(hubs, ["pair_id", "at"], "left").select("pair_id", "at", F.coalesce(F.pmod(F.xxhash64("node_id"), F.col("slots")).cast("int"), F.lit(0)).alias("slot"), "node_id")
    ways = bucketed(dealt, ["pair_id", "at", "slot"], "ways")
    discard(once)
    shut = lambda c: F.col(c) if removed else F.lit(None).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("src").alias("node_id"), shut("dst").alias("shut")), F.struct(F.lit(1).alias("end"), F.col("dst").alias("node_id"), shut("src").alias("shut")))
    frontier = written(pairs.select("pair_id", F.explode(ends).alias("x")).select("pair_id", "x.*", F.lit(0).alias("d")), "frontier")
    known, step = frontier, 0
    while most is None or step < most:
        step += 1
        at = frontier.select("pair_id", "end", F.col("node_id").alias("at"), "shut").join(hubs, ["pair_id", "at"], "left")
        at = at.select("pair_id", "end", "at", "shut", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("slot"))
        near = at.join(ways, ["pair_id", "at", "slot"]).where("shut is null or node_id <> shut")
        near = near.groupBy("pair_id", "end", "node_id").agg(F.first("shut").alias("shut"))  # lies as the anti-join wants it
        frontier = written(near.join(known, ["pair_id", "end", "node_id"], "left_anti").withColumn("d", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    of = lambda end: F.min(F.when(F.col("end") == end, F.col("d")))
    found = written(known.groupBy("pair_id", "node_id").agg(of(0).alias("s"), of(1).alias("t")), "distances")
    discard(ways)
    if not removed:
        return found
    return found.select("pair_id", "node_id", F.when(F.col("t") == 0, 0).otherwise(F.col("s")).alias("s"), F.when(F.col("s") == 0, 0).otherwise(F.col("t")).alias("t"))


def _degree_label(d: Column) -> Column:
    return F.array(F.least(F.coalesce(d, F.lit(0)), F.lit(100)).cast("int"))


def _distance_label(cap: int | None) -> Column:
    """The label of columns s and t: both, held to cap, or without cap DRNL's number."""
    s, t = F.col("s"), F.col("t")
    if cap is not None:
        return F.array(*[F.coalesce(F.least(x, F.lit(cap)), F.lit(cap)) for x in (s, t)])
    half, odd = F.floor((s + t) / 2).cast("int"), (s + t) % 2
    return F.array(F.when((s == 0) | (t == 0), 1).when(s.isNull() | t.isNull(), 0).otherwise(1 + F.least(s, t) + half * (half + odd - 1)).cast("int"))


def labels(pairs: DataFrame, nodes: DataFrame, sub_edges: DataFrame, kind: str) -> DataFrame:
    """(pair_id, node_id, z array<int>): the structural label of every node of each pair's subgraph. hop, zo and degree
    are plain expressions; drnl, de and de+ come from end_distances, where an end is a node at distance 0; others give 0."""
    if kind == "hop":
        return nodes.select("pair_id", "node_id", F.array("dist").alias("z"))
    if kind == "zo":
        return nodes.select("pair_id", "node_id", F.array((F.col("dist") == 0).cast("int")).alias("z"))
    if kind == "degree":
        n = sub_edges.groupBy("pair_id", F.col("v").alias("node_id")).agg(F.sum("w").alias("d"))
        return nodes.join(n, ["pair_id", "node_id"], "left").select("pair_id", "node_id", _degree_label(F.col("d")).alias("z"))
    if kind not in DISTANCE_LABELS:
        return nodes.select("pair_id", "node_id", F.array(F.lit(0)).alias("z"))
    removed, cap = DISTANCE_LABELS[kind]
    far = end_distances(pairs, sub_edges, removed, None if cap is None else cap - 1)
    return nodes.join(far, ["pair_id", "node_id"], "left").select("pair_id", "node_id", _distance_label(cap).alias("z"))


def local_ids(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pair_id, node_id, dist, local_id): nodes with their number in the pair's subgraph: 0 and 1 for the ends, then by
    hop and id."""
    first = F.when(F.col("node_id") == F.col("src"), 0).when(F.col("node_id") == F.col("dst"), 1).otherwise(2)
    placed = nodes.join(pairs.select("pair_id", "src", "dst"), "pair_id").select("pair_id", "node_id", "dist", first.alias("__first"))
    return in_order(placed, ["__first", "dist", "node_id"], ["pair_id"], "local_id").select("pair_id", "node_id", "dist", F.col("local_id").cast("int").alias("local_id"))


@dataclass(frozen=True)
class Batches:
    """Batches of subgraphs, each the disjoint union of its graphs. graphs: (batch, graph, pair_id, src, dst, num_nodes,
    first_node, and what else pairs has); nodes: (batch, node, graph, node_id, dist, z); edges: (batch, graph, u, v, w),
    u and v being nodes of the batch."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame


def batched(pairs: DataFrame, nodes: DataFrame, sub_edges: DataFrame, size: int, labels: DataFrame | None = None, order: str = "pair_id") -> Batches:
    """The subgraphs of pairs (pair_id, src, dst, ...) as input for training: size pairs a batch, in the order of a
    column, number graph of a batch from 0. A graph's nodes have its local ids after those of the graphs before it in
    the batch: a prefix sum over the size graphs of a batch, and over no more. Edges are rewritten to these by two
    joins. labels: (pair_id, node_id, z), null without. Pairs without any node have no graph's nodes, but a graph."""
    numbered = written(in_order(pairs, [order]), "numbered")
    local = written(local_ids(pairs, nodes), "local")
    count = local.groupBy("pair_id").agg(F.count("*").alias("num_nodes"))
    graphs = numbered.join(count, "pair_id", "left").withColumn("num_nodes", F.coalesce("num_nodes", F.lit(0)))
    graphs = graphs.withColumn("batch", F.floor(F.col("pos") / size).cast("long")).withColumn("graph", F.pmod("pos", F.lit(size)).cast("int"))
    before = Window.partitionBy("batch").orderBy("graph").rowsBetween(Window.unboundedPreceding, 0)
    graphs = written(graphs.withColumn("first_node", F.sum("num_nodes").over(before) - F.col("num_nodes")).drop("pos"), "graphs")
    at = local.join(graphs.select("pair_id", "batch", "graph", "first_node"), "pair_id").withColumn("node", F.col("first_node") + F.col("local_id"))
    at = written(at.select("pair_id", "batch", "graph", "node", "node_id", "dist"), "placed")
    known = at.join(labels.select("pair_id", "node_id", "z"), ["pair_id", "node_id"], "left") if labels is not None else at.withColumn("z", F.lit(None).cast("array<int>"))
    u, v = (at.select("pair_id", F.col("node_id").alias(c), F.col("node").alias(f"{c}_node")) for c in ("u", "v"))
    edges = sub_edges.join(u, ["pair_id", "u"]).join(v, ["pair_id", "v"]).join(graphs.select("pair_id", "batch", "graph"), "pair_id")
    return Batches(
        graphs.select("batch", "graph", *pairs.columns, "num_nodes", "first_node"), known.select("batch", "node", "graph", "node_id", "dist", "z"),
        edges.select("batch", "graph", F.col("u_node").alias("u"), F.col("v_node").alias("v"), "w"),
    )


def sort_pool_size(sizes: DataFrame, k: float) -> DataFrame:
    """(k): how many nodes sort pooling keeps, from subgraph sizes (n): k itself if above 1, else the size at that
    share of the graphs, and 10 at least."""
    if k > 1:
        return sizes.sparkSession.range(1).select(F.lit(int(k)).alias("k"))
    share = f"percentile_disc({k if k > 0 else 1.0}) within group (order by n)"
    return sizes.agg(F.greatest(F.lit(10), F.expr(share).cast("int")).alias("k"))


def mean_pool(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair_id, pooled array<double>): the mean of the vectors (id, embedding) of each pair's nodes that have one."""
    dim = (vectors.select(F.size("embedding")).first() or [0])[0]
    met = nodes.select("pair_id", F.col("node_id").alias("id")).join(vectors.select("id", "embedding"), "id")
    return met.groupBy("pair_id").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(dim)]).select("pair_id", F.array(*[f"m{i}" for i in range(dim)]).alias("pooled"))


def sort_pool(nodes: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(pair_id, pooled array<double>): the vectors of each pair's k nodes of the largest last component, largest first,
    ties to smaller ids, side by side, and zeros for what is missing. Tasks pass on k nodes of a pair at most."""
    dim = (vectors.select(F.size("embedding")).first() or [0])[0]
    met = nodes.select("pair_id", F.col("node_id").alias("id")).join(vectors.select("id", F.col("embedding").cast("array<double>").alias("e")), "id")
    w = Window.partitionBy("pair_id").orderBy(F.desc(F.element_at("e", -1)), "id")
    top = met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]))
    rows = top.groupBy("pair_id").agg(flat.alias("x"))
    return rows.select("pair_id", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(k * dim) - F.size("x"))).alias("pooled"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): the triangles of the graph, each once, whichever way and however often edges are stored, as a written
    table. A triangle is found from its node of the fewest neighbours, so that hubs make no more wedges than others."""
    ends = _low_end_first(_once(edges)).select("low", "high")
    wedges = ends.select("low", F.col("high").alias("b")).join(ends.select("low", F.col("high").alias("c")), "low").where("b < c")
    return written(wedges.join(ends.select(F.least("low", "high").alias("b"), F.greatest("low", "high").alias("c")), ["b", "c"]).select(F.col("low").alias("a"), "b", "c"), "triangles")


def _sides(found: DataFrame) -> DataFrame:
    """(src, dst, id): of triangles, for each edge, as src < dst, the neighbours that its ends share."""
    sides = F.array(*[F.struct(F.least(u, v).alias("src"), F.greatest(u, v).alias("dst"), F.col(w).alias("id")) for u, v, w in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))])
    return found.select(F.explode(sides).alias("x")).select("x.*")


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """(src, dst, id): for each edge, as src < dst, the neighbours that its ends share, however edges are stored."""
    return _sides(triangles(edges))


def near_mean_pool(pairs: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """mean_pool of the one-hop subgraphs of pairs (pair_id, src, dst), src < dst, that are edges of a symmetric graph without
    loops. Such a subgraph is what the ends' neighbours are together, so its sum is that of either end's neighbours,
    made once for each node, less that of the neighbours they share, which are the graph's triangles: no subgraph is
    spread out. Vectors with components that are null or not finite, which sums can't be taken back from, are pooled by
    mean_pool."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not vectors.where(odd).isEmpty():
        return mean_pool(k_hop_nodes(pairs, edges, 1), vectors)
    dim = (vectors.select(F.size("embedding")).first() or [0])[0]
    vectors = vectors.select("id", "embedding")
    parts = lookups(vectors, "id", "embedding")

    def sums(rows: DataFrame, by: list[str]) -> DataFrame:
        met = looked_up(rows, vectors, "id", "embedding", parts)
        each = met.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.col("embedding")[i].cast("double")).alias(f"s{i}") for i in range(dim)])
        return each.select(*by, "n", F.array(*[f"s{i}" for i in range(dim)]).alias("s"))

    around = written(sums(edges.select("src", F.col("dst").alias("id")).repartition("src").distinct(), ["src"]), "around")
    shared = sums(_sides(triangles(edges)), ["src", "dst"]).select("src", "dst", F.col("n").alias("cn"), F.col("s").alias("cs"))
    at = lookups(around, "src", "s")
    out = pairs.select("pair_id", "src", "dst").join(shared, ["src", "dst"], "left")
    for end, x in (("src", "a"), ("dst", "b")):
        side = around.select(F.col("src").alias(end), F.col("n").alias(f"{x}n"), F.col("s").alias(f"{x}s"))
        out = looked_up(out, side, end, f"{x}s", at if at is None else [t.select(F.col("src").alias(end), F.col("n").alias(f"{x}n"), F.col("s").alias(f"{x}s")) for t in at], "left")
    n = F.coalesce("an", F.lit(0)) + F.coalesce("bn", F.lit(0)) - F.coalesce("cn", F.lit(0))
    none = F.array_repeat(F.lit(0.0), dim)
    total = F.zip_with(F.zip_with(F.coalesce("as", none), F.coalesce("bs", none), lambda x, y: x + y), F.coalesce("cs", none), lambda x, y: x - y)
    return out.where(n > 0).select("pair_id", F.transform(total, lambda x: x / n).alias("pooled"))


def near_sort_pool(pairs: DataFrame, edges: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """sort_pool of the one-hop subgraphs of pairs (pair_id, src, dst): a pair's k nodes are among the k of either end with
    its neighbours, which are found once for each node, by their last component alone, or by a column key of vectors where there is
    one. Tasks read these lists and the vectors that any of them names from the shared folder, as blocks says, so that a pair is shuffled as
    three ids. Where Arrow can't read that folder, or vectors are null, of unequal lengths or hold null, or keys are null or NaN, pairs meet
    lists and vectors by equi-joins."""
    spark = pairs.sparkSession
    dim = (vectors.select(F.size("embedding")).first() or [0])[0]
    key = F.col("key") if "key" in vectors.columns else F.element_at("embedding", -1)
    keyed = vectors.select("id", key.cast("double").alias("key"))
    near = edges.select("src", F.col("dst").alias("id")).unionByName(vectors.select(F.col("id").alias("src"), "id")).distinct().join(keyed, "id")
    w = Window.partitionBy("src").orderBy(F.desc("key"), "id")
    best = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("src").agg(F.collect_list(F.struct("key", (-F.col("id")).alias("id"))).alias("best"))
    best = written(best, "best")
    held = vectors.select("id", F.col("embedding").alias("e"))
    odd = F.col("embedding").isNull() | (F.size("embedding") != dim) | F.exists("embedding", lambda x: x.isNull()) | key.isNull() | F.isnan(key)
    if dim > 0 and blocks.reachable(spark, shared_dir(spark)) and vectors.where(odd).isEmpty():
        n = blocks.blocks_for(vectors.count(), pairs.count())
        lists = best.select(F.col("src").alias("id"), F.transform("best", lambda x: F.struct(x["key"].alias("key"), (-x["id"]).cast("long").alias("id"))).alias("best"))
        named = best.select(F.explode("best").alias("x")).select((-F.col("x.id")).alias("id")).distinct()
        held = blocks.laid(vectors.join(named, "id", "left_semi").select("id", "embedding"), n)
        return blocks.best_side_by_side(pairs, blocks.dealt(lists, "id", n, "lists"), blocks.place_of(held), k, dim)
    a, b = (best.select(F.col("src").alias(end), F.col("best").alias(x)) for end, x in (("src", "a"), ("dst", "b")))
    none = F.expr(f"cast(array() as {dict(best.dtypes)['best']})")
    both = F.array_distinct(F.concat(F.coalesce("a", none), F.coalesce("b", none)))
    top = F.transform(F.slice(F.sort_array(both, asc=False), 1, k), lambda x: -x["id"])
    rows = pairs.select("pair_id", "src", "dst").join(a, "src", "left").join(b, "dst", "left").select("pair_id", top.alias("ids")).where(F.size("ids") > 0)
    met = rows.select("pair_id", F.posexplode("ids").alias("n", "id")).join(held, "id")
    rows = met.groupBy("pair_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda x: x["e"])).alias("x"))
    x = F.col("x").cast("array<double>")
    return rows.select("pair_id", F.concat(x, F.array_repeat(F.lit(0.0), F.lit(k * dim) - F.size("x"))).alias("pooled"))


def _squares(edges: DataFrame) -> DataFrame:
    """(src, dst, by_src, by_dst): for each edge, as src < dst, and each way around it over three others, by_src being the
    neighbour of src and by_dst that of dst. A ring of four is found from its node of the most neighbours, as two
    nodes that both link that one with the one across, so that hubs aren't wedged through."""
    once = _once(edges)
    both = once.unionByName(swapped(once))
    n = both.groupBy("src").agg(F.count("*").alias("n"))
    both = both.join(n, "src").join(n.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
    rank = F.struct(F.col("m").alias("n"), F.col("dst").alias("id"))
    sides = both.select(F.col("src").alias("c"), F.col("dst").alias("x"), rank.alias("r"), (rank > F.struct("n", F.col("src").alias("id"))).alias("up"))
    a, b = sides.where("up").select("c", F.col("x").alias("a"), F.col("r").alias("ar")), sides.select("c", F.col("x").alias("b"), F.col("r").alias("br"))
    wedges = a.join(b, "c").where("br < ar").select("a", "b", "c")
    rings = wedges.join(wedges.withColumnRenamed("c", "d"), ["a", "b"]).where("c < d")

    def around(x: str, y: str, p: str, q: str) -> Column:  # y next to p, p to q, q to x
        first = F.col(x) < F.col(y)
        return F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), F.when(first, F.col(q)).otherwise(F.col(p)).alias("by_src"), F.when(first, F.col(p)).otherwise(F.col(q)).alias("by_dst"))

    sides = F.array(around("a", "c", "b", "d"), around("c", "b", "d", "a"), around("b", "d", "a", "c"), around("d", "a", "c", "b"))
    return rings.select(F.explode(sides).alias("x")).select("x.*")


@dataclass(frozen=True)
class Near:
    """The one-hop subgraphs of pairs (pair_id, src, dst), src < dst, that are edges of a symmetric graph without loops, in
    parts that are no larger than what they say, none of them a row for every link. inner: (pair_id, u, v, us, ut, vs,
    vt), links u < v that meet neither end, and whether u and v (1 or 0) are neighbours of src and of dst, a written
    table; shared: (pair_id, n), pairs whose ends share neighbours, and how many, a written table. All other links are
    those of the ends with their neighbours, which star gives from the edges themselves."""

    pairs: DataFrame
    edges: DataFrame
    inner: DataFrame
    shared: DataFrame

    def star(self, *more: str) -> DataFrame:
        """(pair_id, node_id, s, t, end): each end's neighbours but the other end, with s = 1 for src, t = 1 for dst,
        null else, the end, and what else pairs has by more."""
        e = self.edges.select(F.col("src").alias("end"), F.col("dst").alias("node_id"))
        sides = []
        for end, other, s, t in (("src", "dst", 1, None), ("dst", "src", None, 1)):
            near = self.pairs.select("pair_id", F.col(end).alias("end"), F.col(other).alias("__other"), *more).join(e, "end").where("node_id <> __other")
            sides.append(near.select("pair_id", "node_id", F.lit(s).cast("int").alias("s"), F.lit(t).cast("int").alias("t"), "end", *more))
        return sides[0].unionByName(sides[1])


def near(pairs: DataFrame, edges: DataFrame) -> Near:
    """The one-hop subgraphs of pairs that are edges. Links that meet neither end come from the graph's triangles, each
    once for the pairs of each of its nodes, and its rings of four, so that no two neighbours are tried for a link."""
    pairs = pairs.select("pair_id", "src", "dst")
    edges = written(edges.select("src", "dst").distinct(), "edges")
    tri = triangles(edges)
    corners = F.array(*[F.struct(F.col(x).alias("end"), F.least(u, v).alias("u"), F.greatest(u, v).alias("v")) for x, u, v in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))])
    across = tri.select(F.explode(corners).alias("x")).select("x.*")
    by_end = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("src").alias("end"), F.col("dst").alias("other"), F.lit(1).alias("s"), F.lit(0).alias("t")), F.struct(F.col("dst").alias("end"), F.col("src").alias("other"), F.lit(0).alias("s"), F.lit(1).alias("t")))).alias("x")).select("pair_id", "x.*")
    one = across.join(by_end, "end").where("u <> other and v <> other").select("pair_id", "u", "v", F.col("s").alias("us"), F.col("t").alias("ut"), F.col("s").alias("vs"), F.col("t").alias("vt"))
    two = _squares(edges).join(pairs, ["src", "dst"])
    first = (F.col("by_src") < F.col("by_dst")).cast("int")
    two = two.select("pair_id", F.least("by_src", "by_dst").alias("u"), F.greatest("by_src", "by_dst").alias("v"), first.alias("us"), (1 - first).alias("ut"), (1 - first).alias("vs"), first.alias("vt"))
    flags = ["us", "ut", "vs", "vt"]
    inner = written(one.unionByName(two).groupBy("pair_id", "u", "v").agg(*[F.max(c).alias(c) for c in flags]), "inner")
    shared = written(_sides(tri).groupBy("src", "dst").agg(F.count("*").alias("n")).join(pairs, ["src", "dst"]).select("pair_id", "n"), "shared")
    discard(tri)
    return Near(pairs, edges, inner, shared)


def near_induced(at: Near) -> DataFrame:
    """induced_pairwise of one-hop subgraphs: (pair_id, u, v, w)."""
    links = at.star().select("pair_id", F.col("end").alias("u"), F.col("node_id").alias("v")).unionByName(at.inner.select("pair_id", "u", "v"))
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")
    return links.select("pair_id", both).select("pair_id", "x.u", "x.v", F.lit(1).alias("w"))


def _inner_distances(at: Near, most: int | None) -> DataFrame:
    """(pair_id, node_id, s, t): how far nodes with links that meet neither end are from src and dst without the other
    one, up to most steps: a breadth-first search over these links alone, from the ends' neighbours among them."""
    sides = F.array(*[F.struct(F.col(x).alias("node_id"), F.col(y).alias("to"), F.col(f"{x}s").alias("s"), F.col(f"{x}t").alias("t")) for x, y in (("u", "v"), ("v", "u"))])
    ways = written(at.inner.select("pair_id", F.explode(sides).alias("x")).select("pair_id", "x.*"), "ways")
    flagged = F.filter(F.array(F.when(F.col("s") == 1, 0), F.when(F.col("t") == 1, 1)), lambda x: x.isNotNull())
    frontier = written(ways.select("pair_id", F.explode(flagged).alias("end"), "node_id").distinct().withColumn("d", F.lit(1)), "frontier")
    known, step, steps = frontier, 1, ways.select("pair_id", "node_id", "to")
    while most is None or step < most:
        step += 1
        there = frontier.select("pair_id", "end", "node_id").join(steps, ["pair_id", "node_id"]).select("pair_id", "end", F.col("to").alias("node_id")).distinct()
        frontier = written(there.join(known, ["pair_id", "end", "node_id"], "left_anti").withColumn("d", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    of = lambda end: F.when(F.col("end") == end, F.col("d"))
    return known.select("pair_id", "node_id", of(0).alias("s"), of(1).alias("t"))


def near_labels(at: Near, kind: str) -> DataFrame:
    """labels of one-hop subgraphs: (pair_id, node_id, z), for degree, drnl, de and de+. A node's row is shuffled once, for
    each end that it is a neighbour of. Distances beyond one come from links that meet neither end; de's, which may lead
    over the other end, are held to three, and three are what such a way has at least, except that the ends are two
    apart if they share a neighbour."""
    if kind == "degree":
        return _near_nodes(at).select("pair_id", "node_id", _degree_label(F.col("d")).alias("z"))
    removed, cap = DISTANCE_LABELS[kind]
    if not removed and (cap is None or cap > 3):
        raise ValueError("ways over the other end are looked at up to three steps")
    inner = _inner_distances(at, None if cap is None else cap - 1)
    apart = F.lit(0) if removed else F.when(F.col("n").isNotNull(), 2)
    joined = at.pairs if removed else at.pairs.join(at.shared, "pair_id", "left")
    ends = joined.select("pair_id", F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("s"), apart.alias("t")), F.struct(F.col("dst").alias("node_id"), apart.alias("s"), F.lit(0).alias("t")))).alias("x")).select("pair_id", "x.*")
    rows = at.star().select("pair_id", "node_id", "s", "t").unionByName(inner).unionByName(ends)
    return rows.groupBy("pair_id", "node_id").agg(F.min("s").alias("s"), F.min("t").alias("t")).select("pair_id", "node_id", _distance_label(cap).alias("z"))


def _near_nodes(at: Near, *more: str) -> DataFrame:
    """(pair_id, node_id, first, s, t, d, and what else pairs has by more): all nodes of the subgraphs; first is 0 and 1
    for the ends and 2 for others, s and t are 1 for neighbours of src and dst, d is the node's links, inner 1 if any of them meets neither end. Rows lie by pair_id,
    as each pair's are numbered next."""
    n = at.edges.groupBy("src").agg((F.count("*") - 1).alias("n"))
    sides = at.pairs.join(n.withColumnRenamed("n", "a"), "src").join(n.select(F.col("src").alias("dst"), F.col("n").alias("b")), "dst")
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("first"), F.col("a").alias("d")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("first"), F.col("b").alias("d")))
    ends = sides.select("pair_id", *more, F.explode(ends).alias("x")).select("pair_id", "x.*", F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("t"), F.lit(0).alias("inner"), *more)
    star = at.star(*more).select("pair_id", "node_id", F.lit(2).alias("first"), F.lit(1).cast("long").alias("d"), "s", "t", F.lit(0).alias("inner"), *more)
    inner = at.inner.select("pair_id", F.explode(F.array("u", "v")).alias("node_id")).groupBy("pair_id", "node_id").agg(F.count("*").alias("d"))
    none = [F.lit(None).cast(dict(at.pairs.dtypes)[c]).alias(c) for c in more]
    inner = inner.select("pair_id", "node_id", F.lit(2).alias("first"), "d", F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("t"), F.lit(1).alias("inner"), *none)
    rows = ends.unionByName(star).unionByName(inner).repartition("pair_id")
    return rows.groupBy("pair_id", "node_id").agg(F.sum("d").alias("d"), *[F.max(c).alias(c) for c in ("first", "s", "t", "inner", *more)])


def near_batched(pairs: DataFrame, edges: DataFrame, size: int) -> Batches:
    """batched of one-hop subgraphs in the order of pair_id, labelled by degree. How many nodes a pair has, and so where
    its nodes begin in the batch, is known from degrees and shared neighbours before any node is looked at; links of
    the ends take their numbers from the nodes' rows, and only links that meet neither end are looked up."""
    at = near(pairs, edges)
    n = at.edges.groupBy("src").agg(F.count("*").alias("n"))
    graphs = in_order(at.pairs, ["pair_id"]).join(n.withColumnRenamed("n", "a"), "src").join(n.select(F.col("src").alias("dst"), F.col("n").alias("b")), "dst")
    graphs = graphs.join(at.shared, "pair_id", "left").withColumn("num_nodes", F.col("a") + F.col("b") - F.coalesce("n", F.lit(0)))
    graphs = graphs.withColumn("batch", F.floor(F.col("pos") / size).cast("long")).withColumn("graph", F.pmod("pos", F.lit(size)).cast("int"))
    before = Window.partitionBy("batch").orderBy("graph").rowsBetween(Window.unboundedPreceding, 0)
    graphs = written(graphs.select("pair_id", "src", "dst", "batch", "graph", "num_nodes", (F.sum("num_nodes").over(before) - F.col("num_nodes")).alias("first_node")), "graphs")
    more = ["batch", "graph", "first_node"]
    found = _near_nodes(Near(graphs, at.edges, at.inner, at.shared), *more)
    # the ends' rows have all of more, and so has every other row with a neighbour
    local = F.row_number().over(Window.partitionBy("pair_id").orderBy("first", "node_id")) - 1
    placed = found.select("pair_id", *more, "node_id", F.when(F.col("first") < 2, 0).otherwise(1).alias("dist"), "s", "t", "d", "inner", (F.col("first_node") + local).alias("node"))
    placed = written(placed, "placed")
    nodes = placed.select("batch", "node", "graph", "node_id", "dist", _degree_label(F.col("d")).alias("z"))
    ends = F.filter(F.array(F.when(F.col("s") == 1, F.col("first_node")), F.when(F.col("t") == 1, F.col("first_node") + 1)), lambda x: x.isNotNull())
    star = placed.where("dist = 1").select("batch", "graph", F.col("node").alias("v"), F.explode(ends).alias("u"))
    held = placed.where("inner = 1")
    u, v = (held.select("pair_id", F.col("node_id").alias(c), F.col("node").alias(f"{c}_node")) for c in ("u", "v"))
    inner = at.inner.select("pair_id", "u", "v").join(u, ["pair_id", "u"]).join(v, ["pair_id", "v"]).join(graphs.select("pair_id", "batch", "graph"), "pair_id")
    links = star.select("batch", "graph", "u", "v").unionByName(inner.select("batch", "graph", F.col("u_node").alias("u"), F.col("v_node").alias("v")))
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")
    return Batches(graphs.select("batch", "graph", "pair_id", "src", "dst", "num_nodes", "first_node"), nodes, links.select("batch", "graph", both).select("batch", "graph", "x.u", "x.v", F.lit(1).alias("w")))


__all__ = ["Batches", "batched", "end_distances", "induced_pairwise", "induced_scan", "k_hop_nodes", "labels", "local_ids", "mean_pool", "near", "near_batched", "near_induced", "near_labels", "near_mean_pool", "near_sort_pool", "shared_neighbours", "sort_pool", "sort_pool_size", "swapped", "triangles"]
