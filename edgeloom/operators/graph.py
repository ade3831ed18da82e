"""A graph as an edge table, and the operators that look at or reshape it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_checked, written

#: Neighbours of a node that one task numbers; a hub's are dealt into blocks of about so many.
BLOCK_NEIGHBOURS = 1 << 16
#: Nodes of a range whose counts are summed before the running sum over ranges.
RANGE_NODES = 1 << 16


@dataclass(frozen=True)
class Graph:
    """edges (src int, dst int, ts int or null) over nodes 0 to num_nodes - 1, of which some may have no edge."""

    edges: DataFrame
    num_nodes: int

    def nodes(self) -> DataFrame:
        return self.edges.sparkSession.range(self.num_nodes).select(F.col("id").cast("int").alias("id"))


def swapped(edges: DataFrame) -> DataFrame:
    other = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns])


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without self-loops; duplicates stay."""
    kept = edges.where("src <> dst")
    return kept.unionByName(swapped(kept))


def dedup(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst), with the earliest timestamp."""
    return edges.groupBy("src", "dst").agg(F.min("ts").alias("ts"))


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, as src < dst."""
    return edges.where("src < dst")


def degrees(g: Graph) -> DataFrame:
    """(id, degree long) of every node, isolated ones too."""
    n = g.edges.groupBy("src").agg(F.count("*").alias("degree"))
    return g.nodes().join(n, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def total_degree(g: Graph, nodes: DataFrame) -> DataFrame:
    """(total long): edges of all the nodes (id), each node counted once."""
    some = g.edges.join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return some.agg(F.count("*").alias("total"))


def checked_pairs(pairs: DataFrame, num_nodes: int, name: str = "pairs") -> DataFrame:
    """pairs (src, dst) as they are, if all ids lie between 0 and num_nodes - 1; else an error that names them."""
    low, high = pairs.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    if low is not None and (low < 0 or high >= num_nodes):
        raise ValueError(f"{name} has ids from {low} to {high}, outside 0 to {num_nodes - 1}")
    return pairs


def flagged_degrees(g: Graph, flag: Column) -> DataFrame:
    """(id, kept long): edges of each node for which flag holds."""
    n = g.edges.groupBy("src").agg(F.count_if(flag).alias("kept"))
    return g.nodes().join(n, F.col("id") == F.col("src"), "left").select("id", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbours array<int>), sorted; a node's row is as long as its degree."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def numbered_neighbours(edges: DataFrame) -> DataFrame:
    """(src, i, dst, n, dst_n): every edge, with its number i from 0 among the n of its node, and how many dst has. So a
    step of a walk is an equi-join by node and number, at a hub as anywhere else.

    A hub's neighbours are dealt into blocks by hash, numbered block by block; only hubs, which are few, have a table
    of where blocks begin."""
    e = edges.select("src", "dst")
    n = e.groupBy("src").agg(F.count("*").alias("n"))
    hubs = n.where(F.col("n") > BLOCK_NEIGHBOURS).select("src", F.ceil(F.col("n") / BLOCK_NEIGHBOURS).cast("int").alias("blocks"))
    dealt = e.join(broadcast_checked(hubs), "src", "left").withColumn("b", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int"), F.lit(0)))
    inside = dealt.selectExpr("src", "dst", "b", "row_number() over (partition by src, b order by dst) - 1 as k")
    sizes = dealt.where("blocks is not null").groupBy("src", "b").agg(F.count("*").alias("c"))
    begin = sizes.selectExpr("src", "b", "sum(c) over (partition by src order by b rows unbounded preceding) - c as base")
    at = inside.join(broadcast_checked(begin), ["src", "b"], "left").select("src", (F.coalesce("base", F.lit(0)) + F.col("k")).alias("i"), "dst")
    other = n.select(F.col("src").alias("dst"), F.col("n").alias("dst_n"))
    return at.join(n, "src").join(other, "dst", "left").select("src", "i", "dst", "n", F.coalesce("dst_n", F.lit(0)).alias("dst_n"))


def neighbour_at(edges: DataFrame, index: int) -> DataFrame:
    """(src, dst, ts): each node's neighbour number index from 0, in the order of (dst, ts); too few: no row."""
    w = Window.partitionBy("src").orderBy("dst", "ts")
    return edges.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= index + 1).where(F.col("__n") == index + 1).select("src", "dst", "ts")


def offsets(counts: DataFrame, id_col: str = "id", n_col: str = "degree") -> DataFrame:
    """(id, start long): the exclusive running sum of counts in the order of ids.

    Ids are cut into ranges; only one total for each RANGE_NODES ids passes through the one task that sums them up."""
    dealt = counts.select(F.col(id_col).alias("id"), F.col(n_col).alias("n"), F.floor(F.col(id_col) / RANGE_NODES).alias("r"))
    totals = dealt.groupBy("r").agg(F.sum("n").alias("t"))
    before = totals.select("r", (F.sum("t").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("r").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return dealt.withColumn("inside", inside).join(before, "r").select("id", (F.col("base") + F.col("inside")).alias("start"))


def in_order(rows: DataFrame, by: list[str], within: list[str] = (), name: str = "pos") -> DataFrame:
    """rows with their place from 0 in the order of by, among all or among those of equal within. Rows are dealt by
    ranges of both, numbered range by range, and get the number of rows before their range: one count for each range,
    and for each of its groups where there are any, so that one large group is as good as many small ones."""
    within = list(within)
    ranged = written(rows.repartitionByRange(*within, *by).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part", *within).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*within).orderBy("__part") if within else Window.orderBy("__part")
    base = sizes.withColumn("__base", F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part", *within).orderBy(*by)) - 1
    return ranged.withColumn("__i", inside).join(base, ["__part", *within]).select(*rows.columns, (F.col("__base") + F.col("__i")).alias(name))


def edges_at(g: Graph, positions: DataFrame) -> DataFrame:
    """(pos, src, dst): the edges at global positions, counted through sorted neighbour rows; positions beyond are
    left out. The row of a position is found by an equi-join on blocks of positions, not by comparing all."""
    start = offsets(degrees(g)).join(degrees(g), "id").where("degree > 0").select("id", "start", (F.col("start") + F.col("degree")).alias("end"))
    block = 1 << 12
    blocks = start.select("id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("b"))
    row = positions.select("pos", F.floor(F.col("pos") / block).alias("b")).join(blocks, "b").where("pos >= start and pos < end")
    n = g.edges.selectExpr("src", "dst", "row_number() over (partition by src order by dst, ts) - 1 as i")
    return row.select("pos", F.col("id").alias("src"), (F.col("pos") - F.col("start")).cast("int").alias("i")).join(n, ["src", "i"]).select("pos", "src", "dst")


# Names of the kinds of graphs.
KINDS = ("undirected-symmetric-csr", "directed", "undirected-single-edge-list")


def masked(edges: DataFrame, kind: str, drop_selfloops: bool = False) -> DataFrame:
    """Edges as an export of that kind holds them: a symmetric graph gives each edge once, other kinds all."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of graph: {kind}")
    out = canonical(edges) if kind == KINDS[0] else edges
    return out.where("src <> dst") if drop_selfloops else out


def mask_counts(edges: DataFrame, kind: str, drop_selfloops: bool = False) -> DataFrame:
    """(kind, kept, selfloops): edges that masked keeps, and self-loops among those of its kind."""
    inside = masked(edges, kind)
    loop = F.col("src") == F.col("dst")
    kept = F.count_if(~loop) if drop_selfloops else F.count("*")
    return inside.agg(kept.alias("kept"), F.count_if(loop).alias("selfloops")).select(F.lit(kind).alias("kind"), "kept", "selfloops")


def quality(g: Graph) -> DataFrame:
    """One row of counts of what a sound graph has none of: ids out of bounds, self-loops, repeated pairs, edges
    without their reverse; with the smallest and largest id."""
    lo, hi = F.least("src", "dst").cast("long").alias("lo"), F.greatest("src", "dst").cast("long").alias("hi")
    there, back = F.count_if(F.col("src") <= F.col("dst")).alias("there"), F.count_if(F.col("src") > F.col("dst")).alias("back")
    pairs = g.edges.groupBy(lo, hi).agg(there, back)  # both directions of an edge meet in one row
    n = F.col("there") + F.col("back")
    extra = F.greatest(F.col("there") - 1, F.lit(0)) + F.greatest(F.col("back") - 1, F.lit(0))
    loop = F.col("lo") == F.col("hi")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return pairs.agg(
        total(n).alias("edges"), F.min("lo").alias("min_id"), F.max("hi").alias("max_id"), total(F.when((F.col("lo") < 0) | (F.col("hi") >= g.num_nodes), n)).alias("out_of_bounds"),
        total(F.when(loop, n)).alias("selfloops"), total(extra).alias("repeated"), F.count_if(~loop & ((F.col("there") == 0) | (F.col("back") == 0))).alias("one_way"),
    )


def unsorted_rows(stored: DataFrame) -> DataFrame:
    """(pos, src, dst, next_dst): places of stored edges (pos, src, dst) at which a node's next neighbour is smaller than
    the one before; none if rows are sorted. An equi-join by place, so that a hub is as good as any other node."""
    after = stored.select((F.col("pos") - 1).alias("pos"), F.col("src").alias("__src"), F.col("dst").alias("next_dst"))
    return stored.select("pos", "src", "dst").join(after, "pos").where("src = __src and next_dst < dst").select("pos", "src", "dst", "next_dst")


def years(y: Column) -> Column:
    """Node years as ints: null and NaN become 0, others are held to 0..2^31-1."""
    return F.greatest(F.lit(0.0), F.least(F.coalesce(F.nanvl(y.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(2147483647.0))).cast("int")


def with_later_year(edges: DataFrame, node_years: DataFrame) -> DataFrame:
    """edges (src, dst) with ts: the later of the years (id, year) of their ends."""
    y = node_years.select("id", years(F.col("year")).alias("y"))
    s, d = y.select(F.col("id").alias("src"), F.col("y").alias("ys")), y.select(F.col("id").alias("dst"), F.col("y").alias("yd"))
    return edges.join(s, "src").join(d, "dst").select("src", "dst", F.greatest("ys", "yd").alias("ts"))


def without_edges(pairs: DataFrame, edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """pairs (src, dst, ...) that aren't edges, in this direction or, with both_ways, in either."""
    e = edges.select("src", "dst")
    if both_ways:
        e = e.unionByName(swapped(e))
    return pairs.join(e.distinct(), ["src", "dst"], "left_anti").select(pairs.columns)


def with_edge_flag(pairs: DataFrame, edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """pairs with exists: whether they are edges."""
    e = edges.select("src", "dst")
    if both_ways:
        e = e.unionByName(swapped(e))
    flag = e.distinct().withColumn("__there", F.lit(True))
    return pairs.join(flag, ["src", "dst"], "left").select(*pairs.columns, F.coalesce("__there", F.lit(False)).alias("exists"))


def two_hop_closure(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): for each source (src) the nodes two steps away that are neither itself nor its neighbours. Sources
    come first, so that only their paths are made; adaptive execution splits what hubs pile up."""
    e = edges.select("src", "dst")
    first = sources.select("src").distinct().join(e, "src").select("src", F.col("dst").alias("mid"))
    second = first.join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("dst <> src").select("src", "dst").distinct()
    return without_edges(second, e)
