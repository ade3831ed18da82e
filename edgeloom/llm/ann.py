"""Approximate nearest neighbours: each shard has a robust-pruned directed graph, and beam search queries every shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.cluster import ship, written

#: Different vectors that a shard is meant to have.
SHARD_ROWS = 8192
#: Queries that meet a shard in one task.
QUERY_ROWS = 4096
#: Edges of a node, candidates of the search that proposes them, and by how much a detour may be longer.
DEGREE = 28
BUILD_BEAM = 64
RELAX = 1.2
#: Candidates that a query keeps, how many it expands at a time, and the share of a shard's vectors, the longest, that it
#: starts from besides the middle.
BEAM = 96
WIDTH = 4
LONGEST = 1 / 16


def usable(c: Column) -> Column:
    """Vectors that take part: not null or empty, every component finite, not all zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids, expanded): of each row of q the beam nodes found of the largest inner product, largest first (-1 where
    there are fewer), going from starts along the graph's edges (-1: none); expanded: what was looked at, step by step.

    All rows go in step: each expands its nearest WIDTH unexpanded candidates, until it has none among its best."""
    n = len(q)
    ids, dist = np.full((n, beam), -1, np.int32), np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    d = -(q @ x[starts].T)
    order = np.argsort(d, axis=1, kind="stable")[:, :beam]
    few = order.shape[1]
    ids[:, :few], dist[:, :few], done[:, :few] = starts[order], np.take_along_axis(d, order, 1), False
    seen = np.zeros((n, len(x)), bool)
    seen[:, starts] = True
    live = np.arange(n)
    expanded = []
    while len(live):
        order = np.argsort(done[live], axis=1, kind="stable")[:, :WIDTH]
        at = live[:, None]
        pick = np.where(done[at, order], -1, ids[at, order])
        done[at, order] = True
        some = np.full((n, WIDTH), -1, np.int32)
        some[live] = pick
        expanded.append(some)
        near = np.where(pick[:, :, None] >= 0, graph[pick], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[at, near]] = -1
        r, c = np.nonzero(near >= 0)
        hit = near[r, c]
        seen[live[r], hit] = True
        d = np.full(near.shape, np.inf, np.float32)
        for i in range(0, len(r), 65536):
            j = slice(i, i + 65536)
            d[r[j], c[j]] = -np.einsum("ij,ij->i", x[hit[j]], q[live[r[j]]])
        all_ids, all_d = np.hstack([ids[live], near]), np.hstack([dist[live], d])
        all_done = np.hstack([done[live], near < 0])
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_d, all_done))
        live = live[~done[live].all(axis=1)]
    return ids, expanded


def robust_prune(u: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int = DEGREE, relax: float = RELAX) -> np.ndarray:
    """Of each node's candidates (rows of near, -1: none) up to degree diverse ones: the nearest stays, and drops those
    that lie nearer to it, relaxed, than to the node. u: vectors of length one."""
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == own[:, None]] = -1
    v = u[near]
    d = np.where(near >= 0, 2 - 2 * np.einsum("ncd,nd->nc", v, u[own]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    near, d, v = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    alive = near >= 0
    out = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for k in range(degree):
        first = alive.argmax(axis=1)
        there = alive[rows, first]
        if not there.any():
            break
        pick = near[rows, first]
        out[there, k] = pick[there]
        between = 2 - 2 * np.einsum("ncd,nd->nc", v, v[rows, first])
        alive &= relax * relax * between > d
        alive[rows, first] = False
    return out


def build(u: np.ndarray) -> tuple[np.ndarray, int]:
    """(graph, start) over vectors of length one: nodes come in batches that double up to a fiftieth of all; each is
    looked up in the graph so far, pruned to its edges, and offered as an edge to them in turn."""
    graph = np.full((len(u), DEGREE), -1, np.int32)
    start = int(np.argmax(u @ u.mean(axis=0)))
    order = np.random.default_rng(7).permutation(len(u))
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        new = order[at : at + size]
        at, size = at + size, min(2 * size, max(64, len(u) // 50))
        ids, expanded = beam_search(u, graph, np.array([start]), u[new], BUILD_BEAM)
        graph[new] = robust_prune(u, new, np.hstack([ids, *expanded]))
        # those of one batch don't see each other; the edges back do the rest
        source, target = np.repeat(new, DEGREE), graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        node, first, n = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(node), n.max(initial=0)), -1, np.int32)
        more[np.repeat(np.arange(len(node)), n), np.arange(len(target)) - np.repeat(first, n)] = source
        wide = np.hstack([graph[node], more])
        full = (wide >= 0).sum(axis=1) > DEGREE
        if full.any():
            graph[node[full]] = robust_prune(u, node[full], wide[full])
        if (~full).any():
            graph[node[~full]] = -np.sort(-wide[~full], axis=1)[:, :DEGREE]
    return graph, start


def unit(v: np.ndarray) -> np.ndarray:
    """v over its lengths, in single precision; the longest component first, as squares of the largest numbers overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]).astype(np.float32)


def scaled(v: np.ndarray) -> np.ndarray:
    """v over its largest component, in single precision: inner products keep their order."""
    return (v.astype(np.float64) / np.abs(v).max()).astype(np.float32)


def start_nodes(x: np.ndarray, start: int) -> np.ndarray:
    """Where searches start: the middle and the longest vectors, a share LONGEST of all, among which unequal lengths put
    the largest products."""
    return np.unique(np.concatenate([[start], np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")[: int(LONGEST * len(x))]]))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), flat.dtype)


def _components(vectors: DataFrame, vec_col: str) -> Column:
    """The vectors as vec: floats as they are, all else in double precision."""
    given = vectors.schema[vec_col].dataType.simpleString()
    return F.col(vec_col).cast(given if given == "array<float>" else "array<double>").alias("vec")


def distinct_vectors(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(dim, vec, ids): every different usable vector with its k + 1 smallest ids, which are all that a search for k
    others can return of it. Tasks keep the first k + 1 of a vector before the shuffle."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), _components(vectors, vec_col))
    ranked = rows.selectExpr("*", "row_number() over (partition by vec order by id) as n").where(F.col("n") <= k + 1)
    return ranked.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.size("vec").alias("dim"), "vec", "ids")


def index(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The written index: (shard, dim, node, vec, ids, edges, start) with a graph over the different vectors of each
    shard. Every usable vector is in it; shards are dealt by hash, vectors of other lengths apart."""
    ship(vectors.sparkSession)
    unique = written(distinct_vectors(vectors, k, id_col, vec_col), "vectors")
    shards = max(1, -(-unique.count() // SHARD_ROWS))
    dealt = unique.select((F.col("dim").cast("long") * 1_000_000 + F.pmod(F.xxhash64("vec"), F.lit(shards))).alias("shard"), "dim", "vec", "ids")

    def make(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        v = _matrix(t.column("vec").combine_chunks())
        order = np.lexsort(v.T)  # the same graph whenever it is built
        v = v[order]
        graph, start = build(unit(v))
        t = t.take(pa.array(order))
        edges = pa.ListArray.from_arrays(pa.array(np.arange(0, graph.size + 1, DEGREE, dtype=np.int32)), pa.array(graph.ravel()))
        return pa.table({"shard": t["shard"], "dim": t["dim"], "node": pa.array(np.arange(len(v), dtype=np.int32)), "vec": t["vec"], "ids": t["ids"], "edges": edges, "start": pa.array(np.full(len(v), start, np.int32))})

    schema = T.StructType([*dealt.schema.fields[:2], T.StructField("node", T.IntegerType()), dealt.schema["vec"], dealt.schema["ids"], T.StructField("edges", T.ArrayType(T.IntegerType())), T.StructField("start", T.IntegerType())])
    return written(dealt.groupBy("shard").applyInArrow(make, schema), "graph")


def search(graphs: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(q, ids array<struct<score, id>>): of each query (q long, dim, vec) the k + 1 best ids over all shards of its
    length, by the inner product in double precision, ties to smaller ids.

    A block of queries meets a shard in one task; a query's answers from all shards, k + 1 from each at most, meet in a
    top-k that keeps as many before the shuffle."""
    ship(queries.sparkSession)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    shards = graphs.groupBy("shard", "dim").agg(F.lit(1).alias("one")).select("shard", "dim").groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = queries.join(shards, "dim").select("q", "vec", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("b"), F.explode("shards").alias("shard"))
    held = graphs.select("shard", "node", "vec", "ids", "edges", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))

    def run(g: pa.Table, a: pa.Table) -> pa.Table:
        if not g.num_rows or not a.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], pa.int64())})
        g = g.combine_chunks().sort_by("node")
        v, edges = _matrix(g["vec"].combine_chunks()), _matrix(g["edges"].combine_chunks())
        ids = g["ids"].to_pylist()
        q = _matrix(a.combine_chunks()["vec"].combine_chunks())
        number = a["q"].to_numpy()
        x = scaled(v)
        starts = start_nodes(x, int(g["start"][0].as_py()))
        out_q, out_s, out_id = [], [], []
        for at in range(0, len(q), 1024):
            part = q[at : at + 1024]
            found, _ = beam_search(x, edges, starts, unit(part), beam)
            for row, f, n in zip(part.astype(np.float64), found, number[at : at + 1024], strict=True):
                f = f[f >= 0]
                score = v[f].astype(np.float64) @ row
                best = sorted(((-s, i) for j in np.argsort(-score, kind="stable")[: k + 1] for s, i in ((score[j], i) for i in ids[f[j]])))[: k + 1]
                out_q += [n] * len(best)
                out_s += [-s for s, _ in best]
                out_id += [i for _, i in best]
        return pa.table({"q": pa.array(out_q, pa.int64()), "score": pa.array(out_s, pa.float64()), "id": pa.array(out_id, pa.int64())})

    found = held.groupBy("shard", "b").cogroup(asked.groupBy("shard", "b")).applyInArrow(run, "q long, score double, id long")
    top = found.selectExpr("*", "row_number() over (partition by q order by score desc, id) as n").where(F.col("n") <= k + 1)
    return top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "score", "id"))).alias("ids"))


def nearest(vectors: DataFrame, wanted: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """(query_id, rank int from 1, vec_id, score): for each row of wanted the k nearest found among all rows of
    vectors but those with its own id; nearest is the largest inner product, ties go to the smaller id.

    Equal vectors are indexed and asked once, whatever their number. Vectors that aren't usable, and rows without id,
    take no part; with fewer candidates all of them come back. Repeated rows of an id are that id once more. An empty
    table gives an empty result; other columns are ignored.
    """
    graphs = index(vectors, k, id_col, vec_col)
    asked = wanted.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("query_id"), _components(wanted, vec_col))
    unique = written(asked.select("vec").distinct().select(F.monotonically_increasing_id().alias("q"), F.size("vec").alias("dim"), "vec"), "queries")
    answers = search(graphs, unique, k, beam)
    each = asked.join(unique, "vec").select("query_id", "q").join(answers, "q").select("query_id", F.filter("ids", lambda x: x["id"] != F.col("query_id")).alias("ids"))
    rows = each.select("query_id", F.posexplode(F.slice("ids", 1, k)).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
