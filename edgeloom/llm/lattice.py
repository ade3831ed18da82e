"""Near-duplicate vectors of one label by lattice hashing: random projections to eight dimensions are decoded to the nearest point of
the E8 lattice, in several tables; vectors that share a cell, their own or a neighbouring one, are verified by cosine."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import ship, written
from edgeloom.llm.ann import _components, _matrix, usable
from edgeloom.llm.components import connected_components
from edgeloom.llm.simhash import forest

#: Vectors link from this cosine on.
COSINE = 0.93
#: Tables, lattice points that make up a cell of a table, and cells of a table in which a vector is looked for: its own
#: and the nearest others. Two vectors of exactly COSINE share a cell of a table four times in five, and of all tables
#: in all but one or two cases of a thousand.
TABLES, BLOCKS, PROBES = 4, 2, 8
#: Points of a block that cells are made of: the nearest and its nearest neighbours.
NEAR = 6
#: The lattice's unit in projected distances of vectors as far apart as the cosine allows.
UNIT = 5.35
#: Members of a tile; larger cells are dealt into tiles, and every two tiles meet.
TILE = 512
SEED = 11


@cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of the lattice, which lead to a point's nearest neighbours."""
    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array(whole + half, float)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points of an even sum: the component that lost most by rounding goes the other way where the sum is odd."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of the whole points of an even sum and the same moved by a half, the nearer one."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def neighbours(x: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """(points, cost): each row's nearest lattice point, then its near - 1 neighbours that lie nearest to the row, with
    how much further their squared distances are."""
    home = decode(x)
    cost = 2 - 2 * ((x - home) @ shortest().T)
    order = np.argpartition(cost, near - 1, axis=1)[:, : near - 1]
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(cost, order, 1), axis=1, kind="stable"), 1)
    points = np.concatenate([home[:, None], home[:, None] + shortest()[order]], axis=1)
    return points, np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(cost, order, 1)], axis=1)


@cache
def _drawn(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(TABLES * BLOCKS * 8, dim)), rng.uniform(-0.5, 0.5, TABLES * BLOCKS * 8), rng.integers(1, 1 << 63, (TABLES, BLOCKS, 8), dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def cells(u: np.ndarray, label: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """(rows, TABLES, PROBES): numbers of each row's cells, its own first; a table's cells come after those of the
    tables before it. u: vectors of length one; label: a 64-bit number that parts labels."""
    with np.errstate(over="ignore"):
        matrix, shift, odd = _drawn(u.shape[1])
        y = (u @ matrix.T / (UNIT * max(2 - 2 * cosine, 1e-6) ** 0.5) + shift).reshape(len(u), TABLES, BLOCKS, 8)
        out = np.empty((len(u), TABLES, PROBES), np.int64)
        for t in range(TABLES):
            hashes, costs = np.zeros((len(u), 1), np.uint64), np.zeros((len(u), 1))
            for b in range(BLOCKS):
                points, cost = neighbours(y[:, t, b])
                h = ((2 * points).astype(np.int64).view(np.uint64) * odd[t, b]).sum(axis=2, dtype=np.uint64)
                hashes = _mixed(hashes[:, :, None] + h[:, None, :]).reshape(len(u), -1)
                costs = (costs[:, :, None] + cost[:, None, :]).reshape(len(u), -1)
            order = np.argsort(costs, axis=1, kind="stable")[:, :PROBES]
            best = _mixed(np.take_along_axis(hashes, order, 1) + label.view(np.uint64)[:, None] + np.uint64(u.shape[1]))
            out[:, t] = (np.int64(t) << 56) | (best >> np.uint64(8)).astype(np.int64)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """v over its lengths, in double precision; the longest component first, as squares of the largest numbers overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _first_shared(a: np.ndarray, b: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether here is the first of the cells that the rows of a and b share, so that a pair counts in one cell alone."""
    first = np.full(len(a), np.iinfo(np.int64).max)
    for t in range(TABLES):
        open_ = np.flatnonzero((here >> 56 >= t) & (first == np.iinfo(np.int64).max))
        for at in range(0, len(open_), 1 << 14):
            rows = open_[at : at + (1 << 14)]
            x, y = a[rows, t], b[rows, t]
            shared = (x[:, :, None] == y[:, None, :]).any(axis=2)
            first[rows] = np.where(shared, x, np.iinfo(np.int64).max).min(axis=1)
    return first == here


def pairs(key: np.ndarray, own: np.ndarray, lab: np.ndarray, cell: np.ndarray, u: np.ndarray, hashed: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): positions of the rows that link, of all groups of equal key (which stand together), each pair in the
    first cell that it shares. own: the tile of a row; in a group of two tiles rows of one tile don't meet, as they
    meet in the tile's own group. Groups of one size are multiplied together."""
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    size = np.diff(np.append(begin, len(key)))
    left, right = [], []
    for n in np.unique(size[size > 1]):
        groups = begin[size == n]
        for at in range(0, len(groups), max(1, (1 << 19) // (n * n))):
            rows = groups[at : at + max(1, (1 << 19) // (n * n)), None] + np.arange(n)
            x = u[rows]
            near = (x @ x.transpose(0, 2, 1) >= cosine) & (lab[rows][:, :, None] == lab[rows][:, None, :])
            two = (own[rows] != own[rows[:, :1]]).any(axis=1)
            near &= ~two[:, None, None] | (own[rows][:, :, None] != own[rows][:, None, :])
            g, i, j = np.nonzero(near & np.triu(np.ones((n, n), bool), 1))
            left.append(rows[g, i])
            right.append(rows[g, j])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    met = np.unique(np.concatenate([i, j]))
    known = cells(u[met], hashed[met], cosine) if len(met) else np.zeros((0, TABLES, PROBES), np.int64)
    counted = _first_shared(known[np.searchsorted(met, i)], known[np.searchsorted(met, j)], cell[i])
    return i[counted], j[counted]


def _celled(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """node and dim with the cells."""
    for b in batches:
        sizes = b.column("dim").to_numpy()
        for dim in np.unique(sizes):
            part = b.filter(pa.array(sizes == dim))
            c = cells(unit(_matrix(part.column("vec"))), part.column("hashed").to_numpy(), cosine)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, TABLES * PROBES, dtype=np.int32)), pa.array(np.ascontiguousarray(c).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("dim"), flat], names=["node", "dim", "cells"])


def _verified(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(node, links, least) of rows sorted by cell and tiles: how many rows a node links with in these groups, and the
    least node that it hangs together with. The group at the end of a batch waits for the next."""
    names = ("dim", "cell", "i", "j")

    def found(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        get = lambda c: t[c].to_numpy()
        key, dims = np.stack([get(c) for c in names], axis=1), get("dim")
        out = []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            part = {c: get(c)[at] for c in ("own", "lab", "cell", "hashed")}
            u = unit(_matrix(t.take(pa.array(at))["vec"].combine_chunks()))
            i, j = pairs(key[at], part["own"], part["lab"], part["cell"], u, part["hashed"], cosine)
            out += [(at[i], at[j])]
        i, j = (np.concatenate(x) for x in zip(*out, strict=True))
        node, weight = get("node"), get("n")
        links = np.bincount(i, weight[j], len(node)).astype(np.int64) + np.bincount(j, weight[i], len(node)).astype(np.int64)
        rank = np.argsort(np.argsort(node, kind="stable"), kind="stable")  # forest wants the least position
        label = forest(rank[i], rank[j], len(node))
        least = np.sort(node)[label[rank]]
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(least[some])], names=["node", "links", "least"])

    wait: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if wait is None else pa.concat_tables([wait, t])
        last = [t[c][-1].as_py() for c in names] if t.num_rows else []
        same = np.logical_and.reduce([t[c].to_numpy() == x for c, x in zip(names, last, strict=True)]) if last else np.zeros(0, bool)
        cut = int(np.argmax(same)) if len(same) else 0
        if cut:
            yield found(t.slice(0, cut))
        wait = t.slice(cut)
    if wait is not None and wait.num_rows:
        yield found(wait)


def links(unique: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, links, least) for the nodes of unique (node long, n long, lab long, hashed long, dim int, vec) that link
    with others, once for each group in which they were found: links adds up the n of those it links with, and least is
    a node that it hangs together with. A pair counts in the first cell that it shares.

    Cells and nodes go through the shuffle without vectors first; only nodes in cells of two or more fetch theirs. A
    cell of over TILE members is dealt into tiles, and every two tiles meet in a group of their own, so that no task
    gets a whole large cell and no pair is left out. Groups are read as a sorted stream.
    """
    ship(unique.sparkSession)
    given = unique.select("node", "hashed", "dim", "vec")
    celled = written(given.mapInArrow(lambda it: _celled(it, cosine), "node long, dim int, cells array<long>"), "cells")
    keyed = celled.select("node", "dim", F.explode("cells").alias("cell"))
    count = keyed.groupBy("dim", "cell").agg(F.count("*").alias("m")).where("m > 1")
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    dealt = keyed.join(count, ["dim", "cell"]).select("node", "cell", tiles.alias("tiles"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("own"))
    met = dealt.select("node", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = met.select("node", "cell", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = met.join(unique.select("node", "n", "lab", "hashed", "dim", "vec"), "node")
    full = full.repartition("dim", "cell", "i", "j").sortWithinPartitions("dim", "cell", "i", "j")
    return full.mapInArrow(lambda it: _verified(it, cosine), "node long, links long, least long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links long, component_id, kept boolean) for every row: n_links counts the other rows of the same label
    whose cosine was found to be cosine or more, component_id is the smallest id that links reach, the row's own
    included, and kept says whether that is the row's own.

    Equal vectors of a label are compared once, whatever their number, and each links with its copies. Vectors that are
    null, empty, zero or hold null or other than finite components, and rows without a label, link with nothing;
    vectors of different lengths don't link. Repeated rows of an id count each; rows without id keep a row, count as
    links and never give a component its id. An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must lie above 0 and not above 1")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), _components(vectors, vec_col), (usable(F.col(vec_col)) & F.col(label_col).isNotNull()).alias("ok"))
    ok = rows.where("ok").select("id", "label", "vec")
    unique = ok.groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    unique = written(unique.select(F.monotonically_increasing_id().alias("node"), "first", "n", "label", F.xxhash64(F.lit(1), "label").alias("lab"), F.xxhash64("label").alias("hashed"), F.size("vec").alias("dim"), "vec"), "unique")
    found = written(links(unique, cosine), "links")
    parts = written(connected_components(found.where("node <> least"), "node", "least"), "parts")
    least = parts.join(unique.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    each = unique.join(parts.join(least, "component").select("node", "component_id"), "node", "left").join(sums, "node", "left")
    each = each.select("label", "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = ok.join(each, ["label", "vec"]).select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
