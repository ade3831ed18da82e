"""Where pairs stand among their source's two-step closure by inner product; the closure itself is never written down or shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import discard, shared_dir, ship, written
from edgeloom.operators import blocks, features, graph
from edgeloom.operators.blocks import Place

#: Sources and first steps that a task has, on average, at most; with few sources there are some GROUPS tasks.
SOURCES, STEPS, GROUPS = 1 << 11, 1 << 20, 32
#: Steps to nodes of a block that are looked at at once.
AT_ONCE = 1 << 21
#: A share of closure nodes among all from which on whole blocks are multiplied.
DENSE = 0.1


def above_in_closure(pairs: DataFrame, edges: DataFrame, vectors: DataFrame, num_nodes: int) -> DataFrame:
    """(src, dst, score double, above long): pairs (src, dst) with the inner product of their vectors (id, embedding), and how many of the
    nodes of src's graph.two_hop_closure in edges score higher with src. Pairs and nodes without a vector are left out.

    The last steps (mid, dst) lie in the shared folder in blocks by dst, and so do the vectors. A task has some sources and their first steps;
    it reads the blocks one after the other, marks what its sources reach in a block, and scores that. So only the pairs and the first
    steps are shuffled, as ids, and a task holds one block and a table of a bit for each of its sources and the block's nodes. Scores are
    taken in single precision, and those that could lie on either side of a pair's once more as features.dot_scores has them. Where Arrow can't read
    the folder, or vectors have components that are null or not finite or are of unequal lengths, the closure is joined and scored row by row."""
    spark = pairs.sparkSession
    dim = (vectors.select(F.size("embedding")).first() or [0])[0]
    odd = F.col("embedding").isNull() | (F.size("embedding") != dim) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dim <= 0 or not blocks.reachable(spark, shared_dir(spark)) or not vectors.where(odd).isEmpty():
        scored = written(features.dot_scores(pairs.select("src", "dst"), vectors), "pairs")
        others = features.dot_scores(graph.two_hop_closure(pairs, edges), vectors).select("src", F.col("score").alias("other"))
        each = scored.distinct().join(others, "src", "left").groupBy("src", "dst").agg(F.count_if(F.col("other") > F.col("score")).alias("above"))
        return scored.join(each, ["src", "dst"]).select("src", "dst", "score", "above")
    n = max(1, -(-num_nodes // blocks.FEW_NODES))
    table = blocks.laid(vectors.select("id", "embedding"), n)
    steps = blocks.dealt(edges.select("src", "dst"), "dst", n, "steps", order="src")
    sources = pairs.select("src").distinct()
    first = written(edges.select("src", "dst").join(sources, "src", "left_semi"), "first")
    many = sources.count()
    groups = max(1, -(-many // SOURCES), min(GROUPS, -(-many // 64)), -(-first.count() // STEPS))
    rows = pairs.select("src", "dst", F.lit(True).alias("asked")).unionByName(first.withColumn("asked", F.lit(False)))
    rows = rows.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "asked").repartitionById(groups, F.pmod(F.xxhash64(F.col("src").cast("long")), F.lit(groups)).cast("int"))
    place, kind = blocks.place_of(table), dict(pairs.dtypes)["src"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            t = pa.Table.from_batches(some)
            src, dst, asked = (t[c].to_numpy() for c in ("src", "dst", "asked"))
            found = _above(src[asked], dst[asked], src[~asked], dst[~asked], steps, place, dim)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["src", "dst", "score", "above"])

    ship(spark)
    out = rows.mapInArrow(count, "src bigint, dst bigint, score double, above bigint")
    out = written(out.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(dict(pairs.dtypes)["dst"]).alias("dst"), "score", "above"), "above")
    discard(first, table)
    blocks.cleared(spark, steps)
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As vectors.dot: summed up component by component."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _vectors(place: Place, wanted: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the wanted ids as rows, and which of them there are."""
    out, there = np.zeros((len(wanted), dim)), np.zeros(len(wanted), bool)
    for j in np.unique(wanted % place.blocks):
        ids, vectors = place.read(int(j))
        rows = np.flatnonzero(wanted % place.blocks == j)
        at = blocks._places(ids, wanted[rows], place.blocks)
        rows, at = rows[at >= 0], at[at >= 0]
        if len(rows):
            out[rows], there[rows] = vectors[at], True
    return out, there


def _above(src: np.ndarray, dst: np.ndarray, start: np.ndarray, mid: np.ndarray, steps: Place, place: Place, dim: int) -> tuple[np.ndarray, ...]:
    """above_in_closure for pairs (src, dst), whose sources have the first steps (start, mid)."""
    sources = np.unique(src)
    own, there = _vectors(place, sources, dim)
    other, met = _vectors(place, dst, dim)
    row = np.searchsorted(sources, src)
    kept = np.flatnonzero(there[row] & met)
    src, dst, row = src[kept], dst[kept], row[kept]
    score = _dot(own[row], other[kept])
    # each source has a mark below all scores, then those of its pairs, rising: a number behind so many of them stands at their end
    marks = np.concatenate([_marks(np.arange(len(sources)), np.full(len(sources), -np.inf)), _marks(row, score)])
    order = np.argsort(marks, kind="stable")
    marks, place_in = marks[order], np.empty(len(order), np.int64)
    place_in[order] = np.arange(len(order))
    values = marks.imag.astype(np.float32)
    ends = np.searchsorted(marks.real, np.arange(len(sources)), side="right")
    hist = np.zeros(len(marks) + 1, np.int64)
    single, norms = own.astype(np.float32), np.sqrt((own * own).sum(axis=1))
    at = np.searchsorted(sources, start)
    mids, which = np.unique(mid, return_inverse=True)
    for j in range(place.blocks):
        ids, vectors = place.read(j)
        t = steps.rows(j, ["src", "dst"])
        if t is None or not len(ids):
            continue
        flat = _reached(sources, at, mid, mids, which, t, ids, place.blocks)
        if not len(flat):
            continue
        theirs = vectors.astype(np.float32)
        slack = (norms * (np.sqrt((vectors * vectors).sum(axis=1).max()) * (dim + 8) * 2.0**-22) + 1e-30).astype(np.float32)
        width = len(ids)
        whole = single @ theirs.T if len(flat) > DENSE * len(sources) * width else None
        for i in range(0, len(flat), blocks.SIDE_BY_SIDE):
            part = flat[i : i + blocks.SIDE_BY_SIDE]
            r, c = part // width, part % width
            x = whole.reshape(-1)[part] if whole is not None else np.einsum("ij,ij->i", single.take(r, axis=0), theirs.take(c, axis=0))
            pos = np.searchsorted(marks, _marks(r, x))
            near = np.abs(values[pos - 1] - x) <= slack[r]
            near |= np.abs(values[np.minimum(pos, len(values) - 1)] - x) <= slack[r]
            if near.any():
                near = np.flatnonzero(near | ~np.isfinite(x))
                pos[near] = np.searchsorted(marks, _marks(r[near], _dot(own[r[near]], vectors[c[near]])))
            hist += np.bincount(pos, minlength=len(hist))
    total = np.cumsum(hist)
    return src, dst, score, total[ends[row]] - total[place_in[len(sources) :]]


def _marks(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Numbers that sort by row, then by x."""
    out = np.empty(len(row), np.complex128)
    out.real, out.imag = row, x
    return out


def _reached(sources: np.ndarray, at: np.ndarray, mid: np.ndarray, mids: np.ndarray, which: np.ndarray, steps: pa.Table, ids: np.ndarray, stride: int) -> np.ndarray:
    """What sources reach of a block's ids in two steps, but not in one or none, as rising numbers: the source's place times len(ids), and the
    id's place. First steps go from the source at place at to mid, which is mids[which]; steps (src, dst) lead to the block."""
    a, b = (steps[c].to_numpy() for c in ("src", "dst"))
    b = blocks._places(ids, b.astype(np.int64), stride)
    a, b = a[b >= 0], b[b >= 0]
    if (a[1:] < a[:-1]).any():
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
    begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    runs = a[begin]
    if not len(runs):
        return np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(a)))
    found = np.minimum(np.searchsorted(runs, mids), len(runs) - 1)
    there = runs[found] == mids
    first, count = np.where(there, begin[found], 0)[which], np.where(there, many[found], 0)[which]
    ends = np.cumsum(count)
    width = len(ids)
    seen, parts, lo = np.zeros(len(sources) * width, bool), [], 0
    sparse = not len(ends) or ends[-1] * 16 < len(seen)
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        n = count[lo:hi]
        step = np.arange(ends[hi - 1] - before) + np.repeat(first[lo:hi] - (ends[lo:hi] - n - before), n)
        flat = np.repeat(at[lo:hi] * width, n) + b[step]
        seen[flat] = True
        if sparse:
            parts.append(flat)
        lo = hi
    for row, nodes in ((at, mid), (np.arange(len(sources)), sources)):
        inside = np.flatnonzero(nodes % stride == ids[0] % stride)
        place = blocks._places(ids, nodes[inside], stride)
        seen[(row[inside] * width + place)[place >= 0]] = False
    if not sparse:
        return np.flatnonzero(seen)
    flat = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return flat[seen[flat]]
