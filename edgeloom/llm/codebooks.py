"""Vector code compression by ball k-means: a codebook for each part of the vectors, and codes that name an entry for each part.

After the first assignment every entry is a ball: its parts lie within a radius that is known from the round before.
Entries whose centres are further apart than twice that radius can't take parts from each other, so only the others are
neighbours. A part nearer to its centre than half the way to the nearest neighbour is in the stable core and keeps its
entry; any other compares the neighbours up to twice its distance from the centre, the rings that reach it, and no more.
All of this is exact: sums, distances and bounds are whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_checked, discard, ship, slices, written
from edgeloom.llm.ann import _matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are assigned at a time.
ROWS = 1024


@dataclass(frozen=True)
class Codebooks:
    """centres: (parts, entries, width) whole numbers; radius: (parts, entries), how far the parts that were assigned
    to an entry lie from its centre at most, or nothing before the first assignment; dim: length of the vectors, of
    which the last part is filled up with zeros."""

    centres: np.ndarray
    dim: int
    radius: np.ndarray | None = None

    def sha256(self) -> str:
        """Of all components in the order of part, entry and place, as decimals with commas between."""
        return hashlib.sha256(",".join(map(str, self.centres.ravel().tolist())).encode()).hexdigest()


def limit(dim: int) -> int:
    """What components are held to, in either direction, so that four times a squared distance has room in 64 bits."""
    return isqrt((1 << 61) // max(1, dim)) // 2


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row by squared distance, ties to the lower index; all are compared."""
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=-1)


def balls(centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, apart): for each entry of one part position the others from near to far, with their squared distances;
    those that are no neighbours, as the ball doesn't reach half the way, are infinitely far."""
    far = np.iinfo(np.int64).max
    apart = squared(centres[:, None], centres[None])
    apart[(apart > 4 * np.minimum(radius, 1 << 30)[:, None] ** 2) | np.eye(len(centres), dtype=bool)] = far
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, 1)


def reassign(x: np.ndarray, centres: np.ndarray, was: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, int]:
    """(entries, compared): the same as nearest, from the entries that the rows had; compared counts distances to
    other entries."""
    own = squared(x, centres[was])
    out = was.copy()
    ring = np.flatnonzero(apart[was, 0] <= 4 * own)  # all others are in the stable core
    if not len(ring):
        return out, 0
    reach = np.zeros(len(ring), np.int64)
    for entry in np.unique(was[ring]):
        at = was[ring] == entry
        reach[at] = np.searchsorted(apart[entry], 4 * own[ring[at]], "right")
    first = np.concatenate([[0], np.cumsum(reach)[:-1]])
    row = np.repeat(ring, reach)
    entry = order[was[row], np.arange(len(row)) - np.repeat(first, reach)]
    away = squared(x[row], centres[entry])
    best = np.minimum.reduceat(away, first)
    lowest = np.minimum.reduceat(np.where(away == np.repeat(best, reach), entry, len(centres)), first)
    better = (best < own[ring]) | ((best == own[ring]) & (lowest < was[ring]))
    out[ring[better]] = lowest[better]
    return out, len(row)


def _assigned(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """The rows with their new codes and errors, and at the end a row of counts for each entry that the task has met."""
    parts, entries, width = books.centres.shape
    around = [balls(c, r) for c, r in zip(books.centres, books.radius, strict=True)] if books.radius is not None else None
    n, far, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    none = lambda k, kind: pa.nulls(k, kind)
    numbers, label_type, id_type = pa.list_(pa.int64()), None, None
    names = ["id", "label", "x", "codes", "error", "part", "entry", "n", "far", "sums"]
    for b in (s for batch in batches for s in slices(iter([batch]), ROWS)):
        if not b.num_rows:
            continue
        id_type, label_type = b.column("id").type, b.column("label").type
        x = _matrix(b.column("x")).astype(np.int64).reshape(b.num_rows, -1)
        x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(b.num_rows, parts, width)
        was = np.frombuffer(b"".join(b.column("codes").to_pylist()), ">u2").reshape(-1, parts).astype(np.int64) if around else None
        codes, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
        for p in range(parts):
            part = x[:, p]
            codes[:, p] = reassign(part, books.centres[p], was[:, p], *around[p])[0] if around else nearest(part, books.centres[p])
            away = squared(part, books.centres[p][codes[:, p]])
            error += away
            n[p] += np.bincount(codes[:, p], minlength=entries)
            np.maximum.at(far[p], codes[:, p], away)
            np.add.at(sums[p], codes[:, p], part)
        k = b.num_rows
        raw = pa.array([r.tobytes() for r in codes.astype(">u2")], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("x"), raw, pa.array(error), none(k, pa.int32()), none(k, pa.int32()), none(k, pa.int64()), none(k, pa.int64()), none(k, numbers)], names=names)
    if id_type is not None:
        p, e = np.nonzero(n)
        k = len(p)
        yield pa.RecordBatch.from_arrays([
            none(k, id_type), none(k, label_type), none(k, pa.list_(pa.int32())), none(k, pa.binary()), none(k, pa.int64()), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(far[p, e]),
            pa.array(sums[p, e].tolist(), numbers),
        ], names=names)


def assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """rows (id, label, x, codes) with new codes and the error, the squared distances added up over parts, as a written table; rows
    with a part hold, for each task and entry, the count, sum and largest squared distance of its parts."""
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"id {kind('id')}, label {kind('label')}, x array<int>, codes binary, error long, part int, entry int, n long, far long, sums array<long>"
    return written(rows.mapInArrow(lambda it: _assigned(it, books), schema), "codes")


def moved(table: DataFrame, books: Codebooks) -> Codebooks:
    """books after every entry has moved to the floor of the mean of its parts; unused ones stay. What comes to the
    driver is one row for each part position and entry."""
    parts, entries, width = books.centres.shape
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    found = table.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *total).collect()
    centres, radius = books.centres.copy(), np.zeros((parts, entries), np.int64)
    for r in found:
        at = (r.part, r.entry)
        centres[at] = [int(r[f"s{i}"]) // r.n for i in range(width)]
        step = int(squared(centres[at], books.centres[at]))
        radius[at] = isqrt(r.far) + isqrt(step) + 2  # either root rounded up
    return Codebooks(centres, books.dim, radius)


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> tuple[DataFrame, int]:
    """(rows (id, label, x array<int>, codes), dim): the floors of scale times the components, of the vectors that
    have nothing but finite components and are as long as that of the smallest id."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    first = kept.where("id is not null").agg(F.min(F.struct("id", F.size("v").alias("dim")))["dim"].alias("dim")).first()
    dim = first.dim if first.dim is not None else -1
    most = float(limit(dim))
    held = lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x * scale))).cast("int")
    return kept.where(F.size("v") == dim).select("id", "label", F.transform("v", held).alias("x"), F.lit(None).cast("binary").alias("codes")), dim


def first_entries(rows: DataFrame, dim: int, parts: int, entries: int) -> Codebooks:
    """Codebooks of the parts of the smallest ids, each once with its smallest vector: entries rows at a time until
    there are as many different ids."""
    found: dict = {}
    while len(found) < entries:
        rest = rows.where(F.col("id") > max(found)) if found else rows.where("id is not null")
        more = rest.orderBy("id", "x").limit(entries).select("id", "x").collect()
        if not more:
            break
        for r in more:
            found.setdefault(r.id, r.x)
    width = -(-dim // parts)
    x = np.array(list(found.values())[:entries], np.int64).reshape(-1, dim)
    x = np.pad(x, ((0, 0), (0, parts * width - dim))).reshape(-1, parts, width)
    return Codebooks(np.ascontiguousarray(x.transpose(1, 0, 2)), dim)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """(rows (id, label, codes array<int>, error long), codebooks): for each vector the entry of each of its parts, and
    the squared distances to them added up, after the codebooks were moved rounds times.

    A round is one pass over the table, which also gives the counts of the next codebooks, and is written down; only
    those counts, one row for each task, part position and entry, are shuffled. Vectors that are null or hold null or
    other than finite components are left out, and so are those of another length than that of the smallest id. A
    length that is no multiple of parts is filled up with zeros. Components beyond limit() after scaling are held to
    it. Repeated rows of an id each get a row; for the first entries an id counts once, with its smallest vector. Rows
    without id get codes but begin no entry; if no row has an id, or in an empty table, there are no rows. Fewer ids
    than entries give as many entries."""
    if not 1 <= entries <= 1 << 16:
        raise ValueError("a code has room for 65,536 entries")
    ship(vectors.sparkSession)
    rows, dim = whole_numbers(vectors, id_col, vec_col, label_col, scale)
    if dim < 0:
        return rows.select(F.col("id").alias(id_col), "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")).limit(0), Codebooks(np.zeros((parts, 0, 0), np.int64), 0)
    books = first_entries(rows, dim, parts, entries)
    was: list[DataFrame] = []
    for _ in range(rounds):
        table = assign(rows, books)
        books = moved(table, books)
        discard(*was)
        was, rows = [table], _data(table)
    last = assign(rows, books)
    discard(*was)
    byte = lambda i: F.conv(F.hex(F.substring("codes", 2 * i + 1, 2)), 16, 10).cast("int")
    return _data(last).select(F.col("id").alias(id_col), "label", F.array(*[byte(i) for i in range(parts)]).alias("codes"), "error"), books


def _data(table: DataFrame) -> DataFrame:
    return table.where("part is null").select("id", "label", "x", "codes", "error")


def code_strings(coded: DataFrame, books: Codebooks, id_col: str = "vec_id") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of compressed rows: codes as two or more hex digits for each
    part, and the errors of each label added up, nulls together. Sums beyond 64 bits stop at the largest long."""
    digits = max(2, len(f"{max(books.centres.shape[1] - 1, 0):x}"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    both = coded.join(broadcast_checked(sums), F.col("label").eqNullSafe(F.col("of")))
    return both.select(id_col, code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def reconstruct(coded: DataFrame, books: Codebooks, id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(id, embedding array<double>): the vectors that the codes stand for."""
    held = F.lit([[[float(v) / scale for v in e] for e in p] for p in books.centres.tolist()])
    whole = F.flatten(F.transform("codes", lambda c, i: held[i][c]))
    return coded.select(id_col, F.slice(whole, 1, books.dim).alias("embedding"))
