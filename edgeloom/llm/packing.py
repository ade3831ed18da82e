"""Best-fit packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.cluster import ship, slices, written

CAPACITY = 2048
#: Pieces that one bucket is meant to hold while pieces of one length are numbered.
BUCKET_ROWS = 1_000


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece int, start long, length long, ids binary): each row's tokens followed by end_id, cut into pieces of
    capacity tokens only where there are more. ids are little-endian unsigned 32-bit. Null texts count as empty: one
    piece with end_id alone. Repeated rows give repeated pieces; other columns are ignored."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from edgeloom.llm.tokenizing import word_ids

        to_ids = word_ids(vocabulary).ids
        step = 4 * capacity
        for b in slices(batches):
            row, piece, ids = [], [], []
            held = 0
            for i, text in enumerate(b.column(1).to_pylist()):
                all_ids = to_ids(text or "") + end
                for k in range(0, len(all_ids), step):
                    row.append(i)
                    piece.append(k // step)
                    ids.append(all_ids[k : k + step])
                held += len(all_ids)
                if held > 32 << 20:
                    yield _pieces(b, row, piece, ids, capacity)
                    row, piece, ids, held = [], [], [], 0
            yield _pieces(b, row, piece, ids, capacity)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = [rows.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType(kinds)).withColumnRenamed("id", id_col)


def _pieces(b: pa.RecordBatch, row: list[int], piece: list[int], ids: list[bytes], capacity: int) -> pa.RecordBatch:
    number = np.array(piece, np.int32)
    length = np.array([len(x) // 4 for x in ids], np.int64)
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length), pa.array(ids, pa.binary())], names=["id", "piece", "start", "length", "ids"])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go, from how many there are of each length: rows (length, first, n, bin, per_bin, offset). Of the
    pieces of that length, numbered from 0, n from first on go to bins from bin on, per_bin to a bin, side by side
    from offset on.

    Pieces over a third of the capacity are large: from the longest on, each is matched with the longest other large
    one that still fits, so that a bin has two of them at most. Then small ones, longest first, go to the smallest gap
    that holds them. Runs of equal bins are handled at once. A piece leaves a gap of less than half of what was there,
    so a run is cut into few rows: their number depends on the capacity, not on how many pieces there are.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    left = {k: v for k, v in counts.items() if v > 0}
    used = dict.fromkeys(left, 0)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first bin, bins)

    def put(length: int, n: int, at: int, per_bin: int, offset: int) -> None:
        rows.append((length, used[length], n, at, per_bin, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - a) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at >= 0 and large[at] == a and left[a] == 1:  # its only match is itself
            at -= 1
            while at >= 0 and not left[large[at]]:
                large.pop(at)
                at -= 1
        if at < 0:
            n = left[a]
            gaps.setdefault(capacity - a, []).append((bins, n))
            put(a, n, bins, 1, 0)
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if capacity > a + b:
                gaps.setdefault(capacity - a - b, []).append((bins, n))
            put(a, n, bins, 1, 0)
            put(b, n, bins, 1, a)
        bins += n
    open_gaps = sorted(k for k in gaps if k)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                per = capacity // length
                whole = left[length] // per
                new = [(per, whole)] if whole else [(left[length], 1)]
                for per_bin, n in new:
                    put(length, per_bin * n, bins, per_bin, 0)
                    _leave(gaps, open_gaps, capacity - per_bin * length, bins, n)
                    bins += n
                continue
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            per = gap // length
            take = min(n, left[length] // per)
            if take:
                put(length, take * per, first, per, capacity - gap)
                _leave(gaps, open_gaps, gap - per * length, first, take)
            else:
                per, take = left[length], 1
                put(length, per, first, per, capacity - gap)
                _leave(gaps, open_gaps, gap - per * length, first, 1)
            if n > take:
                gaps[gap].append((first + take, n - take))
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.remove(gap)
    return rows


def _leave(gaps: dict, open_gaps: list[int], gap: int, first: int, n: int) -> None:
    if gap:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(open_gaps, gap)
        gaps[gap].append((first, n))


def best_fit(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pieces (id, piece, length from 1 to capacity, any others) with sequence_id and offset: pieces of one sequence
    lie side by side from 0 on, and no sequence holds over capacity tokens; see plan.

    The driver sees one count for each length, capacity of them at most. The pieces of a length are dealt by hash into
    buckets of about BUCKET_ROWS and numbered from there, so that neither a length nor a document gathers in one task;
    where a bucket's numbers begin comes by a join with one row for each bucket, which is shuffled as the pieces are.
    Lengths outside 1 to capacity are an error. An empty table gives an empty result.
    """
    pieces = written(pieces, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    rows = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    key = (rows[:, 0] << 48) + rows[:, 1]
    buckets = F.get(F.lit([max(1, -(-counts.get(k, 0) // BUCKET_ROWS)) for k in range(capacity + 1)]), F.col("length").cast("int"))
    dealt = pieces.withColumn("__b", F.pmod(F.xxhash64(id_col, "piece"), buckets).cast("int"))
    first = dealt.groupBy("length", "__b").agg(F.count("*").alias("__n")).selectExpr("length", "__b", "sum(__n) over (partition by length order by __b rows unbounded preceding) - __n __from")
    numbered = dealt.selectExpr("*", f"row_number() over (partition by length, __b order by `{id_col}`, piece) - 1 __i").join(first.hint("merge"), ["length", "__b"])
    numbered = numbered.select(*pieces.columns, (F.col("__from") + F.col("__i")).alias("__rank"))
    send = pieces.sparkSession.sparkContext.broadcast((rows, key))
    ship(pieces.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key = send.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "__rank"))
            r = rows[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            i = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(r[:, 3] + i // r[:, 4]), pa.array(r[:, 5] + i % r[:, 4] * length)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(place, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, pieces): the sequences themselves, from packed pieces that still have their ids."""
    lines = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return lines.select("sequence_id", F.aggregate("x", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.size("x").alias("pieces"))
