"""Line dedup: documents that share runs of lines are aligned pair by pair, and the later one loses the common blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.cluster import ship, slices, written

#: Characters of an aligned block that is worth deleting.
BLOCK_CHARS = 60
#: Rows of runs that go to Spark at a time.
RUN_ROWS = 50_000


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, given by rising first number, whose second numbers rise too."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs (i, j) of equal lines a[i], b[j], both rising. Lines that occur once on either side anchor
    a stretch; stretches between anchors are aligned in turn; where no line is single, the first occurrence meets the
    first, the second the second, and so on."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i >= m or j >= n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {h: k for k, h in enumerate(b[j:n], j) if in_b[h] == 1}
        anchors = _rising([(k, place[h]) for k, h in enumerate(a[i:m], i) if in_a[h] == 1 and h in place])
        if anchors:
            for x, y in [*anchors, (m, n)]:
                todo.append((i, x, j, y))
                i, j = x + 1, y + 1
            found += anchors
        elif not in_a.keys().isdisjoint(in_b):
            at: dict[tuple[int, int], int] = {}
            count: Counter[int] = Counter()
            for k, h in enumerate(b[j:n], j):
                at[h, count[h]] = k
                count[h] += 1
            count.clear()
            pairs = []
            for k, h in enumerate(a[i:m], i):
                if (h, count[h]) in at:
                    pairs.append((k, at[h, count[h]]))
                count[h] += 1
            found += _rising(pairs)
    return sorted(found)


def numbered(text: str) -> tuple[list[int], list[str]]:
    """Where the lines that aren't blank stand, and those lines without outer blanks. Lines end at line feeds."""
    at, lines = [], []
    for i, x in enumerate(text.split("\n")):
        if x := x.strip(" "):
            at.append(i)
            lines.append(x)
    return at, lines


def runs(sizes: list[int], block_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """The shortest runs (from, to) of lines that have block_chars or more and start, or end, at some line, each once
    and by rising end. The runs inside any stretch of block_chars or more cover all of it."""
    i = chars = 0
    for j, n in enumerate(sizes):
        chars += n
        was = i
        while chars >= block_chars:
            chars -= sizes[i]
            i += 1
        # the lines before i reach block_chars by j; those from was on do so here first
        for k in range(min(was, i - 1), i) if i else ():
            yield k, j + 1


def aligned_lines(pos: list[int], size: list[int], at: list[int], run: list[int]) -> list[int]:
    """The lines that a document loses to an earlier one, from the runs that both hold: the run with key run[k] starts
    at line pos[k] here, at line at[k] there, and has size[k] lines.

    Both sides' runs are aligned by patience diff, and what lies in aligned runs goes, here wherever such a run stands;
    nothing else does. What was moved can't be in one rising alignment: the runs that it leaves are aligned anew, with
    the other side from back to front and from front to back in turn, until there are none. Each round takes the
    longest rising or falling stretch of what is left, so that even n runs in any order need some square root of n
    rounds."""
    places: dict[int, list[int]] = {}
    for k in sorted(range(len(pos)), key=lambda k: (pos[k], size[k])):
        places.setdefault(run[k], []).append(k)
    left, cut, back = [x[0] for x in places.values()], set(), False
    while left:
        there = [x[2] for x in sorted(((at[k], size[k], run[k]) for k in left), reverse=back)]
        met = {i for i, _ in align([run[k] for k in left], there)}
        if not met:
            break
        for i in met:
            for k in places[run[left[i]]]:
                cut.update(range(pos[k], pos[k] + size[k]))
        left, back = [k for i, k in enumerate(left) if i not in met], not back
    return sorted(cut)


def held_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, t, run binary, pos, size): the runs of every different text t of an id, by digest; see runs."""
    ship(docs.sparkSession)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            row, key, pos, size = [], [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                plain = numbered(text)[1]
                lines = [x.encode() for x in plain]
                for i, j in runs([len(x) for x in plain], block_chars):
                    row.append(k)
                    key.append(xxhash.xxh3_128_digest(b"\n".join(lines[i:j])))
                    pos.append(i)
                    size.append(j - i)
                if len(row) >= RUN_ROWS:
                    yield _run_rows(b, row, key, pos, size)
                    row, key, pos, size = [], [], [], []
            yield _run_rows(b, row, key, pos, size)

    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(cover, T.StructType([*texts.schema.fields[:2], *T.StructType.fromDDL("run binary, pos int, size int").fields]))


def _run_rows(b: pa.RecordBatch, row: list[int], key: list[bytes], pos: list[int], size: list[int]) -> pa.RecordBatch:
    at = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(key, pa.binary()), pa.array(pos, pa.int32()), pa.array(size, pa.int32())], names=["id", "t", "run", "pos", "size"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, t, cuts array<int>): the lines, by number among those that aren't blank, that each document's text t loses.

    Lines are split at line feeds and compared without outer blanks; blank ones count for nothing. A short line is
    frequent and says little, so a line counts by its runs: the shortest runs of lines around it that reach
    block_chars, the least that can be deleted (a long line is a run of its own). A document is aligned with the first
    document (smallest id) that holds one of its runs, for each of its runs that an earlier document holds. Whichever
    earlier document is met, an aligned run goes, and the first holder has them all: so the result is the same as from
    aligning every two documents, for short, frequent and rare lines alike, while pairs grow with the occurrences of runs.
    Of a pair only the shared runs are shuffled, as digest and place, never the documents.

    Documents that lose nothing, null texts and null ids have no row. Different texts of one id are cut each for
    itself, and none to another of that id.
    """
    every = written(held_runs(docs, id_col, text_col, block_chars), "runs")
    shared = every.groupBy("run").agg(F.min(F.struct("id", "t", "pos")).alias("first"), F.max("id").alias("last")).where("first.id < last").select("run", "first")
    # both sides are shuffled, so that a frequent run can be split
    met = every.join(written(shared, "shared"), "run").where("id > first.id")
    pairs = met.groupBy("id", "t", F.col("first.id").alias("oid"), F.col("first.t").alias("ot")).agg(F.collect_list(F.struct("pos", "size", F.col("first.pos").alias("at"), "run")).alias("x"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            cuts = []
            for k in range(b.num_rows):
                x = b.column(2)[k].values
                number: dict[bytes, int] = {}
                run = [number.setdefault(w, len(number)) for w in x.field(3).to_pylist()]
                cuts.append(aligned_lines(x.field(0).to_pylist(), x.field(1).to_pylist(), x.field(2).to_pylist(), run))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cuts, pa.list_(pa.int32()))], names=["id", "t", "cuts"])

    rows = pairs.select("id", "t", "x")
    cut = rows.mapInArrow(meet, T.StructType([*rows.schema.fields[:2], T.StructField("cuts", T.ArrayType(T.IntegerType()))]))
    return cut.groupBy("id", "t").agg(F.flatten(F.collect_list("cuts")).alias("cuts")).withColumnRenamed("id", id_col)


def without(text: str, cuts: np.ndarray) -> str:
    """text without the lines of these numbers, and without the blank ones between two of them."""
    lines = text.split("\n")
    at, _ = numbered(text)
    gone = sorted(set(map(int, cuts)))
    keep = np.ones(len(lines), bool)
    for i, k in enumerate(gone):
        keep[at[k]] = False
        if i and gone[i - 1] == k - 1:
            keep[at[k - 1] : at[k]] = False
    return "\n".join(x for x, stays in zip(lines, keep.tolist(), strict=True) if stays)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with their repeated lines cut from text_col (see repeated_lines); all rows and columns stay. A text that
    loses every line becomes empty. Only texts that lose lines pass through Python. An empty table stays empty."""
    cuts = repeated_lines(docs, id_col, text_col, **how).select(F.col(id_col).alias("__id"), F.col("t").alias("__t"), F.col("cuts").alias("__cuts"))

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else without(x, c) for x, c in zip(text, cuts, strict=True)], dtype=object)

    both = docs.join(cuts, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__t")), "left")
    new = rewrite(F.when(F.col("__cuts").isNotNull(), F.col(text_col)), F.col("__cuts"))
    return both.withColumn(text_col, F.coalesce(new, F.col(text_col))).select(docs.columns)
