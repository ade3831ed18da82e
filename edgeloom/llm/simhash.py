"""SimHash near-duplicates: fingerprints, then bit-sliced comparison inside blocks that share bits."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.cluster import ship, slices, written
from edgeloom.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: The 64 bits are cut into radius + SPARE parts. So many differing bits touch as many parts at most, and some choice of SPARE parts agrees.
SPARE = 3
#: Beyond it blocks would share too few bits to be worth comparing; near_dedup has another way to find its blocks.
MOST_RADIUS = 8
#: Fingerprints of one tile; a block with more of them is compared tile by tile.
TILE = 1024
#: 64-lane words that one step of the bit-sliced comparison holds.
WORDS = 1 << 19


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set where over half the shingles' XXH64 have it; no words: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((h(x, seed) for x in parts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp long): the fingerprint of every row's whole text, as the same 64 bits signed. Null and empty texts get
    zero; other columns are ignored; repeated rows stay repeated."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(x, shingle, seed) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())])).withColumnRenamed("id", id_col)


def near_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of positions whose fingerprints differ in radius or fewer bits, both in the same block; blocks lie
    one after the other, of the given sizes. fps: one uint64, or a row of them, for each fingerprint.

    Every block's fingerprints stand in bit planes, 64 of them to a word. Each fingerprint meets the words of its
    block: plane after plane, the differing lanes are added to a bit-sliced counter by carries, and a word leaves once
    all its lanes exceed the radius.
    """
    if radius < 0:
        raise ValueError("the radius is a number of bits, from 0 on")
    fps = fps.reshape(len(fps), -1) if len(fps) else np.zeros((0, 1), np.uint64)
    sizes = np.asarray(sizes, np.int64)
    words = (sizes + 63) // 64
    first, first_word = np.cumsum(sizes) - sizes, np.cumsum(words) - words
    block = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(fps)) - first[block]
    at_word, at_lane = first_word[block] + lane // 64, (lane % 64).astype(np.uint64)
    one = np.uint64(1)

    def plane(bits: np.ndarray | int) -> np.ndarray:
        out = np.zeros(int(words.sum()) * 64, np.uint8)
        out[first_word[block] * 64 + lane] = bits
        return np.packbits(out, bitorder="little").view(np.uint64)

    # what meets what: each fingerprint and each word of its block from its own word on
    n = words[block] - lane // 64
    q = np.repeat(np.arange(len(fps)), n)
    w = at_word[q] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
    far = ~plane(1)[w]
    own = w == at_word[q]
    far[own] |= (np.uint64(2) << at_lane[q[own]]) - one  # itself and those before it; lane 63 wraps to all
    count = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
    for b in range(64 * fps.shape[1]):
        if b % 8 == 0 and len(q):
            far |= _over(count, radius)
            live = far != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not live.all():
                q, w, far, count = q[live], w[live], far[live], [c[live] for c in count]
        if not len(q):
            break
        bits = (fps[:, b // 64] >> np.uint64(b % 64)) & one
        carry = plane(bits)[w] ^ (np.uint64(0) - bits[q])
        for k in range(min(len(count), (b + 1).bit_length())):
            count[k], carry = count[k] ^ carry, count[k] & carry
        far |= carry if (b + 1).bit_length() > len(count) else np.uint64(0)  # more than the counter holds
    near = ~(far | _over(count, radius)) if len(q) else far
    hit = np.flatnonzero(near)
    bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, col = np.nonzero(bits)
    left = q[hit][row]
    right = first[block[left]] + (w[hit][row] - first_word[block[left]]) * 64 + col
    return left, right


def _over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose counter, lowest plane first, is above the radius."""
    over, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            over |= same & count[k]
            same &= ~count[k]
    return over


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest position linked to each of n positions."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(0)
        sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, np.int64)
        flat = lists.flatten()
        fps = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
        reps = flat.field(1)
        cost = np.cumsum(sizes * ((sizes + 63) // 64))
        start = row = 0
        while row < len(sizes):  # as many blocks at a time as memory is meant for
            end = max(row + 1, int(np.searchsorted(cost, (cost[row - 1] if row else 0) + WORDS, "right")))
            n = int(sizes[row:end].sum())
            i, j = near_pairs(fps[start : start + n], sizes[row:end], radius)
            label = forest(i, j, n)
            member = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([reps.take(pa.array(start + member)), reps.take(pa.array(start + label[member]))], names=["a", "b"])
            start, row = start + n, end


def near_links(unique: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the reps of fingerprints that differ in radius or fewer bits (0 to MOST_RADIUS): for every
    block of fingerprints that share SPARE of radius + SPARE bit ranges, a spanning forest rather than all pairs.

    unique: (fp long, rep), each fp once. A block with over TILE members is dealt into tiles by hash, and every two
    tiles meet in a row of their own: no task gets a whole large block, and no pair is left out.
    """
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"the radius must lie between 0 and {MOST_RADIUS}")
    ship(unique.sparkSession)
    parts = radius + SPARE
    ends = [round(i * 64 / parts) for i in range(parts + 1)]
    spans = [((1 << ends[i + 1]) - (1 << ends[i])) for i in range(parts)]
    masks = [sum(x) for x in itertools.combinations(spans, SPARE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = unique.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "k"))
    count = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    tiles = keyed.join(count, ["t", "k"]).select(
        "t", "k", "fp", "rep", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TILE)).cast("int").alias("i")
    )
    met = tiles.select("t", "k", "fp", "rep", "i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j")).select(
        "t", "k", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.struct("fp", "rep").alias("x")
    )
    blocks = met.groupBy("t", "k", "i", "j").agg(F.collect_list("x").alias("x")).where(F.size("x") > 1).select("x")
    kind = unique.schema["rep"].dataType
    return blocks.mapInArrow(lambda it: _links(it, radius), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint string of 16 hex digits, component_id) for every row: component_id is the smallest id that
    links of radius or fewer differing bits reach, the row's own included.

    Equal fingerprints count once in the comparison, so a group of copies of any size costs one member. Null, empty
    and wordless texts have fingerprint zero and are linked to each other. Repeated rows give repeated rows with the
    same component. Rows with a null id keep a row; their id takes no part in the minimum. An empty table gives an
    empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    unique = written(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "unique")
    parts = connected_components(near_links(unique.where("rep is not null"), radius), "a", "b")
    named = unique.join(parts, unique["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
