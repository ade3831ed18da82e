"""Near-duplicate documents by the similarity of their word shingles, compared by wide SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.cluster import broadcast_checked, ship, slices, written
from edgeloom.llm.components import connected_components
from edgeloom.llm.simhash import SEED, TILE, WORDS, forest, near_pairs

#: Words of a shingle, and the least share of two documents' shingles that they have in common to be near-duplicates.
SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint. Two documents at the similarity differ in 39 of 256 bits, give or take 5.7.
WIDTH = 4
#: Bits in which fingerprints of documents that are compared shingle by shingle differ, at most: three deviations more.
RADIUS = 56
#: Least hashes that a signature keeps, a byte of each, and the share that agrees in documents compared shingle by
#: shingle, at least: three and a half deviations below the similarity.
HASHES = 128
AGREE = 0.68
#: Documents meet that agree in all ROWS hashes of one of BANDS bands: at the similarity, all but one pair in 10,000.
BANDS = 13
ROWS = 3
#: Sets of fewer shingles are compared by signatures alone: in small sets so many bits of a fingerprint hang on a tie that
#: three deviations don't hold. That goes for what can be similar to them too.
SMALL = 32
#: Shingles of a tile of documents whose sets are compared, besides its TILE documents.
TILE_SHINGLES = 1 << 19
GOLDEN = 0x9E3779B97F4A7C15

_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 64, HASHES, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles, sorted; fewer words: the whole sequence; none: nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(x, seed) for x in parts), np.uint64, max(1, len(words) - shingle + 1)))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """WIDTH words of bits, each set where over half the shingles' hashes (spread to as many words) have it."""
    ones = np.zeros(64 * WIDTH, np.int64)
    for i in range(0, len(h), 16384):
        part = h[i : i + 16384]
        wide = np.stack([part, *(_mix(part + np.uint64(k * GOLDEN % (1 << 64))) for k in range(1, WIDTH))], axis=1)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """The least of each of HASHES hashes of the shingles."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(least, (h[i : i + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return _mix(least)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, t, node binary, bits binary, bands array<long>): each row's text by hash, the digest of its set of shingles,
    and what that set is compared by. Null texts count as empty; texts without words have an empty set and no bands."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.arange(BANDS, dtype=np.uint64) * np.uint64(GOLDEN)
        for b in slices(batches):
            node, bits, bands = [], [], []
            for text in b.column(2).to_pylist():
                h = shingles(text or b"", shingle, seed)
                node.append(xxhash.xxh3_128_digest(h.tobytes()))
                least = signature(h)
                bits.append(fingerprint(h).tobytes() + least.astype(np.uint8).tobytes() + bytes([min(len(h), 255)]))
                key = names.copy()
                for i in range(ROWS):
                    key = _mix(key ^ least[i * BANDS : (i + 1) * BANDS])
                bands.append(key.view(np.int64).tolist() if len(h) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.binary()), pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "t", "node", "bits", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("node binary, bits binary, bands array<long>").fields]))


def shingle_sets(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(node, h array<long>) from (node, text binary): the sets of shingles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            sets = [shingles(x or b"", shingle, seed) for x in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            h = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), h], names=["node", "h"])

    return texts.select("node", "text").mapInArrow(run, "node binary, h array<long>")


def likely_pairs(sketch: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in the same block whose fingerprints are within RADIUS and whose signatures agree, or both of
    which are small and whose signatures agree; sketch has a row of bytes for each member: fingerprint, signature and
    the number of shingles, as far as a byte goes."""
    least = np.ascontiguousarray(sketch[:, 8 * WIDTH : 8 * WIDTH + HASHES])
    i, j = near_pairs(np.ascontiguousarray(sketch[:, : 8 * WIDTH]).view(np.uint64), sizes, RADIUS)
    ok = [(least[i[k : k + 65536]] == least[j[k : k + 65536]]).mean(axis=1) >= AGREE for k in range(0, len(i), 65536)]
    ok = np.concatenate([*ok, np.zeros(0, bool)])
    left, right = [i[ok]], [j[ok]]
    small = np.flatnonzero(sketch[:, 8 * WIDTH + HASHES] < SMALL / SIMILARITY)
    block = np.searchsorted(np.cumsum(sizes), small, "right")
    ends = np.searchsorted(block, block, "right")  # where a member's block ends among the small ones
    for k, x in enumerate(small.tolist()):
        rest = small[k + 1 : ends[k]]
        if len(rest):
            near = rest[(least[rest] == least[x]).mean(axis=1) >= AGREE]
            left.append(np.full(len(near), x))
            right.append(near)
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1).astype(np.int64), axis=0)
    return pairs[:, 0], pairs[:, 1]


def similar_pairs(h: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links enough to connect what the similar ones of the pairs (i, j) connect; h: each position's set. A member is
    held against all its likely partners at once, those left out that it is connected with by then."""
    n = len(h)
    length = np.array([len(x) for x in h], np.int64)
    ends = np.cumsum(length)
    codes = np.unique(np.concatenate(h), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    here = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    degree = np.bincount(a, minlength=n)
    start = np.cumsum(degree) - degree
    label = np.arange(n)
    links = []
    for x in np.argsort(-degree, kind="stable").tolist():  # those with the most partners connect the most at once
        near = b[start[x] : start[x] + degree[x]]
        near = near[label[near] != label[x]]
        if not len(near):
            continue
        own = codes[ends[x] - length[x] : ends[x]]
        here[own] = True
        spots = np.repeat(ends[near] - np.cumsum(length[near]), length[near]) + np.arange(int(length[near].sum()))
        both = np.add.reduceat(here[codes[spots]].astype(np.int64), np.cumsum(length[near]) - length[near])
        here[own] = False
        for y in near[both >= similarity * (length[x] + length[near] - both)].tolist():
            if label[x] != label[y]:
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links


def _blocks(batch: pa.RecordBatch, cost: int) -> Iterator[tuple[pa.StructArray, np.ndarray]]:
    """The rows of a batch, each a list of members, as many at a time as memory is meant for: members and block sizes."""
    lists = batch.column(0)
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten()
    total = np.cumsum(sizes * ((sizes + 63) // 64))
    start = row = 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + cost, "right")))
        n = int(sizes[row:end].sum())
        yield flat.slice(start, n), sizes[row:end]
        start, row = start + n, end


def _sketches_of(part: pa.StructArray) -> np.ndarray:
    return np.frombuffer(b"".join(part.field(1).to_pylist()), np.uint8).reshape(len(part), -1)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, sizes in _blocks(b, WORDS // 4):
            label = forest(*likely_pairs(_sketches_of(part), sizes), len(part))
            member = np.flatnonzero(label != np.arange(len(part)))
            node = part.field(0)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(member)), node.take(pa.array(label[member]))], names=["a", "b"])


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, sizes in _blocks(b, WORDS // 4):
            i, j = likely_pairs(_sketches_of(part), sizes)
            ends = np.cumsum(sizes)
            block = np.searchsorted(ends, i, "right")
            links = []
            for k in np.unique(block).tolist():
                first = int(ends[k] - sizes[k])
                h = [part.field(2)[first + x].values.to_numpy(zero_copy_only=False) for x in range(int(sizes[k]))]
                links += [(first + x, first + y) for x, y in similar_pairs(h, i[block == k] - first, j[block == k] - first, similarity)]
            node = part.field(0)
            yield pa.RecordBatch.from_arrays([node.take(pa.array([x for x, _ in links], pa.int64())), node.take(pa.array([y for _, y in links], pa.int64()))], names=["a", "b"])


def _in_tiles(members: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    """(x array<struct>): the members (key, node, tiles, ...) of each key; where tiles is above one they are dealt into
    so many by hash, and every two tiles meet in a row."""
    m = members.select(*key, F.struct(*what).alias("x"), "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("i"))
    m = m.select(*key, "x", "i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"))
    return m.groupBy(*key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.collect_list("x").alias("x")).where(F.size("x") > 1).select("x")


def similar_sets(docs: DataFrame, unique: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, similarity: float) -> DataFrame:
    """(node, component): which sets of unique (node, bits, bands, who) are linked by a similarity as asked for.

    Sets that agree in a band make a block, in which likely pairs are found by their sketches alone. What likely pairs
    connect is a family; only families are compared shingle by shingle, each as one block, or by its bands if it is too
    large. Blocks over TILE members or TILE_SHINGLES shingles are dealt into tiles. Tasks pass on links enough to
    connect what is similar, never all pairs, and no likely pair is left out unless others connect its ends."""
    keyed = unique.select("node", F.explode("bands").alias("k"))
    blocks = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    members = written(keyed.join(blocks, "k"), "members")
    met = _in_tiles(members.join(unique.select("node", "bits"), "node"), ["k"], ["node", "bits"])
    families = written(connected_components(met.mapInArrow(_likely, "a binary, b binary"), "a", "b"), "families")
    busy = unique.join(families, "node").select("node", "bits", "who")
    at = broadcast_checked(busy.select("node", "who"))
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t")).alias("who"), F.col(text_col).cast("binary").alias("text")).join(at, "who")
    sets = written(shingle_sets(texts, shingle, seed).dropDuplicates(["node"]).join(busy.select("node", "bits"), "node"), "shingles")
    sizes = families.join(sets.select("node", F.size("h").alias("s")), "node")

    def tiles() -> tuple:
        return F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("s") / TILE_SHINGLES)).cast("int").alias("tiles"), F.count("*").alias("n")

    per = written(sizes.groupBy("component").agg(*tiles()), "sizes")
    alone = families.join(per.where("tiles = 1"), "component").select("component", F.lit(0).cast("long").alias("k"), "node", "tiles")
    large = sizes.join(per.where("tiles > 1").select("component"), "component").join(members.select("k", "node"), "node")
    counts = large.groupBy("component", "k").agg(*tiles()).where("n > 1").repartition("component", "k", "n")  # so that both sides are shuffled, and a hot key can be split
    large = large.join(counts, ["component", "k"]).select("component", "k", "node", "tiles")
    met = _in_tiles(alone.union(large).join(sets, "node"), ["component", "k"], ["node", "bits", "h"])
    return connected_components(met.mapInArrow(lambda it: _similar(it, similarity), "a binary, b binary"), "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, similarity: float = SIMILARITY) -> DataFrame:
    """(id, t, component binary) for every row, t being its text's hash: rows of a component are near-duplicates.

    Two documents are linked if their sets of word shingles have a Jaccard similarity of at least similarity; of equal
    sets one is compared. Candidates agree in a band of least hashes, differ in few bits of wide SimHash fingerprints
    (see simhash.near_pairs) and are confirmed by their whole sets. Null texts count as empty; texts without words are
    alike. Repeated rows stay repeated; other columns are ignored; an empty table gives an empty result.
    """
    rows = written(sketches(docs, id_col, text_col, shingle, seed), "sketches")
    unique = written(rows.groupBy("node").agg(F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.min(F.struct("id", "t")).alias("who")), "sets")
    parts = similar_sets(docs, unique, id_col, text_col, shingle, seed, similarity)
    return rows.join(parts, "node", "left").select(F.col("id").alias(id_col), "t", F.coalesce("component", "node").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without all but one document of each group of near-duplicates (see near_duplicates): that of the smallest
    id, then of the smallest text hash; of repeated rows of it one stays. Different texts of one id are different
    documents. Rows without an id stay; all columns stay."""
    named = docs.where(F.col(id_col).isNotNull())
    found = near_duplicates(named, id_col, text_col, **how).groupBy("component").agg(F.min(F.struct(F.col(id_col).alias("id"), "t")).alias("who"))
    kept = named.withColumn("__t", F.xxhash64(text_col)).join(found.select(F.col("who.id").alias("__id"), F.col("who.t").alias("__u")), (F.col(id_col) == F.col("__id")) & (F.col("__t") == F.col("__u")), "left_semi")
    return kept.dropDuplicates([id_col, "__t"]).select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
