"""Temporal splits: the K-th latest timestamp, and train, validation and test edges around it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import unsigned_order, with_mix64, with_pair_hash

EXCLUDE, INCLUDE = "exclude", "include"


@dataclass(frozen=True)
class Threshold:
    """The k-th largest value, how many are larger, and how many equal it."""

    value: int
    above: int
    at: int


def kth_largest(df: DataFrame, col: str, k: int) -> Threshold:
    """By two histograms of 65,536 buckets at most, first of the upper 16 bits, then of the lower 16 in the bucket that
    holds it: two scans with small aggregates, whatever the k. k below 1 or beyond the rows is an error."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    raised = df.where(F.col(col).isNotNull()).select((F.col(col).cast("long") + (1 << 31)).alias("t"))

    def find(rows: list, left: int) -> tuple[int, int, int]:
        above = 0
        for bucket, n in sorted(((r[0], r[1]) for r in rows), reverse=True):
            if above + n >= left:
                return bucket, above, n
            above += n
        raise ValueError("k is larger than the number of rows")

    high, above, _ = find(raised.groupBy(F.shiftright("t", 16).alias("b")).count().collect(), k)
    inside = raised.where(F.shiftright("t", 16) == high)
    low, more, at = find(inside.groupBy(F.col("t").bitwiseAND(F.lit(0xFFFF)).alias("b")).count().collect(), k - above)
    return Threshold((high << 16) + low - (1 << 31), above + more, at)


def _after(t: int, ties: str):
    if ties not in (EXCLUDE, INCLUDE):
        raise ValueError(f"unknown policy for ties: {ties}")
    return F.col("ts") > t if ties == EXCLUDE else F.col("ts") >= t


@dataclass(frozen=True)
class Split:
    train: DataFrame
    val: DataFrame
    test: DataFrame | None = None


def temporal_split(edges: DataFrame, k: int, ties: str) -> Split:
    """The k latest directed edges are for validation, as pairs (src, dst) each once; all others, with ts, for
    training. Edges that tie with the k-th are all left out of validation or all taken in."""
    after = _after(kth_largest(edges, "ts", k).value, ties)
    return Split(edges.where(~after), edges.where(after).select("src", "dst").distinct())


def temporal_split_3way(edges: DataFrame, k_val: int, k_test: int, ties: str) -> Split:
    """As temporal_split for the k_val + k_test latest; of these the k_test latest, by the same policy, are for
    testing. If they are no more than k_test, all are, and validation is empty."""
    first = _after(kth_largest(edges, "ts", k_val + k_test).value, ties)
    late, train = edges.where(first), edges.where(~first)
    n = late.count()
    pairs = lambda df: df.select("src", "dst").distinct()
    if k_test >= n:
        return Split(train, pairs(late.limit(0)), pairs(late))
    after = _after(kth_largest(late, "ts", k_test).value, ties)
    return Split(train, pairs(late.where(~after)), pairs(late.where(after)))


def with_hash_timestamps(edges: DataFrame) -> DataFrame:
    """edges with a ts that depends on the unordered pair alone, for graphs without timestamps."""
    return with_pair_hash(edges.drop("ts"), "ts", "src", "dst")


def first_sources(rows: DataFrame, n: int) -> DataFrame:
    """rows (src, ...) of the first n sources in the order of evaluation (by unsigned hash, then id), each whole: for an
    evaluation that stops early. What is broadcast are n ids."""
    ordered = with_mix64(rows.select("src").distinct(), "__h", F.col("src").cast("long"))
    first = ordered.orderBy(unsigned_order("__h"), "src").limit(n).select("src")
    return rows.join(F.broadcast(first), "src", "left_semi")


def sample_pairs(pairs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n of the pairs (src, dst), all if there are fewer, drawn without replacement: those of the smallest hash of seed
    and pair. A top-n, of which each task passes on n rows at most."""
    key = F.shiftleft(F.col("src").cast("long"), 32).bitwiseOR(F.col("dst").cast("long")) + F.lit(seed)
    return with_mix64(pairs.select("src", "dst"), "__h", key).orderBy(unsigned_order("__h"), "src", "dst").limit(n).select("src", "dst")
