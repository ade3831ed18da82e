"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import discard, written


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """One row (node, component) for each node of a link between two different nodes; component is the smallest
    node that can be reached.

    Each round rewires every edge to the smallest neighbour (first of larger neighbours, then of smaller ones) and is
    written down; the number of rounds grows with the logarithm of the component's size. Minimum and edges meet in an
    equi-join that shuffles both, so that adaptive execution can split a hub. Nulls and self links give nothing; an empty table
    gives an empty table.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    e = written(e.distinct(), "links")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("m", "u")  # no longer by u alone
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        new = written(small.distinct(), "links")
        was, state = state, _state(new)
        discard(e)
        e = new
        if was == state:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
