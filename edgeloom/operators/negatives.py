"""Negative edges. Random numbers are keyed by seed and row, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.cluster import bucketed, discard, written
from edgeloom.functions.hashing import draw
from edgeloom.operators.graph import Graph, numbered_neighbours, swapped, two_hop_closure


#: A slot's attempts in the first round; every round has twice as many as the one before, for the slots still open.
FIRST_ATTEMPTS = 1


def _by_rounds(slots: DataFrame, keys: list[str], attempts: int, tries: Callable[[DataFrame], DataFrame], also: tuple[str, ...] | list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(filled, open): for each of slots, known by keys, its first good attempt, as keys, its columns also, and what that attempt got; and
    the slots for which all fail. tries gives every row back, a slot with an attempt, with got: a struct, attempt included, or
    null where the attempt fails.

    The state is what is still open: a round makes a few attempts for each open slot, writes down every one with what
    it got, and goes on with those that got nothing, so that the usual slot costs one attempt, and only stubborn ones cost
    many. A round is one job, and one of a single attempt joins and sorts nothing by slot. Repeated slots get the same row each."""
    left, filled, first, many = slots, None, 1, FIRST_ATTEMPTS
    while first <= attempts:
        last = min(attempts, first + many - 1)
        if last == first:
            done = tries(left.withColumn("attempt", F.lit(first))).select(*left.columns, "got")
        else:
            left = written(left, "slots") if first == 1 else left
            made = tries(left.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last))))).where("got is not null")
            made_first = made.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("got.attempt"))).where("__n = 1").select(*keys, "got")
            done = left.join(made_first, keys, "left").select(*left.columns, "got")
        done = written(done.withColumn("met", F.col("got").isNotNull()), "round")
        part = done.where("met").select(*keys, *also, "got.*")
        filled = part if filled is None else filled.unionByName(part)
        if first == 1:
            discard(left)
        left = done.where("not met").drop("got", "met")
        if left.isEmpty():
            break
        first, many = last + 1, 2 * many
    return filled, left


def _known(edges: DataFrame, both_ways: bool) -> DataFrame:
    """The different edges, with both_ways in either direction, in buckets by both ends for the lookups of all rounds."""
    e = edges.select("src", "dst")
    return bucketed((e.unionByName(swapped(e)) if both_ways else e).distinct(), ["src", "dst"], "known")


def _met(rows: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """rows, all of them, with edge: true where their columns a and b are one of known, else null."""
    return rows.join(known.select(F.col("src").alias(a), F.col("dst").alias(b), F.lit(True).alias("edge")), [a, b], "left")


def uniform(g: Graph, positives: DataFrame, per_positive: int = 1, seed: int = 0, reject_existing: bool = False, reject_loops: bool = True, attempts: int = 16, tell: bool = False) -> DataFrame:
    """(pair, side, slot, src, dst): for each positive (pair, src, dst) per_positive pairs with another dst, side 0, and
    as many with another src, side 1, drawn from all nodes. Of attempts draws the first that passes counts; if none
    does, the last stands, so that there are always 2 * per_positive. With tell also attempt, from 1: the one that
    counted, null where the last stands."""
    slots = positives.select("pair", "src", "dst", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("side")).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(per_positive))))
    keys, out = ["pair", "side", "slot"], ["pair", "side", "slot", "src", "dst", "attempt"]
    known = _known(g.edges, True) if reject_existing else None

    def ends(rows: DataFrame) -> DataFrame:
        x = draw(g.num_nodes, seed, "pair", "side", "slot", "attempt").cast("int")
        return rows.withColumn("a", F.when(F.col("side") == 0, F.col("src")).otherwise(x)).withColumn("b", F.when(F.col("side") == 0, x).otherwise(F.col("dst")))

    def tries(rows: DataFrame) -> DataFrame:
        made = ends(rows)
        bad = F.col("a") == F.col("b") if reject_loops else F.lit(False)
        if reject_existing:
            made, bad = _met(made, known, "a", "b"), bad | F.coalesce("edge", F.lit(False))
        return made.withColumn("got", F.when(~bad, F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "attempt")))

    filled, left = _by_rounds(slots, keys, attempts if reject_existing or reject_loops else 1, tries)
    last = ends(left.withColumn("attempt", F.lit(attempts))).select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(None).cast("int").alias("attempt"))
    return filled.select(*out).unionByName(last).select(*(out if tell else out[:-1]))


def nonedge(g: Graph, positives: DataFrame, per_positive: int = 1, seed: int = 0, attempts: int = 24, tell: bool = False) -> DataFrame:
    """(pair, slot, src, dst): for each positive per_positive pairs of any two different nodes that are no edge in
    either direction; a slot for which all attempts fail is left out. With tell also attempt, from 1: the one that
    counted."""
    slots = positives.select("pair").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(per_positive))))
    known = _known(g.edges, True)
    end = lambda name: draw(g.num_nodes, seed, "pair", "slot", "attempt", F.lit(name)).cast("int").alias(name)

    def tries(rows: DataFrame) -> DataFrame:
        met = _met(rows.select("*", end("src"), end("dst")), known, "src", "dst")
        return met.withColumn("got", F.when((F.col("src") != F.col("dst")) & F.col("edge").isNull(), F.struct("src", "dst", "attempt")))

    return _by_rounds(slots, ["pair", "slot"], attempts, tries)[0].select("pair", "slot", "src", "dst", *(["attempt"] if tell else []))


def two_hop(g: Graph, positives: DataFrame, per_positive: int = 1, seed: int = 0, attempts: int = 16, tell: bool = False, by_way: bool = False) -> DataFrame:
    """(pair, slot, src, dst): for each positive up to per_positive ends of two-step walks from its src that are
    neither src nor its neighbour; the first good one of attempts walks counts, and a slot without one is left out, as
    are those of sources without neighbours. With tell also attempt, from 1: the one that counted; with by_way also mid, the
    node between."""
    once = written(g.edges.select("src", "dst"), "once")
    rows = bucketed(numbered_neighbours(once), ["src", "i"], "neighbours")
    known = _known(once, False)
    discard(once)
    n = rows.where("i = 0").select("src", "n")
    slots = positives.select("pair", "src").join(n, "src").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(per_positive))))
    keys = ("pair", "slot", "attempt")

    def tries(open_: DataFrame) -> DataFrame:
        first = open_.withColumn("i", draw(F.col("n"), seed, *keys, F.lit("mid"))).join(rows.select("src", "i", F.col("dst").alias("mid"), "dst_n"), ["src", "i"]).drop("i")
        second = first.withColumn("i", draw(F.when(F.col("dst_n") > 0, F.col("dst_n")), seed, *keys, F.lit("dst"))).drop("dst_n")
        walked = second.join(rows.select(F.col("src").alias("mid"), "i", "dst"), ["mid", "i"], "left").drop("i", *([] if by_way else ["mid"]))
        good = F.col("dst").isNotNull() & (F.col("dst") != F.col("src")) & F.col("edge").isNull()
        return _met(walked, known, "src", "dst").withColumn("got", F.when(good, F.struct("dst", "attempt", *(["mid"] if by_way else []))))

    filled = _by_rounds(slots, ["pair", "slot"], attempts, tries, also=["src"])[0]
    return filled.select("pair", "slot", "src", "dst", *(["attempt"] if tell else []), *(["mid"] if by_way else []))


def two_hop_of_sources(g: Graph, sources: DataFrame, walks: int, seed: int = 0) -> DataFrame:
    """(src, dst): up to walks different ends of two-step walks from each source, none of them its neighbour."""
    one = sources.select("src").distinct().select(F.col("src").cast("long").alias("pair"), "src", F.col("src").alias("dst"))
    return two_hop(g, one, walks, seed, attempts=4).select("src", "dst").distinct()


def flatten(negatives: DataFrame, column: str = "negatives") -> DataFrame:
    """(src, dst) from rows (src, negatives array): one pair for each negative of a source."""
    return negatives.select("src", F.explode(column).alias("dst"))


def pools(spark: SparkSession, num_nodes: int, batches: int, size: int, seed: int = 0) -> DataFrame:
    """(batch, slot, id): for each batch a pool of size nodes, drawn from all with repetition, that all its positives
    share as negatives."""
    rows = spark.range(batches).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    return rows.select("batch", "slot", draw(num_nodes, seed, "batch", "slot").cast("int").alias("id"))


def sampling_stats(sampled: DataFrame, wanted: int) -> DataFrame:
    """(total, found, failed, mean_attempts, first_share, failed_share) of a sampler that was to fill so many slots and
    tells its attempts: mean_attempts is over those found, the shares are of all slots, failures included; 0 where
    nothing is to be divided by. Rows without an attempt, which stand for want of a better one, failed."""
    good = F.col("attempt").isNotNull()
    c = sampled.agg(F.count_if(good).alias("found"), F.sum("attempt").alias("tries"), F.count_if(F.col("attempt") == 1).alias("first"))
    total = F.lit(wanted).cast("long")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.select(
        total.alias("total"), "found", (total - F.col("found")).alias("failed"), share(F.coalesce("tries", F.lit(0)), F.col("found")).alias("mean_attempts"), share(F.col("first"), total).alias("first_share"),
        share(total - F.col("found"), total).alias("failed_share"),
    )


#: Samplers by name.
SAMPLERS: dict[str, Callable[..., DataFrame]] = {"uniform": uniform, "uniform_nonedge": nonedge, "two_hop": two_hop}

#: Those that training for link prediction may use.
TRAINING_SAMPLERS = ("two_hop", "uniform_nonedge")


def training_sampler(name: str) -> Callable[..., DataFrame]:
    if name not in TRAINING_SAMPLERS:
        raise ValueError(f"unknown sampler for training: {name}; there are {', '.join(TRAINING_SAMPLERS)}")
    return SAMPLERS[name]


def positives_per_batch(examples: int, sampler: str | None = None, per_positive: int = 1) -> int:
    """Positives of a batch that has so many examples with its negatives; one at least. The uniform sampler gives
    negatives for either end."""
    each = 1 if sampler is None else 1 + per_positive * (2 if sampler == "uniform" else 1)
    return max(1, examples // each)


__all__ = ["SAMPLERS", "flatten", "nonedge", "pools", "sampling_stats", "two_hop", "two_hop_closure", "two_hop_of_sources", "uniform"]
