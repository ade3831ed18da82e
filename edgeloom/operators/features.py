"""Features and scores of node pairs from embeddings, and models over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.cluster import discard, looked_up, lookups, written
from edgeloom.functions.hashing import draw, uniform
from edgeloom.functions.vectors import EDGE_FEATURES, ROW_FEATURES, dot, sigmoid
from edgeloom.operators import blocks


def with_ends(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) with the embeddings of the smaller and the larger id, so that a pair and its reverse look
    the same; src stays for grouping. Pairs without an embedding at either end are left out."""
    out = pairs.withColumn("__lo", F.least("src", "dst")).withColumn("__hi", F.greatest("src", "dst"))
    parts = lookups(vectors, "id", "embedding")
    for key, name in (("__lo", "lo_vec"), ("__hi", "hi_vec")):
        of = lambda t: t.select(F.col("id").alias(key), F.col("embedding").alias(name))  # noqa: B023, E731
        out = looked_up(out, of(vectors), key, name, None if parts is None else [of(t) for t in parts])
    return out.select(*pairs.columns, "lo_vec", "hi_vec")


def edge_features(pairs: DataFrame, vectors: DataFrame, how: str) -> DataFrame:
    """pairs with features array<double>, by name; see EDGE_FEATURES."""
    if how not in EDGE_FEATURES:
        raise ValueError(f"unknown edge feature: {how}")
    return with_ends(pairs, vectors).select(*pairs.columns, EDGE_FEATURES[how]("lo_vec", "hi_vec").alias("features"))


def dot_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with score, the inner product of their embeddings."""
    return with_ends(pairs, vectors).select(*pairs.columns, dot("lo_vec", "hi_vec").alias("score"))


@dataclass(frozen=True)
class Classifier:
    """A logistic regression over edge features."""

    coefficients: tuple[float, ...]
    intercept: float


#: A fit ends when a step is to lower the loss by a smaller share.
SETTLED = 1e-10


def fit_classifier(labelled: DataFrame, vectors: DataFrame, how: str = "hadamard", max_iter: int = 50, weight_decay: float = 0.0) -> Classifier:
    """A logistic regression over edge features of labelled pairs (src, dst, label), of max_iter steps at most; weight_decay weighs half the
    squares of coefficients, each times its feature's deviation.

    Newton steps, halved where they don't lower the loss. Pairs lie in blocks of their smaller id, and vectors too, as blocks says: a step shuffles
    and broadcasts nothing, no feature is kept, and each block gives the driver one row of sums, as long as the square of the features. vectors
    may lie in blocks already. Where Arrow can't read the shared folder, pairs meet vectors by joins, for Spark's own estimator."""
    if how not in EDGE_FEATURES:
        raise ValueError(f"unknown edge feature: {how}")
    table = vectors if blocks.place_of(vectors) else blocks.laid(vectors, blocks.blocks_for(vectors.count(), labelled.count()))
    if not blocks.place_of(table):
        x = edge_features(labelled, table, how).select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
        model = LogisticRegression(maxIter=max_iter, regParam=weight_decay).fit(x)
        return Classifier(tuple(model.coefficients.toArray().tolist()), model.intercept)
    dim = (table.select(F.size("embedding")).first() or [0])[0]
    size = ROW_FEATURES[how](np.zeros((1, dim)), np.zeros((1, dim))).shape[1]
    pairs = labelled.select(F.least("src", "dst").alias("anchor"), F.greatest("src", "dst").alias("context"), F.col("label").cast("double").alias("n"))
    links = blocks.links(pairs, blocks.place_of(table).blocks, both_ways=False)
    weights, best, lowest, decay = np.zeros(size + 1), None, np.inf, None
    for _ in range(max_iter + 1):
        rows = blocks.logistic_sums(links, table, ROW_FEATURES[how], weights).collect()
        sums = np.sum([r.sums for r in sorted(rows)], axis=0)
        n, ones = sums[:2]
        if n == 0:
            raise ValueError("no labelled pair has vectors")
        if ones in (0, n):
            weights = np.append(np.zeros(size), np.inf if ones else -np.inf)
            best = weights
            break
        loss, gradient, curve = sums[2] / n, sums[3 : size + 4] / n, sums[size + 4 :].reshape(size + 1, size + 1) / n
        if decay is None:  # without weights, 4 times the second derivatives are the features' moments
            spread = np.maximum(4 * np.diag(curve) - (4 * curve[-1]) ** 2, 0) * n / max(n - 1, 1)
            decay = weight_decay * np.append(spread[:-1], 0.0)
        loss += (decay * weights**2).sum() / 2
        if best is None and not np.isfinite(gradient).all():
            raise ValueError("features must be finite")
        if not loss <= lowest:
            weights = (weights + best) / 2
            continue
        best, lowest = weights, loss
        gradient, curve = gradient + decay * weights, curve + np.diag(decay)
        scale = np.sqrt(np.diag(curve))
        scale = np.where(scale > 0, scale, 1.0)
        step = -np.linalg.lstsq(curve / scale[:, None] / scale, gradient / scale, rcond=1e-12)[0] / scale
        if -gradient @ step <= SETTLED * loss:
            break
        weights = weights + step
    discard(links, *([table] if table is not vectors else []))
    return Classifier(tuple(best[:-1].tolist()), float(best[-1]))


def classifier_scores(model: Classifier, pairs: DataFrame, vectors: DataFrame, how: str = "hadamard") -> DataFrame:
    """pairs with score, the probability of a link. vectors may lie in blocks already; where Arrow can't read the shared folder, they are
    joined."""
    w, c, made = np.array(model.coefficients), model.intercept, ROW_FEATURES[how]
    table = vectors if blocks.place_of(vectors) else blocks.laid(vectors, blocks.blocks_for(vectors.count(), pairs.count()))
    if blocks.place_of(table):
        return blocks.valued(pairs, table, lambda a, b: blocks.probability(np.einsum("ij,j->i", made(a, b), w) + c), "score")
    margin = dot("features", F.array(*[F.lit(x) for x in model.coefficients])) + F.lit(c)
    return edge_features(pairs, table, how).select(*pairs.columns, (1 / (1 + F.exp(-margin))).alias("score"))


def fit_skipgram(contexts: DataFrame, num_nodes: int, vectors: DataFrame, negatives: int = 1, rounds: int = 8, rate: float = 2.0, seed: int = 0) -> DataFrame:
    """(id, embedding array<double>): vectors (id, embedding) after rounds of gradient descent on the skip-gram loss with
    negatives, over all pairs (anchor, context).

    Pairs are counted first. Vectors and pairs lie in blocks of nodes, as blocks says: a round shuffles the drawn pairs'
    ids alone, negatives of them for each pair's anchor and a node drawn from all by a hash of seed, round and pair, and writes the
    vectors. A node moves by rate times its mean gradient. The table of a round replaces that of the one before. Nodes without
    pairs keep their vectors. Where Arrow can't read the shared folder, each pair meets its vectors by two equi-joins."""
    pairs = counted_pairs(contexts)
    n = blocks.blocks_for(num_nodes, pairs.count())
    table = blocks.laid(vectors, n)
    links = blocks.links(pairs, n) if blocks.place_of(table) else None
    for step in range(rounds):
        new = blocks.laid(skipgram_round(pairs, links, table, num_nodes, step, negatives, rate, seed), n)
        discard(table)
        table = new
    discard(pairs, *([links] if links else []))
    return table


def counted_pairs(contexts: DataFrame) -> DataFrame:
    """(anchor, context, n double): the different pairs of contexts with their numbers, as a written table."""
    return written(contexts.groupBy("anchor", "context").agg(F.count("*").cast("double").alias("n")), "pairs")


def skipgram_round(pairs: DataFrame, links: DataFrame | None, table: DataFrame, num_nodes: int, step: int, negatives: int = 1, rate: float = 2.0, seed: int = 0) -> DataFrame:
    """The vectors of table (id, embedding array<double>) after the round of fit_skipgram that has number step: with links,
    which are the pairs in the blocks of table, also with their block, and without links by joins."""
    fake = pairs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(negatives)))).select("anchor", draw(num_nodes, seed, F.lit(step), "anchor", "context", "k").cast("int").alias("context"), (F.col("n") / negatives).alias("n"))
    if links:
        return blocks.descended(links, fake, table, rate)
    dim = (table.select(F.size("embedding")).first() or [0])[0]
    both = pairs.withColumn("y", F.lit(1.0)).unionByName(fake.withColumn("y", F.lit(0.0)))
    a, b = table.select(F.col("id").alias("anchor"), F.col("embedding").alias("va")), table.select(F.col("id").alias("context"), F.col("embedding").alias("vb"))
    met = both.join(a, "anchor").join(b, "context").withColumn("g", F.col("n") * (sigmoid(dot("va", "vb")) - F.col("y")))
    sides = F.array(F.struct(F.col("anchor").alias("id"), F.col("vb").alias("v")), F.struct(F.col("context").alias("id"), F.col("va").alias("v")))
    each = met.select("g", "n", F.explode(sides).alias("x")).select("x.id", "n", *[(F.col("g") * F.col("x.v")[i]).alias(f"g{i}") for i in range(dim)])
    move = each.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(f"g{i}").alias(f"g{i}") for i in range(dim)])
    move = move.select("id", F.array(*[rate * F.col(f"g{i}") / F.col("n") for i in range(dim)]).alias("d"))
    return table.join(move, "id", "left").select("id", F.when(F.col("d").isNull(), F.col("embedding")).otherwise(F.zip_with("embedding", "d", lambda x, y: x - y)).alias("embedding"))


def initial_embeddings(nodes: DataFrame, dim: int, how: str = "normal", scale: float | None = None, seed: int = 0) -> DataFrame:
    """(id, embedding) drawn by a hash of seed, id and place: normal with deviation scale (1/dim), uniform within
    +-scale (1/sqrt(dim)), or zeros."""
    at = F.sequence(F.lit(1), F.lit(dim))
    if how == "zeros":
        value = F.transform(at, lambda i: F.lit(0.0))
    elif how == "uniform":
        s = scale if scale is not None else dim**-0.5
        value = F.transform(at, lambda i: (2 * uniform(seed, "id", i) - 1) * s)
    elif how == "normal":
        s = scale if scale is not None else 1 / dim
        value = F.transform(at, lambda i: F.sqrt(-2 * F.log(1 - uniform(seed, "id", i, F.lit("r")))) * F.cos(2 * 3.141592653589793 * uniform(seed, "id", i, F.lit("a"))) * s)
    else:
        raise ValueError(f"unknown way to draw embeddings: {how}")
    return nodes.select("id", value.cast("array<float>").alias("embedding"))


def combine(tables: DataFrame, how: str) -> DataFrame:
    """(id, embedding array<double>) of tables (id, part, embedding): the first part's, the mean, or all in a row."""
    rows = tables.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", F.col("embedding").cast("array<double>").alias("e")))).alias("x"))
    if how == "first":
        value = F.col("x")[0]["e"]
    elif how == "concat":
        value = F.flatten(F.transform("x", lambda x: x["e"]))
    elif how == "mean":
        total = F.aggregate(F.slice("x", 2, F.size("x")), F.col("x")[0]["e"], lambda s, x: F.zip_with(s, x["e"], lambda a, b: a + b))
        value = F.transform(total, lambda v: v / F.size("x"))
    else:
        raise ValueError(f"unknown way to combine embeddings: {how}")
    return rows.select("id", value.alias("embedding"))


def by_original_id(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, embedding): vectors (id, embedding) under the original ids of ids (id, original). Vectors without an original
    id go; ids without a vector give none."""
    return vectors.join(ids.select("id", "original"), "id").select(F.col("original").alias("id"), "embedding")


def part_of(vectors: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """(id, embedding): the vectors with ids from rows[0] up to rows[1], and of them the components from columns[0] up to
    columns[1], ends left out, counted from 0."""
    (a, b), (c, d) = rows, columns
    if not (0 <= a <= b and 0 <= c <= d):
        raise ValueError(f"no such part: {rows}, {columns}")
    return vectors.where((F.col("id") >= a) & (F.col("id") < b)).select("id", F.slice("embedding", c + 1, d - c).alias("embedding"))
