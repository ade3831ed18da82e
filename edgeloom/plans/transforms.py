"""What training gets to see of a batch: transforms of raw batches by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import features, subgraphs
from edgeloom.operators.graph import in_order

Transform = Callable[[DataFrame], "DataFrame | subgraphs.Batches"]
TRANSFORMS: dict[str, Callable[..., Transform]] = {}


def transform(name: str):
    """Registers a function of parameters that gives a transform."""

    def add(f: Callable[..., Transform]) -> Callable[..., Transform]:
        TRANSFORMS[name] = f
        return f

    return add


def build(name: str, **how) -> Transform:
    if name not in TRANSFORMS:
        raise ValueError(f"unknown batch transform: {name}; there are {', '.join(TRANSFORMS)}")
    return TRANSFORMS[name](**how)


def raw_batches(rows: DataFrame, size: int) -> DataFrame:
    """rows (seq, src, dst, label, ...), as prepare.training_rows gives them, with batch: size positives with their
    negatives each, in the order of seq."""
    return rows.withColumn("batch", F.floor(F.col("seq") / size).cast("long"))


@transform("identity")
def identity() -> Transform:
    return lambda raw: raw


@transform("edge_label")
def edge_label() -> Transform:
    """(batch, place, src, dst, label): a batch's positives in their order, then its negatives."""

    def make(raw: DataFrame) -> DataFrame:
        rows = raw.select("batch", "seq", "src", "dst", "label", (-F.col("label")).alias("__negative"))
        return in_order(rows, ["__negative", "seq", "src", "dst"], ["batch"], "place").select("batch", "place", "src", "dst", "label")

    return make


@transform("edge_features")
def edge_features(vectors: DataFrame, how: str = "hadamard") -> Transform:
    """edge_label with the features of each pair from the embeddings of its ends."""
    return lambda raw: features.edge_features(edge_label()(raw), vectors, how)


@transform("subgraphs")
def enclosing_subgraphs(edges: DataFrame, size: int, hops: int = 1, label: str = "drnl", **how) -> Transform:
    """Batches of the pairs' subgraphs of that many hops, size pairs each, labelled; how: as k_hop_nodes takes it."""

    def make(raw: DataFrame) -> subgraphs.Batches:
        pairs = in_order(edge_label()(raw), ["batch", "place"], name="pair_id").select("pair_id", "src", "dst", "label")
        nodes = subgraphs.k_hop_nodes(pairs, edges, hops, **how)
        inside = subgraphs.induced_pairwise(pairs, nodes, edges)
        return subgraphs.batched(pairs, nodes, inside, size, subgraphs.labels(pairs, nodes, inside, label))

    return make
