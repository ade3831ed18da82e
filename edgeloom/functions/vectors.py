"""Expressions on embeddings and scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _zip(f):
    return lambda a, b: F.zip_with(doubles(a), doubles(b), f)


#: Features of an edge from the embeddings of its ends, by name.
EDGE_FEATURES = {
    "hadamard": _zip(lambda x, y: x * y),
    "concat": lambda a, b: F.concat(doubles(a), doubles(b)),
    "average": _zip(lambda x, y: (x + y) / 2),
    "weighted_l1": _zip(lambda x, y: F.abs(x - y)),
    "weighted_l2": _zip(lambda x, y: (x - y) * (x - y)),
}

#: The same for arrays with an embedding a row.
ROW_FEATURES = {
    "hadamard": lambda a, b: a * b,
    "concat": lambda a, b: np.concatenate([a, b], axis=1),
    "average": lambda a, b: (a + b) / 2,
    "weighted_l1": lambda a, b: np.abs(a - b),
    "weighted_l2": lambda a, b: (a - b) * (a - b),
}


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    """With x held to +-40."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(x, F.lit(40.0)))))


def minus_log_sigmoid(x: Column) -> Column:
    """-log(sigmoid(x)), stable for any x."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
