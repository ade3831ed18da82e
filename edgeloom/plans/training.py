"""Training that can be cut off at any time: every round leaves a whole table, and a pointer that names it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.cluster import discard, get_text, names, put_text, remove
from edgeloom.operators import blocks
from edgeloom.operators.features import counted_pairs, skipgram_round
from edgeloom.operators.metrics import early_stopping


@dataclass
class State:
    """Where a run stands after a round. what: what the run is about, which a resumed run must share; history: the
    values of the rounds; best: the round of the best one, or none."""

    round: int
    what: dict
    history: list[float | None] = field(default_factory=list)
    best: int | None = None
    stopped: bool = False


def _table(root: str, number: int) -> str:
    return f"{root}/rounds/round={number}"


def latest(spark: SparkSession, root: str) -> State | None:
    """The state that the last pointer names; a round that was cut off has none."""
    found = [x for x in names(spark, f"{root}/state") if x.endswith(".json")]
    return State(**json.loads(get_text(spark, f"{root}/state/{found[-1]}"))) if found else None


def vectors_of(spark: SparkSession, root: str, best: bool = False) -> DataFrame:
    """(id, embedding) after the last whole round or, with best, after the one of the best value."""
    state = latest(spark, root)
    if state is None or best and state.best is None:
        raise ValueError(f"{root} has no such round")
    path, n = _table(root, state.best if best else state.round), state.what.get("blocks")
    return blocks.at(spark, path, n) if n else spark.read.parquet(path)


def resumable(
    spark: SparkSession, root: str, first: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, what: dict,
    evaluate: Callable[[DataFrame], float | None] | None = None, patience: int | None = None, min_delta: float = 0.0, larger_is_better: bool = True,
    read: Callable[[str], DataFrame] | None = None, by: str | None = None,
) -> State:
    """Runs step (table, number) on the table first, rounds times, or goes on where a run below root was cut off, and gives
    back where it stands.

    A round writes its table, judges it by evaluate, and only then puts down the pointer, a small file that is whole or
    not there; tables that are neither the last nor the best go afterwards. With patience the run stops once so many
    rounds in a row have brought nothing better, as early_stopping says. A run that was about something else is an error, and one
    that has stopped or had all its rounds is left as it is. read makes a table of its path, if not as plain Parquet; by a
    column, tables have a folder for each of its values."""
    read = read or spark.read.parquet

    def write(table: DataFrame, number: int) -> None:
        (table.write.partitionBy(by) if by else table.write).mode("overwrite").parquet(_table(root, number))

    state = latest(spark, root)
    if state is None:
        write(first, 0)
        state = State(0, what)
        put_text(spark, f"{root}/state/{0:08d}.json", json.dumps(asdict(state)))
    if state.what != what:
        raise ValueError(f"the run below {root} is about {state.what}, not {what}")
    while state.round < rounds and not state.stopped:
        number = state.round + 1
        write(step(read(_table(root, state.round)), state.round), number)
        value = evaluate(read(_table(root, number))) if evaluate else None
        new = State(number, what, [*state.history, value], state.best)
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(new.history)], "step long, value double")
        trace = early_stopping(rows, patience or rounds + 1, min_delta, larger_is_better).orderBy("step").collect()  # a row for each round
        if trace[-1].improved:
            new.best = number
        new.stopped = trace[-1].stopped
        put_text(spark, f"{root}/state/{number:08d}.json", json.dumps(asdict(new)))
        if state.round != new.best:
            remove(spark, _table(root, state.round))
        if state.best not in (None, new.best):
            remove(spark, _table(root, state.best))
        state = new
    return state


def train_skipgram(
    contexts: DataFrame, num_nodes: int, vectors: DataFrame, root: str, negatives: int = 1, rounds: int = 8, rate: float = 2.0, seed: int = 0, **how,
) -> State:
    """fit_skipgram below root, in rounds that a later call goes on with; see resumable for how it is judged and stopped, and vectors_of
    for what it leaves. The number of nodes, the length of vectors and what the gradient depends on must be the same."""
    spark = contexts.sparkSession
    dim = (vectors.select(F.size("embedding")).first() or [0])[0]
    pairs = counted_pairs(contexts)
    n = blocks.blocks_for(num_nodes, pairs.count()) if blocks.reachable(spark, root) else None
    what = {"num_nodes": num_nodes, "dim": dim, "negatives": negatives, "rate": rate, "seed": seed, "blocks": n}
    links = blocks.links(pairs, n) if n else None
    first = blocks.with_block(vectors, n) if n else vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    layout = {"read": lambda path: blocks.at(spark, path, n), "by": "block"} if n else {}
    try:
        return resumable(spark, root, first, lambda table, step: skipgram_round(pairs, links, table, num_nodes, step, negatives, rate, seed), rounds, what, **layout, **how)
    finally:
        discard(pairs, *([links] if n else []))
