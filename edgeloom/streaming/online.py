"""Structured Streaming forms of what is kept up batch by batch: summaries of values and metrics by source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from edgeloom.cluster import ship
from edgeloom.operators.metrics import source_values


def online_summary(stream: DataFrame, col: str, by: str) -> DataFrame:
    """(by, count, min, max, mean) of the finite values of col so far; for output modes complete and update."""
    x = F.col(col).try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return stream.groupBy(by).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))


def windowed_summary(stream: DataFrame, col: str, by: str, time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same for each tumbling window of event time, with rows up to late behind."""
    x = F.when(F.isnotnull(col) & ~F.isnan(col), F.col(col))
    w = stream.withWatermark(time, late).groupBy(F.window(time, size), by)
    return w.agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean")).select(F.col("window.start").alias("start"), by, "count", "min", "max", "mean")


def online_hits(stream: DataFrame, k: int) -> DataFrame:
    """(src, hit double): whether a positive is among each source's k best (score, label) so far, for the sources that
    a batch touches; output mode update. A source's state is its k best rows, whatever it has seen."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            best = sorted([*best, *zip(f["score"].tolist(), f["label"].tolist(), strict=True)], reverse=True)[:k]
        state.update(([float(s) for s, _ in best], [int(x) for _, x in best]))
        yield pd.DataFrame({"src": [key[0]], "hit": [float(any(x == 1 for _, x in best))]})

    rows = stream.where("score is not null and label is not null").select("src", F.col("score").cast("double").alias("score"), F.col("label").cast("int").alias("label"))
    kind = stream.schema["src"].dataType.simpleString()
    return rows.groupBy("src").applyInPandasWithState(keep, f"src {kind}, hit double", "scores array<double>, labels array<int>", "update", GroupStateTimeout.NoTimeout)


#: Sources, by successive ids, whose states lie in one group, as a call for a group costs more than a few rows do.
SOURCES = 32


class SourceState:
    """What is kept of a source until its end: its best rows, its positives, and the negatives above the best of
    these. Where positives come first, the latter are a number; else their scores wait, as a better positive may come."""

    SCHEMA = "scores array<double>, labels array<int>, n_pos long, best double, negatives long, above long, wait array<double>, closed boolean"

    def __init__(self, kept: tuple | None, most: int, positives_first: bool):
        self.most, self.positives_first = most, positives_first
        scores, labels, self.n_pos, self.best, self.negatives, self.above, wait, self.closed = kept or ([], [], 0, None, 0, 0, [], False)
        self.scores, self.labels, self.wait = np.array(scores, float), np.array(labels, int), np.array(wait, float)

    def add(self, scores: np.ndarray, labels: np.ndarray) -> None:
        pos, neg = scores[labels == 1], scores[labels != 1]
        if len(pos):
            best = float(pos.max()) if self.best is None else max(self.best, float(pos.max()))
            if self.positives_first and self.negatives and best != self.best:
                raise ValueError("a better positive came after negatives of its source")
            self.best, self.n_pos = best, self.n_pos + len(pos)
        self.negatives += len(neg)
        if self.positives_first:
            self.above += int((neg > self.best).sum()) if self.best is not None else len(neg)
        else:
            wait = np.concatenate([self.wait, neg])
            self.wait = wait if self.best is None else wait[wait > self.best]
            self.above = len(self.wait)
        scores, labels = np.concatenate([self.scores, scores]), np.concatenate([self.labels, labels])
        order = np.lexsort((-labels, -scores))[: self.most] if len(scores) > 1 else slice(None)
        self.scores, self.labels = scores[order], labels[order]

    def kept(self) -> tuple:
        return (self.scores.tolist(), self.labels.tolist(), int(self.n_pos), self.best, int(self.negatives), int(self.above), self.wait.tolist(), self.closed)

    def close(self, ks: list[int]) -> dict[str, float]:
        """The counts of a source, as source_values wants them; nothing but that it is closed stays."""
        out: dict[str, float] = {"n_pos": int(self.n_pos), "first": int(self.above) + 1}
        for k in ks:
            s, y = self.scores[:k], self.labels[:k]
            p, n = s[y == 1], s[y != 1]
            gain = (1 / np.log2(np.flatnonzero(y == 1) + 2.0)).sum()
            wins = (p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()
            out |= {f"pos_{k}": len(p), f"neg_{k}": len(n), f"dcg_{k}": float(gain), f"wins_{k}": float(wins)}
        self.__init__((*([], []), 0, None, 0, 0, [], True), self.most, self.positives_first)
        return out


def online_source_metrics(stream: DataFrame, ks: list[int], positives_first: bool = True) -> DataFrame:
    """(src, n_pos, mrr, and for each k the metrics of source_values) of each source, once: when its end comes, a row
    of the stream (src, label, score, ended boolean) with ended; other rows bring a label and a score, and a row may
    bring both. Output mode append; metrics.source_averages over what was written gives the figures of ranking_metrics.

    Rows of a source may come in any number of batches, in any order within a batch. Rows after a source's end are an
    error. With positives_first a source's positives come in batches no later than its negatives, as the order of
    evaluation has them; then its state is its best rows and a few numbers, and a better positive that comes late is an
    error. Otherwise the scores of negatives above its best positive wait in the state. Rows without src, label or
    score count as nothing, but their end does."""
    ship(stream.sparkSession)
    most = max(ks, default=1)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {x: SourceState(tuple(kept), most, positives_first) for x, kept in zip(*state.get, strict=True)} if state.exists else {}
        parts, out = [], []
        for f in frames:  # sources are many and small: plain arrays, a frame only for what is given out
            end = f["ended"].to_numpy()  # objects where some are null
            end = end if end.dtype == bool else np.array([x is True for x in end.tolist()], bool)
            parts.append((f["src"].to_numpy(), f["score"].to_numpy(float, na_value=np.nan), f["label"].to_numpy(float, na_value=np.nan), end))
        src, score, label, ended = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, which = np.unique(src, return_inverse=True)
        some = ~(np.isnan(score) | np.isnan(label))
        for j, x in enumerate(ids.tolist()):
            s = held.setdefault(x, SourceState(None, most, positives_first))
            if s.closed:
                raise ValueError(f"source {x} has rows after its end")
            mine = which == j
            if (good := mine & some).any():
                s.add(score[good], label[good].astype(int))
            if ended[mine].any():
                out.append({"src": x, **s.close(ks)})
        if out:
            yield pd.DataFrame(out)
        state.update((list(held), [s.kept() for s in held.values()]))

    kind = stream.schema["src"].dataType.simpleString()
    counts = "".join(f", pos_{k} long, neg_{k} long, dcg_{k} double, wins_{k} double" for k in ks)
    rows = stream.where("src is not null").select("src", F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"), F.col("ended").cast("boolean").alias("ended"))
    group = F.floor(F.col("src") / SOURCES) if kind in ("int", "bigint") else F.col("src")
    kept = ", ".join(f"{name}: {t}" for name, t in (c.split(" ") for c in SourceState.SCHEMA.split(", ")))
    closed = rows.withColumn("group", group).groupBy("group").applyInPandasWithState(keep, f"src {kind}, n_pos long, first long{counts}", f"src array<{kind}>, kept array<struct<{kept}>>", "append", GroupStateTimeout.NoTimeout)
    return closed.select("src", "n_pos", *[v.alias(name) for name, v in source_values(ks).items()])
