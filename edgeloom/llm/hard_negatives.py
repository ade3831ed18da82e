"""Hard negatives by threshold joins: for each anchor its best rows of the same label, and for each of these the best rows of
other labels whose scores lie in a window below it.

Rows lie in blocks, and every block of anchors meets every block of rows that it may need. There rows are indexed by
dimension, those of most energy first; of each row the last dimensions, as far as norms bound what they can add
below the least threshold asked for, are left out of the index. Partial scores are accumulated dimension by dimension
over the indexed part; pairs whose remaining norms can't lift them to their threshold are pruned, and what is left
is scored exactly. Thresholds begin where the scores of a block of rows drawn from all promise few rows, and are
lowered for windows that don't fill, down to the window's own end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.cluster import broadcast_checked, discard, ship, written
from edgeloom.llm.ann import _matrix

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The window of negatives' scores, in hundredths of the positive's.
LEAST, MOST = 30, 90
#: Rows of a block, anchors of a block, and anchors that are compared at a time.
BLOCK_ROWS = 8192
BLOCK_ANCHORS = 8192
AT_A_TIME = 128
#: Dimensions that are accumulated between two looks at what can be pruned.
CHUNK = 8
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, dim, x array<int>): the floors of scale times the components of the rows that have an id, a label and
    a vector of finite components alone, one at least. What is too large for 128 times a score to have room in 64 bits
    is held to the largest that isn't."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec_col) > 0) & ~F.coalesce(bad, F.lit(True)))
    most = F.floor(F.sqrt(F.lit(2.0**56) / F.col("dim"))).cast("double")
    held = lambda x: F.floor(F.greatest(-most, F.least(most, x * scale))).cast("int")
    return kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.size(v).alias("dim"), v.alias("v")).select("id", "label", "dim", F.transform("v", held).alias("x"))


def indexed(x: np.ndarray, least: float, norm: np.ndarray) -> np.ndarray:
    """How many of its dimensions, from the first on, each row of x must have in the index: the rest can't add least or
    more to a score with any vector whose norms from each dimension on are norm at most."""
    rest = np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]) * norm[None, : x.shape[1]]
    return (rest >= least).sum(axis=1) if least > 0 else np.full(len(x), x.shape[1])


def candidates(x: np.ndarray, y: np.ndarray, least: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs of rows of x and y whose score may be least[j] or more: those of at least that score, and few
    others. allowed(rows) gives which rows of x (in the order given) may meet which of y, or None for all."""
    dim = x.shape[1]
    after = lambda a: np.concatenate([np.sqrt(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1]), np.zeros((len(a), 1))], axis=1)
    rest_x, rest_y = after(x), after(y)
    slack = 1e-9 * (rest_x[:, 0].max(initial=0) * rest_y[:, 0].max(initial=0) + 1)
    need = indexed(x, float(least.min()) - slack, rest_y.max(axis=0)) if len(y) else np.zeros(len(x), int)
    order = np.argsort(-need, kind="stable")  # rows that are still indexed stand first
    order = order[: np.count_nonzero(need)]
    x, rest_x, need = x[order], rest_x[order], need[order]
    ok = allowed(order)
    score = np.zeros((len(x), len(y)))
    left, right = [], []
    live = len(x)
    for at in range(0, dim, CHUNK):
        end = min(dim, at + CHUNK)
        if not live:
            break
        score[:live] += x[:live, at:end] @ y[:, at:end].T
        stay = int(np.count_nonzero(need[:live] > end)) if end < dim else 0
        # rows whose index ends here: what they left out is bounded by norms
        done = slice(stay, live)
        if stay < live:
            may = score[done] + rest_x[done, end][:, None] * rest_y[:, end][None, :] >= least[None, :] - slack
            may &= True if ok is None else ok[done]
            i, j = np.nonzero(may)
            left.append(order[stay + i])
            right.append(j)
        live = stay
        if live and end < dim:  # of those that go on, too few may be left for whole rows
            may = score[:live] + rest_x[:live, end][:, None] * rest_y[:, end][None, :] >= least[None, :] - slack
            may &= True if ok is None else ok[:live]
            if np.count_nonzero(may) * 16 < may.size:
                i, j = np.nonzero(may)
                left.append(order[i])
                right.append(j)
                live = 0
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 15):
        s = slice(at, at + (1 << 15))
        out[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]])
    return out


def _met(rows: pa.Table, asked: pa.Table, k: int, same: bool) -> pa.Table:
    """(ask, window, score, id): of one block of rows the first k of each window that reach its threshold: those of the
    highest scores, ties to the smaller id."""
    schema = pa.schema([("ask", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("id", rows.schema.field("id").type)])
    if not rows.num_rows or not asked.num_rows:
        return schema.empty_table()
    rows, asked = rows.combine_chunks(), asked.combine_chunks()
    ids = rows["id"].combine_chunks()

    def numbers(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
        both = pa.chunked_array([rows[a].combine_chunks(), asked[b].combine_chunks()]).combine_chunks().dictionary_encode().indices.to_numpy()
        return both[: rows.num_rows], both[rows.num_rows :]

    row_label, ask_label = numbers("label", "label")
    row_id, ask_id = numbers("id", "anchor")
    by_id = np.empty(rows.num_rows, np.int64)
    by_id[pc.sort_indices(ids).to_numpy()] = np.arange(rows.num_rows)
    x, y = _matrix(rows["x"].combine_chunks()).astype(np.int64), _matrix(asked["x"].combine_chunks()).astype(np.int64)
    xf, yf = x.astype(np.float64), y.astype(np.float64)
    wide = asked["windows"].combine_chunks()
    first = wide.offsets.to_numpy() - wide.offsets[0].as_py()
    window, low, high, least = (wide.flatten().field(c).to_numpy() for c in ("window", "low", "high", "least"))
    lowest = np.minimum.reduceat(least, first[:-1])
    number = asked["ask"].to_numpy()
    out = []
    for at in range(0, len(y), AT_A_TIME):
        some = slice(at, at + AT_A_TIME)

        def allowed(order: np.ndarray, some: slice = some) -> np.ndarray:
            alike = row_label[order][:, None] == ask_label[some][None, :]
            return (alike if same else ~alike) & (row_id[order][:, None] != ask_id[some][None, :])

        i, j = candidates(xf, yf[some], lowest[some].astype(np.float64), allowed)
        score = exact(x, y[some], i, j)
        order = np.lexsort((by_id[i], -score, j))
        i, j, score = i[order], j[order], score[order]
        begin = np.searchsorted(j, np.arange(len(y[some]) + 1))
        for a in np.flatnonzero(np.diff(begin)):
            down, r = -score[begin[a] : begin[a + 1]], i[begin[a] : begin[a + 1]]
            for w in range(first[at + a], first[at + a + 1]):
                top = int(np.searchsorted(down, -high[w]))  # the first score that isn't above the window
                end = min(top + k, int(np.searchsorted(down, -max(least[w], low[w]), "right")))
                if end > top:
                    out.append((np.full(end - top, number[at + a]), np.full(end - top, window[w]), -down[top:end], r[top:end]))
    if not out:
        return schema.empty_table()
    ask, win, score, r = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table([pa.array(ask), pa.array(win), pa.array(score), ids.take(pa.array(r))], schema=schema)


def _join(rows: DataFrame, asked: DataFrame, n: int, k: int, same: bool) -> DataFrame:
    """(ask, window, score, id): the first k rows of each window that reach its threshold. rows: (block, id, label, x); asked: (ask,
    anchor, label, x, block, windows), of n anchors at most. A block of anchors meets a block of rows in one task."""
    parts = max(1, -(-n // BLOCK_ANCHORS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("ask"), F.lit(parts)))
    held = rows.select("block", "id", "label", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    kind = rows.schema["id"].dataType.simpleString()
    met = held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(lambda a, b: _met(a, b, k, same), f"ask long, window long, score long, id {kind}")
    w = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "id")
    return met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def filled(rows: DataFrame, asks: DataFrame, windows: DataFrame, places: DataFrame, k: int, same: bool) -> DataFrame:
    """(ask, window, score, id): of each window (ask, window, low, high) the first k rows with scores from low to high,
    of the same label as the anchor asks (ask, anchor, label, dim, x) has, or of any other.

    rows: (id, label, dim, x, block, drawn); places: (dim, label, block, own), where labels of a length lie. Windows meet the
    drawn rows first. The best score there is the first threshold, the k-th best, where there are as many, the second,
    at which a window is sure to fill, and low the last. A window is closed by the first threshold at which it gets k
    rows; the others are asked again, in the blocks that they need."""
    key = ["ask", "window"]
    anchors = asks.count()

    def asked(open_: DataFrame) -> DataFrame:
        each = open_.groupBy("ask").agg(F.collect_list(F.struct("window", "low", "high", "least")).alias("windows"))
        return each.join(asks, "ask")

    pilot = asked(windows.withColumn("least", F.col("low"))).withColumn("block", F.col("dim").cast("long"))
    best = _join(rows.where("drawn").withColumn("block", F.col("dim").cast("long")), pilot, anchors, k, same)
    best = best.groupBy(key).agg(F.max("score").alias("best"), F.min("score").alias("last"), F.count("*").alias("n"))
    steps = F.array_distinct(F.array(F.coalesce("best", "low"), F.when(F.col("n") >= k, F.col("last")).otherwise(F.col("low")), F.col("low")))
    open_ = written(windows.select(*key, "low", "high").join(best, key, "left").select(*key, "low", "high", steps.alias("steps")), "windows")
    if same:
        where = lambda a: a.join(places.select("dim", "label", "block"), ["dim", "label"])
    else:  # a block of one label has nothing for anchors of that label
        blocks = broadcast_checked(places.select("dim", "block", F.when(F.col("own"), F.col("label")).alias("only")).distinct())
        where = lambda a: a.join(blocks, "dim").where("only is null or only <> label").drop("only")
    done: list[DataFrame] = []
    left = anchors
    for step in range(3):
        now = open_.withColumn("least", F.element_at("steps", F.least(F.lit(step + 1), F.size("steps"))))
        met = where(asked(now))
        # few windows may need few blocks
        some = rows.join(broadcast_checked(met.select("block").distinct()), "block", "left_semi") if step else rows
        found = written(_join(some, met, left, k, same), "found")
        full = found.groupBy(key).agg(F.count("*").alias("n"))
        judged = now.join(full, key, "left").withColumn("closed", (F.coalesce("n", F.lit(0)) >= k) | (F.col("least") <= F.col("low")))
        judged = written(judged.select(*open_.columns, "closed"), "windows")
        done.append(found.join(judged.where("closed").select(key), key))
        open_ = judged.where("not closed").drop("closed")
        left = min(anchors, open_.count())
        if not left:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _energy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The squares of each dimension, added up over a batch for each length of vectors."""
    for b in batches:
        sizes = b.column("dim").to_numpy()
        for dim in np.unique(sizes):
            x = _matrix(b.column("x").filter(pa.array(sizes == dim))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array((x * x).sum(axis=0))], names=["dim", "at", "e"])


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, places) as filled wants them: rows (id, label, dim, x) with their dimensions in the order of energy, most
    first, in blocks of about BLOCK_ROWS. A label of more rows has blocks of its own; the others of a length share
    blocks by hash. drawn marks about a quarter of BLOCK_ROWS rows of each length, whatever there are."""
    rows = written(rows, "rows")
    sizes = rows.groupBy("dim", "label").agg(F.count("*").alias("m"))
    large = written(sizes.where(F.col("m") > BLOCK_ROWS).select("dim", "label", F.ceil(F.col("m") / BLOCK_ROWS).cast("long").alias("own")), "large")
    energy = rows.select("dim", "x").mapInArrow(_energy, "dim int, at int, e double").groupBy("dim", "at").agg(F.sum("e").alias("e"))
    order = energy.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("e")).alias("e"), "at"))), lambda s: s["at"]).alias("order"))
    total = rows.groupBy("dim").agg(F.count("*").alias("total"))
    lengths = written(total.join(order, "dim"), "lengths")  # a row for each length of vectors
    each = rows.join(broadcast_checked(large), ["dim", "label"], "left").join(broadcast_checked(lengths), "dim").withColumn("at", F.monotonically_increasing_id())
    shared = F.ceil(F.col("total") / BLOCK_ROWS).cast("long")
    salt = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("at"), F.col("own"))).otherwise(F.pmod(F.xxhash64("label"), shared))
    block = F.xxhash64("dim", "own", F.when(F.col("own").isNotNull(), F.xxhash64("label")), salt)
    drawn = F.pmod(F.xxhash64(F.lit(7), "at"), F.ceil(F.col("total") * 4 / BLOCK_ROWS).cast("long")) == 0
    made = each.select("id", "label", "dim", F.transform("order", lambda i: F.get("x", i)).alias("x"), block.alias("block"), F.col("own").isNotNull().alias("own"), drawn.alias("drawn"))
    made = written(made, "blocks")
    discard(rows)
    return made, written(made.select("dim", "label", "block", "own").distinct(), "places")


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank int from 1, negative_id, positive_score, negative_score): for each of the rows for
    which anchors holds, the first positives rows of its label, by inner product, ties to the smaller id, and for each
    of them the first negatives rows of other labels whose score is least to most hundredths of the positive's.

    rows: (id, label, dim, x), as whole_numbers gives them. An anchor never meets rows of its own id; anchors that are
    equal in all are one, other repeated rows stand for themselves. Vectors of different lengths have no score. A positive
    without negatives in its window has no rows, and so has an anchor without positives; an empty table gives an empty
    result, and further columns are ignored."""
    if not 0 <= least <= most <= 128:
        raise ValueError("a window lies between 0 and 128 hundredths, its least end first")
    ship(rows.sparkSession)
    held, places = dealt(rows.select("id", "label", "dim", "x"))
    asks = held.where(anchors).select(F.col("id").alias("anchor"), "label", "dim", "x").distinct()
    asks = written(asks.withColumn("ask", F.monotonically_increasing_id()), "asks")
    all_scores = asks.select("ask", F.lit(0).cast("long").alias("window"), F.lit(LOWEST).cast("long").alias("low"), F.lit(HIGHEST).cast("long").alias("high"))
    best = filled(held, asks, all_scores, places, positives, same=True)
    best = written(best.select("ask", F.monotonically_increasing_id().alias("window"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    # the least whole score from least * positive / 100 on, and the largest up to most * positive / 100
    low, high = F.expr(f"-((-{least} * positive_score - pmod(-{least} * positive_score, 100)) div 100)"), F.expr(f"({most} * positive_score - pmod({most} * positive_score, 100)) div 100")
    windows = written(best.select("ask", "window", low.alias("low"), high.alias("high")).where("low <= high"), "windows")
    found = filled(held, asks, windows, places, negatives, same=False)
    named = found.join(best.select("window", "positive_id", "positive_score"), "window").join(asks.select("ask", F.col("anchor").alias("anchor_id")), "ask")
    w = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return named.select("anchor_id", "positive_id", F.row_number().over(w).alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
