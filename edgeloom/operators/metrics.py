"""Ranking metrics for each source, and global classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.cluster import written
from edgeloom.functions.vectors import sigmoid

#: Probabilities are held this far from 0 and 1 in the log loss.
EPS = 2.220446049250313e-16


def _key(tie: list[str]) -> Column:
    """What rows of a source are ranked by: the score, largest first, then the columns of tie, those with a "-" before
    their name largest first."""
    return F.struct((-F.col("score")).alias("k"), *[(-F.col(c[1:]) if c.startswith("-") else F.col(c)).alias(f"k{i}") for i, c in enumerate(tie)])


def source_values(ks: list[int]) -> dict[str, Column]:
    """A source's metrics by name, from n_pos, first (the rank of its first positive) and for each k the positives
    pos_k, the negatives neg_k, the gain dcg_k and the pairs in order wins_k of its first k rows; null without positives."""
    some = lambda c: F.when(F.col("n_pos") > 0, c)
    out = {"mrr": some(1 / F.col("first"))}
    for k in ks:
        pos, neg = F.coalesce(f"pos_{k}", F.lit(0)), F.coalesce(f"neg_{k}", F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_pos"), F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        values = {
            "hits": (pos > 0).cast("double"), "recall": pos / F.col("n_pos"), "ndcg": F.coalesce(f"dcg_{k}", F.lit(0.0)) / ideal,
            "mrr": F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0), "roc_auc": F.when(pos == 0, 0.0).when(neg == 0, 1.0).otherwise(F.col(f"wins_{k}") / (pos * neg)),
        }
        out |= {f"{name}_at_{k}": some(v) for name, v in values.items()}
    return out


def source_averages(sources: DataFrame, ks: list[int]) -> DataFrame:
    """One row of averages over the sources (n_pos, and the metrics that source_values names) that have a positive, all 0
    without such sources, with num_sources_with_positives and num_sources."""
    counts = [F.count_if(F.col("n_pos") > 0).alias("num_sources_with_positives"), F.count("*").alias("num_sources")]
    return sources.agg(*[F.coalesce(F.avg(name), F.lit(0.0)).alias(name) for name in source_values(ks)], *counts)


def ranking_metrics(scored: DataFrame, ks: list[int], tie: list[str] | None = None) -> DataFrame:
    """One row of averages over sources with a positive, from scored (src, dst, label, score): mrr, and for each k
    hits, recall, ndcg, mrr and roc_auc within the top k; with num_sources and num_sources_with_positives. Equal scores
    rank positives first, then the smaller dst, unless tie names other columns. Without such sources all are 0.

    No source is ranked whole. The rank of its first positive is one more than the rows before it: an aggregate finds
    that positive, and a join with it counts what stands before, both partly before the shuffle. All else lies in the
    first k rows, of which tasks pass on no more than the largest k of a source (for k up to 1000, where Spark limits
    groups before the shuffle).
    """
    key = _key(tie or ["-label", "dst"])
    each = written(scored.groupBy("src").agg(F.sum("label").alias("n_pos"), F.min(F.when(F.col("label") == 1, key)).alias("best")), "sources")
    before = scored.join(each.where("n_pos > 0").select("src", "best"), "src").where(key < F.col("best")).groupBy("src").agg(F.count("*").alias("before"))
    rows = each.join(before, "src", "left").select("src", "n_pos", (F.coalesce("before", F.lit(0)) + 1).alias("first"))
    if ks:
        top = scored.select("src", "label", "score", F.row_number().over(Window.partitionBy("src").orderBy(key)).alias("rn")).where(F.col("rn") <= max(ks))
        sums = []
        for k in ks:
            inside = F.col("rn") <= k
            sums += [
                F.sum(F.when(inside, F.col("label")).otherwise(0)).alias(f"pos_{k}"), F.count_if(inside & (F.col("label") == 0)).alias(f"neg_{k}"),
                F.sum(F.when(inside & (F.col("label") == 1), 1 / F.log2(F.col("rn") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}"),
            ]
        top = written(top, "top")
        rows = rows.join(top.groupBy("src").agg(*sums), "src", "left").join(_prefix_wins(top, ks), "src", "left")
    return source_averages(rows.select("src", "n_pos", *[v.alias(name) for name, v in source_values(ks).items()]), ks)


#: Metrics that ranks of positives alone give.
RANK_METRICS = ("mrr", "hits@k", "recall@k", "ndcg@k", "mrr@k")


def rank_metrics(found: DataFrame, names: list[str], ks: list[int]) -> DataFrame:
    """(metric, value), as compute_metrics has them for scores as they are, from positives (src, dst, score, above) alone, above being
    the number of negatives of src that score higher. Names are of RANK_METRICS."""
    if unknown := [n for n in names if n not in RANK_METRICS]:
        raise ValueError(f"not from ranks alone: {', '.join(unknown)}")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")) + F.col("above")
    sums = [F.count("*").alias("n_pos"), F.min("rank").alias("first")]
    for k in ks:
        inside = F.col("rank") <= k
        sums += [F.count_if(inside).alias(f"pos_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}")]
    wanted = [(n.replace("@k", f"@{k}"), n.replace("@k", f"_at_{k}")) for n in dict.fromkeys(names) for k in (ks if n.endswith("@k") else [0])]
    sources = found.select("src", rank.alias("rank")).groupBy("src").agg(*sums)
    value = source_values(ks)
    means = sources.agg(*[F.coalesce(F.avg(value[c]), F.lit(0.0)).alias(c) for _, c in wanted])
    named = [F.struct(F.lit(i).alias("i"), F.lit(name).alias("metric"), F.col(c).alias("value")) for i, (name, c) in enumerate(wanted)]
    return means.select(F.explode(F.array(*named)).alias("x")).orderBy("x.i").select("x.metric", "x.value")


def _prefix_wins(r: DataFrame, ks: list[int]) -> DataFrame:
    """(src, wins_k...): pairs of a positive and a negative of the top k in the right order, equal scores as a half."""
    groups = r.groupBy("src", "score").agg(*[F.sum(F.when(F.col("rn") <= k, F.col("label")).otherwise(0)).alias(f"p{k}") for k in ks], *[F.count_if((F.col("rn") <= k) & (F.col("label") == 0)).alias(f"n{k}") for k in ks])
    above = Window.partitionBy("src").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    seen = groups.select("src", *[(F.col(f"n{k}") * (F.coalesce(F.sum(f"p{k}").over(above), F.lit(0)) + 0.5 * F.col(f"p{k}"))).alias(f"w{k}") for k in ks])
    return seen.groupBy("src").agg(*[F.sum(f"w{k}").alias(f"wins_{k}") for k in ks])


def roc_auc(scored: DataFrame) -> DataFrame:
    """(roc_auc): of (label, score) over all rows, equal scores as a half; null if a class is missing.

    Rows are counted by score first. The running count of negatives goes over ranges of scores, each in its task, with
    one total for each range in between."""
    right = F.sum(F.col("n") * (F.col("p_above") + 0.5 * F.col("p")))
    return _running_by_score(scored).agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), right / (F.sum("p").cast("double") * F.sum("n"))).alias("roc_auc"))


def _running_by_score(scored: DataFrame) -> DataFrame:
    """(score, p, n, p_above, n_above): positives and negatives of each score, and of all larger ones."""
    counts = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    dealt = written(counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "scores")
    totals = dealt.groupBy("part").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("bn"))
    inside = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", F.coalesce(F.sum("p").over(inside), F.lit(0)).alias("lp"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("ln"))
    return local.join(base, "part").select("score", "p", "n", (F.col("bp") + F.col("lp")).alias("p_above"), (F.col("bn") + F.col("ln")).alias("n_above"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(pr_auc): the step-wise sum of precision over rises in recall; equal scores are one threshold."""
    r = _running_by_score(scored)
    precision = (F.col("p_above") + F.col("p")) / (F.col("p_above") + F.col("p") + F.col("n_above") + F.col("n"))
    return r.agg((F.sum(F.col("p") * precision) / F.sum("p")).alias("pr_auc"))


def logloss(scored: DataFrame) -> DataFrame:
    """(logloss) of (label, score), scores as probabilities."""
    p = F.greatest(F.lit(EPS), F.least(F.col("score"), F.lit(1 - EPS)))
    return scored.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("logloss"))


def threshold_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(accuracy, precision, recall, f1) of score >= threshold; 0 where nothing is to be divided by."""
    said, true = F.col("score") >= threshold, F.col("label") == 1
    c = scored.agg(F.count("*").alias("n"), F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "n"))
    return c.select(ratio(n - fp - fn, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def early_stopping(history: DataFrame, patience: int, min_delta: float = 0.0, larger_is_better: bool = True) -> DataFrame:
    """history (step, value) with best so far, improved, and stopped from the step on at which patience evaluations
    have passed without improvement; a null value changes nothing. A run's history is as short as its epochs."""
    sign = 1 if larger_is_better else -1

    def step(s: Column, x: Column) -> Column:
        v = sign * x["value"]
        better = x["value"].isNotNull() & (s["best"].isNull() | (v > s["best"] + min_delta))
        bad = F.when(better, 0).when(x["value"].isNull(), s["bad"]).otherwise(s["bad"] + 1)
        row = F.struct(x["step"].alias("step"), x["value"].alias("value"), (sign * F.when(better, v).otherwise(s["best"])).alias("best"), better.alias("improved"), (s["stopped"] | (bad >= patience)).alias("stopped"))
        return F.struct(F.when(better, v).otherwise(s["best"]).alias("best"), bad.alias("bad"), (s["stopped"] | (bad >= patience)).alias("stopped"), F.concat(s["rows"], F.array(row)).alias("rows"))

    start = F.expr("named_struct('best', cast(null as double), 'bad', 0, 'stopped', false, 'rows', cast(array() as array<struct<step:bigint,value:double,best:double,improved:boolean,stopped:boolean>>))")
    all_rows = history.agg(F.array_sort(F.collect_list(F.struct(F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value")))).alias("h"))
    return all_rows.select(F.explode(F.aggregate("h", start, step, lambda s: s["rows"])).alias("r")).select("r.*")


def summary(df: DataFrame, col: str) -> DataFrame:
    """(count, min, max, mean) of the finite values of col, rounded to three places; others are skipped."""
    x = F.col(col).try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return df.agg(F.count(x).alias("count"), F.round(F.min(x), 3).alias("min"), F.round(F.max(x), 3).alias("max"), F.round(F.avg(x), 3).alias("mean"))


def over_runs(results: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean, std) over runs; std is the population's, 0 for one run."""
    return results.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


# Names of metrics.
GLOBAL_METRICS = ("roc_auc", "pr_auc", "accuracy", "logloss", "precision", "recall", "f1")
AT_K_METRICS = ("hits", "recall", "ndcg", "mrr", "roc_auc")
COUNT_METRICS = ("num_sources", "num_sources_with_positives")


def compute_metrics(
    scored: DataFrame, names: list[str] = ("roc_auc@k", "hits@k", "recall@k", "ndcg@k", "mrr", "mrr@k"), ks: list[int] = (10, 50, 100), threshold: float = 0.5, apply_sigmoid: bool = True, by_source: bool = False,
) -> DataFrame:
    """(metric, value): the metrics named, of scored (src, dst, label, score), in the order of their names.

    Names of GLOBAL_METRICS are over all rows; "mrr", COUNT_METRICS and those of AT_K_METRICS with "@k" are averages over
    sources, the latter for every k. "-" counts as "_". With by_source, for evaluations source by source, "roc_auc"
    stands for "roc_auc@k". Scores become probabilities first if apply_sigmoid is set; since that makes large scores
    equal, ranks and ties are those of probabilities too. Metrics that need both classes have no row where one is
    missing. Unknown names are an error, and so are source metrics without a src column.
    """
    wanted = list(dict.fromkeys(n.replace("-", "_") for n in names))
    if by_source:
        wanted = list(dict.fromkeys("roc_auc@k" if n == "roc_auc" else n for n in wanted))
    per_source = [n for n in wanted if n == "mrr" or n in COUNT_METRICS or n.removesuffix("@k") in AT_K_METRICS and n.endswith("@k")]
    if unknown := [n for n in wanted if n not in GLOBAL_METRICS and n not in per_source]:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    if per_source and "src" not in scored.columns:
        raise ValueError("metrics by source need a src column")
    rows = written(scored.withColumn("score", sigmoid(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("score")))) if apply_sigmoid else F.col("score").cast("double")), "scored")
    parts, order = [], []
    if per_source:
        parts.append(ranking_metrics(rows, list(ks) if any(n.endswith("@k") for n in per_source) else []))
    if "roc_auc" in wanted:
        parts.append(roc_auc(rows))
    if "pr_auc" in wanted:
        parts.append(average_precision(rows))
    if "logloss" in wanted:
        parts.append(logloss(rows))
    if {"accuracy", "precision", "recall", "f1"} & set(wanted):
        parts.append(threshold_metrics(rows, threshold))
    for n in wanted:
        order += [(f"{n.removesuffix('@k')}@{k}", f"{n.removesuffix('@k')}_at_{k}") for k in ks] if n.endswith("@k") else [(n, n)]
    found = None
    for part in parts:  # a row each
        named = [F.struct(F.lit(i).alias("i"), F.lit(name).alias("metric"), F.col(c).cast("double").alias("value")) for i, (name, c) in enumerate(order) if c in part.columns]
        one = part.select(F.explode(F.array(*named)).alias("x")).select("x.*")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return scored.sparkSession.createDataFrame([], "metric string, value double")
    return found.where("value is not null").orderBy("i").select("metric", "value")
