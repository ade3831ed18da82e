"""Expressions for samples of a run's resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1024 * 1024


def number(c: Column) -> Column:
    """The number in a reading such as "81 %", "4096 MiB", "70.5 W" or "65 C"; null for N/A and other text."""
    return F.regexp_replace(F.trim(c), r"\s*(MiB|W|%|C)$", "").try_cast("double")


def mib(c: Column) -> Column:
    """Bytes as MiB, to three places; null and NaN give null."""
    x = c.cast("double")
    return F.when(~F.isnan(x), F.round(x / MIB, 3))


def with_device_totals(samples: DataFrame) -> DataFrame:
    """samples with devices array<struct<used, util>> summed up: devices, used_total, util_max and util_mean."""
    used, util = F.filter("devices.used", lambda x: x.isNotNull()), F.filter("devices.util", lambda x: x.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return samples.withColumns({"n_devices": F.size("devices"), "used_total": total(used), "util_max": F.array_max(util), "util_mean": F.when(F.size(util) > 0, total(util) / F.size(util))})


def process_totals(processes: DataFrame) -> DataFrame:
    """(sample, pids, cpu, rss, threads) and vms and uss where there are such readings: sums over each sample's processes."""
    more = [F.sum(c).alias(c) for c in ("vms", "uss") if c in processes.columns]
    return processes.groupBy("sample").agg(F.count("pid").alias("pids"), F.sum("cpu").alias("cpu"), F.sum("rss").alias("rss"), F.sum("threads").alias("threads"), *more)


def top_processes(processes: DataFrame, n: int) -> DataFrame:
    """Each sample's n largest processes by memory, then by CPU."""
    return processes.selectExpr("*", "row_number() over (partition by sample order by rss desc, cpu desc, pid) as n").where(F.col("n") <= n).drop("n")
