"""What jobs share on a cluster: the written tables that cut lineage, shipped code, checked broadcasts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; beyond it the join is left to the shuffle.
BROADCAST_ROWS = 500_000
#: Bytes that a side of rows of any size may have to be broadcast.
BROADCAST_BYTES = 64 << 20
#: Tables of vectors of up to so many times BROADCAST_BYTES are broadcast in as many parts.
LOOKUP_PARTS = 4
#: Rows of a batch that goes to Python.
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only where driver and executors
    are one process, on one machine, may it be unset: then it is a temporary folder of that machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_edgeloom_dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = sc._edgeloom_dir = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
    return named.rstrip("/")


def written(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later steps don't repeat what made it, and it
    outlives lost executors. By a column it has a folder for each of its values. The files go when the session's JVM ends,
    or before by discard."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/edgeloom/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    at, fs = _place(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._edgeloom_path = path
    return out


def bucketed(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """df as a table of the shared folder, like written, in as many buckets by keys as the session shuffles into: an
    equi-join on all the keys reads it as it lies, and only the other side is shuffled. Choose keys of which no value has a large
    share of the rows, as a bucket is one task's. The table stands in the session's catalog under a name of its own
    until discard."""
    spark = df.sparkSession
    name = f"edgeloom_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/edgeloom/{name}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    at, fs = _place(spark, path)
    fs.deleteOnExit(at)
    out = spark.table(name)
    out._edgeloom_path, out._edgeloom_table = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing to come will read; other DataFrames are left alone."""
    for t in tables:
        if path := t.__dict__.get("_edgeloom_path"):
            if name := t.__dict__.get("_edgeloom_table"):
                t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            at, fs = _place(t.sparkSession, path)
            fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _place(spark, path)
    return fs.exists(at)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file on any file system that Spark knows: under another name first, so that path is either whole
    or not there. A file that is there already stays, and is an error."""
    at, fs = _place(spark, path)
    draft, _ = _place(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(path)


def get_text(spark: SparkSession, path: str) -> str:
    at, fs = _place(spark, path)
    file = fs.open(at)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, sorted; nothing if it isn't there."""
    at, fs = _place(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _place(spark, path)
    fs.delete(at, True)


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI that names its file system."""
    at, fs = _place(spark, path)
    return fs.makeQualified(at).toString()


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df itself (a shuffle join then). Only for rows of a
    bounded size; see small for others."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def small(df: DataFrame, size: Column | str, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows' sizes, in bytes, add up to no more than limit."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def lookups(table: DataFrame, key: str, vector: str) -> list[DataFrame] | None:
    """table (key, vector, ...), whose rows are little more than a vector, in LOOKUP_PARTS parts at most by hash of key, each
    of about BROADCAST_BYTES at most; none if it is larger."""
    each = 8 if "double" in dict(table.dtypes)[vector] else 4
    size = table.agg(F.sum(32 + each * F.coalesce(F.size(vector), F.lit(0)))).first()[0] or 0
    n = max(1, -(-size // BROADCAST_BYTES))
    if n > LOOKUP_PARTS:
        return None
    return [table] if n == 1 else [table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def looked_up(rows: DataFrame, table: DataFrame, key: str, vector: str, parts: list[DataFrame] | None, how: str = "inner") -> DataFrame:
    """rows joined with table by key, how being inner or left. Where lookups gives parts, each is broadcast and rows stay
    where they are, so that no vector is shuffled for every row; else it is a shuffle join."""
    if parts is None or len(parts) == 1:
        return rows.join(table if parts is None else F.broadcast(parts[0]), key, how)
    others = [c for c in table.columns if c != key]
    out = rows
    for i, part in enumerate(parts):
        out = out.join(F.broadcast(part.select(key, F.struct(*others).alias(f"__{i}"))), key, "left")
    found = F.coalesce(*[F.col(f"__{i}") for i in range(len(parts))])
    out = out.select(*rows.columns, found.alias("__found"))
    out = out.where("__found is not null") if how == "inner" else out
    return out.select(*rows.columns, *[F.col("__found")[c].alias(c) for c in others])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that few texts at a time become Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each Spark context. Where nobody has set the session's
    batch size for Python, to whatever value, this sets it to BATCH_ROWS, since rows here are often whole texts."""
    sc = spark.sparkContext
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(size):
        spark.conf.set(size, str(BATCH_ROWS))
    if getattr(sc, "_edgeloom_shipped", False):
        return
    root = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="edgeloom-"), "edgeloom_package.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._edgeloom_shipped = True
