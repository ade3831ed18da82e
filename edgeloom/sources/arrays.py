"""Array files (.npy, or raw rows without a header) of pairs and embeddings, read by ranges of rows.

Fixed values of the .npy header, version 1 or 2: the magic string, two version bytes, the header's length, and a Python
literal with descr, fortran_order and shape.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.cluster import ship

MAGIC = b"\x93NUMPY"
ROWS_PER_TASK = 1 << 20


def npy_header(path: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, offset of the data) of a .npy file in row order."""
    with open(path, "rb") as f:
        start = f.read(8)
        if start[:6] != MAGIC:
            raise ValueError(f"{path} is no .npy file")
        size, = struct.unpack("<H", f.read(2)) if start[6] == 1 else struct.unpack("<I", f.read(4))
        info = ast.literal_eval(f.read(size).decode("latin-1"))
        if info["fortran_order"]:
            raise ValueError(f"{path} isn't in row order")
        return np.dtype(info["descr"]), tuple(info["shape"]), f.tell()


def _blocks(spark: SparkSession, path: str, kind: np.dtype, shape: tuple[int, int], offset: int, make, schema: str, rows_per_task: int) -> DataFrame:
    ship(spark)
    n, width = shape
    tasks = max(1, -(-n // rows_per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in (b.column(0).to_numpy() * rows_per_task).tolist():
                last = min(n, first + rows_per_task)
                for i in range(first, last, 1 << 16):
                    count = min(1 << 16, last - i)
                    data = np.fromfile(path, kind, count * width, offset=offset + i * width * kind.itemsize)
                    if len(data) != count * width:
                        raise ValueError(f"{path} is too short")
                    yield make(i, data.reshape(count, width))

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)


def _pairs(i: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(x))), pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1].astype(np.int64))], names=["pos", "src", "dst"])


def _vectors(i: int, x: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(x))), lists], names=["id", "embedding"])


def read_pairs(spark: SparkSession, path: str, required: bool = True, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """(pos, src, dst) of a .npy file [n, 2] of whole numbers that all executors see; a missing file is None unless it
    is required."""
    if not Path(path).exists():
        if required:
            raise ValueError(f"{path} is missing")
        return None
    kind, shape, offset = npy_header(path)
    if len(shape) != 2 or shape[1] != 2 or kind.kind not in "iu":
        raise ValueError(f"{path} must hold pairs of whole numbers, not {kind} {shape}")
    return _blocks(spark, path, kind, shape, offset, _pairs, "pos long, src long, dst long", rows_per_task)


def read_embeddings(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, embedding array<float>) of a .npy file [n, dim] of floats, ids by row."""
    kind, shape, offset = npy_header(path)
    if len(shape) != 2 or kind.kind != "f":
        raise ValueError(f"{path} must hold rows of floats, not {kind} {shape}")
    return _blocks(spark, path, kind, shape, offset, _vectors, "id long, embedding array<float>", rows_per_task)


def read_raw_embeddings(spark: SparkSession, path: str, rows: int, dim: int, kind: str = "<f4", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same of a file without header, whose size must be rows * dim values."""
    t = np.dtype(kind)
    if Path(path).stat().st_size != rows * dim * t.itemsize:
        raise ValueError(f"{path} doesn't have {rows} x {dim} values of {t}")
    return _blocks(spark, path, t, (rows, dim), 0, _vectors, "id long, embedding array<float>", rows_per_task)


def write_pairs(pairs: DataFrame, path: str, edge_index: bool = False) -> int:
    """Pairs (src, dst) as .npy [n, 2] of 64-bit numbers, sorted, into a folder that all executors see: ranges get their
    place from counts, and every task writes its own. With edge_index the array is [2, n], in column order, which is
    the same bytes. Gives back how many there are."""
    spark = pairs.sparkSession
    ship(spark)
    from edgeloom.cluster import written

    ranged = written(pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).repartitionByRange("src", "dst").withColumn("part", F.spark_partition_id()), "pairs")
    counts = {r[0]: r[1] for r in ranged.groupBy("part").count().collect()}  # one for each task of the sort
    total = sum(counts.values())
    shape = f"(2, {total})" if edge_index else f"({total}, 2)"
    head = f"{{'descr': '<i8', 'fortran_order': {edge_index}, 'shape': {shape}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    start = 10 + len(head)
    with open(path, "wb") as f:
        f.write(MAGIC + b"\x01\x00" + struct.pack("<H", len(head)) + head.encode("latin-1"))
        f.truncate(start + 16 * total)
    first, at = {}, 0
    for part in sorted(counts):
        first[part], at = at, at + counts[part]

    def put(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("src", "ascending"), ("dst", "ascending")])
        with open(path, "r+b") as f:
            f.seek(start + 16 * first[key[0].as_py()])
            f.write(np.stack([t["src"].to_numpy(), t["dst"].to_numpy()], axis=1).astype("<i8").tobytes())
        return pa.table({"n": pa.array([t.num_rows], pa.int64())})

    done = ranged.groupBy("part").applyInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if done != total:
        raise OSError("not every pair was written")
    return total
