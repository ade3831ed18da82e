"""Compressed sparse row folders as a Spark data source: edge_ends.bin, edge_starts.bin and timestamps.bin.

Fixed values of the format: a 64-bit count, then 32-bit ends; plain 64-bit starts, one for each node; 32-bit timestamps
as the ends, or an empty file where there are none.

The writer puts down parts of these files, which are their bytes one after the other (without the header), and a
manifest that names them.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from edgeloom.cluster import ship
from edgeloom.operators.graph import Graph, degrees, offsets

SCHEMA = "src int, dst int, ts int"
ENDS, STARTS, TIMES = "edge_ends.bin", "edge_starts.bin", "timestamps.bin"
MANIFEST, PARTS = "manifest.json", "parts"


def _code(endian: str) -> str:
    return {"big": ">", "little": "<"}[endian]


class NodeRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class Folder:
    """A graph's folder as it is read, on any file system that Arrow knows by its URI: plain files or, where a manifest
    names them, parts of these files, whose bytes one after the other are the same."""

    def __init__(self, path: str, endian: str):
        self.order, (self.fs, self.path) = _code(endian), _file_system(path)
        if self._size(MANIFEST) is not None:
            with self.fs.open_input_stream(f"{self.path}/{MANIFEST}") as f:
                about = json.loads(f.read())
            if about["endian"] != endian:
                raise ValueError(f"{path} is {about['endian']}-endian")
            self.nodes, self.edges, self.timed = about["nodes"], about["edges"], about["timed"]
            self.parts = {name: [(first, count, f"{self.path}/{file}", 0) for first, count, file in parts] for name, parts in about["parts"].items()}
            return
        size = {name: self._size(name) for name in (STARTS, ENDS, TIMES)}
        if missing := [name for name, n in size.items() if n is None]:
            raise FileNotFoundError(f"{path} has no {', '.join(missing)}")
        if size[STARTS] % 8:
            raise ValueError(f"{STARTS} must hold whole 64-bit numbers")
        self.nodes, self.timed = size[STARTS] // 8, size[TIMES] > 0
        self.parts = {ENDS: [(0, 1, f"{self.path}/{ENDS}", 0)]}
        self.edges = int(self.read(ENDS, "i8", 0, 1)[0])
        self.parts = {STARTS: [(0, self.nodes, f"{self.path}/{STARTS}", 0)], ENDS: [(0, self.edges, f"{self.path}/{ENDS}", 8)], TIMES: [(0, self.edges, f"{self.path}/{TIMES}", 8)]}

    def _size(self, name: str) -> int | None:
        info = self.fs.get_file_info(f"{self.path}/{name}")
        return None if info.type == pa.fs.FileType.NotFound else info.size

    def read(self, name: str, kind: str, first: int, count: int) -> np.ndarray:
        """Values first to first + count of a file, without its header."""
        width, out = int(kind[1]), []
        for start, n, file, header in self.parts[name]:
            at, end = max(first, start), min(first + count, start + n)
            if at < end:
                with self.fs.open_input_file(file) as f:
                    f.seek(header + (at - start) * width)
                    out.append(np.frombuffer(f.read((end - at) * width), self.order + kind))
        values = np.concatenate(out) if out else np.zeros(0, self.order + kind)
        if len(values) != count:
            raise ValueError(f"{name} is too short")
        return values


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class CsrReader(DataSourceReader):
    """One partition for each range of nodes; a partition reads its part of each file."""

    def __init__(self, options: dict):
        self.path, self.endian = options["path"], options["endian"]
        self.nodes_per_task = int(options.get("nodespertask", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        n = Folder(self.path, self.endian).nodes
        return [NodeRange(i, min(i + self.nodes_per_task, n)) for i in range(0, n, self.nodes_per_task)]

    def read(self, partition: NodeRange) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        folder = Folder(self.path, self.endian)
        starts = folder.read(STARTS, "i8", first, last - first + (last < folder.nodes)).astype(np.int64)
        if last == folder.nodes:
            starts = np.append(starts, folder.edges)
        if (np.diff(starts) < 0).any() or starts[-1] > folder.edges or first == 0 and starts[0] != 0:
            raise ValueError(f"{STARTS} must rise from 0 up to the number of edges")
        for i in range(0, len(starts) - 1, 1 << 16):
            part = starts[i : i + (1 << 16) + 1]
            at, count = int(part[0]), int(part[-1] - part[0])
            src = np.repeat(np.arange(first + i, first + i + len(part) - 1, dtype=np.int32), np.diff(part))
            ts = pa.array(folder.read(TIMES, "i4", at, count).astype(np.int32)) if folder.timed else pa.nulls(count, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(folder.read(ENDS, "i4", at, count).astype(np.int32)), ts], names=["src", "dst", "ts"])


@dataclass
class Written(WriterCommitMessage):
    """The parts that a task has written: (name of the file, first value, values, name of the part)."""

    parts: list[tuple[str, int, int, str]]


class CsrWriter(DataSourceArrowWriter):
    """Writes rows (kind, pos, value, ts), kind 0 for edges and 1 for the starts of nodes, which lie in order within a
    task, as parts. A task's parts bear names of their own, so that retries and rivals don't meet. The commit checks that
    the parts are whole files together, removes what else lies there, and puts down the manifest; without that there is
    no graph. An abort removes all that was written."""

    def __init__(self, options: dict):
        self.path, self.endian = options["path"], options["endian"]
        self.nodes, self.edges, self.timed = int(options["nodes"]), int(options["edges"]), options["timed"] == "true"
        fs, root = _file_system(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type != pa.fs.FileType.NotFound:
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _file_system(self.path)
        order, own = _code(self.endian), uuid.uuid4().hex
        open_: dict[str, tuple[object, int, str]] = {}
        placed: dict[str, int] = {}
        fs.create_dir(f"{root}/{PARTS}", recursive=True)
        try:
            for b in iterator:
                kind = b.column("kind").to_numpy()
                for k, names in ((0, (ENDS, TIMES) if self.timed else (ENDS,)), (1, (STARTS,))):
                    rows = b.filter(pa.array(kind == k))
                    pos = rows.column("pos").to_numpy()
                    if not len(pos):
                        continue
                    for name in names:
                        if name not in open_:
                            file = f"{PARTS}/{name}-{pos[0]:020d}-{own}"
                            open_[name], placed[name] = (fs.open_output_stream(f"{root}/{file}"), int(pos[0]), file), int(pos[0])
                        if pos[0] != placed[name] or (np.diff(pos) != 1).any():
                            raise ValueError("rows of a task must lie in order, without gaps")
                        placed[name] += len(pos)
                        values = rows.column("ts" if name == TIMES else "value").to_numpy()
                        open_[name][0].write(values.astype(order + ("i8" if name == STARTS else "i4")).tobytes())
        finally:
            for f, _, _ in open_.values():
                f.close()
        return Written([(name, first, placed[name] - first, file) for name, (_, first, file) in open_.items()])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _file_system(self.path)
        found = sorted(p for m in messages if m is not None for p in m.parts)
        want = {STARTS: self.nodes, ENDS: self.edges} | ({TIMES: self.edges} if self.timed else {})
        parts: dict[str, list] = {name: [] for name in want}
        for name, first, count, file in found:
            if first != sum(c for _, c, _ in parts[name]):
                raise OSError(f"parts of {name} overlap or are missing before {first}")
            parts[name].append((first, count, file))
        if wrong := [name for name, n in want.items() if sum(c for _, c, _ in parts[name]) != n]:
            raise OSError(f"not all of {', '.join(wrong)} was written")
        kept = {file.split("/")[-1] for _, _, _, file in found}
        for info in fs.get_file_info(pa.fs.FileSelector(f"{root}/{PARTS}")):
            if info.base_name not in kept:  # of tasks that failed or were too late
                fs.delete_file(info.path)
        about = {"endian": self.endian, "nodes": self.nodes, "edges": self.edges, "timed": self.timed, "parts": parts}
        with fs.open_output_stream(f"{root}/{MANIFEST}.draft") as f:
            f.write(json.dumps(about).encode())
        fs.move(f"{root}/{MANIFEST}.draft", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _file_system(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pa.fs.FileType.NotFound and fs.get_file_info(f"{root}/{PARTS}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{PARTS}")


class CsrSource(DataSource):
    """spark.read.format("edgeloom_csr").option("endian", "big" or "little").load(folder); the folder must be one that
    all executors see. Its writer takes rows as CsrWriter wants them."""

    @classmethod
    def name(cls) -> str:
        return "edgeloom_csr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CsrReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CsrWriter:
        return CsrWriter(dict(self.options))


def counts(spark: SparkSession, path: str, endian: str) -> tuple[int, int]:
    """(nodes, edges) of a folder, from its manifest or from the length of one file and the header of another; that the
    lengths of all files agree is checked. No edge is read."""
    folder = Folder(path, endian)
    if folder._size(MANIFEST) is None and (folder._size(ENDS) != 8 + 4 * folder.edges or folder._size(TIMES) not in (0, folder._size(ENDS))):
        raise ValueError(f"the files of {path} don't agree on {folder.edges} edges")
    return folder.nodes, folder.edges


def read_csr(spark: SparkSession, path: str, endian: str, nodes_per_task: int = 1 << 20) -> Graph:
    ship(spark)
    spark.dataSource.register(CsrSource)
    edges = spark.read.format("edgeloom_csr").option("endian", endian).option("nodespertask", str(nodes_per_task)).load(path)
    return Graph(edges, counts(spark, path, endian)[0])


def write_parts(g: Graph, path: str, endian: str) -> None:
    """Writes g, rows sorted by (dst, ts), as parts below path, a folder on any file system that Arrow knows, in one
    transaction: with its commit the graph is there, and without it nothing is. A folder that holds a graph already is an
    error. A graph without edges can't be told apart in this format, and is an error too."""
    spark = g.edges.sparkSession
    ship(spark)
    spark.dataSource.register(CsrSource)
    total, timed = g.edges.agg(F.count("*"), F.count("ts")).first()
    if not total:
        raise ValueError("the format can't hold a graph without edges")
    starts = offsets(degrees(g))
    numbered = g.edges.selectExpr("src", "dst", "ts", "row_number() over (partition by src order by dst, ts) - 1 as i").join(starts, F.col("src") == F.col("id"))
    edges = numbered.select(F.lit(0).alias("kind"), (F.col("start") + F.col("i")).cast("long").alias("pos"), F.col("dst").cast("long").alias("value"), "ts")
    rows = edges.unionByName(starts.select(F.lit(1).alias("kind"), F.col("id").cast("long").alias("pos"), F.col("start").cast("long").alias("value"), F.lit(None).cast("int").alias("ts")))
    rows = rows.repartitionByRange("kind", "pos").sortWithinPartitions("kind", "pos")
    options = {"endian": endian, "nodes": str(g.num_nodes), "edges": str(total), "timed": str(timed == total).lower()}
    rows.write.format("edgeloom_csr").options(**options).mode("append").save(path)


def write_csr(g: Graph, path: str, endian: str) -> None:
    """Writes g as plain files into a folder of a shared POSIX file system that isn't there yet or is empty: parts first, which tasks
    then copy to their places in files of full size, and the folder gets its name when all is there. Whatever fails
    leaves nothing. For other file systems see write_parts, which read_csr reads as well."""
    target = path.removeprefix("file://")
    if os.path.isdir(target) and os.listdir(target):
        raise FileExistsError(path)
    draft = f"{target.rstrip('/')}.{uuid.uuid4().hex}.draft"
    try:
        write_parts(g, f"{draft}/parts", endian)
        _assemble(g.edges.sparkSession, f"{draft}/parts", f"{draft}/files", endian)
        if os.path.isdir(target):
            os.rmdir(target)
        os.rename(f"{draft}/files", target)
    finally:
        shutil.rmtree(draft, ignore_errors=True)


def _assemble(spark: SparkSession, parts: str, files: str, endian: str) -> None:
    """The plain files of a folder of parts; every task copies some parts to their places."""
    folder, order = Folder(parts, endian), _code(endian)
    os.makedirs(files)
    width = {ENDS: 4, TIMES: 4, STARTS: 8}
    for name, header, n in ((ENDS, 8, folder.edges), (TIMES, 8, folder.edges if folder.timed else 0), (STARTS, 0, folder.nodes)):
        with open(f"{files}/{name}", "wb") as f:
            if header and n:
                f.write(np.array([n], order + "i8").tobytes())
            f.truncate(header + width[name] * n if n else 0)
    todo = [(name, first, file) for name, some in folder.parts.items() for first, _, file, _ in some]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first, file in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open(file, "rb") as source, open(f"{files}/{name}", "r+b") as f:
                    f.seek((name != STARTS) * 8 + width[name] * first)
                    shutil.copyfileobj(source, f, 1 << 20)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    done = spark.createDataFrame(todo, "name string, first long, file string").repartition(len(todo)).mapInArrow(copy, "n long").agg(F.sum("n")).first()[0]
    if done != len(todo):
        raise OSError("not every part was copied")


def to_tsv(edges: DataFrame, path: str) -> None:
    """Tab-separated src and dst with a header, in the order of both."""
    edges.select("src", "dst").orderBy("src", "dst").write.option("sep", "\t").option("header", True).csv(path)


def from_tsv(spark: SparkSession, path: str, src: str = "src", dst: str = "dst", sep: str = "\t") -> DataFrame:
    """(src int, dst int) from separated values with a header, by the names of the two columns, wherever they stand and
    whatever others there are. Values that are no 32-bit whole numbers are an error."""
    rows = spark.read.option("sep", sep).option("header", True).csv(path)
    if missing := [c for c in (src, dst) if c not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows.select(F.col(src).cast("int").alias("src"), F.col(dst).cast("int").alias("dst"))


def line_count(spark: SparkSession, path: str, header: bool = True) -> int:
    """Lines of text files, without one header for all."""
    return spark.read.text(path).count() - header
