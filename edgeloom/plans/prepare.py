"""Prepared datasets: a graph split by time and written in one layout, and what reads it back."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from edgeloom.cluster import exists, get_text, names, put_text, remove, written
from edgeloom.functions.hashing import permutation, unsigned_order, with_mix64
from edgeloom.operators import negatives, splits
from edgeloom.operators.graph import KINDS, Graph, canonical, checked_pairs, dedup, masked, symmetrize, with_later_year
from edgeloom.sources.arrays import write_pairs

SPLITS = ("valid", "test")
#: Nodes that 32-bit ids have room for.
MOST_NODES = (1 << 31) - 1


@dataclass(frozen=True)
class Layout:
    """Where a prepared dataset's tables are; split_root replaces root for the splits alone."""

    root: str
    split_root: str | None = None

    @property
    def train_edges(self) -> str:
        return f"{self.root}/train_edges"

    @property
    def train_pairs(self) -> str:
        return f"{self.root}/train_pairs"

    @property
    def meta(self) -> str:
        return f"{self.root}/meta"

    def split(self, name: str, label: int) -> str:
        return f"{self.split_root or self.root}/splits/split={name}/label={label}"


def graph_from_years(edges: DataFrame, node_years: DataFrame, num_nodes: int) -> Graph:
    """A symmetric graph without self-loops and duplicates, from raw edges (src, dst) and node years (id, year). Nodes
    must be few enough for 32-bit ids, and edges must be between them."""
    if not 0 <= num_nodes <= MOST_NODES:
        raise ValueError(f"{num_nodes} nodes need more than 32 bits for an id")
    edges = checked_pairs(edges, num_nodes, "edges").select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    return Graph(dedup(symmetrize(with_later_year(edges, node_years))), num_nodes)


def prepare(g: Graph, layout: Layout, k_val: int, k_test: int = 0, ties: str = splits.EXCLUDE, walks: int = 10, seed: int = 42) -> None:
    """Splits g by time, draws two-hop negatives of the held-out sources on the training graph, and writes train edges
    sorted by src, canonical train pairs, and the splits; without k_test there is no test split."""
    g = Graph(written(g.edges, "edges"), g.num_nodes)
    s = splits.temporal_split_3way(g.edges, k_val, k_test, ties) if k_test else splits.temporal_split(g.edges, k_val, ties)
    train = Graph(s.train, g.num_nodes)
    counts = {"num_nodes": g.num_nodes}
    counts["num_edges"] = _counted(s.train.repartitionByRange("src").sortWithinPartitions("src", "dst"), layout.train_edges)
    counts["num_pairs"] = _counted(canonical(s.train).select("src", "dst"), layout.train_pairs)
    for name, pos, shift in (("valid", s.val, 10_000), ("test", s.test, 20_000)):
        if pos is not None:
            pos = written(pos, name)
            counts[f"{name}_pos"] = _counted(pos, layout.split(name, 1))
            counts[f"{name}_neg"] = _counted(negatives.two_hop_of_sources(train, pos, walks, seed + shift), layout.split(name, 0))
    g.edges.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in counts.items()]).coalesce(1).write.json(layout.meta)


def _counted(df: DataFrame, path: str) -> int:
    """Writes df and gives back its rows, as the tasks that wrote it have counted them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def counts(spark: SparkSession, layout: Layout) -> dict[str, int]:
    """Nodes, training edges and pairs and the rows of both splits, as prepare has noted them: nothing of the tables is read."""
    row = spark.read.schema("num_nodes long, num_edges long, num_pairs long, valid_pos long, valid_neg long, test_pos long, test_neg long").json(layout.meta).first()
    return {k: v for k, v in row.asDict().items() if v is not None}


def write_given_split(split: DataFrame, layout: Layout, name: str, num_nodes: int) -> None:
    """A split that came with its dataset, rows (src, dst, negatives array), as positives and as one pair for each
    negative of their sources."""
    if name not in SPLITS:
        raise ValueError(f"unknown split: {name}")
    pos = checked_pairs(split.select("src", "dst"), num_nodes, f"{name} positives")
    neg = checked_pairs(negatives.flatten(split), num_nodes, f"{name} negatives")
    pos.write.parquet(layout.split(name, 1))
    neg.write.parquet(layout.split(name, 0))


def missing_parts(spark: SparkSession, layout: Layout) -> list[str]:
    """The tables of both splits that aren't there."""
    wanted = [layout.split(name, label) for name in SPLITS for label in (1, 0)]
    return [path for path in wanted if not exists(spark, path)]


def load_splits(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    """Both splits by name, as load_split gives them; an error that names every part that is missing."""
    if missing := missing_parts(spark, layout):
        raise ValueError(f"missing: {', '.join(missing)}")
    return {name: load_split(spark, layout, name) for name in SPLITS}


def export_edges(spark: SparkSession, layout: Layout, path: str) -> int:
    """The canonical training pairs as an edge index [2, n] in a .npy file; from the training edges where the pairs
    weren't written."""
    stored = spark.read.parquet(layout.train_pairs) if exists(spark, layout.train_pairs) else canonical(spark.read.parquet(layout.train_edges))
    return write_pairs(stored, path, edge_index=True)


def export_dataset(spark: SparkSession, layout: Layout, folder: str, kind: str = KINDS[0]) -> dict:
    """A whole prepared dataset for other programs: the training edges that a graph of that kind gives, as an edge
    index, for each split its positives and negatives as pairs, and metadata.json, which is written last and given back:
    the kind, the number of nodes and what each file holds."""
    n = load_train(spark, layout).num_nodes
    parts = {"train_edge_index": write_pairs(masked(spark.read.parquet(layout.train_edges), kind).select("src", "dst"), f"{folder}/train_edge_index.npy", edge_index=True)}
    for name in SPLITS:
        for label, word in ((1, "pos"), (0, "neg")):
            if exists(spark, layout.split(name, label)):
                parts[f"{name}_{word}"] = write_pairs(spark.read.parquet(layout.split(name, label)).select("src", "dst"), f"{folder}/{name}_{word}.npy")
    about = {"kind": kind, "num_nodes": n, "files": parts}
    remove(spark, f"{folder}/metadata.json")
    put_text(spark, f"{folder}/metadata.json", json.dumps(about, indent=1))
    return about


def load_train(spark: SparkSession, layout: Layout) -> Graph:
    n = spark.read.schema("num_nodes long").json(layout.meta).first()[0]
    return Graph(spark.read.parquet(layout.train_edges), n)


def load_split(spark: SparkSession, layout: Layout, name: str) -> DataFrame:
    """(src, dst, label) of a split, in the order of evaluation: sources by unsigned hash, positives first."""
    if name not in SPLITS:
        raise ValueError(f"unknown split: {name}")
    both = [spark.read.parquet(layout.split(name, label)).select(F.col("src").cast("long"), F.col("dst").cast("long")).withColumn("label", F.lit(label)) for label in (1, 0)]
    rows = with_mix64(both[0].unionByName(both[1]), "h", F.col("src"))
    return rows.orderBy(unsigned_order("h"), "src", F.desc("label"), "dst").drop("h")


def training_rows(g: Graph, sampler: str = "uniform_nonedge", per_positive: int = 1, seed: int = 42, epoch: int = 0, **how) -> DataFrame:
    """(seq, src, dst, label): an epoch's examples: canonical edges in the affine order of seed and epoch, each with the
    negatives that the sampler named draws for it."""
    pairs = canonical(g.edges).select("src", "dst")
    numbered = written(pairs.select((F.col("src").cast("long") * g.num_nodes + F.col("dst")).alias("pair"), "src", "dst"), "positives")
    n = numbered.count()
    offset, stride = permutation(n, seed, epoch)
    bucket = F.pmod(F.xxhash64("pair"), F.lit(max(1, n // 100_000))).cast("int")
    dealt = numbered.withColumn("b", bucket)
    counts = dealt.groupBy("b").agg(F.count("*").alias("c")).selectExpr("b", "sum(c) over (order by b rows unbounded preceding) - c as base")
    ranked = dealt.selectExpr("*", "row_number() over (partition by b order by pair) - 1 as i").join(counts, "b").select("pair", "src", "dst", (F.col("base") + F.col("i")).alias("at"))
    # example number seq is edge (offset + seq * stride) mod n, so an edge's number is the inverse of that
    back = pow(stride, -1, n) if n > 1 else 0
    pos = ranked.select("pair", F.pmod((F.pmod(F.col("at") - offset, F.lit(n)) * back), F.lit(n)).cast("long").alias("seq"), "src", "dst")
    neg = negatives.SAMPLERS[sampler](g, numbered, per_positive, seed + epoch, **how).select("pair", "src", "dst")
    neg = neg.join(pos.select("pair", "seq"), "pair")
    return pos.select("seq", "src", "dst", F.lit(1).alias("label")).unionByName(neg.select("seq", "src", "dst", F.lit(0).alias("label")))


def save_embeddings(vectors: DataFrame, root: str, version: str, **about) -> None:
    """An embedding table (id, embedding) as a version under root, with what is known of it: its rows and the length of
    its vectors, and about. The version is there once its metadata are, and becomes the latest then."""
    spark, path = vectors.sparkSession, f"{root}/embedding_table/version={version}"
    vectors.write.parquet(path)
    n, dim = spark.read.parquet(path).agg(F.count("*"), F.max(F.size("embedding"))).first()
    number = len(names(spark, f"{root}/versions"))
    put_text(spark, f"{root}/versions/{number:08d}.json", json.dumps({"version": version, "num_embeddings": n, "embedding_dim": dim or 0, **about}))


def embedding_versions(spark: SparkSession, root: str) -> list[dict]:
    """The metadata of all versions, in the order in which they were saved."""
    return [json.loads(get_text(spark, f"{root}/versions/{x}")) for x in names(spark, f"{root}/versions") if x.endswith(".json")]


def load_embeddings(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    known = [x["version"] for x in embedding_versions(spark, root)]
    if not known or version is not None and version not in known:
        raise ValueError(f"no such version: {version or 'the latest'}; there are {', '.join(known) or 'none'}")
    return spark.read.parquet(f"{root}/embedding_table/version={version or known[-1]}")


def run_stages(stages: list[tuple[str, Callable[[], None]]], markers: str, force: bool = False, dry_run: bool = False) -> list[str]:
    """Runs named stages in order, skips those whose marker is there, and gives back the names of those that ran (or,
    in a dry run, would run). Markers are small files on any file system that Spark knows."""
    spark, ran = SparkSession.builder.getOrCreate(), []
    for name, stage in stages:
        done = f"{markers}/{name}.done"
        if exists(spark, done) and not force:
            continue
        ran.append(name)
        if not dry_run:
            stage()
            remove(spark, done)
            put_text(spark, done, json.dumps({"stage": name}))
    return ran
