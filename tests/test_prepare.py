import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import monitoring
from edgeloom.functions.hashing import permutation, splitmix64
from edgeloom.operators import negatives
from edgeloom.operators.graph import canonical
from edgeloom.plans import prepare
from edgeloom.sources import arrays
from edgeloom.sources.tables import customer_graph
from tests.conftest import SF


def test_prepare_and_load(spark, tmp_path):
    g = customer_graph(spark, SF)
    layout = prepare.Layout(str(tmp_path / "d"))
    prepare.prepare(g, layout, 100, 60)
    train = prepare.load_train(spark, layout)
    pos = {n: {(r.src, r.dst) for r in prepare.load_split(spark, layout, n).where("label = 1").collect()} for n in prepare.SPLITS}
    every = {(r.src, r.dst) for r in g.edges.collect()}
    kept = {(r.src, r.dst) for r in train.edges.collect()}
    assert train.num_nodes == g.num_nodes and kept | pos["valid"] | pos["test"] == every and not pos["valid"] & pos["test"]
    valid = prepare.load_split(spark, layout, "valid").collect()
    order = [(splitmix64(r.src), r.src, -r.label, r.dst) for r in valid]
    assert order == sorted(order) and all((r.src, r.dst) not in kept for r in valid)
    with pytest.raises(ValueError):
        prepare.load_split(spark, layout, "train")
    assert spark.read.parquet(layout.train_pairs).count() == canonical(train.edges).count()


def test_given_splits_missing_parts_and_exports(spark, tmp_path):
    layout = prepare.Layout(str(tmp_path / "d"))
    given = spark.createDataFrame([(0, 1, [2, 3]), (1, 2, [0, 0])], "src long, dst long, negatives array<long>")
    prepare.write_given_split(given, layout, "valid", 4)
    assert [(r.src, r.dst, r.label) for r in prepare.load_split(spark, layout, "valid").collect() if r.src == 0] == [(0, 1, 1), (0, 2, 0), (0, 3, 0)]
    assert prepare.missing_parts(spark, layout) == [layout.split("test", 1), layout.split("test", 0)]
    with pytest.raises(ValueError, match="missing: .*split=test/label=1"):
        prepare.load_splits(spark, layout)
    for bad, name in ((given.limit(0), "train"), (given.withColumn("dst", F.lit(9)), "test"), (given.withColumn("negatives", F.array(F.lit(-1).cast("long"))), "test")):
        with pytest.raises(ValueError):
            prepare.write_given_split(bad, layout, name, 4)
    edges = spark.createDataFrame([(a, b, 0) for a, b in [(0, 1), (1, 0), (1, 2), (2, 1), (3, 0), (0, 3)]], "src int, dst int, ts int")
    edges.write.parquet(layout.train_edges)
    assert prepare.export_edges(spark, layout, str(tmp_path / "e.npy")) == 3
    assert np.load(tmp_path / "e.npy").tolist() == [[0, 0, 1], [1, 3, 2]]
    edges.where("src = 0 and dst = 1").select("src", "dst").write.parquet(layout.train_pairs)
    assert prepare.export_edges(spark, layout, str(tmp_path / "f.npy")) == 1 and np.load(tmp_path / "f.npy").shape == (2, 1)


def test_counts_and_whole_exports(spark, tmp_path):
    g = customer_graph(spark, SF)
    layout = prepare.Layout(str(tmp_path / "d"))
    prepare.prepare(g, layout, 100, 60)
    want = {"num_nodes": g.num_nodes, "num_edges": spark.read.parquet(layout.train_edges).count(), "num_pairs": spark.read.parquet(layout.train_pairs).count()}
    want |= {f"{n}_{w}": spark.read.parquet(layout.split(n, y)).count() for n in prepare.SPLITS for y, w in ((1, "pos"), (0, "neg"))}
    (tmp_path / "d/train_edges").rename(tmp_path / "d/elsewhere")  # counts need no table
    assert prepare.counts(spark, layout) == want
    (tmp_path / "d/elsewhere").rename(tmp_path / "d/train_edges")
    (tmp_path / "e").mkdir()
    about = prepare.export_dataset(spark, layout, str(tmp_path / "e"))
    assert json.loads((tmp_path / "e/metadata.json").read_text()) == about and about["num_nodes"] == g.num_nodes and about["kind"] == "undirected-symmetric-csr"
    index = np.load(tmp_path / "e/train_edge_index.npy")
    assert {tuple(x) for x in index.T.tolist()} == {(r.src, r.dst) for r in spark.read.parquet(layout.train_pairs).collect()} and about["files"]["train_edge_index"] == want["num_pairs"]
    for n in prepare.SPLITS:
        for y, w in ((1, "pos"), (0, "neg")):
            assert sorted(map(tuple, np.load(tmp_path / f"e/{n}_{w}.npy").tolist())) == sorted((r.src, r.dst) for r in spark.read.parquet(layout.split(n, y)).collect())
    assert prepare.export_dataset(spark, layout, str(tmp_path / "e"), "directed")["files"]["train_edge_index"] == want["num_edges"]


def test_raw_graphs_are_checked(spark):
    edges, years = spark.createDataFrame([(0, 1), (1, 2), (2, 2)], "src long, dst long"), spark.createDataFrame([(0, 1.0), (1, 5.0), (2, None)], "id int, year double")
    assert sorted(map(tuple, prepare.graph_from_years(edges, years, 3).edges.collect())) == [(0, 1, 5), (1, 0, 5), (1, 2, 5), (2, 1, 5)]
    with pytest.raises(ValueError, match="32 bits"):
        prepare.graph_from_years(edges, years, 1 << 31)
    with pytest.raises(ValueError, match="edges has ids from 0 to 2"):
        prepare.graph_from_years(edges, years, 2)


def test_samplers_of_training():
    assert negatives.training_sampler("two_hop") is negatives.two_hop
    with pytest.raises(ValueError, match="two_hop, uniform_nonedge"):
        negatives.training_sampler("uniform")
    assert [negatives.positives_per_batch(1024, *how) for how in ((), ("two_hop", 3), ("uniform", 2))] == [1024, 256, 204] and negatives.positives_per_batch(1, "uniform", 9) == 1


def test_training_rows_follow_the_permutation(spark):
    g = customer_graph(spark, SF)
    rows = prepare.training_rows(g, per_positive=2, epoch=3)
    n = canonical(g.edges).count()
    pos = rows.where("label = 1").orderBy("seq").collect()
    assert [r.seq for r in pos] == list(range(n)) and rows.where("label = 0").count() == 2 * n
    ordered = [r.src * g.num_nodes + r.dst for r in pos]
    assert sorted(ordered) == sorted(r[0] for r in canonical(g.edges).select(F.col("src") * g.num_nodes + F.col("dst")).collect())
    offset, stride = permutation(n, 42, 3)
    place = {p: (offset + i * stride) % n for i, p in enumerate(ordered)}
    assert sorted(place.values()) == list(range(n))


def test_embedding_versions(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id int, embedding array<float>")
    prepare.save_embeddings(v, str(tmp_path), "a")
    prepare.save_embeddings(v.withColumn("id", F.lit(2)), str(tmp_path), "b")
    prepare.save_embeddings(v.limit(0), str(tmp_path), "c", dtype="float32", seed=7)
    assert prepare.embedding_versions(spark, str(tmp_path))[1:] == [{"version": "b", "num_embeddings": 1, "embedding_dim": 2}, {"version": "c", "num_embeddings": 0, "embedding_dim": 0, "dtype": "float32", "seed": 7}]
    with pytest.raises(ValueError, match="no such version: x"):
        prepare.load_embeddings(spark, str(tmp_path), "x")
    with pytest.raises(Exception, match="exist"):
        prepare.save_embeddings(v, str(tmp_path), "a")
    (tmp_path / "versions/00000002.json").unlink()  # as if it had been cut off before its metadata
    assert prepare.load_embeddings(spark, str(tmp_path)).first().id == 2 and prepare.load_embeddings(spark, str(tmp_path), "a").first().id == 1


def test_stages_run_once(tmp_path):
    ran = []
    stages = [("a", lambda: ran.append("a")), ("b", lambda: ran.append("b"))]
    assert prepare.run_stages(stages, str(tmp_path), dry_run=True) == ["a", "b"] and not ran
    assert prepare.run_stages(stages, str(tmp_path)) == ["a", "b"] and prepare.run_stages(stages, str(tmp_path)) == []
    assert prepare.run_stages(stages, str(tmp_path), force=True) == ["a", "b"]


def test_array_files(spark, tmp_path):
    x = np.random.default_rng(0).integers(0, 1000, (500, 2))
    np.save(tmp_path / "p.npy", x.astype(np.int32))
    got = arrays.read_pairs(spark, str(tmp_path / "p.npy"), rows_per_task=64).orderBy("pos").collect()
    assert [(r.src, r.dst) for r in got] == [tuple(map(int, r)) for r in x]
    n = arrays.write_pairs(spark.createDataFrame(x.tolist(), "src long, dst long"), str(tmp_path / "q.npy"))
    assert n == 500 and (np.load(tmp_path / "q.npy") == x[np.lexsort((x[:, 1], x[:, 0]))]).all()
    e = (np.arange(20) / 10).reshape(5, 4).astype(np.float32)
    np.save(tmp_path / "e.npy", e)
    assert [r.embedding for r in arrays.read_embeddings(spark, str(tmp_path / "e.npy"), 2).orderBy("id").collect()] == e.tolist()
    (np.arange(12, dtype="<f4") + 1).tofile(tmp_path / "r.bin")
    assert arrays.read_raw_embeddings(spark, str(tmp_path / "r.bin"), 3, 4).where("id = 2").first().embedding == [9, 10, 11, 12]
    with pytest.raises(ValueError):
        arrays.read_raw_embeddings(spark, str(tmp_path / "r.bin"), 4, 4)
    with pytest.raises(ValueError):
        arrays.read_pairs(spark, str(tmp_path / "e.npy"))
    assert arrays.read_pairs(spark, str(tmp_path / "none.npy"), required=False) is None


def test_monitoring(spark):
    d = spark.createDataFrame([("81 %",), ("4096 MiB",), ("70.5 W",), ("N/A",), ("[Not Supported]",), (None,)], "v string")
    assert [r[0] for r in d.select(monitoring.number(F.col("v"))).collect()] == [81, 4096, 70.5, None, None, None]
    s = spark.createDataFrame([(1, [(10.0, 50.0), (None, 70.0)]), (2, [])], "sample int, devices array<struct<used:double,util:double>>")
    got = monitoring.with_device_totals(s).orderBy("sample").collect()
    assert (got[0].used_total, got[0].util_max, got[0].util_mean, got[1].util_mean) == (10, 70, 60, None)
    p = spark.createDataFrame([(1, 1, 1.0, 5, 2), (1, 2, 2.0, 9, 1)], "sample int, pid int, cpu double, rss long, threads int")
    assert monitoring.process_totals(p).first() == (1, 2, 3.0, 14, 3) and monitoring.top_processes(p, 1).first().pid == 2
    assert spark.range(1).select(monitoring.mib(F.lit(1572864))).first()[0] == 1.5
