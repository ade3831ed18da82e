"""Runs that are cut off, and batches of subgraphs."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.cluster import get_text, names, put_text
from edgeloom.operators import blocks, features, graph, subgraphs, walks
from edgeloom.plans import training, transforms


@pytest.fixture(scope="module")
def contexts(spark):
    return spark.createDataFrame([(a, b) for c in (0, 4) for a in range(c, c + 4) for b in range(c, c + 4) if a != b], "anchor int, context int")


@pytest.fixture(scope="module")
def first(spark):
    return features.initial_embeddings(spark.range(8).select(F.col("id").cast("int").alias("id")), 4, "uniform", seed=3)


def vectors(df):
    return {r.id: np.array(r.embedding) for r in df.collect()}


def close(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-12) for i in a)


def test_a_run_cut_after_round_3_ends_with_the_same_vectors(spark, contexts, first, tmp_path):
    want = vectors(features.fit_skipgram(contexts, 8, first, rounds=5, seed=3))
    root, calls = str(tmp_path / "run"), []

    def judge(v):
        calls.append(v)
        if len(calls) == 4:
            raise KeyboardInterrupt  # the fourth round's table is written, its pointer isn't
        return float(len(calls))

    with pytest.raises(KeyboardInterrupt):
        training.train_skipgram(contexts, 8, first, root, rounds=5, seed=3, evaluate=judge)
    assert training.latest(spark, root).round == 3
    state = training.train_skipgram(contexts, 8, first, root, rounds=5, seed=3, evaluate=judge)
    assert (state.round, state.best, state.history) == (5, 5, [1.0, 2.0, 3.0, 5.0, 6.0])
    assert close(vectors(training.vectors_of(spark, root)), want)
    again = training.train_skipgram(contexts, 8, first, root, rounds=5, seed=3, evaluate=judge)
    assert again == state and len(calls) == 6 and names(spark, f"{root}/rounds") == ["round=5"]
    with pytest.raises(ValueError, match="is about"):
        training.train_skipgram(contexts, 9, first, root, rounds=6, seed=3)


def test_the_best_round_stays_and_patience_stops(spark, contexts, first, tmp_path):
    root, values = str(tmp_path / "run"), iter([0.1, 0.5, 0.3, None, 0.4, 0.2, 0.9])
    state = training.train_skipgram(contexts, 8, first, root, rounds=7, seed=3, evaluate=lambda v: next(values), patience=3)
    assert (state.round, state.best, state.stopped) == (6, 2, True)  # a round without a value counts for nothing
    assert names(spark, f"{root}/rounds") == ["round=2", "round=6"]
    best = vectors(training.vectors_of(spark, root, best=True))
    assert close(best, vectors(features.fit_skipgram(contexts, 8, first, rounds=2, seed=3)))
    assert training.train_skipgram(contexts, 8, first, root, rounds=9, seed=3).round == 6
    with pytest.raises(ValueError):
        training.vectors_of(spark, str(tmp_path / "none"))


def test_rounds_by_blocks_and_by_joins_are_the_same(spark, monkeypatch):
    """Several blocks, some of them empty; ends without a vector, pairs of a node with itself, nodes without pairs, ids as long."""
    monkeypatch.setattr(blocks, "FEW_NODES", 9)
    monkeypatch.setattr(blocks, "PACKED", 50)
    monkeypatch.setattr(blocks, "SIDE_BY_SIDE", 7)
    rng = random.Random(5)
    rows = [(rng.choice((0, rng.randrange(50))), rng.randrange(50)) for _ in range(700)] + [(3, 3), (None, 4), (70, 1), (2, 70)]
    for kind in ("int", "long"):
        contexts = spark.createDataFrame(rows, f"anchor {kind}, context {kind}").repartition(5)
        first = features.initial_embeddings(spark.range(60).where("id % 5 > 0 and id % 11 <> 2").select(F.col("id").cast(kind).alias("id")), 3, "uniform", seed=3)
        got = features.fit_skipgram(contexts, 50, first, negatives=2, rounds=3, seed=4)
        assert blocks.place_of(got).blocks == 6 and got.columns == ["id", "embedding"] and dict(got.dtypes)["id"] == {"int": "int", "long": "bigint"}[kind]
        with monkeypatch.context() as m:
            m.setattr(blocks, "reachable", lambda *_: False)
            want = features.fit_skipgram(contexts, 50, first, negatives=2, rounds=3, seed=4)
        assert blocks.place_of(want) is None and close(vectors(got), vectors(want)) and len(vectors(got)) == first.count()
        fake = contexts.withColumn("context", F.pmod(F.col("context") + 7, F.lit(50)).cast(kind))
        for bias in (False, True):
            a, b = (walks.skipgram_loss(contexts, fake, v, 50, bias).first().loss for v in (got, want))
            assert abs(a - b) < 1e-12


def test_a_round_and_a_loss_shuffle_no_vectors(spark, contexts, first):
    def shuffled(df):
        found, open_ = [], [df._jdf.queryExecution().executedPlan()]
        while open_:
            p = open_.pop()
            p = p.initialPlan() if p.nodeName() == "AdaptiveSparkPlan" else p
            if p.nodeName() == "Exchange":
                found.append(p.schema().simpleString())
            open_ += [p.children().apply(i) for i in range(p.children().size())]
        return found

    pairs = features.counted_pairs(contexts)
    table, links = blocks.laid(first, 2), blocks.links(pairs, 2)
    one = shuffled(features.skipgram_round(pairs, links, table, 8, 0))
    assert len(one) == 1 and "ids:array<int>" in one[0] and "embedding" not in one[0]
    assert not any("embedding" in x for x in shuffled(walks.skipgram_loss(contexts, contexts, table, 8)))


def test_vectors_in_blocks_are_whole(spark, monkeypatch):
    for rows in ([(0, [1.0]), (1, None)], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0]), (1, [None])]):
        table = blocks.laid(spark.createDataFrame(rows, "id int, embedding array<double>"), 1)
        with pytest.raises(ValueError, match="one length"):
            blocks.place_of(table).read(0)
    assert [len(x) for x in blocks.place_of(table).read(5)] == [0, 0]
    assert blocks.blocks_for(1) == 1 and blocks.blocks_for(15_000) == 2 and blocks.blocks_for(1 << 22) == 64 and blocks.blocks_for(1 << 25) == 128 and blocks.blocks_for(1, 1 << 24) == 8
    assert blocks.reachable(spark, "/tmp")
    monkeypatch.setattr(blocks, "qualified", lambda *_: "viewfs://store/in")
    assert not blocks.reachable(spark, "/in")


def test_small_files_are_whole_or_not_there(spark, tmp_path):
    put_text(spark, f"{tmp_path}/a/b.json", "é{}")
    assert get_text(spark, f"{tmp_path}/a/b.json") == "é{}" and names(spark, f"{tmp_path}/a") == ["b.json"] and names(spark, f"{tmp_path}/c") == []
    with pytest.raises(FileExistsError):
        put_text(spark, f"{tmp_path}/a/b.json", "other")
    assert get_text(spark, f"{tmp_path}/a/b.json") == "é{}" and names(spark, f"{tmp_path}/a") == ["b.json"]


def test_places_in_order(spark):
    rng = random.Random(1)
    rows = [(0 if i % 3 else rng.randint(1, 9), rng.randint(0, 1000), i) for i in range(900)]  # one group has most of the rows
    d = spark.createDataFrame(rows, "g int, x int, i int").repartition(7)
    every = {r.i: r.pos for r in graph.in_order(d, ["x", "i"]).collect()}
    assert every == {i: n for n, (_, i) in enumerate(sorted((x, i) for _, x, i in rows))}
    groups = defaultdict(list)
    for g, x, i in rows:
        groups[g].append((x, i))
    want = {i: n for xs in groups.values() for n, (_, i) in enumerate(sorted(xs))}
    assert {r.i: r.at for r in graph.in_order(d, ["x", "i"], ["g"], "at").collect()} == want
    assert graph.in_order(d.limit(0), ["x"]).count() == 0


def test_batches_are_disjoint_unions(spark):
    rng = random.Random(2)
    edges = [(a, b, 0) for a, b in {tuple(rng.sample(range(40), 2)) for _ in range(120)}]
    e = spark.createDataFrame([*edges, *[(b, a, 0) for a, b, _ in edges]], "src int, dst int, ts int").distinct()
    pairs = spark.createDataFrame([(100 - p, *rng.sample(range(40), 2), p % 2, p) for p in range(23)], "pair_id long, src int, dst int, label int, seq long")
    nodes = subgraphs.k_hop_nodes(pairs, e, 1)
    sub = subgraphs.induced_pairwise(pairs, nodes, e)
    b = subgraphs.batched(pairs, nodes, sub, 5, subgraphs.labels(pairs, nodes, sub, "drnl"), order="seq")
    graphs = {(r.batch, r.graph): r for r in b.graphs.collect()}
    assert sorted(graphs) == [(p // 5, p % 5) for p in range(23)] and all(r.seq == 5 * r.batch + r.graph and r.label == r.seq % 2 for r in graphs.values())
    at = {(r.batch, r.node): r for r in b.nodes.collect()}
    mine = {(r.pair_id, r.node_id) for r in nodes.collect()}
    for batch in range(5):
        size = sum(r.num_nodes for r in graphs.values() if r.batch == batch)
        assert sorted(n for q, n in at if q == batch) == list(range(size))
    z = {(r.pair_id, r.node_id): r.z for r in subgraphs.labels(pairs, nodes, sub, "drnl").collect()}
    for (batch, node), r in at.items():
        g = graphs[batch, r.graph]
        assert (g.pair_id, r.node_id) in mine and g.first_node <= node < g.first_node + g.num_nodes and r.z == z[g.pair_id, r.node_id]
    for g in graphs.values():
        assert [at[g.batch, g.first_node + i].node_id for i in (0, 1)] == [g.src, g.dst]
    back = sorted((graphs[r.batch, r.graph].pair_id, at[r.batch, r.u].node_id, at[r.batch, r.v].node_id) for r in b.edges.collect())
    assert back == sorted((r.pair_id, r.u, r.v) for r in sub.collect()) and json.dumps(back)


def test_batches_of_pairs_without_nodes_or_labels(spark):
    pairs = spark.createDataFrame([(1, 0, 1), (2, 2, 3)], "pair_id long, src int, dst int")
    nodes = spark.createDataFrame([(2, 2, 0), (2, 3, 0)], "pair_id long, node_id int, dist int")
    none = spark.createDataFrame([], "pair_id long, u int, v int, w int")
    b = subgraphs.batched(pairs, nodes, none, 2)
    assert [(r.graph, r.num_nodes, r.first_node) for r in b.graphs.orderBy("graph").collect()] == [(0, 0, 0), (1, 2, 0)]
    assert sorted((r.node, r.node_id, r.z) for r in b.nodes.collect()) == [(0, 2, None), (1, 3, None)] and b.edges.count() == 0


def test_batch_transforms_by_name(spark):
    rows = spark.createDataFrame([(i, i, i + 1, 1) for i in range(5)] + [(i, i, 9 - i, 0) for i in range(5) for _ in range(2)], "seq long, src int, dst int, label int")
    raw = transforms.raw_batches(rows, 2)
    assert transforms.build("identity")(raw) is raw
    got = [tuple(r) for r in transforms.build("edge_label")(raw).orderBy("batch", "place").collect()]
    assert got[:6] == [(0, 0, 0, 1, 1), (0, 1, 1, 2, 1), (0, 2, 0, 9, 0), (0, 3, 0, 9, 0), (0, 4, 1, 8, 0), (0, 5, 1, 8, 0)] and [r[:2] for r in got[12:]] == [(2, 0), (2, 1), (2, 2)]
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id int, embedding array<float>")
    x = transforms.build("edge_features", vectors=v, how="weighted_l1")(raw).where("batch = 0 and place = 2").first()
    assert x.features == [9.0, 0.0]
    e = spark.createDataFrame([(a, b, 0) for i in range(9) for a, b in ((i, i + 1), (i + 1, i))], "src int, dst int, ts int")
    b = transforms.build("subgraphs", edges=e, size=4, hops=1, label="zo")(raw)
    graphs = b.graphs.orderBy("batch", "graph").collect()
    assert len(graphs) == 15 and [(r.src, r.dst, r.label) for r in graphs] == [r[2:] for r in got] and b.nodes.where("z[0] = 1").count() == 30
    with pytest.raises(ValueError, match="identity, edge_label"):
        transforms.build("other")


def test_hubs_are_drawn_from_by_number(spark):
    """Sampling by vertex at a hub, and walks to the smallest neighbours, however many blocks a hub has."""
    e = spark.createDataFrame([(0, i, 0) for i in range(1, 200)] + [(i, 0, 0) for i in range(1, 200)], "src int, dst int, ts int")
    pairs = spark.createDataFrame([(p, 0, p) for p in range(1, 40)], "pair_id long, src int, dst int")
    for size in (1 << 16, 16):
        before, graph.BLOCK_NEIGHBOURS = graph.BLOCK_NEIGHBOURS, size
        try:
            got = subgraphs.k_hop_nodes(pairs, e, 1, max_per_hop=8, oversample=1.5, seed=3).where("dist = 1").collect()
        finally:
            graph.BLOCK_NEIGHBOURS = before
        assert {r.pair_id for r in got} == set(range(1, 40)) and len({r.node_id for r in got}) > 60 and all(1 <= r.node_id < 200 for r in got)
    w = {r.walk[0]: r.walk for r in walks.smallest_neighbour_walks(graph.Graph(e, 201), 5).collect()}
    assert w[0] == [0, 2, 0, 4, 0] and w[7] == [7, 0, 3, 0, 5] and w[200] == [200] * 5


def test_scanned_edges_keep_their_direction_and_number(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(12), rng.randrange(12), 0) for _ in range(60)] + [(0, i, 0) for i in range(12)] + [(3, 3, 0)] * 2
    e = spark.createDataFrame(edges, "src int, dst int, ts int")
    pairs = spark.createDataFrame([(p, *rng.sample(range(12), 2)) for p in range(10)], "pair_id long, src int, dst int")
    nodes = subgraphs.k_hop_nodes(pairs, e, 1)
    of, want = defaultdict(set), defaultdict(int)
    for r in nodes.collect():
        of[r.pair_id].add(r.node_id)
    for r in pairs.collect():
        for u, v, _ in edges:
            if {u, v} <= of[r.pair_id] and (u, v) not in ((r.src, r.dst), (r.dst, r.src)):
                want[r.pair_id, u, v] += 1
    assert {(r.pair_id, r.u, r.v): r.w for r in subgraphs.induced_scan(pairs, nodes, e).collect()} == want
