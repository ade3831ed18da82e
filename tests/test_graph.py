"""Graph operators on small graphs with known answers, and invariants of what is drawn at random."""

import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgeloom import cluster
from edgeloom.functions import hashing, vectors
from edgeloom.operators import blocks, features, graph, metrics, negatives, ranks, splits, subgraphs, walks
from edgeloom.plans import queries
from edgeloom.sources import csr
from edgeloom.sources.tables import customer_graph
from tests.conftest import SF

EDGES = "src int, dst int, ts int"
TOY = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 3), (3, 1), (3, 2)]


def make(spark, pairs, n, ts=None):
    return graph.Graph(spark.createDataFrame([(a, b, ts[i] if ts else 0) for i, (a, b) in enumerate(pairs)], EDGES), n)


@pytest.fixture(scope="module")
def customers(spark):
    return customer_graph(spark, SF)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_splitmix64():
    want = [16294208416658607535, 10451216379200822465, 10905525725756348110, 2092789425003139053]
    assert [hashing.splitmix64(i) for i in range(4)] == want and hashing.splitmix64(42) == 13679457532755275413
    assert sorted(range(6), key=hashing.splitmix64) == [3, 5, 4, 1, 2, 0]
    assert hashing.permutation(10, 42) == (6, 7)
    for n in range(1, 60):
        offset, stride = hashing.permutation(n, 7, 3)
        assert sorted((offset + i * stride) % n for i in range(n)) == list(range(n))


def test_hash_columns(spark):
    rng = random.Random(0)
    xs = [0, 1, 2**62, 2**63 - 1, *(rng.getrandbits(63) for _ in range(40))]
    d = spark.createDataFrame([(x,) for x in xs], "x long")
    got = [r.h % 2**64 for r in hashing.with_mix64(d, "h", F.col("x")).collect()]
    assert got == [hashing.splitmix64(x) for x in xs]
    pairs = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (7, 1000000)], "u int, v int")
    assert [r.h for r in hashing.with_pair_hash(pairs, "h", "u", "v").collect()] == [269157861, 269157861, 2113851966, 101077200]
    order = d.limit(6).withColumn("h", F.col("x"))
    assert order.orderBy(hashing.unsigned_order("h")).count() == 6


def test_basic_operators(spark):
    g = make(spark, [*TOY, (1, 1)], 6)
    assert rows(graph.degrees(g)) == [(0, 2), (1, 3), (2, 2), (3, 2), (4, 0), (5, 0)]
    assert rows(graph.offsets(graph.degrees(g))) == [(0, 0), (1, 2), (2, 5), (3, 7), (4, 9), (5, 9)]
    assert rows(graph.neighbour_at(g.edges, 2)) == [(1, 2, 0)]
    at = graph.edges_at(g, spark.range(-1, 12).withColumnRenamed("id", "pos").where("pos >= 0"))
    assert rows(at) == [(i, *e) for i, e in enumerate(sorted([*TOY, (1, 1)]))]
    assert rows(graph.canonical(g.edges).select("src", "dst")) == [(0, 1), (0, 2), (1, 2), (2, 3)]
    assert rows(graph.adjacency(g.edges))[1] == (1, [0, 1, 2])
    q = graph.quality(make(spark, [(0, 1), (0, 1), (1, 0), (2, 2), (3, 9)], 4)).first().asDict()
    assert q == {"edges": 5, "min_id": 0, "max_id": 9, "out_of_bounds": 1, "selfloops": 1, "repeated": 1, "one_way": 1}
    with pytest.raises(ValueError):
        graph.masked(g.edges, "other")
    d = spark.createDataFrame([(1, 5.9), (2, float("nan")), (3, None), (4, -3.0), (5, 1e12)], "id int, y double")
    assert [r[0] for r in d.orderBy("id").select(graph.years(F.col("y"))).collect()] == [5, 0, 0, 0, 2147483647]


def test_symmetrize_and_dedup(spark):
    g = make(spark, [(0, 1), (1, 0), (0, 1), (2, 2)], 3, [5, 3, 9, 1])
    assert rows(graph.dedup(graph.symmetrize(g.edges))) == [(0, 1, 3), (1, 0, 3)]


@pytest.mark.parametrize("k", [1, 7, 40, 100])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    ts = [rng.choice([-(2**31), 2**31 - 1, 0, -1, rng.randrange(-100000, 100000)]) for _ in range(100)]
    t = splits.kth_largest(spark.createDataFrame([(x,) for x in ts], "ts int"), "ts", k)
    value = sorted(ts, reverse=True)[k - 1]
    assert (t.value, t.above, t.at) == (value, sum(x > value for x in ts), ts.count(value))


def test_splits_at_the_edges(spark):
    g = make(spark, TOY, 4, [1, 1, 2, 2, 3, 3, 3, 4])
    with pytest.raises(ValueError):
        splits.kth_largest(g.edges, "ts", 9)
    s = splits.temporal_split(g.edges, 2, splits.EXCLUDE)
    assert s.val.count() == 1 and s.train.count() == 7
    s = splits.temporal_split(g.edges, 2, splits.INCLUDE)
    assert s.val.count() == 4 and s.train.count() == 4
    s = splits.temporal_split_3way(g.edges, 2, 2, splits.EXCLUDE)  # four late ones wanted, of which ties leave one
    assert (s.train.count(), s.val.count(), s.test.count()) == (7, 0, 1)
    tied = make(spark, TOY, 4, [5] * 8)
    assert splits.temporal_split(tied.edges, 3, splits.EXCLUDE).val.count() == 0


def test_negatives_keep_their_promises(spark, customers):
    g = customers
    e = {(r.src, r.dst) for r in g.edges.collect()}
    pos = graph.canonical(g.edges).select((F.col("src") * 1000 + F.col("dst")).cast("long").alias("pair"), "src", "dst")
    n = pos.count()
    u = negatives.uniform(g, pos, 2, seed=1, reject_existing=True).join(pos.withColumnsRenamed({"src": "s", "dst": "d"}), "pair").collect()
    assert len(u) == 4 * n and all((r.src, r.dst) not in e and r.src != r.dst for r in u)
    assert all(r.src == r.s if r.side == 0 else r.dst == r.d for r in u)
    v = negatives.nonedge(g, pos, 2, seed=1).collect()
    assert len(v) == 2 * n and all((r.src, r.dst) not in e and (r.dst, r.src) not in e and r.src != r.dst for r in v)
    closure = {(r.src, r.dst) for r in graph.two_hop_closure(pos, g.edges).collect()}
    w = negatives.two_hop(g, pos, 2, seed=1).collect()
    assert 0 < len(w) <= 2 * n and all((r.src, r.dst) in closure for r in w)
    again = negatives.two_hop(graph.Graph(g.edges.repartition(7), g.num_nodes), pos.repartition(3), 2, seed=1)
    assert rows(again) == sorted(tuple(r) for r in w)  # however the data lie
    told = negatives.two_hop(g, pos, 2, seed=1, tell=True).collect()
    assert sorted(tuple(r)[:4] for r in told) == sorted(tuple(r) for r in w)
    s = negatives.sampling_stats(negatives.two_hop(g, pos, 2, seed=1, tell=True), 2 * n).first()
    tries = [r.attempt for r in told]
    assert (s.total, s.found, s.failed) == (2 * n, len(w), 2 * n - len(w)) and s.mean_attempts == pytest.approx(sum(tries) / len(tries))
    assert s.first_share == pytest.approx(tries.count(1) / (2 * n)) and s.failed_share == pytest.approx(1 - len(w) / (2 * n)) and max(tries) > 1


def test_walks(spark, customers):
    cycle = make(spark, [(0, 1), (1, 2), (2, 0)], 3)
    w = walks.windows(walks.uniform_walks(cycle, 5, walks_per_node=2, seed=3), 3)
    assert w.count() == 18
    assert all(r.window == [r.window[0], (r.window[0] + 1) % 3, (r.window[0] + 2) % 3] for r in w.collect())
    for made in (walks.uniform_walks(customers, 7, 2, seed=1), walks.biased_walks(customers, 4, 0.25, 4.0, seed=1)):
        assert walks.invalid_steps(made, customers).count() == 0
    lonely = graph.Graph(cycle.edges, 5)
    assert [r.walk for r in walks.biased_walks(lonely, 4, 2.0, 2.0).where("walk_id >= 3").orderBy("walk_id").collect()] == [[3] * 4, [4] * 4]
    neg = walks.negative_windows(walks.uniform_walks(cycle, 6, 2, seed=3), 3, 3, per_walk=2)
    assert neg.count() == 48 and {x for r in neg.collect() for x in r.window} <= {0, 1, 2}
    with pytest.raises(ValueError):
        walks.windows(w, 1)


def test_biased_walks_follow_their_weights(spark):
    # from 0 to 1; there: back to 0 (1/p), to 2, a neighbour of 0 (1), or to 3 (1/q)
    g = make(spark, [(0, 1), (1, 0), (1, 2), (1, 3), (0, 2), (2, 0), (2, 1), (3, 1)], 4)
    w = walks.biased_walks(g, 3, p=0.5, q=4.0, walks_per_node=1500, seed=5).where("walk[0] = 0 and walk[1] = 1")
    n = {r.x: r["count"] for r in w.groupBy(F.col("walk")[2].alias("x")).count().collect()}
    total, want = sum(n.values()), {0: 2, 2: 1, 3: 0.25}
    assert all(abs(n[x] / total - v / 3.25) < 0.06 for x, v in want.items())


def hub_graph(spark):
    """A node with a third of all edges beside a ring."""
    ring = [(i, i % 300 + 1) for i in range(1, 301)]
    return make(spark, [x for a, b in ring + [(0, i) for i in range(1, 301)] for x in ((a, b), (b, a))], 301)


def test_numbered_neighbours_at_a_hub(spark, monkeypatch):
    g = hub_graph(spark)
    want = rows(graph.numbered_neighbours(g.edges))
    monkeypatch.setattr(graph, "BLOCK_NEIGHBOURS", 16)
    got = rows(graph.numbered_neighbours(g.edges))
    for found in (want, got):
        assert sorted((a, b) for a, _, b, _, _ in found) == sorted(map(tuple, g.edges.select("src", "dst").collect()))
        assert all(sorted(i for a, i, _, _, _ in found if a == s) == list(range(n)) for s, n in ((0, 300), (1, 3), (300, 3)))
        assert all(n == (300 if a == 0 else 3) and m == (300 if b == 0 else 3) for a, _, b, n, m in found)
    negative = rows(negatives.two_hop(g, graph.canonical(g.edges).where("src > 0").select(F.col("src").cast("long").alias("pair"), "src", "dst"), 2, seed=1).select("src", "dst"))
    near = {(a, b) for a, b, *_ in rows(g.edges.select("src", "dst"))}
    assert len(negative) > 500 and not near & set(negative) and all(a != b for a, b in negative)


def test_biased_walks_draw_at_hubs_as_their_weights_say(spark, monkeypatch):
    """From 1 by way of the hub: back to 1 with weight 1/p, to 1's neighbours 2 and 300 with 1, to others with 1/q."""
    monkeypatch.setattr(walks, "LOOK", 64)
    w = walks.biased_walks(hub_graph(spark), 3, p=0.02, q=4.0, walks_per_node=3000, seed=5).where("walk[0] = 1 and walk[1] = 0")
    ends = [r.walk[2] for r in w.collect()]
    total = 50 + 2 * 1 + 297 / 4
    assert len(ends) > 800
    assert abs(ends.count(1) / len(ends) - 50 / total) < 0.06 and abs(sum(x in (2, 300) for x in ends) / len(ends) - 2 / total) < 0.02
    assert walks.invalid_steps(w, hub_graph(spark)).count() == 0


def test_biased_steps_spread_no_neighbours_where_lists_are_short(spark, monkeypatch):
    """A step is one row for each walk: no list is exploded, and each table of a step comes of one shuffle of walkers."""
    plans, before = [], walks.written
    monkeypatch.setattr(walks, "written", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or before(df, tag))
    ring = make(spark, [x for i in range(40) for x in ((i, (i + 1) % 40), ((i + 1) % 40, i))], 41)
    w = walks.biased_walks(ring, 5, 0.5, 2.0, 2, seed=3)
    steps = [p for tag, p in plans if tag == "walks"]
    assert len(steps) == 4 and w.count() == 82 and walks.invalid_steps(w, ring).count() == 0
    assert all("Aggregate" not in p and "exchange" not in p.lower().replace("broadcastexchange", "").replace("exchange hashpartitioning(at", "") for p in steps)
    assert not any("Generate" in p for p in steps[1:])  # the first has the walks of a node


def test_lists_and_numbered_edges_give_the_same_uniform_walks(spark, customers, monkeypatch):
    want = sorted(map(tuple, rows(walks.uniform_walks(customers, 6, 2, seed=4).select("walk_id", F.concat_ws(",", "walk")))))
    for look in (1, 8):
        monkeypatch.setattr(walks, "LOOK", look)
        assert sorted(map(tuple, rows(walks.uniform_walks(customers, 6, 2, seed=4).select("walk_id", F.concat_ws(",", "walk"))))) == want


@pytest.mark.parametrize("look", [2, 64])
def test_biased_walks_from_and_at_hubs_follow_their_weights(spark, monkeypatch, look):
    """From the hub 0 to 1, there: back to 0, to 2, which the hub knows, or to 9, which it doesn't."""
    monkeypatch.setattr(walks, "LOOK", look)
    edges = [(0, i) for i in range(1, 6)] + [(1, 0), (1, 2), (1, 9)] + [(i, 0) for i in range(2, 6)] + [(9, 1)]
    w = walks.biased_walks(make(spark, edges, 10), 3, p=0.5, q=4.0, walks_per_node=3000, seed=5).where("walk[0] = 0 and walk[1] = 1")
    n = {r.x: r["count"] for r in w.groupBy(F.col("walk")[2].alias("x")).count().collect()}
    assert all(abs(n[x] / sum(n.values()) - v / 3.25) < 0.06 for x, v in {0: 2, 2: 1, 9: 0.25}.items())


def test_two_step_chances_match_all_walks_and_spread_none(spark, monkeypatch):
    rng = random.Random(8)
    near = {i: set() for i in range(30)}
    for a, b in [tuple(rng.sample(range(24), 2)) for _ in range(70)] + [(24, 25), (25, 26), (24, 26), (27, 28)]:
        near[a].add(b)
        near[b].add(a)
    g = make(spark, [(a, b) for a, bs in near.items() for b in bs], 30)
    want = {a: sum(1 / len(bs) / len(near[m]) for m in bs for d in near[m] if d != a and d not in bs) for a, bs in near.items() if bs}
    got = {r.src: r.p for r in queries._two_steps(g).collect()}
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a], abs=1e-12) for a in want)
    assert got[27] == got[25] == 0  # exactly, as attempts are divided by it


def test_a_round_of_one_attempt_neither_joins_nor_sorts_slots(spark, monkeypatch):
    plans, before = [], negatives.written
    monkeypatch.setattr(negatives, "written", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or before(df, tag))
    g = make(spark, [(a, b) for a in range(6) for b in range(6) if a != b and a + b != 9] + [(6, 0), (0, 6)], 8)
    pos = graph.canonical(g.edges).select((F.col("src").cast("long") * 8 + F.col("dst")).alias("pair"), "src", "dst")
    edges = {(a, b) for a, b, *_ in rows(g.edges.select("src", "dst"))}
    for name, how in (("uniform", {"reject_existing": True}), ("uniform_nonedge", {}), ("two_hop", {"by_way": True})):
        plans.clear()
        made = negatives.SAMPLERS[name](g, pos, 2, 3, **how)
        assert "Window" not in next(p for tag, p in plans if tag == "round") and made.count() > 0
    for r in made.collect():
        assert (r.src, r.mid) in edges and (r.mid, r.dst) in edges and (r.src, r.dst) not in edges and r.src != r.dst


def test_pools_and_sampling_stats(spark, customers):
    p = rows(negatives.pools(spark, 50, 3, 40, seed=1))
    assert len(p) == 120 and {r[0] for r in p} == {0, 1, 2} and all(0 <= r[2] < 50 for r in p) and len({r[2] for r in p}) > 30
    pos = graph.canonical(customers.edges).select(F.col("src").cast("long").alias("pair"), "src", "dst").limit(100)
    drawn = negatives.nonedge(customers, pos.withColumn("pair", F.monotonically_increasing_id()), 2, seed=3, tell=True)
    s = negatives.sampling_stats(drawn, 200).first()
    assert (s.found, s.failed) == (200, 0) and s.mean_attempts >= 1 and 0 < s.first_share <= 1
    s = negatives.sampling_stats(drawn, 400).first()  # failures count in the shares
    assert (s.total, s.found, s.failed, s.failed_share) == (400, 200, 200, 0.5) and s.first_share <= 0.5
    none = negatives.sampling_stats(drawn.limit(0), 0).first()
    assert tuple(none) == (0, 0, 0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("first", [1, 16])
def test_rounds_of_attempts_give_the_first_good_one(spark, monkeypatch, first):
    """Nodes 0 to 3 are all linked with each other and 4 with none: an attempt is good if and only if 4 is drawn."""
    g = make(spark, [(a, b) for a in range(4) for b in range(4) if a != b], 5)
    pos = spark.createDataFrame([(i, i % 4, (i + 1) % 4) for i in range(40)], "pair long, src int, dst int")
    monkeypatch.setattr(negatives, "FIRST_ATTEMPTS", first)
    got = negatives.uniform(g, pos, 1, seed=5, reject_existing=True, attempts=6, tell=True).collect()
    every = spark.createDataFrame([(i, side, 1, a) for i in range(40) for side in (0, 1) for a in range(1, 7)], "pair long, side int, slot int, attempt int")
    drawn = {(r.pair, r.side, r.attempt): r.x for r in every.select("pair", "side", "attempt", hashing.draw(5, 5, "pair", "side", "slot", "attempt").alias("x")).collect()}
    assert len(got) == 80 and any(r.attempt is None for r in got) and any((r.attempt or 0) > 3 for r in got)
    for r in got:
        good = [a for a in range(1, 7) if drawn[r.pair, r.side, a] == 4]
        assert r.attempt == (good[0] if good else None)
        assert (r.dst if r.side == 0 else r.src) == (4 if good else drawn[r.pair, r.side, 6])


@pytest.mark.parametrize("first", [1, 24])
def test_repeated_slots_get_the_same_row(spark, monkeypatch, first):
    g = make(spark, [(a, b) for a in range(4) for b in range(4) if a != b], 5)
    pos = spark.createDataFrame([(i // 2, 0, 1) for i in range(40)], "pair long, src int, dst int")
    monkeypatch.setattr(negatives, "FIRST_ATTEMPTS", first)
    got = rows(negatives.nonedge(g, pos, 2, seed=5, tell=True))
    assert len(got) == 80 and len(set(got)) == 40 and all(got.count(x) == 2 for x in got) and any(x[-1] > 1 for x in got)


def test_steps_of_walks_and_attempts_shuffle_no_edges(spark, customers):
    """Where nothing is broadcast, no exchange stands between a join and the bucketed edges."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w = walks.uniform_walks(customers, 4, 2, seed=1)
        assert walks.invalid_steps(w, customers).count() == 0
        w.collect()
        plan = w._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda x: len(re.match(r"[ :]*([+:]- )?", x)[0])
    scans = [i for i, x in enumerate(plan) if "edgeloom_neighbours" in x and "dst" in x]
    assert len(scans) >= 3
    for i in scans:
        at, above = depth(plan[i]), []
        for x in reversed(plan[:i]):
            if depth(x) < at:
                at = depth(x)
                above.append(x)
                if "Join" in x:
                    break
        assert "Join" in above[-1] and not any("Exchange" in x for x in above), above

def test_edge_lists_by_column_name(spark, tmp_path):
    (tmp_path / "e.csv").write_text("w,to,from\n0.5,2,1\n0.7,4,3\n")
    assert rows(csr.from_tsv(spark, str(tmp_path / "e.csv"), "from", "to", ",")) == [(1, 2), (3, 4)] and csr.line_count(spark, str(tmp_path / "e.csv")) == 2
    with pytest.raises(ValueError, match="src"):
        csr.from_tsv(spark, str(tmp_path / "e.csv"), sep=",")
    with pytest.raises(ValueError, match="part"):
        features.part_of(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"), (2, 1), (0, 1))


def test_compute_metrics_by_name(spark):
    d = spark.createDataFrame([(1, 5, 1, 60.0), (1, 6, 0, 50.0), (1, 7, 0, -1.0), (2, 5, 0, 3.0), (2, 6, 1, -3.0)], "src int, dst int, label int, score double")
    get = lambda *a, **k: {r.metric: r.value for r in metrics.compute_metrics(d, *a, **k).collect()}
    got = get(["hits@k", "mrr", "num-sources", "accuracy"], [1, 2])
    assert list(got) == ["hits@1", "hits@2", "mrr", "num_sources", "accuracy"]
    assert got == {"hits@1": 0.5, "hits@2": 1.0, "mrr": 0.75, "num_sources": 2.0, "accuracy": 0.4}
    # scores beyond the sigmoid's range are equal, so the positive ranks first by label
    tied = d.withColumn("score", F.when(F.col("score") == 60, 45.0).otherwise(F.col("score")))
    assert metrics.compute_metrics(tied, ["mrr"]).first().value == 0.75
    assert get(["accuracy", "precision"], threshold=0.0, apply_sigmoid=False) == {"accuracy": 0.4, "precision": pytest.approx(1 / 3)}
    assert list(get(["roc_auc", "roc-auc@k"], [3], by_source=True)) == ["roc_auc@3"] and list(get(["roc_auc"])) == ["roc_auc"]
    assert metrics.compute_metrics(d.where("label = 1"), ["roc_auc"]).count() == 0 and get([]) == {}
    with pytest.raises(ValueError, match="unknown metrics: hit@k"):
        get(["hit@k"])
    with pytest.raises(ValueError, match="src"):
        metrics.compute_metrics(d.drop("src"), ["mrr"])


def test_fit_skipgram_brings_contexts_together(spark):
    pairs = spark.createDataFrame([(a, b) for c in (0, 4) for a in range(c, c + 4) for b in range(c, c + 4) if a != b] * 3, "anchor int, context int")
    first = features.initial_embeddings(spark.range(9).select(F.col("id").cast("int").alias("id")), 4, "uniform", seed=3)
    v = {r.id: np.array(r.embedding) for r in features.fit_skipgram(pairs, 8, first, negatives=2, rounds=12, seed=3).collect()}
    begin = {r.id: np.array(r.embedding) for r in first.collect()}
    assert v.keys() == begin.keys() and (v[8] == begin[8]).all()
    pairs = [(a, b) for a in range(8) for b in range(8) if a != b]
    near = np.mean([v[a] @ v[b] for a, b in pairs if (a < 4) == (b < 4)])
    far = np.mean([v[a] @ v[b] for a, b in pairs if (a < 4) != (b < 4)])
    assert near > far + 0.5


def test_ranking_golden(spark):
    d = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 0, 0.1), (2, 0, 0, 0.8), (2, 1, 1, 0.7)], "src long, dst long, label int, score double")
    m = metrics.ranking_metrics(d, [1, 2]).first()
    assert (m.hits_at_1, m.hits_at_2, m.recall_at_1, m.mrr, m.mrr_at_1, m.mrr_at_2) == (0.5, 1.0, 0.5, 0.75, 0.5, 0.75)
    assert (m.ndcg_at_1, m.roc_auc_at_1, m.roc_auc_at_2, m.num_sources, m.num_sources_with_positives) == (0.5, 0.5, 0.5, 2, 2)
    assert math.isclose(m.ndcg_at_2, (1 + 1 / math.log2(3)) / 2)
    none = metrics.ranking_metrics(d.where("label = 0"), [1]).first()
    assert (none.mrr, none.hits_at_1, none.num_sources, none.num_sources_with_positives) == (0, 0, 2, 0)
    tie = spark.createDataFrame([(1, 5, 0, 0.5), (1, 9, 1, 0.5)], "src long, dst long, label int, score double")
    assert metrics.ranking_metrics(tie, [1]).first().hits_at_1 == 1


def slow_ranking(rows, ks):
    """Source by source: (src, dst, label, score)."""
    sums, n = {}, 0
    for src in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == src), key=lambda r: (-r[3], -r[2], r[1]))
        y = [r[2] for r in ranked]
        if not any(y):
            continue
        n += 1
        first = y.index(1) + 1
        one = {"mrr": 1 / first}
        for k in ks:
            top = ranked[:k]
            pos, neg = [r[3] for r in top if r[2]], [r[3] for r in top if not r[2]]
            auc = 0.0 if not pos else 1.0 if not neg else sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
            gain = sum(1 / math.log2(i + 2) for i, v in enumerate(y[:k]) if v) / sum(1 / math.log2(i + 2) for i in range(min(sum(y), k)))
            one |= {f"hits_at_{k}": float(bool(pos)), f"recall_at_{k}": len(pos) / sum(y), f"ndcg_at_{k}": gain, f"mrr_at_{k}": 1 / first if first <= k else 0.0, f"roc_auc_at_{k}": auc}
        sums = {m: sums.get(m, 0.0) + v for m, v in one.items()}
    return {m: v / n for m, v in sums.items()} | {"num_sources_with_positives": n, "num_sources": len({r[0] for r in rows})}


def test_ranking_with_half_of_all_rows_in_one_source(spark):
    rng = random.Random(12)
    rows = [(0 if i % 2 else rng.randint(1, 40), i, int(rng.random() < 0.08), rng.choice([rng.random(), 0.5, 0.25])) for i in range(3000)]
    d = spark.createDataFrame(rows, "src long, dst long, label int, score double")
    made = metrics.ranking_metrics(d, [1, 10, 50])
    got, want = made.first().asDict(), slow_ranking(rows, [1, 10, 50])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    late = [(s, i, y, x if y else x + 2) for s, i, y, x in rows]  # no positive among the first k
    assert metrics.ranking_metrics(spark.createDataFrame(late, d.schema), [5]).first().mrr == pytest.approx(slow_ranking(late, [5])["mrr"])
    far = metrics.ranking_metrics(d, [5], tie=["dst"]).first().asDict()
    assert far["mrr"] == pytest.approx(np.mean([1 / (1 + next(i for i, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (-r[3], r[1]))) if r[2])) for s in {r[0] for r in rows if r[2]}]))


def test_no_source_is_ranked_whole(spark):
    """Every window by source stands above a limit of its groups or over what such a limit has left."""
    made = []
    before = metrics.written
    try:
        metrics.written = lambda df, tag: made.append((tag, df._jdf.queryExecution().executedPlan().toString())) or before(df, tag)
        metrics.ranking_metrics(spark.createDataFrame([(1, 2, 1, 0.5)], "src long, dst long, label int, score double"), [3]).collect()
    finally:
        metrics.written = before
    plans = dict(made)
    assert "Window" not in plans["sources"] and plans["top"].count("WindowGroupLimit") == 2


def test_global_metrics_match_brute_force(spark):
    rng = random.Random(6)
    data = [(rng.randint(0, 1), rng.choice([rng.random(), 0.5, 0.25])) for _ in range(300)]
    d = spark.createDataFrame(data, "label int, score double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert math.isclose(metrics.roc_auc(d).first()[0], auc)
    ap, seen = 0.0, 0
    for t in sorted({s for _, s in data}, reverse=True):
        tp = sum(s >= t for s in pos)
        ap += (tp - seen) / len(pos) * tp / (tp + sum(s >= t for s in neg))
        seen = tp
    assert math.isclose(metrics.average_precision(d).first()[0], ap)
    assert metrics.roc_auc(d.where("label = 1")).first()[0] is None
    loss = -np.mean([math.log(min(max(s if y else 1 - s, 1e-300), 1)) for y, s in data])
    assert math.isclose(metrics.logloss(d).first()[0], loss)
    t = metrics.threshold_metrics(d, 2.0).first()
    assert (t.precision, t.recall, t.f1) == (0, 0, 0)


def test_subgraphs_golden(spark):
    adjacency = {0: [1, 2], 1: [0, 2], 2: [0, 1, 3], 3: [2]}
    e = make(spark, [(a, b) for a, bs in adjacency.items() for b in bs], 4).edges
    pairs = spark.createDataFrame([(7, 0, 1)], "pair_id long, src int, dst int")
    one = subgraphs.k_hop_nodes(pairs, e, 1)
    assert rows(one) == [(7, 0, 0), (7, 1, 0), (7, 2, 1)]
    both = [subgraphs.induced_pairwise(pairs, one, e), subgraphs.induced_scan(pairs, one, e)]
    assert all(rows(x) == [(7, 0, 2, 1), (7, 1, 2, 1), (7, 2, 0, 1), (7, 2, 1, 1)] for x in both)
    z = lambda nodes, kind: [r[2] for r in rows(subgraphs.labels(pairs, nodes, subgraphs.induced_pairwise(pairs, nodes, e), kind))]
    two = subgraphs.k_hop_nodes(pairs, e, 2)
    assert z(one, "drnl") == [[1], [1], [2]] and z(two, "drnl") == [[1], [1], [2], [5]]
    assert z(two, "hop") == [[0], [0], [1], [2]] and z(two, "zo") == [[1], [1], [0], [0]] and z(two, "degree") == [[1], [1], [3], [1]]
    assert z(two, "de") == [[0, 2], [2, 0], [1, 1], [2, 2]] and z(two, "de+") == [[0, 0], [0, 0], [1, 1], [2, 2]] and z(two, "x") == [[0]] * 4
    assert [r.local_id for r in subgraphs.local_ids(pairs, two).orderBy("node_id").collect()] == [0, 1, 2, 3]


def test_subgraphs_loops_samples_and_unreachable(spark):
    e = make(spark, [(0, 1), (0, 2), (1, 0), (2, 0), (2, 2)], 5).edges
    pairs = spark.createDataFrame([(1, 0, 1), (2, 3, 4)], "pair_id long, src int, dst int")
    nodes = subgraphs.k_hop_nodes(pairs, e, 2)
    assert rows(nodes.where("pair_id = 2")) == [(2, 3, 0), (2, 4, 0)]
    assert not any(u == v for _, u, v, _ in rows(subgraphs.induced_pairwise(pairs, nodes, e)))
    assert (1, 2, 2, 1) in rows(subgraphs.induced_scan(pairs, nodes, e))
    de = subgraphs.labels(pairs, nodes, subgraphs.induced_pairwise(pairs, nodes, e), "de")
    assert rows(de.where("pair_id = 2")) == [(2, 3, [0, 3]), (2, 4, [3, 0])]
    hub = make(spark, [(0, i) for i in range(1, 60)] + [(i, 0) for i in range(1, 60)], 60).edges
    one = spark.createDataFrame([(1, 0, 1)], "pair_id long, src int, dst int")
    assert subgraphs.k_hop_nodes(one, hub, 1, max_per_hop=10).count() == 12
    assert subgraphs.k_hop_nodes(one, hub, 1, ratio=0.5).count() == 2 + 29
    assert 2 < subgraphs.k_hop_nodes(one, hub, 1, max_per_hop=10, oversample=1.5).count() <= 12
    sizes = spark.createDataFrame([(n,) for n in (3, 8, 20, 30, 40)], "n long")
    assert [subgraphs.sort_pool_size(sizes, k).first()[0] for k in (0.6, 0.2, 25, 0)] == [20, 10, 25, 40]


def slow_distances(links, start, shut):
    near = {}
    for u, v in links:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    dist, level = {start: 0}, [start]
    while level:
        level = [v for v in sorted({v for u in level for v in near.get(u, ())} - {shut}) if v not in dist and not dist.update({v: dist[level[0]] + 1})]
    return dist


@pytest.mark.parametrize("slot", [1 << 16, 3])
def test_end_distances_match_a_search_pair_by_pair(spark, monkeypatch, slot):
    """Random subgraphs stored in one direction or the other, with loops, repeated links, hubs and parts out of reach."""
    monkeypatch.setattr(subgraphs, "SLOT_LINKS", slot)
    rng = random.Random(slot)
    ends, links = {}, []
    for p in range(30):
        n = rng.randint(2, 14)
        ends[p] = tuple(rng.sample(range(n), 2))
        links += [(p, *rng.choices(range(n), k=2)) for _ in range(rng.randint(0, 2 * n))] + [(p, 0, i) for i in range(n) if p % 5 == 0]
    pairs = spark.createDataFrame([(p, *e) for p, e in ends.items()], "pair_id long, src int, dst int")
    sub = spark.createDataFrame([(*x, 1) for x in links], "pair_id long, u int, v int, w int")
    for removed in (True, False):
        got = {(r.pair_id, r.node_id): (r.s, r.t) for r in subgraphs.end_distances(pairs, sub, removed).collect()}
        for p, (src, dst) in ends.items():
            mine = [(u, v) for q, u, v in links if q == p and u != v]
            s, t = slow_distances(mine, src, dst if removed else None), slow_distances(mine, dst, src if removed else None)
            if removed:
                s[dst] = t[src] = 0
            assert {i: x for (q, i), x in got.items() if q == p} == {i: (s.get(i), t.get(i)) for i in s.keys() | t.keys()}
    near = {(r.pair_id, r.node_id): (r.s, r.t) for r in subgraphs.end_distances(pairs, sub, False, most=1).collect()}
    assert max(x for st in near.values() for x in st if x is not None) == 1
    assert subgraphs.end_distances(pairs.limit(0), sub, True).count() == 0


def test_labels_of_one_pair_with_a_million_links(spark):
    """Two hubs with 250,000 nodes between them, each linked to both, in both directions: everything is one step from either."""
    n = 250_000
    nodes = spark.range(n + 2).select(F.lit(1).cast("long").alias("pair_id"), F.col("id").cast("int").alias("node_id"), F.lit(1).alias("dist"))
    one = spark.range(2, n + 2).select(F.explode(F.array(*[F.struct(F.lit(h).alias("u"), F.col("id").cast("int").alias("v")) for h in (0, 1)])).alias("x")).select(F.lit(1).cast("long").alias("pair_id"), "x.*")
    sub = one.unionByName(one.select("pair_id", F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("w", F.lit(1))
    pairs = spark.createDataFrame([(1, 0, 1)], "pair_id long, src int, dst int")
    for kind, want in (("drnl", {(1,): 2, (2,): n}), ("de", {(0, 2): 1, (2, 0): 1, (1, 1): n}), ("de+", {(0, 0): 2, (1, 1): n})):
        made = subgraphs.labels(pairs, nodes, sub, kind)
        assert {tuple(r.z): r["count"] for r in made.groupBy("z").count().collect()} == want
        assert "Python" not in made._jdf.queryExecution().toString() and "Pandas" not in made._jdf.queryExecution().toString()


def test_features_and_models(spark, customers):
    v = features.initial_embeddings(customers.nodes(), 8, seed=3)
    values = np.array([r.embedding for r in v.collect()])
    assert values.shape == (customers.num_nodes, 8) and abs(values.std() - 1 / 8) < 0.02
    assert np.abs(np.array([r.embedding for r in features.initial_embeddings(customers.nodes(), 8, "uniform").collect()])).max() <= 8**-0.5
    pair = spark.createDataFrame([(5, 2), (2, 5)], "src int, dst int")
    a, b = features.edge_features(pair, v, "concat").collect()
    assert a.features == b.features and len(a.features) == 16
    with pytest.raises(ValueError):
        features.edge_features(pair, v, "other")
    pos = graph.canonical(customers.edges).select("src", "dst", F.lit(1).alias("label"))
    neg = negatives.nonedge(customers, pos.select((F.col("src") * 1000 + F.col("dst")).cast("long").alias("pair"), "src", "dst"), seed=2).select("src", "dst", F.lit(0).alias("label"))
    model = features.fit_classifier(pos.unionByName(neg), v, "weighted_l2", max_iter=5)
    p = features.classifier_scores(model, pos, v, "weighted_l2").agg(F.min("score"), F.max("score")).first()
    assert 0 <= p[0] <= p[1] <= 1
    x = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "x double").select(vectors.sigmoid(F.col("x")), vectors.minus_log_sigmoid(F.col("x"))).collect()
    assert [round(r[0], 9) for r in x] == [0, 0.5, 1] and [r[1] for r in x] == [1000.0, math.log(2), 0.0]
    table = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 6.0])], "id int, part int, embedding array<float>")
    assert [features.combine(table, how).first().embedding for how in ("first", "mean", "concat")] == [[1, 2], [2, 4], [1, 2, 3, 6]]


def test_early_stopping_and_summaries(spark):
    h = spark.createDataFrame([(0, 0.1), (1, 0.3), (2, None), (3, 0.2), (4, 0.3), (5, 0.9)], "step long, value double")
    got = metrics.early_stopping(h, patience=2).orderBy("step").collect()
    assert [r.improved for r in got] == [True, True, False, False, False, True] and [r.stopped for r in got] == [False] * 4 + [True] * 2
    d = spark.createDataFrame([("1.5",), ("x",), (None,), ("nan",), ("Infinity",), ("2",), ("",)], "v string")
    assert metrics.summary(d, "v").first() == (2, 1.5, 2.0, 1.75)
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "m string, v double")
    assert rows(metrics.over_runs(runs, "m", "v")) == [("a", 2.0, 1.0), ("b", 5.0, 0.0)]


@pytest.mark.parametrize("endian", ["big", "little"])
def test_csr_parts_are_the_files_byte_for_byte(request, spark, customers, tmp_path, endian):
    code = {"big": ">", "little": "<"}[endian]
    e = sorted(map(tuple, customers.edges.collect()))
    want = {"edge_ends.bin": np.array([len(e)], code + "i8").tobytes() + np.array([b for _, b, _ in e], code + "i4").tobytes()}
    want["timestamps.bin"] = np.array([len(e)], code + "i8").tobytes() + np.array([t for _, _, t in e], code + "i4").tobytes()
    want["edge_starts.bin"] = np.searchsorted([a for a, _, _ in e], np.arange(customers.num_nodes)).astype(code + "i8").tobytes()
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # so that there are several tasks
    request.addfinalizer(lambda: spark.conf.unset(setting))
    csr.write_csr(customers, str(tmp_path / "plain"), endian)
    assert {p.name: p.read_bytes() for p in (tmp_path / "plain").iterdir()} == want and [p.name for p in tmp_path.iterdir()] == ["plain"]
    csr.write_parts(customers, f"file://{tmp_path}/parts", endian)
    about = json.loads((tmp_path / "parts/manifest.json").read_text())
    assert len(about["parts"]["edge_ends.bin"]) > 1
    for name, data in want.items():
        head = data[:8] if name != "edge_starts.bin" else b""
        assert head + b"".join((tmp_path / "parts" / file).read_bytes() for _, _, file in about["parts"][name]) == data
    back = csr.read_csr(spark, str(tmp_path / "parts"), endian, nodes_per_task=33)
    assert rows(back.edges) == e and back.num_nodes == customers.num_nodes and csr.counts(spark, str(tmp_path / "parts"), endian) == (customers.num_nodes, len(e))
    for again in (lambda: csr.write_csr(customers, str(tmp_path / "plain"), endian), lambda: csr.write_parts(customers, f"file://{tmp_path}/parts", endian)):
        with pytest.raises(Exception, match="FileExistsError|plain"):
            again()


def test_a_task_that_dies_leaves_nothing(spark, customers, tmp_path):
    broken = graph.Graph(customers.edges.withColumn("dst", F.when(F.col("src") > 100, F.raise_error(F.lit("killed"))).otherwise(F.col("dst")).cast("int")), customers.num_nodes)
    with pytest.raises(Exception, match="killed"):
        csr.write_parts(broken, str(tmp_path / "p"), "big")
    with pytest.raises(Exception, match="killed"):
        csr.write_csr(broken, str(tmp_path / "f"), "big")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()] and not (tmp_path / "f").exists()
    with pytest.raises(FileNotFoundError):
        csr.counts(spark, str(tmp_path / "p"), "big")


def test_a_commit_takes_winners_alone_and_wants_all(tmp_path):
    """Tasks that were run twice, died halfway or didn't come back, by the writer alone."""
    batch = lambda kind, first, values: pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(values), pa.int32()), "pos": list(range(first, first + len(values))), "value": values, "ts": pa.array([None] * len(values), pa.int32())})
    make = lambda name: csr.CsrWriter({"path": str(tmp_path / name), "endian": "little", "nodes": "3", "edges": "5", "timed": "false"})
    w = make("a")
    one = w.write(iter([batch(0, 0, [1, 2]), batch(0, 2, [0])]))
    w.write(iter([batch(0, 0, [1, 2]), batch(0, 2, [0])]))  # a rival of the first, too late
    with pytest.raises(ValueError, match="gaps"):
        w.write(iter([batch(0, 3, [0]), batch(0, 5, [1])]))
    two = w.write(iter([batch(0, 3, [0, 1]), batch(1, 0, [0, 2, 3])]))
    with pytest.raises(OSError, match="overlap or are missing"):
        w.commit([two, None])
    with pytest.raises(OSError, match="not all"):
        w.commit([one])
    assert not (tmp_path / "a/manifest.json").exists() and len(list((tmp_path / "a/parts").iterdir())) >= 4
    w.commit([one, two, None])
    assert len(list((tmp_path / "a/parts").iterdir())) == 3
    f = csr.Folder(str(tmp_path / "a"), "little")
    assert f.read("edge_ends.bin", "i4", 1, 4).tolist() == [2, 0, 0, 1] and f.read("edge_starts.bin", "i8", 0, 3).tolist() == [0, 2, 3]
    with pytest.raises(ValueError, match="little-endian"):
        csr.Folder(str(tmp_path / "a"), "big")
    with pytest.raises(FileExistsError):
        make("a")
    b = make("b")
    b.abort([b.write(iter([batch(0, 0, [1])])), None])
    assert not list((tmp_path / "b").iterdir())


@pytest.mark.parametrize("endian", ["big", "little"])
def test_csr_round_trip(spark, customers, tmp_path, endian):
    g = graph.Graph(customers.edges, customers.num_nodes + 3)  # isolated nodes at the end
    csr.write_csr(g, str(tmp_path / "g"), endian)
    back = csr.read_csr(spark, str(tmp_path / "g"), endian, nodes_per_task=40)
    assert back.num_nodes == g.num_nodes and rows(back.edges) == rows(g.edges) and back.edges.rdd.getNumPartitions() == 4
    assert csr.counts(spark, str(tmp_path / "g"), endian) == (g.num_nodes, g.edges.count())
    bare = graph.Graph(g.edges.withColumn("ts", F.lit(None).cast("int")), g.num_nodes)
    csr.write_csr(bare, str(tmp_path / "b"), endian)
    assert rows(csr.read_csr(spark, str(tmp_path / "b"), endian).edges.select("src", "dst")) == rows(g.edges.select("src", "dst"))
    with pytest.raises(ValueError):
        csr.write_csr(graph.Graph(g.edges.limit(0), 3), str(tmp_path / "e"), endian)
    assert csr.counts(spark, str(tmp_path / "b"), endian) == (g.num_nodes, g.edges.count())
    with open(tmp_path / "b/edge_ends.bin", "ab") as f:
        f.write(b"1234")
    with pytest.raises(ValueError, match="agree"):
        csr.counts(spark, str(tmp_path / "b"), endian)
    starts = np.fromfile(tmp_path / "g/edge_starts.bin", {"big": ">", "little": "<"}[endian] + "i8")
    starts[0] = 1
    starts.tofile(tmp_path / "g/edge_starts.bin")
    with pytest.raises(Exception, match="rise from 0"):
        csr.read_csr(spark, str(tmp_path / "g"), endian).edges.collect()
    csr.to_tsv(g.edges, str(tmp_path / "t"))
    assert rows(csr.from_tsv(spark, str(tmp_path / "t"))) == rows(g.edges.select("src", "dst"))


def linked(spark, n, m, seed):
    """A random symmetric graph of n nodes, stored once in each direction, and its edges as pairs."""
    rng = random.Random(seed)
    some = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(0, i) for i in range(1, n, 2)})
    e = make(spark, some + [(b, a) for a, b in some], n).edges
    return e, spark.createDataFrame([(1000 * a + b, a, b) for a, b in some], "pair_id long, src int, dst int")


@pytest.mark.parametrize("parts", [1, 3, None])
def test_near_pools_are_those_of_whole_subgraphs(spark, monkeypatch, parts):
    """By one broadcast, by several, and by shuffles; some nodes have no vector."""
    e, pairs = linked(spark, 40, 90, 5)
    v = features.initial_embeddings(spark.range(36).select(F.col("id").cast("int").alias("id")), 4, seed=3)
    if parts != 1:
        monkeypatch.setattr(cluster, "BROADCAST_BYTES", 36 * 48 // 3 if parts else 1)
    assert (cluster.lookups(v, "id", "embedding") is None) == (parts is None)
    nodes = subgraphs.k_hop_nodes(pairs, e, 1)
    tidy = lambda d: [(r.pair_id, [round(x, 9) + 0.0 for x in r.pooled]) for r in d.orderBy("pair_id").collect()]
    assert tidy(subgraphs.near_mean_pool(pairs, e, v)) == tidy(subgraphs.mean_pool(nodes, v))
    assert tidy(subgraphs.near_sort_pool(pairs, e, v, 3)) == tidy(subgraphs.sort_pool(nodes, v, 3))
    odd = v.withColumn("embedding", F.when(F.col("id") == 0, F.array(*[F.lit(float("inf")).cast("float")] * 4)).otherwise(F.col("embedding")))
    assert tidy(subgraphs.near_mean_pool(pairs, e, odd)) == tidy(subgraphs.mean_pool(nodes, odd))


@pytest.mark.parametrize("few, kept", [(1 << 13, 64 << 20), (7, 64 << 20), (7, 300)])
def test_sort_pools_shuffle_and_broadcast_no_vectors(request, spark, monkeypatch, few, kept):
    """In one block, in several, and with few vectors in memory: the same pools, ties and missing vectors too, and pairs are shuffled as ids alone."""
    e, pairs = linked(spark, 40, 90, 5)
    v = features.initial_embeddings(spark.range(36).select(F.col("id").cast("int").alias("id")), 4, seed=3)
    v = v.withColumn("embedding", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0), F.col("id"), F.lit(0.5)).cast("array<float>")).otherwise(F.col("embedding")))
    monkeypatch.setattr(blocks, "FEW_NODES", few)
    monkeypatch.setattr(blocks, "KEPT_BYTES", kept)
    got = subgraphs.near_sort_pool(pairs, e, v, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 1 and "embedding" not in plan
    tidy = lambda d: [(r.pair_id, r.pooled) for r in d.orderBy("pair_id").collect()]
    want = tidy(subgraphs.sort_pool(subgraphs.k_hop_nodes(pairs, e, 1), v, 3))
    assert tidy(got) == want and len(want) == pairs.count()
    far = spark.createDataFrame([(1, 37, 38), (2, 39, 0), (3, 100, 101)], "pair_id long, src int, dst int")  # ends without vectors or neighbours
    some = e.where("src not in (37, 38) and dst not in (37, 38)")
    assert tidy(subgraphs.near_sort_pool(far, some, v, 3)) == tidy(subgraphs.sort_pool(subgraphs.k_hop_nodes(far, some, 1), v, 3))
    keyed = v.withColumn("key", F.element_at("embedding", -1)).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 2)))
    assert [[round(x, 2) for x in p] for _, p in tidy(subgraphs.near_sort_pool(pairs, e, keyed, 3))] == [[round(x, 2) for x in p] for _, p in want]
    odd = v.withColumn("embedding", F.when(F.col("id") == 1, F.array(F.lit(None).cast("float"), F.lit(1.0), F.lit(1.0), F.lit(9.0)).cast("array<float>")).otherwise(F.col("embedding")))
    assert tidy(subgraphs.near_sort_pool(pairs, e, odd, 3)) == tidy(subgraphs.sort_pool(subgraphs.k_hop_nodes(pairs, e, 1), odd, 3))


@pytest.mark.parametrize("few, sources, dense, at_once", [(1 << 13, 1 << 11, 0.1, 1 << 21), (7, 5, 0.0, 9), (7, 3, 2.0, 1 << 21)])
def test_ranks_in_the_closure_are_those_of_scored_rows(spark, monkeypatch, few, sources, dense, at_once):
    """In one block and task and in several, multiplied whole and by rows: as many score higher as among all rows of the closure; with a hub, equal
    scores, pairs that are repeated or lack a vector, and sources without a way."""
    e, _ = linked(spark, 60, 90, 5)
    v = features.initial_embeddings(spark.range(56).select(F.col("id").cast("int").alias("id")), 4, seed=3)
    v = v.withColumn("embedding", F.when(F.col("id") % 3 == 0, F.array(F.lit(0.25), F.lit(0.5), F.lit(-1.0), F.lit(0.125)).cast("array<float>")).otherwise(F.col("embedding")))
    asked = [(s, d) for s in range(0, 60, 2) for d in random.Random(s).sample(range(60), 4)] + [(0, 3), (0, 6), (70, 1), (55, 3), (55, 3)]
    pairs = spark.createDataFrame(asked, "src int, dst int")
    some = e.where("src <> 4 and dst <> 4")
    for module, name, value in ((blocks, "FEW_NODES", few), (ranks, "SOURCES", sources), (ranks, "DENSE", dense), (ranks, "AT_ONCE", at_once), (blocks, "SIDE_BY_SIDE", 11)):
        monkeypatch.setattr(module, name, value)
    got = ranks.above_in_closure(pairs, some, v, 60)
    closure = features.dot_scores(graph.two_hop_closure(pairs, some), v).collect()
    want = sorted((r.src, r.dst, r.score, sum(c.src == r.src and c.score > r.score for c in closure)) for r in features.dot_scores(pairs, v).collect())
    assert sorted(map(tuple, got.collect())) == want and len(want) > 90
    if few == 7:
        part, own = blocks.Place("file:///nowhere", few), np.arange(1, 60, 7)  # nodes of other blocks are no nodes of this one
        flat = ranks._reached(np.array([0]), np.array([0, 0]), np.array([8, 9]), np.array([8, 9]), np.array([0, 1]), pa.table({"src": [8, 9, 9], "dst": [1, 8, 15]}), own, part.blocks)
        assert flat.tolist() == [0, 2]
    odd = v.withColumn("embedding", F.when(F.col("id") == 1, F.array(F.lit(float("inf")), F.lit(0.0), F.lit(0.0), F.lit(0.0)).cast("array<float>")).otherwise(F.col("embedding")))
    endless = features.dot_scores(graph.two_hop_closure(pairs, some), odd).collect()
    want = sorted((r.src, r.dst, r.score, sum(c.src == r.src and c.score > r.score for c in endless)) for r in features.dot_scores(pairs, odd).collect())
    assert sorted(map(tuple, ranks.above_in_closure(pairs, some, odd, 60).collect())) == want
    labelled = features.dot_scores(pairs.distinct(), v).withColumn("label", F.lit(1)).unionByName(features.dot_scores(graph.two_hop_closure(pairs, some), v).withColumn("label", F.lit(0)))
    names, tidy = ["recall@k", "mrr", "hits@k", "ndcg@k", "mrr@k"], lambda d: [(r.metric, round(r.value, 12)) for r in d.collect()]
    single = ranks.above_in_closure(pairs.distinct(), some, v, 60)
    assert tidy(metrics.rank_metrics(single, names, [2, 5])) == tidy(metrics.compute_metrics(labelled, names, [2, 5], apply_sigmoid=False))
    with pytest.raises(ValueError):
        metrics.rank_metrics(single, ["roc_auc@k"], [2])


def test_a_classifier_keeps_and_broadcasts_no_features(spark, monkeypatch):
    """Blocks of nodes give the model that Spark's estimator finds, by whatever features, and the scores that joins give; vectors are neither
    broadcast nor shuffled."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(blocks, "FEW_NODES", 7)
    monkeypatch.setattr(blocks, "SIDE_BY_SIDE", 11)
    e, _ = linked(spark, 40, 150, 5)
    v = features.initial_embeddings(spark.range(36).select(F.col("id").cast("int").alias("id")), 3, scale=1.0, seed=3)
    labelled = e.select("src", "dst", F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(3)).cast("boolean").cast("int").alias("label"))
    tests = labelled.select("src", "dst", "label", F.concat("src", F.lit("x")).alias("name"))
    for how, decay in (("hadamard", 0.0), ("concat", 0.3), ("weighted_l1", 0.0)):
        x = features.edge_features(labelled, v, how).select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
        want = LogisticRegression(maxIter=200, regParam=decay, tol=1e-12).fit(x)
        model = features.fit_classifier(labelled, v, how, weight_decay=decay)
        assert np.allclose(model.coefficients, want.coefficients.toArray(), atol=1e-5) and abs(model.intercept - want.intercept) < 1e-5
        got = features.classifier_scores(model, tests, v, how)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("Exchange") == 1 and "embedding" not in plan
        tidy = lambda d: sorted((r.src, r.dst, r.label, r.name, round(r.score, 4)) for r in d.collect())
        with monkeypatch.context() as m:
            m.setattr(blocks, "reachable", lambda *_: False)
            other = features.fit_classifier(labelled, v, how, weight_decay=decay)
            assert np.allclose(model.coefficients, other.coefficients, atol=1e-3)
            assert tidy(features.classifier_scores(model, tests, v, how)) == tidy(got) and got.count() == tests.where("src < 36 and dst < 36").count()
    assert features.fit_classifier(labelled.withColumn("label", F.lit(1)), v) == features.Classifier((0.0, 0.0, 0.0), math.inf)
    split = labelled.join(v.withColumnRenamed("id", "src"), "src").select("src", "dst", (F.least("src", "dst") < 9).cast("int").alias("label"))
    apart = v.withColumn("embedding", F.array(F.when(F.col("id") < 9, -1.0).otherwise(1.0), F.lit(1.0)).cast("array<float>"))
    model = features.fit_classifier(split, apart, "concat", max_iter=8)  # classes that a plane parts, and constant features
    assert {(r.label, r.score > 0.5) for r in features.classifier_scores(model, split, apart, "concat").collect()} == {(0, False), (1, True)}
    with pytest.raises(ValueError, match="no labelled pair"):
        features.fit_classifier(labelled.where("src = 39"), v)


@pytest.mark.parametrize("nodes, links", [(60, 40), (30, 120), (9, 30)])
def test_near_subgraphs_are_those_of_any_hops(spark, nodes, links):
    """Sparse, with a hub, and nearly complete: the same links, labels and batches as from subgraphs that are spread out."""
    e, pairs = linked(spark, nodes, links, nodes)
    whole = subgraphs.k_hop_nodes(pairs, e, 1)
    inside = subgraphs.induced_pairwise(pairs, whole, e).localCheckpoint()
    at = subgraphs.near(pairs, e)
    assert rows(subgraphs.near_induced(at)) == rows(inside)
    for kind in ("degree", "drnl", "de", "de+"):
        assert rows(subgraphs.near_labels(at, kind)) == rows(subgraphs.labels(pairs, whole, inside, kind)), kind
    old = subgraphs.batched(pairs, whole, inside, 7, subgraphs.labels(pairs, whole, inside, "degree"))
    new = subgraphs.near_batched(pairs, e, 7)
    tidy = lambda d: sorted(map(repr, (r.asDict() for r in d.select(*sorted(d.columns)).collect())))
    for part in ("graphs", "nodes", "edges"):
        assert tidy(getattr(new, part)) == tidy(getattr(old, part)), part


def test_near_subgraphs_try_no_two_neighbours(spark):
    """A ring of 400 with a hub in its middle, which would make 80,000 wedges for each of its pairs: the inner links are
    those that there are, and triangles as many as the ring's links."""
    n = 400
    some = sorted({(0, i) for i in range(1, n + 1)} | {tuple(sorted((i, i % n + 1))) for i in range(1, n + 1)})
    e = make(spark, some + [(b, a) for a, b in some], n + 1).edges
    at = subgraphs.near(spark.createDataFrame([(1000 * a + b, a, b) for a, b in some], "pair_id long, src int, dst int"), e)
    assert at.inner.count() == n * n  # n - 2 for each pair of the hub, two for each of the ring
    assert subgraphs.triangles(e).count() == n


def test_vectors_of_pairs_are_looked_up_where_pairs_lie(request, spark, monkeypatch):
    """By one broadcast, by several and by shuffles, with the same scores; only the latter shuffle vectors."""
    e, _ = linked(spark, 40, 90, 5)
    v = features.initial_embeddings(spark.range(36).select(F.col("id").cast("int").alias("id")), 4, seed=3)
    fake = e.select(F.col("src").alias("anchor"), F.pmod(F.col("dst") + 1, F.lit(36)).cast("int").alias("context"))
    want, least = None, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(least)
    spark.conf.set(least, "-1")
    request.addfinalizer(lambda: spark.conf.set(least, before))
    for size in (cluster.BROADCAST_BYTES, 36 * 48 // 3, 1):
        monkeypatch.setattr(cluster, "BROADCAST_BYTES", size)
        scored = features.dot_scores(e.select("src", "dst"), v)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange hashpartitioning" in plan) == (size == 1)
        loss = walks.skipgram_loss(e.select(F.col("src").alias("anchor"), F.col("dst").alias("context")), fake, v, 40).first().loss
        got = (rows(scored), round(loss, 12))
        assert want in (None, got)
        want = got


def test_strange_rows_of_sampled_subgraphs_are_told(spark):
    """What an anti-join with whole subgraphs leaves; rows that are made up are among it, drawn ones aren't."""
    e, pairs = linked(spark, 30, 40, 2)
    whole = subgraphs.k_hop_nodes(pairs, e, 1)
    for kept in ({"max_per_hop": 3}, {"ratio": 0.5}, {"max_per_hop": 3, "oversample": 1.5}):
        assert queries._strange(subgraphs.k_hop_nodes(pairs, e, 1, seed=7, **kept), pairs, e).count() == 0
    made = pairs.select("pair_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("node_id")).withColumn("dist", F.explode(F.array(F.lit(0), F.lit(1))))
    assert rows(queries._strange(made, pairs, e)) == rows(made.join(whole, ["pair_id", "node_id", "dist"], "left_anti").select("pair_id", "node_id"))
