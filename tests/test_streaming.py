import random

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import metrics
from edgeloom.streaming import online, sinks
from tests.conftest import SF


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_online_summary_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(online.online_summary(stream, "value", "event_type"), "summary", "complete")
    got = {r.event_type: r for r in spark.table("summary").collect()}
    for r in online.online_summary(events, "value", "event_type").collect():
        assert got[r.event_type]["count"] == r["count"] and got[r.event_type]["max"] == r["max"] and got[r.event_type]["mean"] == pytest.approx(r["mean"])


def test_windows_and_hits(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run(online.windowed_summary(stream, "value", "event_type"), "windowed", "append")
    assert 0 < spark.table("windowed").agg(F.sum("count")).first()[0] <= events.count()
    batches = [[(1, 1, 0.9), (1, 0, 0.1), (2, 0, 0.8), (2, 1, 0.7)], [(1, 0, 0.95), (3, 1, 0.2), (3, None, 0.9)], [(2, 1, 0.85), (3, 0, 0.1)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "src long, label int, score double").coalesce(1).write.parquet(str(tmp_path / f"s/{i}"))
    stream = spark.readStream.schema("src long, label int, score double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "s"))
    run(online.online_hits(stream, 1), "hits", "update")
    hits = [(r.src, r.hit) for r in spark.table("hits").collect()]
    assert len(hits) == 6 and dict(hits) == {1: 0.0, 2: 1.0, 3: 1.0} and (1, 1.0) in hits and (2, 0.0) in hits


ROWS = "src long, label int, score double, ended boolean"


def streamed(spark, path, batches, ks, **how):
    """The metrics of sources after batches of (src, label, score, ended), each a file and a batch."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, ROWS).coalesce(1).write.parquet(f"{path}/in/{i}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    found = online.online_source_metrics(stream, ks, **how)
    sinks.follow(found, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return sinks.written_batches(spark, f"{path}/out", ", ".join(f"{c} {t}" for c, t in found.dtypes))


@pytest.mark.parametrize("positives_first", [True, False])
def test_source_metrics_of_a_stream_equal_the_batch(spark, tmp_path, positives_first):
    rng = random.Random(4)
    rows = [(s, int(rng.random() < 0.2), rng.choice([rng.random(), 0.5])) for s in range(20) for _ in range(rng.randint(1, 60) if s else 600)]
    ordered = sorted(rows, key=lambda r: -r[1]) if positives_first else rng.sample(rows, len(rows))
    cut = sum(r[1] for r in rows) if positives_first else len(rows) // 3
    parts = [ordered[:cut], ordered[cut : cut + 400], ordered[cut + 400 :]]
    batches = [[(*r, False) for r in p] for p in parts] + [[(s, None, None, True) for s in range(10)], [(s, None, None, True) for s in range(10, 22)]]
    got = streamed(spark, tmp_path, batches, [1, 5, 20], positives_first=positives_first)
    assert sorted(r.src for r in got.select("src").collect()) == list(range(22))  # each once, ends without rows too
    d = spark.createDataFrame([(s, i, y, x) for i, (s, y, x) in enumerate(rows)], "src long, dst long, label int, score double")
    want = metrics.ranking_metrics(d, [1, 5, 20]).first().asDict() | {"num_sources": 22}
    have = metrics.source_averages(got, [1, 5, 20]).first().asDict()
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("late, message", [([(1, 0, 0.3, False)], "after its end"), ([(2, 1, 0.9, False)], "better positive")])
def test_rows_that_come_too_late_are_an_error(spark, tmp_path, late, message):
    with pytest.raises(Exception, match=message):
        streamed(spark, tmp_path, [[(1, 1, 0.5, False), (1, 0, 0.7, True), (2, 1, 0.1, False), (2, 0, 0.5, False)], late], [1])


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    write = sinks.write_once(str(tmp_path / "out"))
    rows = spark.range(5).select(F.col("id").alias("x"))
    write(rows, 0)
    write(rows.selectExpr("x + 5 as x"), 1)
    write(rows.selectExpr("x + 5 as x"), 1)  # replayed after it was written
    (tmp_path / "out/batch=2").mkdir()
    (tmp_path / "out/batch=2/part-cut-off.parquet").write_bytes(b"nothing whole")
    write(rows.selectExpr("x + 10 as x"), 2)  # cut off before
    got = sinks.written_batches(spark, str(tmp_path / "out"), "x long")
    assert sorted((r.batch, r.x) for r in got.collect()) == [(i // 5, i) for i in range(15)]


def test_a_stream_that_forgot_its_last_batch_writes_it_once(spark, tmp_path):
    """A query that ended between writing a batch and noting that down replays it."""
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "in"))
    start = lambda: sinks.follow(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    start()
    for f in (tmp_path / "checkpoint/commits").glob("*2*"):
        f.unlink()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*")}
    start()
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("part-*")} == before
    assert sorted(r.id for r in sinks.written_batches(spark, str(tmp_path / "out"), "id long").collect()) == list(range(30))


def test_sources_share_groups(spark, tmp_path):
    """A call for a group costs more than a few rows do: successive ids lie in one group, and each is closed for itself."""
    batches = [[(i, 1, 2.0, False) for i in range(100)], [(i, 0, float(i % 4), False) for i in range(100)], [(i, None, None, True) for i in range(0, 100, 2)], [(i, None, None, True) for i in range(1, 100, 2)]]
    for n, b in enumerate(batches):
        spark.createDataFrame(b, "src long, label int, score double, ended boolean").coalesce(1).write.parquet(str(tmp_path / f"s/{n}"))
    stream = spark.readStream.schema("src long, label int, score double, ended boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "s"))
    q = online.online_source_metrics(stream, [1]).writeStream.outputMode("append").format("memory").queryName("shared").start()
    q.processAllAvailable()
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    q.stop()
    got = {r.src: (r.n_pos, r.mrr) for r in spark.table("shared").collect()}
    assert got == {i: (1, 0.5 if i % 4 == 3 else 1.0) for i in range(100)} and max(held) == 4
