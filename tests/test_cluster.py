from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from edgeloom import cluster


def fake(master, **conf):
    """A session as shared_dir sees it."""
    sc = SimpleNamespace(master=master, getConf=lambda: conf)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: default))


def test_only_one_machine_may_go_without_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            cluster.shared_dir(fake(master))
    assert cluster.shared_dir(fake("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    own = fake("local[2]")
    assert cluster.shared_dir(own) == cluster.shared_dir(own) != cluster.shared_dir(fake("local"))


def test_written_tables_can_be_discarded(spark):
    t = cluster.written(spark.range(10), "numbers")
    assert t.count() == 10 and t._edgeloom_path.startswith(cluster.shared_dir(spark))
    path = t._edgeloom_path
    cluster.discard(t, spark.range(3))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_sizes_decide_on_broadcasts(spark):
    d = spark.range(10).select("id", F.lit("x" * 10).alias("s"))
    assert cluster.small(d, F.length("s"), 100) and not cluster.small(d, F.length("s"), 99) and cluster.small(d.limit(0), F.length("s"), 0)
    assert "broadcast" in cluster.broadcast_checked(d, 10)._jdf.queryExecution().toString() and "broadcast" not in cluster.broadcast_checked(d, 9)._jdf.queryExecution().toString()


def test_a_batch_size_of_ones_own_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    cluster.ship(spark)
    assert spark.conf.get(key) == "10000"
    spark.conf.set(key, before)
