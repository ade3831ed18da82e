"""The pipeline's stages, each held against brute force on its own input, and on odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.cluster import written
from edgeloom.llm import queries
from edgeloom.llm.tokenizing import WordIds
from tests.conftest import SF
from tests.llm.test_documents import ODD, check_sequences, slow_contamination, slow_line_dedup
from tests.llm.test_near_dedup import slow_groups


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    words = [f"w{i * i % 997}" for i in range(80)]
    near = [(10**6 + 10 + i, " ".join([*words[: 20 * i], f"new{i}", *words[20 * i + 1 :]]), "en", "s", 1) for i in range(4)]
    more = [*near, (10**6, None, None, "s", 0), (10**6 + 1, "... 123 !", "en", "s", 9), (10**6 + 2, passage, "en", "s", 1), (10**6 + 3, passage + " x", "en", "s", 1)]
    out = [written(docs.unionByName(spark.createDataFrame(more, docs.schema)), "input")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(steps):
    assert all(x.columns == steps[0].columns for x in steps[1:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_language_stage(steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert after == {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}


def test_line_stage(steps):
    before, after = texts(steps[1]), texts(steps[2])
    assert after == dict(slow_line_dedup(list(before.items()))) and any(before[i] != after[i] for i in before)


def test_near_stage(steps):
    before, after = texts(steps[2]), texts(steps[3])
    parts = slow_groups(before)
    assert after == {i: t for i, t in before.items() if parts[i] == i} and len(after) < len(before)
    assert 10**6 + 10 in after and not {10**6 + 11, 10**6 + 12, 10**6 + 13} & after.keys()


def test_contamination_stage(spark, steps):
    before, after = texts(steps[3]), texts(steps[4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert after == {i: t for i, t in before.items() if not slow_contamination(t, items)[3]} and len(after) < len(before)


def test_packing_stage(steps):
    ids = WordIds(queries.vocabulary("word_bpe_49k.json"))
    pieces = steps[5].collect()
    size = {}
    for p in pieces:
        size[p.doc_id] = size.get(p.doc_id, 0) + p.length
    assert size == {i: len(ids.whole(t or "")) // 4 + 1 for i, t in texts(steps[4]).items()}
    check_sequences([(p.sequence_id, p.offset, p.length) for p in pieces], 2048)


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 0


def test_odd_rows(spark):
    rows = [(i, t, None, None, None, i) for i, t in enumerate(ODD)] + [(None, "a row without an id, in plain words", "en", "s", 1, 0), (3, ODD[3], None, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    known = docs.withColumn("lang", F.when(F.col("doc_id") > 4, F.lit("xx")))
    for some, n in ((docs, 14), (known, 14), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            some = written(stage(spark, some, SF), name)
        assert some.select("doc_id").distinct().count() == n
