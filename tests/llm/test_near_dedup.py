"""Near-duplicates by similarity, against comparing every two documents."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import near_dedup
from tests.llm.test_documents import ODD


def slow_set(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def slow_groups(texts, least=0.8):
    """{key: smallest key of its group}, from {key: text}."""
    sets = {k: slow_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both and both >= least * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def families(seed, bases=12, copies=12):
    """Bases and copies with a few words changed, around the similarity and on both sides of it."""
    rng = random.Random(seed)
    texts = []
    for b in range(bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 30, 120, 400]))]
        texts += [" ".join(words)] + [edited(rng, words, rng.randint(0, max(1, len(words) // 25))) for _ in range(copies)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def kept(spark, texts):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, node string, t int")
    out = near_dedup.drop_near_duplicates(d)
    assert out.columns == d.columns
    return {r.doc_id: r.text for r in out.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_groups_match_brute_force(spark, seed):
    texts = families(seed)
    groups = slow_groups(texts)
    assert len(set(groups.values())) < len(texts) * 0.8
    assert kept(spark, texts) == {i: t for i, t in texts.items() if groups[i] == i}


def test_large_group_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 32)
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(100)]
    # the copies are near the base alone, which has not the smallest id
    texts = {i: edited(rng, words, 2) for i in range(150)} | {150: " ".join(words)} | {i: edited(rng, words, 6) for i in range(151, 180)}
    groups = slow_groups(texts)
    assert sum(g == 0 for g in groups.values()) >= 151
    assert kept(spark, texts) == {i: t for i, t in texts.items() if groups[i] == i}


def test_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "x"), (None, "no id at all", "x"), (None, "no id at all", "x"), (5, "another text of the same id, with more words", "x"), (100, "TWO   words", "x"), (101, "long " * 300_000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, component string")
    out = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(d).collect()), key=repr)
    alone = [(i, t) for i, t in enumerate(ODD) if i not in (1, 2)]  # null and empty texts are alike, the first stays
    want = [*alone, (None, "no id at all"), (None, "no id at all"), (5, rows[-3][1]), (101, rows[-1][1])]
    assert out == sorted(want, key=repr)
    assert near_dedup.drop_near_duplicates(d.limit(0)).count() == 0


def test_fingerprints_and_signatures_tell_similarity():
    rng = np.random.default_rng(3)
    apart, agree = [], []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = np.unique(x[:500]), np.unique(np.concatenate([x[:444], x[500:556]]))  # 444 of 556 in common
        apart.append(int(np.bitwise_count(near_dedup.fingerprint(a) ^ near_dedup.fingerprint(b)).sum()))
        agree.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
    assert 30 < np.mean(apart) < 48 and np.mean(np.array(apart) <= near_dedup.RADIUS) > 0.99
    assert 0.77 < np.mean(agree) < 0.83 and np.mean(np.array(agree) >= near_dedup.AGREE) > 0.99


def test_planted_near_copies_in_the_table(spark):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = slow_groups(texts)
    got = {r.doc_id for r in near_dedup.drop_near_duplicates(docs).select("doc_id").collect()}
    assert got == {i for i, g in groups.items() if g == i} and len(got) < len(texts)
    assert near_dedup.drop_near_duplicates(docs.withColumn("text", F.lit(None).cast("string"))).count() == 1


def test_short_texts_at_the_similarity_are_found(spark):
    """Pairs of a text and the same with words added at its end, as similar as they have to be and no more, by length."""
    rng = random.Random(6)
    rows, at = [], {}
    for n in (4, 8, 12, 20, 28, 40, 80):  # shingles of the shorter one; the longer one has a quarter more
        for _ in range(150):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4 + n // 4)]
            at[len(rows)] = n
            rows += [(len(rows), " ".join(words[: n + 4])), (len(rows) + 1, " ".join(words))]
    out = {r.doc_id for r in near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = {n: sum(i + 1 in out for i, m in at.items() if m == n) for n in sorted(set(at.values()))}
    assert all(i in out for i in at) and all(x <= 3 for x in lost.values()), lost
