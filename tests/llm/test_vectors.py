"""Hard negatives, vector codes and near-duplicate vectors against brute force."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import codebooks, hard_negatives, lattice

VECTORS = "vec_id long, embedding array<double>, label int"
ODD = [None, [], [float("nan")] * 8, [None, *[1.0] * 7], [float("inf")] + [0.0] * 7]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# hard negatives


def slow_negatives(rows, anchors, positives=5, negatives=10):
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    out = []
    for a, lab, v in {(i, lab, tuple(v)) for i, lab, v in whole if anchors(i)}:
        score = [(sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in whole if i != a and len(w) == len(v)]
        best = sorted((-s, i) for s, i, other in score if other == lab)[:positives]
        for p, i in best:
            inside = sorted((-s, j) for s, j, other in score if other != lab and 30 * -p <= 100 * s <= 90 * -p)[:negatives]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(inside)]
    return sorted(out)


def random_vectors(n, dim, seed, labels=6, shared=0.5):
    """A third of the rows have one label; many pairs are equal or close, and components are coarse, so that scores tie."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, dim))
    v = np.round((shared * base[rng.integers(0, len(base), n)] + (1 - shared) * rng.normal(size=(n, dim))) * rng.choice([0.5, 1, 1, 2], n)[:, None], 1)
    return [(i, int(0 if rng.random() < 1 / 3 else rng.integers(0, labels)), v[i].tolist()) for i in range(n)]


def mined(d, anchors, **how):
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.whole_numbers(d, "vec_id", "embedding", "label"), anchors, **how).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_match_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, of one label and of several, and blocks of anchors
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
        monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 9)
    rows = random_vectors(400, 8, 3)
    d = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], VECTORS)
    assert mined(d, F.col("id") % 10 == 0) == slow_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    rows = random_vectors(90, 8, 5, labels=3)
    rows += [(10, 1, rows[10][2]), rows[20], rows[21], (500, 2, [0.0] * 8), (501, 0, [-0.1] * 8), (510, 1, [1.0, 2.0]), (511, 1, [2.0, 2.0]), (512, 0, [1.0, 1.5]), (520, 77, rows[5][2])]
    odd = [(900 + i, v, 1) for i, v in enumerate(ODD)] + [(910, rows[0][2], None), (None, rows[0][2], 1)]
    clash = {c: F.lit("clash") for c in ("id", "dim", "x", "block", "own", "drawn", "ask", "window", "score", "order", "anchor", "rank")}
    d = spark.createDataFrame([(i, v, lab) for i, lab, v in rows] + odd, VECTORS).withColumns(clash)
    want = slow_negatives(rows, lambda i: i % 10 == 0)
    assert mined(d, F.col("id") % 10 == 0) == want and any(r[0] == 510 for r in want)
    assert mined(d.limit(0), F.col("id") % 10 == 0) == [] and mined(d, F.col("id") < 0) == []
    assert mined(d.where("label = 1"), F.col("id") % 10 == 0) == []  # no other label
    text = d.where("label is not null").withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    assert mined(text, F.col("id") % 10 == 0) == want
    few = slow_negatives(rows, lambda i: i % 10 == 0, 2, 3)
    assert mined(d, F.col("id") % 10 == 0, positives=2, negatives=3) == few


def test_hard_negatives_of_the_largest_components(spark):
    d = spark.createDataFrame([(i, [x * 1e300, 1.0], i % 2) for i, x in ((0, 1.0), (1, 1.0), (2, 1.0), (3, -1.0))], VECTORS)
    assert mined(d, F.col("id") == 0) == []  # equal scores lie above the window
    with pytest.raises(ValueError):
        mined(d, F.col("id") == 0, least=40, most=30)


def test_candidates_lose_nothing_and_prune():
    rng = np.random.default_rng(2)
    energy = np.sort(rng.gamma(0.5, size=48))[::-1] ** 2  # most of it in a few dimensions
    x, y = np.rint(rng.normal(size=(600, 48)) * energy * 200), np.rint(rng.normal(size=(30, 48)) * energy * 200)
    score = x @ y.T
    least = np.sort(score, axis=0)[-6]
    i, j = hard_negatives.candidates(x, y, least, lambda order: None)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(found) == len(i) and found >= set(zip(*map(np.ndarray.tolist, np.nonzero(score >= least)), strict=True)) and len(found) < 0.1 * score.size
    norm = np.sqrt(np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]).max(axis=0)
    assert hard_negatives.indexed(x, float(least.min()), norm).mean() < 40 and (hard_negatives.indexed(x, float(score.max()), norm) == 0).any()
    assert (hard_negatives.exact(x.astype(int), y.astype(int), i, j) == score[i, j]).all()


# vector codes


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """Plain whole numbers, every distance."""
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    width = -(-len(whole[0][2]) // parts)
    cut = lambda v: [tuple((v + [0] * width)[k * width : (k + 1) * width]) for k in range(parts)]
    seeds = {}
    for i, _, v in sorted((r for r in whole if r[0] is not None), key=lambda r: (r[0], r[2])):
        seeds.setdefault(i, cut(v + [0] * (width * parts - len(v))))
    books = [[s[p] for s in list(seeds.values())[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    cuts = [cut(v + [0] * (width * parts - len(v))) for _, _, v in whole]
    for n in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda k, p=p, c=c: (away(c[p], books[p][k]), k)) for p in range(parts)] for c in cuts]
        if n < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [c[p] for c, code in zip(cuts, codes, strict=True) if code[p] == k]
                    if mine:
                        books[p][k] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    error = [sum(away(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cuts, codes, strict=True)]
    total = defaultdict(int)
    for (_, lab, _), e in zip(whole, error, strict=True):
        total[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in code), e, total[lab], digest) for (i, lab, _), code, e in zip(whole, codes, error, strict=True)), key=repr)


def coded(d, **how):
    return rows_of(codebooks.code_strings(*codebooks.compress(d, **how)))


def test_codes_match_brute_force(spark):
    rows = random_vectors(300, 32, 7, shared=0.8)
    d = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], VECTORS).repartition(5)
    assert coded(d) == slow_codes(rows)
    assert coded(d, parts=3, entries=7, rounds=4) == slow_codes(rows, 3, 7, 4)  # 32 is no multiple of 3
    assert coded(d, entries=1, rounds=0) == slow_codes(rows, entries=1, rounds=0)


def test_codes_of_odd_rows(spark):
    rows = random_vectors(40, 8, 9)
    rows += [(3, None, [9.0] * 8), (3, None, rows[3][2]), (4, 2, rows[4][2]), (None, 1, rows[7][2]), (50, None, [0.0] * 8)]
    clash = {c: F.lit("clash") for c in ("id", "x", "codes", "error", "part", "entry", "n", "far", "sums", "dim", "of", "code")}
    d = spark.createDataFrame([(i, v, lab) for i, lab, v in rows] + [(900 + i, v, 1) for i, v in enumerate(ODD) if v != []] + [(950, [1.0], 1)], VECTORS).withColumns(clash)
    assert coded(d, parts=4) == slow_codes(rows, 4)
    assert coded(d, parts=4, entries=10) == slow_codes(rows, 4, 10)
    assert coded(d.limit(0)) == [] and coded(d.where("embedding is null")) == []
    huge = spark.createDataFrame([(i, [x * 1e300, -x * 3e38, 1.0, 0.0], None) for i, x in enumerate((1.0, -1.0, 1.0))], VECTORS)
    got = coded(huge, parts=2)
    assert [r[1] for r in got] == ["0000", "0100", "0000"] and all(r[2] == 0 for r in got)
    with pytest.raises(ValueError):
        codebooks.compress(d, entries=0)


def test_reconstruction_is_as_near_as_the_error_says(spark):
    rows = [(i, lab, [math.floor(256 * x) / 256 for x in v]) for i, lab, v in random_vectors(200, 16, 4)]
    d = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], VECTORS)
    codes, books = codebooks.compress(d, parts=4)
    made = {r.vec_id: r.embedding for r in codebooks.reconstruct(codes, books).collect()}
    error = {r.vec_id: r.error for r in codes.collect()}
    for i, _, v in rows:
        assert round(sum((x - y) ** 2 for x, y in zip(v, made[i], strict=True)) * 65536) == error[i]


@pytest.mark.parametrize("width", [1, 4])
def test_balls_give_what_all_distances_give(width):
    rng = np.random.default_rng(width)
    centres = rng.integers(-300, 300, (64, width))
    centres[7] = centres[3]  # a tie
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-40, 41, (5000, width))
    was = codebooks.nearest(x, centres)
    moved = centres + rng.integers(-9, 10, centres.shape)
    moved[9] = moved[5]
    radius = np.array([math.isqrt(int(codebooks.squared(x[was == k], moved[k]).max(initial=0))) + 1 for k in range(64)])
    got, compared = codebooks.reassign(x, moved, was, *codebooks.balls(moved, radius))
    assert (got == codebooks.nearest(x, moved)).all() and (got != was).any()
    assert compared < 0.5 * 64 * len(x)


# near-duplicate vectors


def slow_links(rows, cosine=0.93):
    """All pairs of rows; (id, n_links, component, kept)."""
    ok = [lab is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, lab, v in rows]
    unit = [np.array(v) / np.abs(v).max() if o else None for (_, _, v), o in zip(rows, ok, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[b for b in range(len(rows)) if a != b and ok[a] and ok[b] and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]) and unit[a] @ unit[b] >= cosine] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(near[a]), least, rows[a][0] is not None and rows[a][0] == least))
    return sorted(out, key=repr)


def planted(rng, n, dim, groups, spread):
    """Groups around one vector each; the first has a third of all rows, and a third of these are copies."""
    base = rng.normal(size=(groups, dim))
    g = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))
    v = base[g] + rng.normal(size=(n, dim)) * spread
    same = np.flatnonzero(g == 0)
    v[same[: len(same) // 3]] = v[same[0]]
    return [(i, int(g[i] % 3), (v[i] * rng.uniform(0.2, 5)).round(4).tolist()) for i in range(n)]


@pytest.mark.parametrize("tile", [512, 16])
def test_near_vectors_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(lattice, "TILE", tile)
    rows = planted(np.random.default_rng(1), 500, 32, 60, 0.15)
    d = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], VECTORS)
    want = slow_links(rows)
    assert rows_of(lattice.near_duplicates(d)) == want and sum(r[1] for r in want) > 20_000


def test_near_vectors_of_odd_rows(spark):
    rows = planted(np.random.default_rng(2), 60, 8, 10, 0.1)
    rows += [(i, 1, v) for i, v in enumerate(ODD, 900)] + [(910, 1, [0.0] * 8), (911, None, rows[0][2]), (None, 0, rows[0][2]), (3, rows[3][1], rows[3][2]), (4, 2, rows[5][2]), (912, 1, [1.0, 2.0]), (913, 1, [2.0, 4.0])]
    rows += [(920, 2, [1e300, 1e300] + [0.0] * 6), (921, 2, [1e-300, 1e-300] + [0.0] * 6), (None, 77, [1.0] * 8)]
    clash = {c: F.lit("clash") for c in ("id", "vec", "ok", "node", "n", "first", "lab", "hashed", "dim", "cells", "cell", "links", "least", "component", "component_id", "kept")}
    d = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], VECTORS).withColumns(clash)
    assert rows_of(lattice.near_duplicates(d)) == slow_links(rows)
    assert lattice.near_duplicates(d.limit(0)).count() == 0
    assert rows_of(lattice.near_duplicates(d, cosine=0.99)) == slow_links(rows, 0.99)
    with pytest.raises(ValueError):
        lattice.near_duplicates(d, cosine=0.0)


@pytest.mark.parametrize("cosine", [0.93, 0.8])
def test_pairs_at_the_threshold_are_found(spark, cosine):
    """Pairs just above the cosine, the hardest there are, in 64 dimensions."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = cosine + 1e-6
    rows = [(2 * i + k, x.tolist(), 1) for i in range(3000) for k, x in enumerate((a[i], c * a[i] + math.sqrt(1 - c * c) * b[i]))]
    found = lattice.near_duplicates(spark.createDataFrame(rows, VECTORS), cosine=cosine).where("n_links > 0").count()
    assert found >= 0.99 * 6000


def test_decoding_gives_the_nearest_point():
    x = np.random.default_rng(3).normal(size=(2000, 8)) * 2
    p = lattice.decode(x)
    own = ((x - p) ** 2).sum(axis=1)
    assert own.max() <= 1 and len(lattice.shortest()) == 240 and ((lattice.shortest() ** 2).sum(axis=1) == 2).all()
    assert all((((x - p - s) ** 2).sum(axis=1) >= own - 1e-12).all() for s in lattice.shortest())
    doubled = 2 * p
    assert (doubled == doubled.round()).all() and ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
