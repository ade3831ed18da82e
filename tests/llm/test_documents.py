"""Operators on documents against brute force, on the small tables and on cases planted by hand."""

import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edgeloom.llm import decontaminate, langid, line_dedup, packing, queries, simhash, token_counts
from edgeloom.llm.tokenizing import WordIds
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "...", "word", "Two words", "x" * 5000, "é" * 300, "a b c\nd e f", "I'm we'll  they've \n\n\n tabs\t\there ", "<|endoftext|> and <|startoftext|> x", "日本語 テキスト", "ΟΔΟΣ Σ", "a\x1cb\x85c\xa0d", "é Å", "🙂 ok 🙂", "MiXeD Case 123 4,567.89 -- #@!"]


MULTILINGUAL = "Hi — “quoted” naïve's 日本語 テキスト  ΟΔΟΣ 🙂 ok\n\n Привет,\u00a0мир! ٣٤ ½ áb  ----  हिन्दी\u200d x"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    rows = [(i, t, None, "src", 0, "clash", -1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, *rows[3:6]], DOCS + ", fingerprint string, component_id int")


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=2):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash_matches_brute_force(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    parts = slow_components(fps)
    assert got == {i: (f"{fps[i]:016x}", parts[i]) for i in fps}
    assert len(set(parts.values())) < len(parts)


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD) + 3
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {0, 1, 2} and {r.component_id for r in zero} == {0}
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0
    for radius in (-1, simhash.MOST_RADIUS + 1):
        with pytest.raises(ValueError, match="radius"):
            simhash.near_duplicates(odd(spark), radius=radius)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_near_pairs(radius):
    rng = random.Random(radius)
    sizes = [1, 2, 63, 64, 65, 130]
    fps = []
    for n in sizes:
        base = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
        for _ in range(n):
            x = rng.choice(base)
            for b in rng.sample(range(64), rng.randint(0, 1 + radius)):
                x ^= 1 << b
            fps.append(x)
    i, j = simhash.near_pairs(np.array(fps, np.uint64), np.array(sizes), radius)
    at = 0
    want = set()
    for n in sizes:
        want |= {(a, b) for a, b in itertools.combinations(range(at, at + n), 2) if (fps[a] ^ fps[b]).bit_count() <= radius}
        at += n
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_near_pairs_of_wide_fingerprints():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 64, (200, 4), np.uint64)
    for k in range(100, 200):
        flip = np.zeros(256, np.uint8)
        flip[rng.choice(256, rng.integers(0, 90), replace=False)] = 1
        fps[k] = fps[k - 100] ^ np.packbits(flip).view(np.uint64)
    i, j = simhash.near_pairs(fps, np.array([200]), 56)
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    want = {(a, b) for a, b in itertools.combinations(range(200), 2) if apart[a, b] <= 56}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) > 40


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_near_links_of_other_radii(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(63) for _ in range(20)]
    fps = sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, radius + 2))) for _ in range(150)})
    unique = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    parts = {r.node: r.component for r in simhash.connected_components(simhash.near_links(unique, radius), "a", "b").collect()}
    assert {i: parts.get(i, i) for i in range(len(fps))} == slow_components(dict(enumerate(fps)), radius)


def test_near_links_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(5)
    base = rng.getrandbits(63)
    fps = sorted({base ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)})
    unique = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    parts = {r.node: r.component for r in simhash.connected_components(simhash.near_links(unique), "a", "b").collect()}
    assert {i: parts.get(i, i) for i in range(len(fps))} == slow_components(dict(enumerate(fps)))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 100), (None, 3), (201, 200), (201, 202), (200, 201)], "a long, b long")
    got = {r.node: r.component for r in simhash.connected_components(links, "a", "b").collect()}
    assert got == dict.fromkeys(range(1, 61), 1) | dict.fromkeys((200, 201, 202), 200)


def slow_contamination(text, items, window=13):
    import regex

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination_with_short_items_and_ties(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (2, "Short item, here"), (10, " ".join(f"w{i}" for i in range(5, 25))), (3, None), (4, "?!"), (5, "solo")]
    texts = [*ODD, f"x {passage} y " * 3, passage[3:], "short ITEM here short item here", "Solo", "w1 w2 w3", f"clean {'word ' * 400} solo", None, f"{'word ' * 200_000}{passage}"]
    d = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.contamination(d, b).collect()}
    assert got == {i: slow_contamination(t, items) for i, t in enumerate(texts)}
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i][3]}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b).collect()}
    assert cut[len(ODD)] == "x y x y x y " and cut[len(ODD) + 2] == "" and cut[4] == "word"
    again = decontaminate.contamination(d.withColumn("text", F.col("text")), b.limit(0)).collect()
    assert len(again) == len(texts) and not any(r.n_hit for r in again)


@pytest.mark.parametrize("broadcast", [True, False])
def test_texts_of_one_id_are_judged_each_for_itself(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    passage, clean = " ".join(f"w{i}" for i in range(20)), "plain words that nobody has ever asked for"
    rows = [(7, passage, 1), (7, clean, 2), (7, f"x {passage} y", 3), (7, f"x {passage} y", 3), (8, None, 4), (None, passage, 5), (9, clean, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted((r.row, r.text) for r in decontaminate.drop_contaminated(d, b).collect()) == [(2, clean), (4, None), (5, passage), (6, clean)]
    assert sorted(((r.row, r.text) for r in decontaminate.remove_spans(d, b).collect()), key=str) == [(1, ""), (2, clean), (3, "x y"), (3, "x y"), (4, None), (5, passage), (6, clean)]


def test_contamination_by_shuffle_shuffles_no_words(spark, docs, monkeypatch):
    """The same as by broadcast on the whole table, and what windows are joined by is narrow."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    tidy = lambda rows: sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows)
    want = tidy(decontaminate.contamination(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    joined = []
    plain = decontaminate._spots
    monkeypatch.setattr(decontaminate, "_spots", lambda rows, *how: joined.append(rows.columns) or plain(rows, *how))
    assert tidy(decontaminate.contamination(docs, items).collect()) == want and any(r[2] for r in want)
    assert joined == [["row", "n_words", "h"]]


def test_word_ids_match_the_library(docs):
    ids = WordIds(queries.vocabulary("word_bpe_49k.json"))
    for text in [t or "" for t in ODD] + [MULTILINGUAL] + [r.text for r in docs.collect()]:
        assert ids.ids(text) == ids.whole(text)


def test_packing(spark, docs):
    vocabulary = queries.vocabulary("word_bpe_49k.json")
    given = docs.select("doc_id", "text").union(odd(spark).limit(len(ODD)).select(F.col("doc_id") + 1_000_000, "text"))
    pieces = packing.best_fit(packing.tokenized(given, vocabulary)).collect()
    ids = WordIds(vocabulary)
    want = {}
    for r in given.collect():
        whole = ids.whole(r.text or "") + bytes(4)
        for k in range(0, len(whole), 8192):
            want[r.doc_id, k // 8192] = whole[k : k + 8192]
    assert {(p.doc_id, p.piece): bytes(p.ids) for p in pieces} == want
    assert all(p.start == 2048 * p.piece and p.length == len(p.ids) // 4 for p in pieces)
    check_sequences([(p.sequence_id, p.offset, p.length) for p in pieces], 2048)
    n, total = len({p.sequence_id for p in pieces}), sum(p.length for p in pieces)
    assert n <= -(-total // 2048) + 2
    assert packing.best_fit(packing.tokenized(given.limit(0), vocabulary)).count() == 0


CLASHES = ("id", "row", "text_", "piece", "start", "length", "ids", "offset", "sequence_id", "t", "node", "run", "fp", "w", "h", "lang_pred", "score", "items")


def test_long_texts_and_clashing_columns_everywhere(spark):
    """Texts of megabytes, among others, in tables whose other columns have names that operators use themselves."""
    long = "some words and 12 more, " * 60_000
    texts = [long, long + "end", "x" * 1_500_000, "short one", None, long]
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clash = plain.withColumns({c: F.lit("clash") for c in CLASHES})
    rows = {r.doc_id: r for r in simhash.near_duplicates(clash).collect()}
    assert all(rows[i].fingerprint == f"{slow_fingerprint(t):016x}" for i, t in enumerate(texts)) and rows[5].component_id == 0
    vocabulary = queries.vocabulary("word_bpe_49k.json")
    ids = WordIds(vocabulary)
    want = {(i, k // 8192): whole[k : k + 8192] for i, t in enumerate(texts) for whole in [ids.whole(t or "") + bytes(4)] for k in range(0, len(whole), 8192)}
    pieces = packing.best_fit(packing.tokenized(clash, vocabulary)).collect()
    assert {(p.doc_id, p.piece): bytes(p.ids) for p in pieces} == want
    check_sequences([(p.sequence_id, p.offset, p.length) for p in pieces], 2048)
    bench = spark.createDataFrame([(1, "and 12 more, some words " * 3)], "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})
    assert [(r.doc_id, r.contaminated) for r in decontaminate.contamination(clash, bench).orderBy("doc_id").collect()] == [(0, True), (1, True), (2, False), (3, False), (4, False), (5, True)]
    model = langid.fit(clash.withColumn("lang", F.when(F.col("doc_id") == 2, "xx").otherwise("yy")))
    found = {r.doc_id: r.lang_pred for r in langid.identify(clash, model).collect()}
    assert found[2] == "xx" and found[0] == found[5] == "yy" and found[4] == "und"
    cut = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(clash).collect()}
    assert cut == {0: long, 1: long + "end", 2: texts[2], 3: "short one", 4: None, 5: ""}


def check_sequences(places, capacity):
    for _, group in itertools.groupby(sorted(places), key=lambda x: x[0]):
        at = 0
        for _, offset, length in group:
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_gapless_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100, 2048])
    lengths = [min(capacity, max(1, int(rng.choice([rng.random(), rng.random() ** 3, rng.betavariate(8, 8)]) * capacity))) for _ in range(rng.randint(0, 400))]
    counts = {k: lengths.count(k) for k in set(lengths)}
    places, seen = [], set()
    for length, first, n, at, per, offset in packing.plan(counts, capacity):
        for i in range(n):
            assert (length, first + i) not in seen
            seen.add((length, first + i))
            places.append((at + i // per, offset + i % per * length, length))
    assert seen == {(k, i) for k, n in counts.items() for i in range(n)}
    check_sequences(places, capacity)
    bins: list[int] = []
    for x in sorted(lengths, reverse=True):  # plain best fit, one by one
        fits = [i for i, g in enumerate(bins) if g >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    assert len({p[0] for p in places}) <= len(bins) + 1


def test_pre_tokens_are_the_library_s_for_every_plain_character():
    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    split = token_counts.load(vocabulary).pre_tokenizer.pre_tokenize_str
    plain = [c for c in map(chr, range(0x300)) if not token_counts.PLAIN.search(c)]
    assert len(plain) > 650
    rng = random.Random(6)
    texts = [f"{x}{c}{y}" for c in plain for x, y in (("", ""), ("a ", " b"), ("1", "2"), (" ", "  x"), ("-", "'s"))] + ["".join(rng.choices([*plain, " ", "'", "l"], k=30)) for _ in range(3000)]
    for t in texts:
        assert token_counts.pre_tokens(t, None, vocabulary) == [t[i:j] for _, (i, j) in split(t)], t


def test_token_counts_match_the_library(spark, docs, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 500)
    vocabulary = queries.vocabulary("byte_bpe_50k.json")
    tokenizer = token_counts.load(vocabulary)
    more = [MULTILINGUAL, f"<|endoftext|>{MULTILINGUAL}<|endoftext|><|endoftext|> x", "-" * 3000, f"{'-' * 3000} “", "é" * 200_000, f"{MULTILINGUAL} " * 5000, "word " * 200_000]
    planted = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more * 2)], "doc_id long, text string")
    given = docs.select("doc_id", "text").union(odd(spark).select("doc_id", "text")).union(planted)
    assert given.count() > 0 and max(len(r.key) for r in token_counts.distinct_pieces(given, vocabulary).collect()) <= token_counts.KEY_CHARS + 1
    clash = given.withColumns({x: F.lit("x") for x in ("id", "row", "key", "n_bytes", "n_tokens")})
    assert token_counts.token_counts(clash, vocabulary).columns == ["doc_id", "n_bytes", "n_tokens"]
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(given, vocabulary).collect())
    assert got == sorted((r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in given.collect())


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang", langid.held_out().alias("out")), "doc_id").collect()
    out = [r for r in found if r.out]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    some = docs.select("doc_id", "text", "lang", F.lit(1).alias("score"), F.lit("x").alias("lang_pred"))
    junk = spark.createDataFrame([(i, t, None, 1, "x") for i, t in enumerate(ODD)], some.schema)
    kept = langid.drop_unidentified(junk, langid.fit(some))
    assert kept.columns == some.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(ODD))) - {0, 1, 2, 3}
    assert {r.lang_pred for r in langid.identify(junk, langid.fit(junk)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_language_id_matches_slow_kernel_ridge_regression(spark):
    """With every training row a landmark, Nyström is exact: plain kernel ridge regression on sets of n-grams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(70)
    rows = sorted((r.lang, r.n, r.text) for r in langid.training_rows(docs).collect())
    assert max(sum(r[0] == x for r in rows) for x in {r[0] for r in rows}) <= langid.LANDMARKS

    def spectrum(text):
        low = text.lower()
        return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}

    def slow(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    sets = [spectrum(r[2]) for r in rows]
    k = np.array([[slow(a, b) for b in sets] for a in sets])
    languages = sorted({r[0] for r in rows})
    y = np.array([[1.0 if r[0] == x else -1.0 for x in languages] for r in rows])
    w = np.array([len(rows) / len(languages) / sum(q[0] == r[0] for q in rows) for r in rows])
    # with bias: (K + ridge / weight) alpha + b = y, sum of alpha = 0
    n = len(rows)
    system = np.zeros((n + 1, n + 1))
    system[:n, :n] = k + np.diag(langid.RIDGE * n / w)
    system[:n, n] = system[n, :n] = 1
    alpha = np.linalg.solve(system, np.vstack([y, np.zeros((1, len(languages)))]))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    margins = np.array([[slow(spectrum(t), s) for s in sets] for t in texts]) @ alpha[:n] + alpha[n]
    model = langid.fit(docs)
    lang, score = model.predict(texts)
    e = np.exp(langid.SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
    sure = np.sort(margins, axis=1)[:, -1] - np.sort(margins, axis=1)[:, -2] > 0.02
    assert model.languages == languages and sure.mean() > 0.95
    assert all(lang[i] == languages[margins[i].argmax()] for i in np.flatnonzero(sure))
    assert np.abs(score - (e / e.sum(axis=1, keepdims=True)).max(axis=1)).max() < 0.1


def test_languages_of_large_alphabets_at_any_length(spark):
    """Two skewed languages of 3,000 characters each, of the same characters in other orders of frequency, far from and
    near to each other, whose long texts have nearly every pair of frequent characters."""
    rng = np.random.default_rng(4)
    letters = np.array([chr(0x4E00 + i) for i in range(3000)])
    weight = 1 / np.arange(1, 3001)
    order = {x: rng.permutation(3000) for x in ("aa", "bb")}
    draw = lambda x, n: "".join(letters[order[x]][rng.choice(3000, n, p=weight / weight.sum())])
    rows = [(i, draw(x, int(rng.integers(50, 3000))), x) for i, x in enumerate(["aa", "bb"] * 60)] + [(1000 + i, draw(x, 200_000), x) for i, x in enumerate(["aa", "bb"])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for n in (20, 400, 20_000, 200_000, 1_000_000):
        said, score = model.predict([draw(x, n) for x in ("aa", "bb")])
        assert said == ["aa", "bb"] and (n < 400 or score.min() > 0.6), (n, said, score)


def test_spectra_and_kernels_are_exact(monkeypatch):
    monkeypatch.setattr(langid, "GRAMS", 7)
    texts = ["", "a", "ab", "Abc abc", "é🙂é🙂", "\U0010ffff\x00x", "abcabc" * 50]
    sets = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t.lower()) - n + 1)} for t in texts]
    spectra = [langid.spectrum(t) for t in texts]
    assert [len(x) for x in spectra] == [len(x) for x in sets]
    marks = langid.landmarks(spectra[1:])
    got = marks.kernel(iter(spectra))
    want = [[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in sets[1:]] for a in sets]
    assert np.abs(got - want).max() < 1e-6 and langid.landmarks([]).kernel(iter(spectra)).shape == (7, 0)


def test_language_id_learns_from_few_rows_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 20)
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(1, "one row, many times over", "aa")] * 3000 + [(i, f"text number {i} of many", "bb") for i in range(2000)]
    rows += [(i, f"other text {i}", "cc") for i in range(10)] + [(1, "different text, same id", "cc"), (5, "rare", "dd"), (None, "no id", "cc"), (7, None, "cc"), (8, "no label", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.lang, r.n, r.text) for r in langid.training_rows(d).collect()]
    of = {x: [t for lang, _, t in got if lang == x] for x in ("aa", "bb", "cc", "dd")}
    kept = [i for i in range(10) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert of["aa"] == ["one row, many times over"] and len(of["bb"]) == len(set(of["bb"])) == 20 and not of["dd"]
    assert set(of["cc"]) == {f"other text {i}" for i in kept} | {"no id"} | ({"different text, same id"} if 1 in kept else set())
    assert all(zlib.crc32(t.split()[2].encode()) % 4 != 2 for t in of["bb"])


def test_align_finds_rising_pairs():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = line_dedup.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    a = list(range(30))
    assert line_dedup.align(a, a) == [(i, i) for i in a]
    assert line_dedup.align([1, 2, 3, 9], [7, 1, 2, 8, 3]) == [(0, 1), (1, 2), (2, 4)]


def slow_line_dedup(rows, block=60):
    """Every document against every earlier one: lines of any run of block characters or more that both hold go."""
    def runs(lines):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(map(len, lines[i:j])) >= block:
                    yield i, j, tuple(lines[i:j])

    sides = [(i, t, [(k, x.strip(" ")) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]) for i, t in rows]
    held = [(i, {r for _, _, r in runs([x for _, x in lines])}) for i, _, lines in sides]
    out = []
    for i, t, lines in sides:
        earlier = set().union(*(h for j, h in held if i is not None and j is not None and j < i))
        cut = {k for a, z, r in runs([x for _, x in lines]) if r in earlier for k in range(a, z)}
        gone = {lines[k][0] for k in cut} | {m for k in cut if k + 1 in cut for m in range(lines[k][0], lines[k + 1][0])}
        out.append((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return out


def line_dedup_of(spark, rows):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, run string")
    out = line_dedup.drop_repeated_lines(d)
    assert out.columns == d.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_line_dedup(spark):
    line = [f"this is line number {i} of the shared passage, which goes on for a while" for i in range(6)]
    texts = {
        1: "\n".join(["own start one", *line, "own end one"]),
        2: "\n".join(["own start two", *line, "own end two"]),
        3: "\n".join([line[2], "clean text here", "ok", line[2]]),
        4: "a clean document\nok\nwith lines of its own that nobody shares at all, ever",
        5: None, 6: "", 7: "\n".join(line), 8: "\n".join(reversed(line)), 9: " \n\n".join(["own start nine", *line, "the end", ""]),
    }
    rows = [*texts.items(), (7, texts[7]), (None, texts[7]), (10, "x" * 2_000_000 + "\n" + line[3])]
    got = line_dedup_of(spark, rows)
    assert got == sorted(slow_line_dedup(rows), key=repr)
    got = dict(got)
    assert got[1] == texts[1] and got[4] == texts[4] and got[5] is None and got[6] == "" and got[None] == texts[7]
    assert got[2] == "own start two\nown end two" and got[7] == "" and got[10] == "x" * 2_000_000
    assert got[3] == "clean text here\nok" and got[8] == "" and got[9] == "own start nine \n\n\nthe end \n\n"
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_finds_blocks_whatever_the_holders_of_their_lines(spark):
    a, b = "a frequent line of thirty-odd characters", "another frequent line, held by very many"
    rows = [(i, f"{(a, b)[i % 2]}\nown words {i}") for i in range(60)]
    rows += [(60, f"{a}\n{b}"), (61, f"start\n{a}\n{b}\nend"), (62, f"{b}\n{a}")] + [(i, rows[i % 2][1]) for i in range(64, 100)]
    short = "\n".join(f"step {i}" for i in range(12))
    rows += [(100, f"{a}\n{b}\nx"), (101, short), (102, f"a title\n{short}\nthe end")]
    got = dict(line_dedup_of(spark, rows))
    assert got == dict(slow_line_dedup(rows))
    assert got[61] == "start\nend" and got[100] == "x" and got[102] == "a title\nthe end" and got[101] == short
    x, y, z = (f"{w} a line of over thirty characters" for w in "xyz")
    rows = [*enumerate((x, y, z, f"{x}\n{y}\n{z}"), 1), *enumerate((x, y, z, f"{x}\n{y}\n{z}"), 5)]
    assert dict(line_dedup_of(spark, rows))[8] == ""
    eight = "\n".join(f"line {i:02d}." for i in range(30))
    assert dict(line_dedup_of(spark, [(1, f"one\n{eight}"), (2, f"{eight}\ntwo")]))[2] == "two"


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["", " ", "a", "bb " * 4, "a line of thirty characters or so", "x" * 59, "y" * 60, "another line, of more characters than one block has to have at all"]
    texts = ["\n".join(rng.choice(words) + rng.choice(["", "", "", "1", "2"]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    rows = [(i // 2 if i < 10 else i, rng.choice([t, rng.choice(texts)])) for i, t in enumerate(texts)]
    assert line_dedup_of(spark, rows) == sorted(slow_line_dedup(rows), key=repr)


def test_aligned_lines_follow_moved_and_repeated_runs():
    assert line_dedup.aligned_lines([0, 1, 2], [1, 1, 1], [0, 1, 2], [0, 1, 2]) == [0, 1, 2]
    assert line_dedup.aligned_lines([0, 1, 2, 7], [1, 1, 3, 1], [9, 5, 0, 9], [0, 1, 2, 0]) == [0, 1, 2, 3, 4, 7]


def test_lines_go_by_alignment_alone(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 40)
        at = rng.sample(range(100), n)
        run = [rng.choice([k, k, 0]) for k in range(n)]
        first = {}
        at = [first.setdefault(r, a) for r, a in zip(run, at, strict=True)]
        assert line_dedup.aligned_lines(list(range(n)), [1] * n, at, run) == list(range(n))
    calls, plain = [], line_dedup.align
    monkeypatch.setattr(line_dedup, "align", lambda a, b: calls.append(len(a)) or plain(a, b))
    n = 4000
    for order in (range(n), range(n, 0, -1), rng.sample(range(n), n)):
        calls.clear()
        assert line_dedup.aligned_lines(list(range(n)), [1] * n, list(order), list(range(n))) == list(range(n)) and len(calls) < 150
    assert line_dedup.aligned_lines(list(range(n)), [1] * n, [3] * n, [0] * n) == list(range(n))  # one line over and over
    monkeypatch.setattr(line_dedup, "align", lambda a, b: [(i, j) for i, j in plain(a, b) if i % 2])
    assert line_dedup.aligned_lines([0, 1], [1, 1], [0, 1], [0, 1]) == [1]  # what isn't aligned stays
    monkeypatch.setattr(line_dedup, "align", lambda a, b: [])
    assert line_dedup.aligned_lines([0, 1], [1, 1], [0, 1], [0, 1]) == []


def test_runs_cover_every_long_stretch():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.randint(1, 70) for _ in range(rng.randint(0, 30))]
        got = list(line_dedup.runs(sizes))
        assert len(got) == len(set(got))
        long = {(k, m) for k, m in itertools.combinations(range(len(sizes) + 1), 2) if sum(sizes[k:m]) >= 60}
        assert set(got) <= long
        for k, m in long:
            assert {i for x, y in got if k <= x and y <= m for i in range(x, y)} == set(range(k, m))


def test_line_dedup_on_the_table(spark, docs):
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert before.keys() == after.keys()
    first = {}
    for i in sorted(before):
        for x in before[i].split("\n"):
            first.setdefault(x.strip(" "), i)
    for i, text in after.items():
        kept = text.split("\n") if text else []
        gone = before[i].split("\n")
        for x in kept:
            gone.remove(x)
        assert all(first[x.strip(" ")] < i for x in gone)  # what goes stands in an earlier document
    for x, i in first.items():
        assert x in (y.strip(" ") for y in after[i].split("\n")) or not x  # and its first holder keeps it
