"""Operators on conversations, pages, vectors and licences against brute force and round trips."""

import hashlib
import itertools
import random
import re
import textwrap

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgeloom.llm import ann, chat, licenses, queries, url_rules
from tests.conftest import SF

TURNS = "conv_id long, turn long, role string, text string"
HARD = ["", "\\", "\\\\", "###", "####", "######", "##\\#", "</turn>", "</turn>\n", "<\\/turn>", "\\</turn>", "### user: hi</turn>\n", "a\\### Assistant: </turn> ok", "#" * 9 + "\\" * 5, ":", "\\:", "é🙂\n"]


def slow_turns(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_render_reads_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b", "\\", None]), "".join(rng.choices(HARD, k=3))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, "assistant", None), (51, 0, "assistant", "x"), (51, 0, "assistant", "x"), (51, 0, "assistant", "w")]
    d = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", formatted string")
    got = {r.conv_id: r for r in chat.render(d).collect()}
    want = slow_turns(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        p = chat.parse(got[c].formatted, got[c].loss)
        assert p.turns == turns and p.loss == "".join(x for r, x in turns if r == "assistant") and got[c].n_turns == len(turns)
    for r in chat.digests(chat.render(d)).collect():
        loss = "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.render(d.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\#:/<>turn \n", max_size=40))
def test_unescape_is_the_inverse(text):
    escaped = text.replace("\\", "\\\\")
    escaped = "".join("\\#" if c == "#" and escaped[max(0, i - 2) : i] == "##" else c for i, c in enumerate(escaped)).replace("</turn>", "<\\/turn>")
    assert "###" not in escaped and "</turn>" not in escaped and chat.unescape(escaped) == text


def slow_fold(events):
    """Events one by one."""
    convs = {}
    for c, m, seq, kind, role, text in sorted(events, key=lambda e: (e[0], e[2])):
        if kind not in chat.KINDS:
            continue
        x = convs.setdefault(c, {}).setdefault(m, {"text": "", "role": None, "dead": False})
        x["role"] = role or x["role"]
        if kind == "delta":
            x["text"] += text or ""
        else:
            x["text"] = "" if kind == "regenerate" else text or ""
            x["dead"] = kind == "delete"
    return {(c, i): (x["role"], x["text"]) for c, ms in convs.items() for i, x in enumerate(x for x in ms.values() if not x["dead"])}


def test_reconstruct_folds_events(spark):
    rng = random.Random(2)
    events = []
    for c in range(30):
        for seq in range(rng.randint(1, 25)):
            kind = rng.choice([*chat.KINDS, "delta", "delta", "ping", None])
            events.append((c, rng.randint(0, 4), seq, kind, rng.choice([None, "user", "assistant"]), rng.choice([None, f"t{seq} "])))
    d = spark.createDataFrame(events, "conv_id long, message_id long, seq long, kind string, role string, text string")
    assert {(r.conv_id, r.turn): (r.role, r.text) for r in chat.reconstruct(d).collect()} == slow_fold(events)
    assert chat.reconstruct(d.limit(0)).count() == 0


def test_long_messages_and_clashing_columns(spark):
    long = "a\\###</turn>" * 100_000
    events = [(1, 1, 0, "start", "user", None), (1, 1, 1, "delta", None, long), (1, 1, 2, "delta", None, "b"), (1, 2, 3, "message", "assistant", "first"), (1, 2, 4, "edit", "assistant", long), (2, 9, 0, "delete", "user", "x")]
    clash = {c: F.lit("clash") for c in ("at", "reset", "first", "parts", "last", "turn", "start", "line", "head", "body", "raw", "loss", "n_turns")}
    d = spark.createDataFrame(events, "conv_id long, message_id long, seq long, kind string, role string, text string").withColumns(clash)
    turns = chat.reconstruct(d)
    assert [tuple(r) for r in turns.orderBy("turn").collect()] == [(1, 0, "user", long + "b"), (1, 1, "assistant", long)]
    got = chat.render(turns.withColumns({k: v for k, v in clash.items() if k not in ("turn",)})).first()
    p = chat.parse(got.formatted, got.loss)
    assert p.turns == [("user", long + "b"), ("assistant", long)] and p.loss == long


def slow_split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    end = min([i for i, c in enumerate(rest) if c in "?#" and i >= at], default=len(rest))
    return host, rest[at:end]


URLS = [None, "", "no scheme", "http://", "HTTP://ExAmple.COM/en/7?x=1", "https://a.b.example.com/en/78#t", "http://example.com/en/", "http://com/en/x", "http://notexample.com/en/7", "x://É.net/de/8", "http://example.net/de/8/9", "http://m.example.net/de/81", "http://a.net/fr/", "http://q.org/es/?p", "http://q.org?/es/", "a://b://c/d", "http://h/" + "s/" * 3000, "http://long.com/en/" + "x" * 1_000_000, f"http://{'a.' * 2000}net/de/1"]


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, *URLS[:5]])], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, unwanted boolean")
    got = {r.page_id: r for r in url_rules.judge(rows, none, queries.URL_RULES).collect()}
    assert len(got) == len(URLS) + 5
    for i, u in enumerate([*URLS, *URLS[:5]]):
        h, p = slow_split(u)
        fits = [(r, v) for r, v in queries.URL_RULES if (h == r.partition("/")[0] or h.endswith("." + r.partition("/")[0])) and p.startswith("/" + r.partition("/")[2])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (got[i].host, got[i].path, got[i]["rule"], got[i].verdict) == (h, p, rule, verdict), u
    assert url_rules.judge(rows.limit(0), none, queries.URL_RULES).count() == 0


@pytest.mark.parametrize("basket", [url_rules.BASKET, 6, 0])
def test_mined_rules_match_brute_force(spark, monkeypatch, basket):
    monkeypatch.setattr(url_rules, "BASKET", basket)
    rng = random.Random(4)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['a', 'b', 'spam'])}.x{rng.randint(0, 2)}.com/{rng.choice(['en', 'de'])}/{rng.randint(1, 99)}{rng.choice(['', '?ref=1', '#top'])}" for _ in range(400)]
    bad = [("spam." in u and "/en/" in u) or rng.random() < 0.1 for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(list(enumerate(bad)), "page_id long, unwanted boolean")
    rules = url_rules.mine(pages, labels, support=0.02)
    sets = {r.url: set(r.t) for r in pages.select("url", url_rules.tokens(F.col("url")).alias("t")).collect()}
    want = {}
    every = sorted(set().union(*sets.values()))
    for w in range(1, url_rules.WIDTH + 1):
        for combo in itertools.combinations(every, w):
            has = [b for u, b in zip(urls, bad, strict=True) if sets[u].issuperset(combo)]
            if sum(has) >= 0.02 * len(urls) and sum(has) / len(has) >= url_rules.CONFIDENCE and sum(has) / len(has) > sum(bad) / len(bad):
                if not any(set(s) < set(combo) and c >= sum(has) / len(has) for s, c in want.items()):
                    want[combo] = sum(has) / len(has)
    got = {tuple(r.tokens): r.confidence for r in rules.collect()}
    assert got.keys() == want.keys() and len(got) > 1 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    hit = {r.url: r.confidence for r in url_rules.matched(pages, rules).collect()}
    assert hit.keys() == {u for u in urls if any(sets[u].issuperset(k) for k in got)}
    assert all(abs(hit[u] - max(c for k, c in got.items() if sets[u].issuperset(k))) < 1e-9 for u in hit)


@pytest.mark.parametrize("basket", [16, 3])
def test_mining_long_and_repeated_urls(spark, monkeypatch, basket):
    monkeypatch.setattr(url_rules, "BASKET", basket)
    long = "http://bad.example.com/" + "/".join(f"seg{chr(97 + i)}" for i in range(40)) + "?" + "&".join(f"k{chr(97 + i)}=1" for i in range(20))
    urls = [(i, long if i < 12 else f"http://good{i % 7}.org/x{i % 5}/{'y' if i % 2 else 'z'}") for i in range(200)]
    many = [(1000 + i, "http://mixed.net/?" + "&".join(f"q{chr(97 + k)}=1" for k in range(26) if (i * 7919 + k * 104729) % 11 > 1)) for i in range(60)]
    pages = spark.createDataFrame([*urls, *many], "page_id long, url string")
    labels = spark.createDataFrame([(7, i, i < 12) for i, _ in urls] + [(7, i, i % 10 == 0) for i, _ in many], "n int, page_id long, unwanted boolean")
    rules = url_rules.mine(pages, labels)
    hit = {r.url for r in url_rules.matched(pages, rules).collect()}
    assert long in hit and not any("good" in u for u in hit)
    sets = {r.page_id: set(r.t) for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    bad = {r.page_id: r.unwanted for r in labels.collect()}
    for r in rules.collect():  # what is told of a rule holds over all labelled pages
        has = [bad[i] for i in sets if sets[i].issuperset(r.tokens)]
        assert sum(has) / len(has) == pytest.approx(r.confidence) and sum(has) / len(bad) == pytest.approx(r.support) and r.confidence >= url_rules.CONFIDENCE


def test_no_rule_is_lost_among_many_tokens(spark):
    """aa and zz together mark 60 pages, all unwanted, each alone is mostly wanted; other tokens of a page mark unwanted ones better."""
    rng = random.Random(9)
    noise = [f"n{chr(97 + i)}" for i in range(24)]
    said = [(["aa", "zz"] + rng.sample(noise, 17), True) for _ in range(60)] + [([rng.choice(["aa", "zz"])], False) for _ in range(240)] + [(rng.sample(noise, 5), False) for _ in range(200)]
    pages = spark.createDataFrame([(i, "http://h/" + "/".join(t), "x", "y") for i, (t, _) in enumerate(said)], "page_id long, url string, rule string, verdict string")
    labels = spark.createDataFrame([(i, b, "z") for i, (_, b) in enumerate(said)], "page_id long, unwanted boolean, mined string")
    rules = {tuple(r.tokens): r for r in url_rules.mine(pages, labels).collect()}
    sets = [({f"path={x}" for x in t}, b) for t, b in said]
    assert rules["path=aa", "path=zz"].confidence == 1.0 and rules["path=aa", "path=zz"].support == 0.12
    for k, r in rules.items():
        has = [b for t, b in sets if t.issuperset(set(k) - {"host=h", "scheme=http"})]
        assert sum(has) / len(has) == pytest.approx(r.confidence) and r.support == pytest.approx(sum(has) / 500)
    pairs = {tuple(sorted((f"path={a}", f"path={b}"))) for a, b in itertools.combinations(["aa", "zz", *noise], 2)}
    for k in pairs:
        has = [b for t, b in sets if t.issuperset(k)]
        alone = [[b for t, b in sets if x in t] for x in k]
        if sum(has) >= 5 and sum(has) >= 0.6 * len(has) and not any(sum(a) >= 0.6 * len(a) and sum(a) / len(a) >= sum(has) / len(has) for a in alone):
            assert k in rules
    got = {r.page_id: r for r in url_rules.judge(pages, labels, []).collect()}
    assert len(got) == 500 and all(got[i].verdict == "block" for i in range(60)) and all(got[i].verdict == "allow" for i in range(60, 300))


def slow_nearest(rows, k, want):
    out = {}
    for q, v in want:
        found = sorted((-float(np.dot(np.array(v, float), np.array(x, float))), i) for i, x in rows if i != q and len(x) == len(v))
        out[q] = found[:k]
    return out


def test_nearest_recall_and_scores(spark):
    v = spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), 20).collect()
    want = slow_nearest(rows, 20, [r for r in rows if r[0] % 20 == 0])
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert by.keys() == want.keys() and all(len(x) == 20 and x == sorted(x) for x in by.values())
    assert np.mean([len({i for _, i in by[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.95
    vec = dict(rows)
    assert all(abs(r.score - float(np.dot(np.array(vec[r.query_id], float), np.array(vec[r.vec_id], float)))) < 1e-12 for r in got)


def test_nearest_across_shards_with_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 60)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    base = np.round(rng.normal(size=(200, 8)) * rng.uniform(0.2, 3, (200, 1)), 2).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 200 if i < 400 else 0]]) for i in range(500)]  # copies, one of them a hundred times
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [None, *[1.0] * 7]), (1005, [float("inf")] * 8), (None, [1.0] * 8), (1020, [1.0, 2.0])]
    d = spark.createDataFrame([(i, x, 1.0) for i, x in rows + odd], "vec_id int, embedding array<float>, score double")
    got = {}
    for r in ann.nearest(d, d.where("vec_id % 20 = 0"), 20, beam=120).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = slow_nearest(rows, 20, [r for r in rows if r[0] % 20 == 0])
    assert got.keys() == want.keys()
    same = [len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want]
    assert np.mean(same) >= 19.5
    few = d.where("vec_id < 5")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(few, few, 20).collect()) == [(a, b) for a in range(5) for b in range(5) if a != b]
    assert ann.nearest(d.limit(0), d, 20).count() == 0


def varied(kind, n, rng):
    """Directions without any structure, which are the hardest, of equal or more and more unequal lengths."""
    x = rng.normal(size=(n, 64))
    if kind != "own":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * np.exp(rng.normal(size=(n, 1)) * {"unit": 0, "own": 0, "unequal": 0.5, "heavy": 1.5}[kind])


@pytest.mark.parametrize("kind", ["own", "unequal"])
def test_recall_of_a_full_shard(kind):
    rng = np.random.default_rng(5)
    x = varied(kind, ann.SHARD_ROWS, rng).astype(np.float32)
    q = x[rng.choice(len(x), 150, replace=False)]
    graph, start = ann.build(ann.unit(x))
    found, _ = ann.beam_search(ann.scaled(x), graph, ann.start_nodes(x, start), ann.unit(q), ann.BEAM)
    true = np.argsort(-(q @ x.T), axis=1)[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(true, found[:, :21], strict=True)]) >= 0.95


@pytest.mark.parametrize("n", [2000, 4000])
@pytest.mark.parametrize("kind", ["own", "heavy"])
def test_small_shards_are_searched_by_their_graph(kind, n):
    """Recall of a small shard is that of a full one, and no search looks at all of it."""
    rng = np.random.default_rng(8)
    x = varied(kind, n, rng).astype(np.float32)
    graph, start = ann.build(ann.unit(x))
    starts = ann.start_nodes(x, start)
    assert len(starts) <= n // 16 + 1
    q = x[rng.choice(n, 100, replace=False)]
    found, expanded = ann.beam_search(ann.scaled(x), graph, starts, ann.unit(q), ann.BEAM)
    true = np.argsort(-(q @ x.T), axis=1)[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(true, found[:, :21], strict=True)]) >= 0.95
    looked = [set(starts.tolist()) | {int(i) for at in row if at >= 0 for i in graph[at] if i >= 0} for row in np.hstack(expanded)]
    assert max(map(len, looked)) < n


@pytest.mark.parametrize("kind", ["unit", "own", "unequal", "heavy"])
def test_recall_over_shards_of_doubles(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "SHARD_ROWS", 1000)
    x = varied(kind, 3000, np.random.default_rng(6))
    d = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, q int, shard int")
    got = {}
    for r in ann.nearest(d, d.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    true = {q: [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20] for q in range(0, 3000, 20)}
    assert got.keys() == true.keys() and np.mean([len({i for i, _ in got[q]} & set(true[q])) / 20 for q in true]) >= 0.95
    assert all(abs(s - float(x[q] @ x[i])) <= 1e-14 * np.linalg.norm(x[q]) * np.linalg.norm(x[i]) for q in got for i, s in got[q])


def test_nearest_of_extreme_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2e300]), (2, [1e-300, 1e-300]), (3, [1.0, 1.0]), (4, [3.0, 4.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(d, d.where("vec_id = 3"), 2).collect()}
    assert got == {(3, 1): (1, 1e300), (3, 2): (0, 1e300)} or got == {(3, 1): (0, 1e300), (3, 2): (1, 1e300)}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_licenses(spark, model):
    texts = [None, "", "nothing to see here", "Released under the MIT License.", "Distributed under the Foo License, version 9.",
             "some words\nThis work is licensed under the GNU Lesser General Public License, version 3.\n\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
             "version of the file and the terms of use of this work by any person", "long " * 3000 + "licensed under the apache license, version 2.0"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, licenses string")
    got = sorted((r.doc_id, r.licenses, r.n_licensed, r.n_paragraphs) for r in licenses.licenses(d, model).collect())
    assert got == [(0, "", 0, 1), (1, "", 0, 1), (2, "", 0, 1), (3, "MIT", 1, 1), (3, "MIT", 1, 1), (4, "unknown", 1, 1), (5, "CC-BY-NC,LGPL", 3, 5), (6, "", 0, 1), (7, "Apache-2.0", 1, 1)]
    assert licenses.licenses(d.limit(0), model).count() == 0


def slow_paragraphs(text):
    """Line after line: one that was wrapped takes the next one in."""
    lines = (text or "").split("\n")
    out = [lines[0]]
    for line, after in itertools.pairwise(lines):
        first = re.match(r"[\s/#*;>-]*(\S+)", after)
        wraps = line.strip(" ") and len(line) <= licenses.WRAP and first and len(line) + 1 + len(first[1]) > max(len(line), len(after)) and not re.search(r"[.!?][\"')]*\s*\Z", line)
        if wraps:
            out[-1] += " " + after
        else:
            out.append(after)
    return out


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices_are_one_paragraph(spark, model, mark):
    """Wrapped and marked as comments, a notice gives the families that it gives on one line."""
    said = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(f, t, t) for f, t in said] + [(f, t, "\n".join(mark + x for x in textwrap.wrap(t, w, break_long_words=False, break_on_hyphens=False))) for f, t in said for w in (16, 24, 40, 72)]
    rows.append(("MIT", "Released under the MIT License.", "\n".join(mark + x for x in textwrap.wrap("Released under the MIT License.", 12))))
    d = spark.createDataFrame([(i, t, "p") for i, (_, _, t) in enumerate(rows)], "doc_id long, text string, paragraphs string")
    got = {r.doc_id: r.licenses for r in licenses.licenses(d, model).collect()}
    whole = {t: got[i] for i, (_, t) in enumerate(said)}
    assert [(f, t) for f, t in said if whole[t] != f] in ([], [("MPL-2.0", "SPDX-License-Identifier: MPL-2.0")])
    assert not [(t, got[i]) for i, (_, of, t) in enumerate(rows) if got[i] != whole[of]]


def slow_licenses(texts, model):
    """Paragraph by paragraph: margins, calibrated chances and template overlaps, without Spark."""
    import regex

    def grams(text):
        w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
        return len(w), {" ".join(w[i : i + n]) for n in range(1, licenses.ORDER + 1) for i in range(len(w) - n + 1)}

    sketches = [(f, {g for g in grams(t)[1] if " " in g}) for f, ts in licenses.TEMPLATES.items() for t in ts]
    out = []
    for text in texts:
        found, lines = [], slow_paragraphs(text)
        for at, line in enumerate(lines):
            n, have = grams(line)
            met = [g for g in have if g in model.weights]
            shared = [len(have & s) for _, s in sketches]
            if not met and not any(shared):
                continue
            m = (np.array(model.intercepts) + sum((np.array(model.weights[g]) for g in met), np.zeros(len(model.intercepts)))) / model.temperature
            best, p = int(m.argmax()), 1 / np.exp(m - m.max()).sum()
            overlap = max((min(1.0, x / max(1, min(len(s), 2 * n - 3))) for x, (f, s) in zip(shared, sketches, strict=True) if f == licenses.CLASSES[best]), default=0.0)
            if best < len(licenses.TEMPLATES) and p >= model.threshold and overlap >= licenses.OVERLAP:
                found.append((licenses.CLASSES[best], p))
            elif best == len(licenses.CLASSES) - 2 or best < len(licenses.CLASSES) - 2 and overlap >= licenses.TRACE:
                found.append((licenses.UNKNOWN, p))
        out.append((",".join(sorted({f for f, _ in found})), len(found), len(lines), max((p for _, p in found), default=None)))
    return out


def test_licenses_match_a_slow_scorer(spark, model):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    said = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.UNKNOWN_NOTICES
    rng = random.Random(8)
    for t in said:  # whole, cut, with words left out, in other orders, in company
        w = t.split()
        texts += [t, " ".join(w[len(w) // 3 :]), " ".join(x for x in w if rng.random() < 0.8), " ".join(rng.sample(w, len(w))), f"{rng.choice(said)}\n\n{t}\nsome other words"]
    texts += [None, "", "\n\n", "é", "license " * 50_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.licenses(d, model).collect()}
    for i, (names, n, lines, p) in enumerate(slow_licenses(texts, model)):
        assert (got[i].licenses, got[i].n_licensed, got[i].n_paragraphs) == (names, n, lines), texts[i]
        assert got[i].probability is None if p is None else abs(got[i].probability - p) < 1e-9


def test_calibration_tells_the_unknown_apart():
    rng = np.random.default_rng(4)
    k, family = len(licenses.CLASSES), len(licenses.TEMPLATES)
    label = rng.integers(0, k, 4000)
    margins = rng.normal(size=(4000, k))
    margins[np.arange(4000), label] += 3.0
    margins *= 3.0  # log chances as they are, at temperature one
    temperature, threshold = licenses.calibrate(label, margins * 3)
    assert temperature == 3.0
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    named = (p.argmax(axis=1) < family) & (p.max(axis=1) >= threshold)
    assert named.any() and (p.argmax(axis=1) == label)[named].mean() >= licenses.PRECISION and 0.3 <= threshold < 0.96
    assert licenses.calibrate(np.zeros(0, int), np.zeros((0, k))) == (1.0, 0.5)


def test_licenses_on_the_table(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = {"CC BY-NC 4.0": "CC-BY-NC", "GNU General Public License": "GPL", "Apache License": "Apache-2.0", "MIT License": "MIT"}
    want = {r.doc_id: sorted({f for s, f in named.items() if s in r.text}) for r in docs.collect()}
    assert {r.doc_id: [x for x in r.licenses.split(",") if x] for r in licenses.licenses(docs, model).collect()} == want


def test_every_template_is_its_own_family(spark, model):
    rows = [(i, f, t) for i, (f, t) in enumerate((f, t) for f, ts in licenses.TEMPLATES.items() for t in ts)]
    got = {r.doc_id: r.licenses for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, f string, text string"), model).collect()}
    assert np.mean([got[i] == f for i, f, _ in rows]) > 0.85
