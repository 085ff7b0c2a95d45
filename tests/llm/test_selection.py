"""Decontamination, lexical search and hard negatives against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from ringtrace.llm import decontaminate, lexical, negatives

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_hits(text, items, n=10):
    w, hit, ids = words(text), set(), set()
    for item, passage in items:
        p = words(passage)
        k = min(n, len(p))
        runs = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if p else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in runs:
                hit |= set(range(i, i + k))
                ids.add(item)
    return len(w), sorted(hit), sorted(str(i) for i in ids if i is not None)


PASSAGE = "It was the Best of times, it was the worst of times; Ünder the SKY of İstanbul and K 100 men walked."
ITEMS = [(1, PASSAGE), (2, "short Item here"), (3, ""), (4, None), (5, "... !!"), (10, PASSAGE + " They walked on."), (None, "nobody knows whose passage this one is but it has eleven words"), (2, "short item HERE")]


def documents():
    rng = np.random.default_rng(2)
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50, n))
    rows = [(0, PASSAGE), (1, None), (2, ""), (3, noise(200)), (4, f"{noise(7)} {PASSAGE.upper()} {noise(5)}"), (5, PASSAGE.replace("İ", "i̇")), (6, f"{noise(3)},SHORT item\nhere-{noise(2)}"), (7, "short item"), (8, " ".join(words(PASSAGE)[:9]))]
    rows += [(9, f"({PASSAGE}) " * 40), (10, noise(60_000) + " " + PASSAGE + " ?!"), (0, PASSAGE), (0, "another text of the same id"), (None, PASSAGE), (None, None), (None, None)]
    rows += [(11, "xx short item here short item here yy nobody knows whose passage this one is but it has eleven words zz")]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 25, 600])
def test_contamination(spark, block_bytes):
    rows = documents()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, digest string, items int").repartition(3)
    items = spark.createDataFrame([(*r, 3) for r in ITEMS], "item_id bigint, text string, h int")
    found = decontaminate.contamination(docs, items, block_bytes=block_bytes)
    got = sorted(((r.doc_id, r.n_words, [i for s in r.spans for i in range(s.start, s.end)], list(r["items"]), r.contaminated) for r in found.collect()), key=repr)
    want = sorted(((i, n, hit, ids, bool(hit)) for i, t in rows for n, hit, ids in [brute_hits(t, ITEMS)]), key=repr)
    assert got == want
    assert all(a.end < b.start for r in found.collect() for a, b in zip(r.spans, r.spans[1:]))


def test_cleaned(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, spans string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontaminate.contamination(docs, items)
    whole = decontaminate.cleaned(docs, found, spans_only=False)
    assert sorted(map(repr, (tuple(r) for r in whole.collect()))) == sorted(repr((*r, "x")) for r in rows if not brute_hits(r[1], ITEMS)[1])
    cut = decontaminate.cleaned(docs, found)
    assert cut.columns == docs.columns
    got = sorted(repr((r.doc_id, words(r.text))) for r in cut.collect())
    hit = [set(brute_hits(t, ITEMS)[1]) for _, t in rows]
    assert got == sorted(repr((i, [w for k, w in enumerate(words(t)) if k not in h])) for (i, t), h in zip(rows, hit))
    kept = {r.doc_id: r.text for r in cut.collect() if r.doc_id in (3, 6, 7, 10)}
    assert kept[3] == rows[3][1] and kept[7] == "short item" and kept[10].endswith(" ?!")
    assert re.fullmatch(r"w\d+ w\d+ w\d+-w\d+ w\d+", kept[6])


def test_contamination_of_nothing(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated OR n_hit > 0 OR n_items > 0").count() == 0
    assert decontaminate.contamination(odd, items).count() == odd.count()


def test_equal_hashes_are_verified(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string")
    window = spark.createDataFrame([(["a", "b", "x"], [7])], "window array<string>, items array<bigint>")
    h = decontaminate.run_hashes(F.array(*map(F.lit, "abc")), [3])
    forged = window.select(F.get(F.get(h, F.lit(0)), F.lit(0)).alias("h"), "window", "items")
    assert [r.span for r in decontaminate.hits(docs, forged, [3]).collect()] == [None]


def brute_search(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "query_bytes", "parts"), [(20, 1 << 22, 3), (3, 700, 7), (1, 1 << 22, 1)])
def test_search(spark, k, query_bytes, parts):
    rng = np.random.default_rng(7)
    vocabulary = [f"t{x}" for x in range(400)] + ["Éa", "日本", "don", "x1"]
    text = lambda n: " ".join(vocabulary[int(x)] for x in np.minimum(rng.zipf(1.3, n), 403))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(500)]
    docs += [(600 + i, docs[3][1]) for i in range(30)]  # ties
    docs += [(700, None), (701, ""), (702, "-- !!"), (703, text(30_000)), (5, docs[5][1]), (None, docs[8][1]), (704, "ÉA éa Éa")]
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(12)] + [(20, text(3000)), (21, None), (22, ""), (23, "unknown words"), (24, docs[3][1].upper()), (25, "don't don't x1")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, n int").repartition(parts)
    asked = spark.createDataFrame([(*i, 1) for i in [*items, items[0]]], "item_id bigint, text string, q int")
    got = sorted((tuple(r) for r in lexical.search(df, asked, k, query_bytes).collect()), key=repr)
    assert got == brute_search(docs, items, k)


def test_search_of_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "the cat")], "item_id bigint, text string")
    assert lexical.search(none, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0
    assert sorted((r["rank"], r.doc_id) for r in lexical.search(odd, items).collect()) == [(1, 1), (2, None)]


def test_few_documents_are_scored(monkeypatch):
    """Groups whose bound lies below the k-th best score are left out."""
    rng = np.random.default_rng(4)
    n, seen = 5000, []
    sizes = np.full(n, 6)
    terms = np.concatenate([rng.permutation(40)[:6] for _ in range(n)])
    block = lexical.Block(np.full(n, 100), sizes, terms, np.ones(len(terms), np.int64))
    real = lexical.saturated
    monkeypatch.setattr(lexical, "saturated", lambda tf, norm: (seen.append(np.size(tf)), real(tf, norm))[1])
    best = lexical.block_best(block, np.arange(n), np.arange(10), np.arange(10, 0, -1) ** 3, 5, np.zeros((0, 2), np.int64))
    assert len(best) == 5 and sum(seen[1:]) < 0.1 * n


def brute_negatives(rows, anchors, n_pos, n_neg, least):
    v = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        row = (label, [math.floor(256 * float(np.float32(c))) for c in x])
        v[i] = max(v.get(i, row), row)
    out = []
    for a in anchors & v.keys():
        score = {i: sum(p * q for p, q in zip(v[a][1], x)) for i, (_, x) in v.items() if i != a and len(x) == len(v[a][1])}
        pos = sorted((-s, i) for i, s in score.items() if v[i][0] == v[a][0])[:n_pos]
        for p, i in pos:
            neg = sorted((-s, j) for j, s in score.items() if v[j][0] != v[a][0] and least[0] * -p <= least[1] * s and s <= -p)[:n_neg]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(neg)]
    return sorted(out)


@pytest.mark.parametrize(("anchor_bytes", "cells", "least", "k"), [(1 << 24, 1 << 21, (80, 100), 5), (2000, 60, (1, 2), 3), (1 << 24, 500, (95, 100), 2)])
def test_hard_negatives(spark, monkeypatch, anchor_bytes, cells, least, k):
    monkeypatch.setattr(negatives, "SCORES", cells)
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(0.4, 0.5, 6)]) for i in range(120)]
    rows += [(200 + i, i % 3, rows[10][2]) for i in range(30)]  # ties, many equal vectors
    rows += [(300 + i, 7, [-x for x in rows[i][2]]) for i in range(10)] + [(400 + i, i % 2, [0.1 * i, 0.3]) for i in range(8)]
    rows += [(500, None, rows[0][2]), (510, 1, None), (520, 1, [None] * 6), (530, 1, [float("nan")] * 6), (540, 1, []), (550, 2, []), (None, 1, rows[0][2]), (10, 2, rows[11][2]), (10, 2, rows[11][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, label int, embedding array<float>, v int").repartition(4)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, k, k, least, anchor_bytes=anchor_bytes).collect())
    assert got == brute_negatives(rows, {i for i, _, _ in rows if i is not None and i % 10 == 0}, k, k, least)
    assert got


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "vec_id bigint, label int, embedding array<float>")
    for some, anchors in ((df.limit(0), F.lit(True)), (df, F.lit(False)), (df, F.lit(None).cast("boolean")), (df, F.lit(True))):
        assert negatives.hard_negatives(some, anchors).count() == 0


