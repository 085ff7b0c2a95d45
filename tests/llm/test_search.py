import itertools

import numpy as np
import pytest
from ringtrace.llm import near_dup, topk


def brute_groups(rows, words, t):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        met, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] and sets[b] and met * t[1] >= t[0] * union:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def variants(seed=3):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(12, 160))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.integers(0, 6)):
                text[rng.integers(0, len(text))] = f"e{rng.integers(0, 90)}"
            if rng.random() < 0.3:
                text = text[: len(text) - int(rng.integers(0, 8))]
            rows.append((n, " ".join(text)))
            n += 1
    common = " ".join(f"shared{x}" for x in range(60))
    rows += [(n + k, common + " " + " ".join(f"u{k}x{j}" for j in range(30))) for k in range(40)]
    rows += [(900, None), (901, ""), (902, "Hello World"), (903, "hello\tworld"), (904, "one"), (905, rows[0][1].upper())]
    return rows


@pytest.mark.parametrize(("words", "t", "block"), [(3, (9, 10), 1024), (5, (4, 5), 1024), (3, (9, 10), 7), (5, (4, 5), 9), (3, (4, 5), 5)])
def test_near_duplicates_are_exact(spark, words, t, block):
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words, t, block).collect()}
    assert got == brute_groups(rows, words, t)


def test_odd_documents(odd, none):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert all(r.component_id == r.doc_id for r in rows if r.doc_id is not None)
    assert near_dup.near_duplicates(none).count() == 0


def test_tree_finds_what_comparing_finds():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64)) for _ in range(120)]
    sets = [np.frombuffer(x, np.uint64) for x in {s.tobytes() for s in sets}]
    tree, wanted = near_dup._Tree(sets), rng.random(len(sets)) < 0.8
    for t in ((9, 10), (1, 2), (4, 5)):
        for own in sets[:40]:
            near = [k for k, s in enumerate(sets) if wanted[k] and len(np.intersect1d(own, s)) * t[1] >= t[0] * len(np.union1d(own, s))]
            assert sorted(tree.similar(own, t, wanted).tolist()) == near


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in near_dup.components(spark.createDataFrame(links, "a bigint, b bigint"), spark).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200, 202: 200}


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 11)])
def test_top_k_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 24)]) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(12)]  # ties
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 24), (203, [float("inf")] * 24), (204, []), (205, [0.5] * 7), (None, [1.0] * 24), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 10 = 0 OR vec_id IN (204, 205)")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in ok if i % 10 == 0]:
        scored = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert topk.top_k(df, df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df).count() == 0
