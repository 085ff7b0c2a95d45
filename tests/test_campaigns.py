import random

import pytest
from pyspark.sql import functions as F
from ringtrace.operators import anomalies, contextual, graph, incremental, matching, metrics, prepare, registry, similarity, validation
from ringtrace.operators.common import empty

DOC = "document_id string, category string, confidence string, specific_case string, severity string, scam_types array<string>, bank_roles array<string>, first_seen timestamp, last_seen timestamp"
EDGE = "document_id string, kind string, value string, confidence double, source string, quote string, position int"

DOCS = [
    ("doc-1", "scam_report", "0.9", "true", "5", ["Fake Bank"], ["Victim bank"], None, None),
    ("doc-2", "impersonation_abuse", "0.8", "true", "3", ["fake-bank"], [], None, None),
    ("doc-3", "scam_report", "0.7", "true", "4", None, None, None, None),
    ("doc-4", "odd one", "0.4", "false", "9", [], [], None, None),
]
EDGES = [
    ("doc-1", "account", "001-234-567-890", 1.0, "text", "q1", 0),
    ("doc-1", "account", "001234567890", 0.5, "text", "q2", 1),
    ("doc-2", "bank_account", "001 234 567 890", 1.0, "text", "q3", 0),
    ("doc-2", "phone", "+84912345678", 1.0, "text", "q4", 1),
    ("doc-3", "phone", "0912345678", 1.0, "text", "q5", 0),
    ("doc-3", "person_alias", "Some One", 1.0, "text", "q6", 1),
    ("doc-4", "nothing", "x", 1.0, "text", "q7", 0),
]


@pytest.fixture(scope="module")
def base(spark):
    docs = prepare.documents(spark.createDataFrame(DOCS, DOC))
    edges = prepare.edges(spark.createDataFrame(EDGES, EDGE))
    return docs.persist(), edges.persist()


def test_prepared(base):
    docs, edges = base
    rows = {r.document_id: r for r in docs.collect()}
    assert rows["doc-1"].scam_types == ["fake_bank"] == rows["doc-2"].scam_types and rows["doc-4"].category == "noise" and rows["doc-4"].severity == 5
    assert [r.document_id for r in docs.filter(prepare.eligible()).orderBy("document_id").collect()] == ["doc-1", "doc-2", "doc-3"]
    assert edges.count() == 5 and edges.filter("document_id = 'doc-1'").first().confidence == 1.0


def test_repeated_ids_are_an_error(spark, base):
    assert prepare.checked_ids(base[0]).count() == 4
    with pytest.raises(ValueError):
        prepare.checked_ids(base[0].union(base[0]))


def test_clusters_and_scores(base):
    docs, edges = base
    g = graph.clusters(docs, prepare.linking(edges))
    (c,) = g.clusters.collect()
    assert (c.component, c.anchor, c.document_count, c.maximum_severity, c.indicator_count, c.shared_count) == ("doc-1", "bank_account|001234567890", 3, 5, 2, 2)
    scores = {r.document_id: r.membership_score for r in g.members.collect()}
    assert scores == {"doc-1": 0.98, "doc-2": 0.999, "doc-3": 0.95}
    roles = {r.key: (r.role, r.weight, r.reasons) for r in graph.indicator_roles(g.keys, g.reasons).collect()}
    assert roles == {"bank_account|001234567890": ("anchor", 0.98, ["q1", "q3"]), "phone|0912345678": ("shared", 0.95, ["q4", "q5"])}
    assert validation.sound_clusters(g.clusters, g.members).first().sound
    why = {(r.document_id, r.indicator_key): (r.reason_type, r.indicator_type, r.shared_document_count, r.indicator_confidence, r.contribution, r.evidence_source, r.evidence_quote) for r in g.reasons.collect()}
    assert why["doc-2", "phone|0912345678"] == ("shared_strong_indicator", "phone", 2, 1.0, 0.95, "text", "q4") and len(why) == 4
    assert not any(t.startswith("array") and c not in ("scam_types", "bank_roles", "category_counts") for df in g for c, t in df.dtypes)


def test_order_of_input_does_not_matter(spark):
    rows = EDGES[:]
    random.Random(1).shuffle(rows)
    a = prepare.edges(spark.createDataFrame(rows, EDGE).repartition(3))
    links = graph.components(graph.star_edges(prepare.linking(a))).orderBy("document_id").collect()
    assert [tuple(r) for r in links] == [("doc-1", "doc-1"), ("doc-2", "doc-1"), ("doc-3", "doc-1")]


def test_metrics_and_anomalies(base):
    docs, edges = base
    s = metrics.summary(docs, edges).first()
    assert (s.document_count, s.unique_indicator_count, s.document_indicator_edge_count, s.maximum_severity, s.average_confidence) == (4, 3, 5, 5, 0.7)
    linking = prepare.linking(edges)
    clusters, members, keys, _ = graph.clusters(docs, linking)
    found = anomalies.found(docs, linking, clusters).groupBy("anomaly_type").count().collect()
    assert {r.anomaly_type: r["count"] for r in found} == {"high_severity": 3, "repeated_indicator": 2, "burst_size": 1}
    rows = anomalies.found(docs, linking, clusters)
    behind = anomalies.evidence(rows, docs, linking, linking, keys, members).collect()
    burst = next(r for r in rows.collect() if r.anomaly_type == "burst_size")
    assert len([r for r in behind if r.anomaly_key == burst.anomaly_key and r.document_id]) == burst.document_count
    assert burst.anomaly_key == f"burst_size_{clusters.first().campaign_key}"
    order = [r.anomaly_type for r in anomalies.ordered(rows, anomalies.evidence(rows, docs, linking, linking, keys, members)).orderBy("place").collect()]
    assert order == sorted(order, key=anomalies.ORDER.index)


def test_empty_input(spark):
    docs, edges = prepare.documents(empty(spark, DOC)), prepare.edges(empty(spark, EDGE))
    s = metrics.summary(docs, edges).first()
    assert (s.document_count, s.average_confidence, s.maximum_severity) == (0, 0.0, 0)
    g = graph.clusters(docs, edges)
    assert [df.count() for df in g] == [0, 0, 0, 0] and anomalies.found(docs, edges, g.clusters).count() == 0


def test_anomalies_are_ordered_by_whole_lists(spark):
    rng = random.Random(5)
    lists = {f"a{i}": (sorted(rng.sample("abcdef", rng.randrange(0, 5))), sorted(rng.sample("xyz", rng.randrange(0, 4))), rng.choice(anomalies.ORDER)) for i in range(60)}
    lists["a60"], lists["a61"] = (["a", "b"], [], "burst_size"), (["a"], [], "burst_size")
    rows = spark.createDataFrame([(k, v[2]) for k, v in lists.items()], "anomaly_key string, anomaly_type string")
    behind = [(k, d, None) for k, v in lists.items() for d in v[0]] + [(k, None, i) for k, v in lists.items() for i in v[1]]
    got = [r.anomaly_key for r in anomalies.ordered(rows, spark.createDataFrame(behind, "anomaly_key string, document_id string, indicator_key string")).orderBy("place").collect()]
    assert got == sorted(lists, key=lambda k: (anomalies.ORDER.index(lists[k][2]), lists[k][0], lists[k][1], k))


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(80):03d}", f"n{rng.randrange(80):03d}") for _ in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    got = {r.document_id: r.component for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == want


CLUSTER = "campaign_key string, anchor string, document_count bigint, risk_score double, scam_types array<string>"
OLD = "campaign_key string, anchor string, document_count bigint, risk_score double, label string, status string, analyst_confirmed boolean, is_active boolean, updated_at string"


def _without(rows, at=2):
    return [(*r[:at], *r[at + 1 :]) for r in rows]


def _keys(spark, rows, anchors=False):
    return spark.createDataFrame([(r[0], k) for r in rows for k in {*r[2], *([r[1]] if anchors else [])}], "campaign_key string, key string")


@pytest.mark.parametrize("largest", [100_000, 3])
def test_identities_are_those_of_choosing_one_by_one(spark, largest):
    rng = random.Random(4)
    keys = [f"phone|{k}" for k in range(30)]
    new = [(f"n{i}", keys[i], rng.sample(keys, 5), rng.randrange(2, 9), 1.0, ["t"]) for i in range(14)]
    old = [(f"n{i}" if i < 3 else f"o{i}", keys[i], rng.sample(keys, 5), 3, 1.0, "", "dismissed" if i % 5 == 0 else "provisional", i % 3 == 0, True, f"2024-01-{i + 1:02d}") for i in range(12)]
    want = {n[0]: n[0] for n in new if n[0] in {o[0] for o in old}}
    taken = set(want.values())
    for n in sorted(new, key=lambda n: (-n[3], n[0])):
        if n[0] in want:
            continue
        fit = []
        for o in old:
            overlap = len(set(n[2]) & ({*o[2], o[1]}))
            if o[0] not in taken and o[6] != "dismissed" and overlap:
                fit.append((o[7], overlap, o[9], o[0]))
        if fit:
            want[n[0]] = max(fit)[3]
            taken.add(want[n[0]])
    clusters, before = spark.createDataFrame(_without(new), CLUSTER), spark.createDataFrame(_without(old), OLD)
    keys, old_keys = _keys(spark, new), _keys(spark, old, True)
    identities = registry.assigned(clusters, keys, before, old_keys, largest)
    assert {r.campaign_key: r.old_key for r in identities.collect()} == want
    merged = {r.campaign_key: r for r in registry.merged(clusters, before, identities).collect()}
    assert all(not merged[o[0]].is_active for o in old if o[6] == "dismissed") and len(merged) == len(old) + len(new) - len(want)
    again = {r.campaign_key: r for r in registry.merged(clusters, before, identities).collect()}
    assert again == merged
    held = {}
    for r in registry.merged_keys(keys, old_keys, identities).collect():
        held.setdefault(r.campaign_key, set()).add(r.key)
    assert all(held[want.get(n[0], n[0])] == set(n[2]) for n in new) and all(held[o[0]] == {*o[2], o[1]} for o in old if o[0] not in want.values())


def test_a_long_chain_of_refusals_takes_few_rounds(spark):
    n = 3000
    clusters = spark.createDataFrame([(f"n{i:05d}", "phone|1", n - i, 1.0, ["t"]) for i in range(n)], CLUSTER)
    # each cluster wants the campaign of the one before it most
    keys = spark.createDataFrame([(f"n{i:05d}", f"k{j}x{x}") for i in range(n) for j, m in ((i - 1, 3), (i, 2)) if j >= 0 for x in range(m)], "campaign_key string, key string")
    old = spark.createDataFrame([(f"o{i:05d}", "phone|2", 2, 1.0, "", "provisional", False, True, "x") for i in range(n)], OLD)
    old_keys = spark.createDataFrame([(f"o{i:05d}", f"k{i}x{x}") for i in range(n) for x in range(3)], "campaign_key string, key string")
    got = {r.campaign_key: r.old_key for r in registry.assigned(clusters, keys, old, old_keys).collect()}
    assert got == {f"n{i:05d}": f"o{i:05d}" for i in range(n)}


def test_labels_of_analysts_stay(spark):
    new = [("n1", "phone|0912345678", ["phone|0912345678"], 2, 5.0, ["fake_bank"])]
    before = [("n1", "phone|0912345678", ["phone|0912345678"], 2, 1.0, "Mine", "confirmed", True, True, "x"), ("n2", "phone|1", ["phone|1"], 2, 1.0, None, "provisional", False, True, "x")]
    clusters, old, keys, old_keys = spark.createDataFrame(_without(new), CLUSTER), spark.createDataFrame(_without(before), OLD), _keys(spark, new), _keys(spark, before)
    rows = {r.campaign_key: r for r in registry.merged(clusters, old, registry.assigned(clusters, keys, old, old_keys)).collect()}
    assert (rows["n1"].label, rows["n1"].risk_score, rows["n1"].is_active, rows["n2"].is_active) == ("Mine", 5.0, True, False)
    new = registry.merged(clusters, old.limit(0), registry.assigned(clusters, keys, old.limit(0), old_keys.limit(0))).first()
    assert new.label == "Fake Bank · Phone ••••5678"


@pytest.mark.parametrize(("category", "specific", "anchor", "score", "confirmed", "contextual", "want"), [
    ("scam_report", True, True, 0.3, False, False, "matched_campaign"), ("scam_report", True, False, 0.85, False, False, "matched_campaign"), ("scam_report", True, False, 0.55, False, False, "possible_match"),
    ("scam_report", True, False, 0.54, False, False, "new_unmatched_case"), ("scam_report", True, None, None, None, None, "new_unmatched_case"), ("scam_report", False, True, 1.0, True, False, "not_scam"),
    ("noise", False, True, 1.0, True, False, "matched_campaign"), ("noise", False, True, 1.0, False, False, "possible_match"), ("noise", True, False, 1.0, False, False, "not_scam"),
    ("scam_report", True, False, 0.75, False, True, "possible_match"), ("scam_report", True, False, 0.74, False, True, "new_unmatched_case"),
])
def test_status(spark, category, specific, anchor, score, confirmed, contextual, want):
    row = spark.createDataFrame([(category, specific, anchor, score, confirmed, contextual)], "c string, s boolean, a boolean, x double, y boolean, z boolean")
    assert row.select(matching.status(*map(F.col, "csaxyz")).alias("o")).first().o == want


def brute_similarity(a, b):
    import re

    a, b = (" ".join(x.lower().split()) for x in (a, b))
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    toks = lambda s: {t for t in re.split(r"[^a-z0-9]+", s) if len(t) >= 2}
    if len(short) >= 24 and len(toks(short)) >= 4 and short in long:
        return min(0.97, 0.88 + len(short) / len(long) * 0.09)
    x, y = toks(a), toks(b)
    if len(x) < 4 or len(y) < 4:
        return 0.0
    met = len(x & y)
    c, j = met / min(len(x), len(y)), met / len(x | y)
    g, h = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
    d = 2 * len(g & h) / (len(g) + len(h)) if g or h else 0
    return 0.0 if met < 4 or c < 0.8 or j < 0.6 or d < 0.72 else min(0.99, c * 0.35 + j * 0.25 + d * 0.4)


def test_similar_messages_equal_comparing_all(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(25)]
    templates = [(f"t{i}", " ".join(rng.sample(words, rng.randrange(4, 14)))) for i in range(40)] + [("t90", "Hi"), ("t91", "")]
    inputs = []
    for i in range(60):
        w = rng.choice(templates[:40])[1].split()
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "changed"
        if i % 4 == 0:
            w = ["before"] + w + ["after!"]
        inputs.append((f"i{i}", " ".join(w).title() if i % 5 == 0 else " ".join(w)))
    inputs += [("i90", "hi"), ("i91", None)]
    got = {(r.input_id, r.template_id): r.similarity for r in similarity.similar(spark.createDataFrame(inputs, "input_id string, text string"), spark.createDataFrame(templates, "template_id string, text string"), n=None).collect()}
    want = {(i, t): round(s, 4) for i, x in inputs for t, y in templates if (s := brute_similarity(x or "", y)) >= 0.82}
    assert got == pytest.approx(want)


def test_judgements(spark):
    rows = [("c", "k", "likely_related", 0.8, ["a", "b"], ["taxonomy", "channel"]), ("c", "k", "likely_related", 0.7, ["a", "b"], ["x", "y"]), ("c", "k", "likely_related", 0.9, ["a", "b"], ["taxonomy"]), ("c", "other", "likely_related", 0.9, ["a", "b"], ["x", "y"]), ("c", "k", "unrelated", 0.9, ["a", "b"], ["x", "y"])]
    judged = spark.createDataFrame(rows, "case_id string, campaign_key string, relationship string, confidence double, shared_patterns array<string>, matched_dimensions array<string>")
    assert contextual.accepted(judged, spark.createDataFrame([("c", "k")], "case_id string, campaign_key string")).count() == 1


def test_validation(spark):
    df = spark.createDataFrame([(1, 3), (2, None), (3, 9)], "id int, n int")
    ok, bad = validation.split(df, {"range": F.col("n").between(1, 5), "id": F.col("id") > 0})
    assert [r.id for r in ok.collect()] == [1] and {r.id: r.violations for r in bad.collect()} == {2: ["range"], 3: ["range"]}


def test_retrieved_equals_scoring_each_case(spark):
    rng = random.Random(3)
    labels = ["fake_bank", "fake_shop", "loan_app", "urgent_loan", "bank_staff"]
    some = lambda: rng.sample(labels, rng.randrange(3))
    kinds = [(["phone"], ["bank_alert"]), (["email"], []), ([], ["loan_offer", "app_install"])]
    cases = spark.createDataFrame([(f"d{i}", some(), some(), *rng.choice(kinds)) for i in range(60)], "case_id string, scam_types array<string>, bank_roles array<string>, kinds array<string>, signals array<string>")
    rows = [(f"k{i}", some(), some(), rng.choice(["phone|1", "email|x"]), rng.choice([0.4, 0.9]), rng.choice([3.0, 6.0]), rng.randrange(2, 4), i % 3 == 0, "Fake Bank", i % 9 != 0, "dismissed" if i % 7 == 0 else "provisional") for i in range(40)]
    campaigns = spark.createDataFrame(rows, "campaign_key string, scam_types array<string>, bank_roles array<string>, anchor string, average_confidence double, risk_score double, document_count bigint, analyst_confirmed boolean, label string, is_active boolean, status string")
    pairs = sorted({(f"d{rng.randrange(60)}", f"k{rng.randrange(40)}") for _ in range(90)})
    bridged = spark.createDataFrame([(*p, ["payment_method"], rng.choice([0.2, 0.8])) for p in pairs], "case_id string, campaign_key string, bridge_kinds array<string>, bridge_score double")
    live = campaigns.filter("is_active AND status <> 'dismissed'")
    each = contextual.overlapping(cases, live).unionByName(bridged.select("case_id", "campaign_key")).distinct().join(cases, "case_id").join(bridged, ["case_id", "campaign_key"], "left")
    want = contextual.ranked(contextual.scored(each, live), "case_id", 3).drop("analyst_confirmed", "risk_score", "document_count")
    got = contextual.retrieved(cases, campaigns, bridged, n=3).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 60


def test_all_documents_outside_campaigns_are_cases(spark, sf):
    from ringtrace.plans import queries

    docs, _, g, _ = queries._registry(spark, sf)
    outside = docs.join(g.members, "document_id", "left_anti")
    found = queries.j5_contextual(spark, sf).select(F.col("case_id").alias("document_id")).distinct().join(docs, "document_id")
    assert {r.severity for r in found.select("severity").distinct().collect()} == {r.severity for r in outside.select("severity").distinct().collect()} != {5}


def test_metrics_have_evidence_as_rows(base):
    docs, edges = base
    for df in (metrics.summary(docs, edges), metrics.by_category(docs), metrics.by_severity(docs), metrics.by_indicator(docs, edges)):
        assert not {"evidence_document_ids", "evidence_keys"} & set(df.columns)
    rows = {(r.metric_scope, r.metric_key): r["count"] for r in metrics.evidence(docs, edges).groupBy("metric_scope", "metric_key").count().collect()}
    assert (rows["summary", "global"], rows["category", "scam_report"], rows["severity", "5"], rows["indicator", "phone|0912345678"]) == (4, 2, 2, 2)


def test_line_clusters_have_a_large_component(spark, sf):
    from ringtrace.plans import queries

    docs, edges, (clusters, members, _, _) = queries._line_clusters(spark, sf)
    component = graph.components(graph.star_edges(edges)).groupBy("component").count()
    assert {tuple(r) for r in clusters.select("component", "document_count").collect()} == {tuple(r) for r in component.collect()}
    assert clusters.agg(F.max("document_count")).first()[0] > 7 and members.count() == component.agg(F.sum("count")).first()[0]


def test_components_by_batches_equal_all_at_once(spark, tmp_path, monkeypatch):
    rng = random.Random(0)
    rows = [(f"d{rng.randrange(70):02d}", f"k{rng.randrange(60)}") for _ in range(110)] + [("d00", "k999"), (None, "k1"), ("d01", None)]
    edges = spark.createDataFrame(rows, "document_id string, key string")
    batches = [spark.createDataFrame(rows[i::4], edges.schema) for i in range(4)]
    state = incremental.Components(spark, str(tmp_path), buckets=4)
    known = []
    for n, batch in enumerate(batches):
        if n == 2:  # broken off between two tables, then run again
            with monkeypatch.context() as m:
                m.setattr(incremental.Components, "_renamed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    state.apply(n, batch)
        state.apply(n, batch)
        if n == 1:
            state.apply(n, batch)
        known += rows[n::4]
        if n % 2 == 0:
            continue
        whole = graph.components(graph.star_edges(spark.createDataFrame([r for r in known if None not in r], edges.schema)))
        assert sorted(map(tuple, state.current().collect())) == sorted(map(tuple, whole.select("document_id", "component").collect()))
    assert state.current(2).count() <= state.current().count()
    # a batch that only repeats what is known writes nothing and renames nothing
    assert state.apply(4, batches[0]).count() == 0
    assert all(state._table(t, None).filter("batch = 4").isEmpty() for t in incremental.SCHEMAS)


def test_few_classes_of_campaigns_are_scored(spark):
    n = 400
    campaigns = spark.createDataFrame([(f"k{i:03d}", ["fake_bank"] if i % 2 else ["loan_app"], ["bank_staff"], f"phone|{i}", 0.9 - i % 7 / 100, float(i % 5), 2, False, f"Fake Bank · Phone ••••{i}") for i in range(n)], "campaign_key string, scam_types array<string>, bank_roles array<string>, anchor string, average_confidence double, risk_score double, document_count bigint, analyst_confirmed boolean, label string")
    groups = spark.createDataFrame([("p", ["fake_bank"], ["bank_staff"], ["phone"], ["bank_alert"])], "profile string, scam_types array<string>, bank_roles array<string>, kinds array<string>, signals array<string>")
    assert contextual.promising(groups, campaigns, 4).count() < n / 4
