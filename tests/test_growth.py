"""What is shuffled, written and repeated by the queries that large tables are read by."""

import random

import pytest
from ringtrace.operators import anomalies, graph, matching, registry, similarity, views
from ringtrace.plans import queries


@pytest.fixture
def messages(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    templates = [(f"t{i}", " ".join(rng.sample(words, rng.randrange(4, 14)))) for i in range(30)]
    inputs = [(f"i{i}", " ".join(rng.sample(words, 9))) for i in range(300)] + [(f"j{i}", f"so {text} it is") for i, (_, text) in enumerate(templates)]
    return spark.createDataFrame(inputs, "input_id string, text string"), spark.createDataFrame(templates, "template_id string, text string")


def test_similar_writes_nothing_of_its_inputs(messages, monkeypatch):
    rows, write = {}, similarity.written

    def noted(df, name="rows"):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "written", noted)
    assert similarity.similar(*messages).count() >= 30
    assert rows["templates"] == 30 and not {"messages", "prefixes", "word-pairs", "fit"} & rows.keys()


def test_similar_in_blocks_of_templates_equals_all_at_once(messages):
    def rows(n, **more):
        return sorted(map(tuple, similarity.similar(*messages, n=n, **more).collect()))

    assert rows(None, block_chars=300) == rows(None) and rows(1, block_chars=300) == rows(1)


@pytest.fixture
def noted(monkeypatch):
    """[(name, rows)] of all that is written to the shared folder."""
    from ringtrace.operators import common

    out, write = [], common.written

    def writing(df, name="rows"):
        table = write(df, name)
        out.append((name, table.count()))
        return table

    for module in (anomalies, graph, registry, queries):
        monkeypatch.setattr(module, "written", writing)
    return out


def test_links_shrink_each_round_and_chains_end(spark, noted, monkeypatch):
    n = 3000
    monkeypatch.setattr(graph, "TASK_LINKS", 0)
    monkeypatch.setattr(graph._roots, "__defaults__", (0,))
    ids = [f"n{i:05d}" for i in range(n)]
    links = [(ids[i], ids[i + 1]) for i in range(n - 1)]
    got = graph.components(spark.createDataFrame(links, "a string, b string"))
    assert {r.component for r in got.collect()} == {"n00000"} and got.count() == n
    rows = [k for name, k in noted if name == "links"]
    assert rows[-1] == 0 and sum(rows) < 4 * n


def test_matches_need_no_reasons_and_no_members(spark, sf, noted):
    assert queries.w2_best_campaign(spark, sf).count() == 1500 and queries.f12_evidence(spark, sf).count() > 1500
    names = [name for name, _ in noted]
    assert not {"linked", "reasons", "members", "matches"} & set(names) and names.count("edges") == 2


def test_filtered_graph_builds_what_it_shows(spark, sf, noted):
    _, _, g, campaigns = queries._registry(spark, sf)
    docs = spark.createDataFrame([], "document_id string, title string, url string")
    whole = views.filtered_graph(*views.graph(campaigns, graph.roles(g.keys), matching.campaign_evidence(g.members, docs)), "tactic")
    noted.clear()
    shown = queries.g7_filtered_graph(spark, sf)
    assert sorted(map(str, shown.collect())) == sorted(map(str, queries._graph_rows(*whole).collect()))
    assert not {"reasons", "members"} & {name for name, _ in noted}


def test_a_long_list_is_compared_no_further_than_it_is_like_others(spark, noted):
    long = [f"v{i:04d}" for i in range(600)]
    lists = {"a": long, "b": long[:20], "c": [*long[:20], "w"], "d": long[:20], "e": ["v0000"], "f": [*long[:8], "w"], "g": []}
    rows = spark.createDataFrame([(k, "burst_size") for k in lists], "anomaly_key string, anomaly_type string")
    behind = spark.createDataFrame([(k, v, None) for k, x in lists.items() for v in x], "anomaly_key string, document_id string, indicator_key string")
    got = [r.anomaly_key for r in anomalies.ordered(rows, behind).orderBy("place").collect()]
    assert got == sorted(lists, key=lambda k: (lists[k], k))
    assert len([name for name, _ in noted if name == "runs"]) <= 6  # not 10, as 600 values would need
