import duckdb
import pytest
from pyspark.sql import functions as F
from ringtrace.operators import registry
from ringtrace.sources import store, tables
from ringtrace.streaming import refresh


def test_upsert_keeps_what_is_not_supplied(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, v string, note string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "n")], "id int, v string, note string")
    got = {r.id: (r.v, r.note) for r in registry.upsert(old, new, ["id"], protected=["note"]).collect()}
    assert got == {1: ("a", "x"), 2: (None, "n"), 3: ("c", "n")}


def test_snapshots_swap(spark, tmp_path):
    root = str(tmp_path / "snap")
    for n in (3, 5):
        tables.swap(spark.range(n), root, spark)
        assert tables.current(root, spark).count() == n


def test_search_results(spark):
    body = '{"organic_results":[{"title":" A  b","link":"https://x.example/1"},{"link":" "},{"position":9,"link":"http://y.example","source":"Y"}]}'
    rows = tables.search_results(spark.createDataFrame([("q", body), ("e", "{}")], "query_id string, body string"), start=10).orderBy("position").collect()
    assert [(r.position, r.title, r.site) for r in rows] == [(9, "", "Y"), (11, "A b", "x.example")]


def test_domains_beyond_ten_thousand(spark):
    from ringtrace.functions import urls

    wanted = spark.createDataFrame([(f"d{i}.example",) for i in range(12_000)] + [("a.d1.example",), (None,)], "domain string")
    pages = [(i, f"https://{'www.' * (i % 2)}{'a.' * (i % 3)}d{i}.example:80/x") for i in range(12_000)] + [(1, "https://a.d1.example/"), (1, "https://a.d1.example/"), (2, "http://xd1.example"), (3, None), (4, ""), (5, "http://example")]
    results = spark.createDataFrame(pages, "page_id int, url string")
    got = tables.on_domains(results, wanted)
    assert got.columns == ["page_id", "url"] and got.count() == 12_002
    few = wanted.filter("domain IN ('d1.example', 'a.d1.example', 'd50.example')")
    plain = results.join(few, urls.on_domain(urls.domain(F.col("url")), F.col("domain")), "left_semi")
    assert sorted(map(tuple, tables.on_domains(results, few).collect())) == sorted(map(tuple, plain.collect()))


def test_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "j", "fetch", "info", "2024-01-01 00:00:00"), (2, "j", "fetch", "error", "2024-01-02 00:00:00")], "event_id int, job_id string, stage string, level string, at string").withColumn("at", F.to_timestamp("at"))
    tables.append_log(rows, str(tmp_path / "log"))
    tables.append_log(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and [r.event_id for r in tables.recent(log, level="error", n=1).collect()] == [2]


def test_refresh_is_idempotent(spark, tmp_path):
    source, edges, seen = str(tmp_path / "in"), str(tmp_path / "edges"), []
    hits = lambda *r: spark.createDataFrame(list(r), "event_id int, url_key string, at timestamp")
    from datetime import datetime as d

    hits((1, "a", d(2024, 1, 1, 0, 1)), (2, "a", d(2024, 1, 1, 0, 2)), (3, "b", d(2024, 1, 1, 0, 3))).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema

    def run():
        query = refresh.refreshing(spark.readStream.schema(schema).parquet(source), edges, str(tmp_path / "ck"), lambda df: seen.append(sorted(r.url_key for r in df.collect()))).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    hits((4, "a", d(2024, 1, 9)), (5, "c", d(2024, 1, 9))).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert seen == [["a", "b"], ["a", "b", "c"]]


def test_stream_windows_and_dedup(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(i, f"u{i % 3}", f"job{i % 2}", f"2024-01-01 00:{i:02d}:00") for i in range(30)], "event_id int, url_key string, job_id string, at string").withColumn("at", F.to_timestamp("at"))
    rows.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for name, df, mode in (("cycles", refresh.cycle_counts(stream), "complete"), ("once", refresh.once(stream), "append"), ("seen", refresh.seen(stream), "update")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("cycles").agg(F.sum("hits")).first()[0] == 30 and spark.table("once").count() == 3 and spark.table("seen").count() == 3


CHEAP = ["s1_filtered_scan", "s6_nested_read", "n4_canonical_urls", "n12_money", "n16_indicator_values", "a4_by_indicator", "g1_page_components", "a6_clusters", "c3_drilled", "t1_cycles"]


@pytest.mark.parametrize("name", CHEAP)
def test_queries_equal_their_sql(spark, sf, name):
    from pathlib import Path

    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df, want = entry.queries()[name](spark, sf), con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    plain = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()) == sorted([plain(r[i]) for i in order] for r in want.fetchall())


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"a{i}", i * 1.0) for i in range(200)], "id bigint, name string, x double")
    store.create(rows, root, ["id"], 16)
    with pytest.raises(FileExistsError):
        store.create(rows, root, ["id"], 16)
    first = store.manifest(spark, root)
    one = spark.createDataFrame([(7, "seven"), (1000, "new")], "id bigint, name string")
    assert store.upsert(one, root, before_commit=lambda: None) == 1
    second = store.manifest(spark, root)
    moved = {b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)}
    assert 1 <= len(moved) <= 2 and len(second["folders"]) >= 14
    got = {r.id: (r.name, r.x) for r in store.read(spark, root).collect()}
    assert got == {**{i: (f"a{i}", i * 1.0) for i in range(200)}, 7: ("seven", 7.0), 1000: ("new", None)}
    assert {r.id: r.name for r in store.read(spark, root, 0).collect()}[7] == "a7"
    assert store.upsert(one.limit(0), root) == 1
    store.upsert(spark.createDataFrame([(7, "other")], "id bigint, name string"), root, protected=["name"])
    assert store.read(spark, root).filter("id = 7").first().name == "seven"
    with pytest.raises(ValueError):
        store.upsert(one.withColumn("odd", F.lit(1)), root)
    store.replace(rows.limit(3), root)
    assert store.read(spark, root).count() == 3 and len(store.vacuum(spark, root, 1)) > 3 and store.read(spark, root).count() == 3 and store.versions(spark, root) == [3]


KILLED = """
import os, signal, sys
sys.path[:0] = [{repo!r}]
from pyspark.sql import SparkSession
from ringtrace.sources import store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
new = spark.createDataFrame([(i, "changed") for i in range(50)], "id bigint, name string")
store.upsert(new, {root!r}, before_commit=lambda: os.kill(os.getpid(), signal.SIGKILL))
"""


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = str(tmp_path / "store")
    store.create(spark.createDataFrame([(i, "old") for i in range(60)], "id bigint, name string"), root, ["id"], 4)
    code = KILLED.format(repo=str(Path(__file__).resolve().parents[1]), root=root)
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=200).returncode == -9
    assert store.versions(spark, root) == [0] and store.read(spark, root).filter("name = 'old'").count() == 60
    other = spark.createDataFrame([(1, "mine")], "id bigint, name string")
    # two writers of one version: the second is refused
    with pytest.raises(FileExistsError):
        store.upsert(other, root, before_commit=lambda: store.upsert(other, root))
    assert store.versions(spark, root) == [0, 1] and store.read(spark, root).filter("name = 'mine'").count() == 1


def test_lookback_counts_hits_near_a_boundary_twice(spark, tmp_path):
    rows = [("u", "2024-01-01 00:14:59"), ("u", "2024-01-01 00:15:00"), ("u", "2024-01-01 00:09:59"), ("v", "2024-01-01 00:10:00")]
    df = spark.createDataFrame(rows, "url_key string, at string").withColumn("at", F.to_timestamp("at"))
    want = sorted([("2024-01-01 00:15:00", "u", 2), ("2024-01-01 00:30:00", "u", 2), ("2024-01-01 00:15:00", "v", 1), ("2024-01-01 00:30:00", "v", 1)])
    shown = lambda x: sorted(tuple(r) for r in x.select(F.date_format("cycle_end", "yyyy-MM-dd HH:mm:ss"), "url_key", "hits").collect())
    assert shown(refresh.lookback_counts(df)) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    refresh.lookback_counts(stream).writeStream.format("memory").queryName("lookback").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert shown(spark.table("lookback")) == want
    with pytest.raises(ValueError):
        refresh.lookback_counts(df, interval=0)


def test_components_follow_a_stream(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    batches = [[("a", "k1"), ("b", "k1"), ("c", "k2")], [("d", "k2"), ("e", "k3")], [("c", "k1"), ("e", "k4")]]
    for rows in batches:
        spark.createDataFrame(rows, "document_id string, key string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("document_id string, key string").parquet(source)
        note = lambda moved, state: seen.append((sorted(map(tuple, moved.collect())), sorted(map(tuple, state.current().collect()))))
        refresh.refreshing_components(stream, str(tmp_path / "state"), str(tmp_path / "check"), note).trigger(availableNow=True).start().awaitTermination()
    assert seen[0] == ([], [("a", "a"), ("b", "a")]) and seen[1] == ([], [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")])
    assert seen[2] == ([("c", "a")], [(x, "a") for x in "abcd"])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
