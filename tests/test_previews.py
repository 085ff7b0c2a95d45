import random

from ringtrace.operators import previews

CUT = lambda text, n: text if len(text) <= n else text[: n - 1] + "…"


def _tables(spark, docs, classes, edges, media):
    return (
        spark.createDataFrame(docs, "document_id string, published_at string, created_at string, platform string, author_name string, title string, body string, severity string, agent_run_id string, url string, _marks string"),
        spark.createDataFrame(classes, "document_id string, primary_category string, confidence double, severity int, note string"),
        spark.createDataFrame(edges, "document_id string, kind string, display_value string, position int"),
        spark.createDataFrame(media, "document_id string, vision_status string"),
    )


def test_documents_as_rows(spark):
    docs = [
        ("a", None, "2024-01-02T03:04:05Z", "", None, "", "  long " + "x" * 400 + " ", "4", "run-1", "https://a.example", "clash"),
        ("b", "2024-02-03", "2023-01-01", "web", "An", "Title", "body", None, None, None, "clash"),
        ("b", "2024-02-03", "2023-01-01", "web", "An", "Title", "body", None, None, None, "clash"),
        ("c", "", "", None, "", None, None, "no number", "", "", None),
        (None, None, None, None, None, None, None, None, None, None, None),
    ]
    marks = [("a", "phone", f"0{i:09d}", i) for i in range(500)] + [("b", None, "plain", 1), ("b", "email", "z@x", 0), ("b", "email", "a@x", 0), ("b", "email", "", 2), ("b", "email", None, 3)]
    random.Random(1).shuffle(marks)
    out = previews.document_table(*_tables(spark, docs, [("b", "noise", 0.5, 2, "n"), ("a", "", None, None, "n")], marks, [("b", "read"), ("b", "pending"), ("b", "read"), ("b", ""), ("b", None), ("c", None)]))
    rows = sorted((tuple(r) for r in out.collect()), key=lambda r: r[0] or "")
    a = CUT(", ".join(f"phone: 0{i:09d}" for i in range(500)), 300)
    none = ("—", "—", "—", "", "—", None, None, "—", "No", "—", "")
    b = ("b", "2024-02-03", "web", "An", "Title", "noise", 0.5, 2.0, "email: a@x, email: z@x, plain", "No", "pending, read", "")
    assert rows == [(None, *none), ("a", "2024-01-02 03:04:05 UTC", "—", "—", CUT("long " + "x" * 400, 180), "—", None, 4.0, a, "Yes", "—", "https://a.example"), b, b, ("c", *none)]
    assert len(a) == 300 and len(rows[1][4]) == 180
    assert previews.document_table(*_tables(spark, [], [], [], [])).collect() == []


def test_short_marks_fill_the_cell_before_they_are_cut(spark):
    docs = [("a", *[None] * 10)]
    marks = [("a", None, "x", i) for i in range(150)]
    (row,) = previews.document_table(*_tables(spark, docs, [], marks, [])).collect()
    assert row.indicators == CUT(", ".join("x" for _ in marks), 300)


def test_events_jobs_and_clusters_as_rows(spark):
    events = spark.createDataFrame([("2024-01-01T00:00:00Z", None, "fetch", "m" * 401, {"k": "v" * 600}, 1), (None, "error", "", "  told ", None, 2)], "timestamp string, level string, stage string, event string, data map<string,string>, extra int")
    assert [tuple(r) for r in previews.event_table(events).collect()] == [
        ("2024-01-01 00:00:00 UTC", "INFO", "fetch", "m" * 399 + "…", CUT('{"k":"' + "v" * 600 + '"}', 500)),
        ("—", "ERROR", "—", "told", ""),
    ]
    jobs = spark.createDataFrame([(None, "n", 3, "x", None), ("j", None, None, None, "2024-01-01")], "name string, job_name string, discovered_count int, failed_count string, updated_at string")
    assert [tuple(r) for r in previews.job_table(jobs).collect()] == [("n", "—", "—", "—", 3, 0, 0, 0, 0, "—"), ("j", "—", "—", "—", 0, 0, 0, 0, 0, "2024-01-01")]
    clusters = spark.createDataFrame([("k", 5.2, 3, 4, 2, ["a", "b"], None), ("l", None, 2, 1, 0, None, "2024-05-06T00:00:00Z")], "campaign_key string, risk_score double, document_count int, maximum_severity int, shared_count int, scam_types array<string>, last_seen string")
    assert [tuple(r) for r in previews.cluster_table(clusters).collect()] == [("k", 5.2, 3, 4, 2, "a, b", "—"), ("l", None, 2, 1, 0, None, "2024-05-06 00:00:00 UTC")]
