import duckdb
import pytest
from pyspark.sql import functions as F
from ringtrace.operators.common import digest, listed
from ringtrace.plans import oracles, queries


def by_sql(sql, sf):
    con = duckdb.connect()
    for name in ("orders", "customer", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con.execute(sql).df()


def test_digest_is_of_the_set(spark):
    ids = spark.range(500).select(F.col("id").cast("string"))
    whole = ids.agg(digest("id")).first()[0]
    assert ids.orderBy(F.desc("id")).repartition(7).agg(digest("id")).first()[0] == whole
    assert ids.filter("id <> '7'").agg(digest("id")).first()[0] != whole
    assert ids.limit(0).agg(digest("id")).first()[0] is None


def test_lists_are_whole_and_in_parts(spark):
    rows = spark.range(2600).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("key"), F.col("id").cast("string").alias("v"))
    got = listed(rows.union(rows), ["key"], "v", "vs").toPandas()
    assert sorted(got.key) == ["hot"] * 3 + ["k0", "k1", "k2"] and set(got.part[got.key != "hot"]) == {0}
    assert sorted(",".join(got.vs).split(",")) == sorted(str(i) for i in range(2600)) and max(len(x.split(",")) for x in got.vs) < 1200
    con = duckdb.connect()
    con.register("rows_", rows.toPandas())
    want = con.execute("SELECT * FROM " + oracles._listed("rows_", "key", "v", "vs")).fetchall()
    assert sorted(want) == sorted(map(tuple, got.values.tolist()))


@pytest.mark.parametrize("name", ["a1_summary", "a2_by_category", "a3_by_severity", "a4_by_indicator", "a6_clusters", "g3_memberships"])
def test_evidence_is_returned_and_equals_the_sql(spark, sf, name):
    out = queries.queries()[name](spark, sf)
    column = {"a1_summary": "ids", "g3_memberships": "reasons", "a6_clusters": "shared_keys"}.get(name, "evidence_document_ids")
    assert column in out.columns
    want = by_sql(oracles.ORACLES[name], sf)
    assert sorted(want.columns) == sorted(out.columns)
    assert sorted(map(str, want[out.columns].values.tolist())) == sorted(map(str, out.toPandas().values.tolist()))


def test_evidence_is_that_of_all_documents(spark, sf):
    docs, edges = queries._cases(spark, sf)
    assert queries.a1_summary(spark, sf).first().ids == docs.agg(digest("document_id")).first()[0]
    lists = queries.a4_by_indicator(spark, sf).select("key", F.explode(F.split("evidence_document_ids", ",")).alias("document_id"))
    assert lists.count() == edges.select("key", "document_id").distinct().count() == lists.join(edges, ["key", "document_id"], "left_semi").count()
    g = queries._clusters(spark, sf)[2]
    keys = queries.a6_clusters(spark, sf).select("component", F.explode(F.split("shared_keys", ",")).alias("key"))
    assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, g.keys.filter("n > 1").select("component", "key").collect()))
