import corpus_pipeline
from ringtrace.llm import near_dup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near duplicates", "secret scan", "packing"]
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(docs.count())
        if k == 2:
            assert near_dup.near_duplicates(docs).filter("component_id <> doc_id").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}


def test_odd_rows_pass_through(spark, odd, none, sf):
    """Nulls, empty texts, repeated rows and clashing columns: what each stage makes of them."""
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    every = ids(odd)
    for name, stage in stages.items():
        assert stage(spark, none, sf).count() == 0, name
    # under 20 words, or mostly repeated: gone
    assert ids(stages["quality rules"](spark, odd, sf)) == [1]
    # no letters: gone
    assert not {2, 3, 4, 9} & set(ids(stages["language ID"](spark, odd, sf)))
    # rows that repeat an id are one document; a row without an id stays
    assert ids(stages["near duplicates"](spark, odd, sf)) == every
    assert ids(stages["secret scan"](spark, odd, sf)) == every
    assert set(ids(stages["packing"](spark, odd, sf))) == set(every)
