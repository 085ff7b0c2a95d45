from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from ringtrace.llm import common, language, near_dup
from ringtrace.llm.shingles import shingles


@pytest.fixture(scope="module")
def many(spark):
    """A partition that comes as one batch of Arrow."""
    return spark.createDataFrame([(i, f"a b c d e {i % 50} f g {i} h i j k l m") for i in range(3000)], "doc_id bigint, text string").coalesce(1)


def test_slices_are_small_and_whole():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"]) for n in (0, 1, 512, 1300)]
    got = list(common.slices(batches))
    assert [x for b in got for x in b.column(0).to_pylist()] == [x for n in (0, 1, 512, 1300) for x in range(n)] and max(b.num_rows for b in got) == 512


def test_a_batch_is_shingled_in_slices(many, monkeypatch):
    def few(texts, words):
        assert len(texts) <= 512
        return shingles(texts, words)

    monkeypatch.setattr(near_dup, "shingles", few)
    assert near_dup._frequent(many, 5).num_rows


@pytest.mark.parametrize("counted", [7, 1000, 10_000_000])
def test_frequent_shingles_are_counted_in_bounded_runs(many, monkeypatch, counted):
    monkeypatch.setattr(near_dup, "COUNTED", counted)
    found = shingles(pa.array([r.text for r in many.collect()]), 5)[0]
    want: Counter = Counter()
    for k in range(0, len(found), counted):
        want.update({h: n for h, n in zip(*(x.tolist() for x in np.unique(found[k : k + counted].view(np.int64), return_counts=True))) if n > 1})
    got = near_dup._frequent(many, 5).to_pydict()
    assert dict(zip(got["h"], got["n"])) == {h: n for h, n in want.items() if n >= 8}


def test_slices_change_no_prediction(many):
    labels = ["en", "de"]
    rng = np.random.default_rng(1)
    model = language.Model(labels, rng.normal(0, 1, (1 << language.BUCKET_BITS, 2)), np.zeros(2), 0.1)
    whole = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in language.predicted(many, model).collect()}
    apart = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in language.predicted(many.repartition(40), model).collect()}
    assert whole == apart and len(whole) == 3000


def test_a_bound_value_is_evaluated_once_and_typed_once(spark):
    """A fold of nothing: no ``transform`` whose type is worked out at each use."""
    from pyspark.sql import functions as F
    from ringtrace.llm import bpe

    df = spark.range(3).select(bpe.let(F.col("id") + 1, lambda x: bpe.let(x * 2, lambda y: F.array(x, y, y))).alias("v"))
    assert [r.v for r in df.collect()] == [[1, 2, 2], [2, 4, 4], [3, 6, 6]]
    assert "transform" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_lie_in_short_buckets():
    from ringtrace.llm import bpe, wordpiece

    ranks = bpe.read_ranks(wordpiece.tokenizer_path("byte_bpe_50k.tiktoken"))
    sizes = Counter(bpe.bucket(ranks[t[:k]], ranks[t[k:]]) for t in ranks for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
    assert max(sizes.values()) <= 10
