"""Very long texts, repeated rows, clashing columns, and cases in which an operator's method decides."""

import base64
import hashlib
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from ringtrace.llm import bpe, coder, language, near_dup, packing, quality, queries, secrets, token_counts, topk
from ringtrace.llm.common import discard, written
from ringtrace.llm.shingles import shingle_sets
from ringtrace.llm.wordpiece import tokenizer_path

LONG = " ".join(f"w{k % 9973}" for k in range(300_000))


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two near copies of 2 MB, one repeated row, and columns that clash with results."""
    rows = [(1, LONG, "en", "a"), (2, LONG + " end", "en", "a"), (3, "short words only", "en", "b"), (3, "short words only", "en", "b")]
    return spark.createDataFrame([(*r, True, 7, "x") for r in rows], "doc_id bigint, text string, lang string, source string, kept boolean, n_words int, component_id string")


def test_hosts_that_differ_by_chance_lose_nothing(spark, sf):
    rows = queries.op1_quality_rules(spark, sf)
    assert rows.filter("NOT base_failed AND NOT kept").count() == 0 < rows.filter("base_failed").count()


def test_quality_of_long_texts(long_docs):
    rows = quality.judged(long_docs).collect()
    assert sorted(r.n_words for r in rows) == [3, 3, 300_000, 300_001] and not any(r.kept for r in rows)


def test_near_duplicates_of_long_texts(long_docs):
    got = sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(long_docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3)]


def test_shingles_of_slices():
    import pyarrow as pa

    texts = pa.array(["skipped", "A b\tc d", None, "", "a B C", " x ", "y" * 400_000 + " z", "a b c d é"])
    sets = shingle_sets(texts[1:], 3)
    assert [len(x) for x in sets] == [2, 0, 0, 1, 1, 1, 3]
    assert set(sets[3]) < set(sets[0]) < set(sets[6])


def test_one_group_of_many_near_copies(spark):
    """All share a leader, in several chunks, and some link only through others."""
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base, *(f"x{k}y{j}" for j in range(k % 4))])) for k in range(90)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 3, (9, 10), block=16).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 90


def test_discarded_tables_are_gone(spark):
    table = written(spark.range(5).toDF("n"), "five")
    path = table.inputFiles()[0]
    discard(table)
    with pytest.raises(Exception, match=r"(?i)exist|found"):
        spark.read.parquet(path).count()


def test_letters():
    for text in ("½ ² ٣ 12 _ a1b été 日本", "12 _ a1b Été 日本"):
        assert language.letter_runs(text) == language.LETTERS.findall(text.lower()) == ["a", "b", "été", "日本"]


def test_language_sample_is_bounded(spark):
    rows = [(7, f"the cat and the dog {k}", "en") for k in range(200)] + [(k, "der Hund und die Katze", "de") for k in range(8, 20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_rows=10)
    out = language.predicted(spark.createDataFrame([(1, "½ ²"), (2, "der Hund"), (3, None)], "doc_id bigint, text string"), model).collect()
    assert [r.lang_pred for r in out if r.doc_id != 2] == ["und", "und"] and all(0 <= r.score <= 1 for r in out)


def test_rejection_is_calibrated(spark, sf):
    """Held-out rows: scores are near the share that is right, and few right ones are rejected."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang IS NOT NULL AND length(text) > 40")
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    rows = language.predicted(docs.filter(language.held_out(F.col("doc_id"))), model).collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert abs(np.mean([r.score for r in rows]) - np.mean(right)) < 0.1
    assert np.mean([r.rejected for r, ok in zip(rows, right) if ok]) < 0.05


def test_markov_score_is_brute_force(spark, sf):
    ratios = secrets.train(spark.read.parquet(f"{sf}/documents.parquet"))
    letters = list(secrets.ALPHABET)
    words = [base64.b64encode(hashlib.sha256(bytes([k])).digest()).decode() for k in range(40)] + ["more_of_the_same_text_and_plain_identifier"] * 2
    text = " é ".join(words)
    (row,) = secrets.scanned(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), ratios).collect()
    base = [(s.start, s.end) for s in row.base_spans]
    want = []
    blank = "".join(" " if any(a <= k < b for a, b in base) else c for k, c in enumerate(text))
    for m in re.finditer(secrets.CANDIDATE, blank):
        x = sum(ratios[letters.index(a) * len(letters) + letters.index(b)] for a, b in zip(m[0], m[0][1:]))
        if x > secrets.LEAST_SUM and x > secrets.LEAST_MEAN * len(m[0]):
            want.append((m.start(), m.end()))
    assert want and [(s.start, s.end) for s in row.all_spans if s.kind == 3] == want


def test_secrets_in_a_text_of_keys(spark):
    keys = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(4000)]
    df = spark.createDataFrame([(1, " é ".join(keys)), (2, None)], "doc_id bigint, text string")
    start = time.time()
    found = {r.doc_id: r for r in secrets.scanned(df, [0.0] * len(secrets.ALPHABET) ** 2).withColumn("clean", secrets.masked(F.col("text"), F.col("all_spans"), "<s>")).collect()}
    assert time.time() - start < 60
    assert [s.start for s in found[1].base_spans] == [k * 67 for k in range(4000)] and found[1].clean == " é ".join(["<s>"] * 4000)
    assert found[2].all_spans == [] and found[2].clean is None


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_totals(spark, n):
    values = [(k * 37) % 11 for k in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(secrets.running(F.col("v")).alias("s"), secrets.running(F.col("v"), F.greatest).alias("m")).first()
    assert row.s == [sum(values[:k]) for k in range(n)] and row.m == [max(values[:k], default=0) for k in range(n)]


def test_counts_by_tokenizer(spark, odd, none):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    paths = {x: tokenizer_path(x) for x in (queries.WORD_BPE, queries.BYTE_BPE)}
    docs = odd.withColumn("new_text", token_counts.without_repeated_lines(F.col("text")))
    word = Tokenizer.from_file(paths[queries.WORD_BPE])
    byte = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(paths[queries.BYTE_BPE]), special_tokens={})
    count = {queries.WORD_BPE: lambda t: len(word.encode(t, add_special_tokens=False).ids), queries.BYTE_BPE: lambda t: len(byte.encode_ordinary(t))}
    want = []
    for r in odd.collect():
        lines = (r.text or "").split("\n")
        new = None if len(set(lines)) == len(lines) else "\n".join(dict.fromkeys(lines))
        want += [str((r.source, r.lang, v, None if new is None else f(new), f(r.text or ""))) for v, f in count.items()]
    got = token_counts.counted(docs, paths, public_tokenizers.PATTERN)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)
    assert token_counts.counted(docs.limit(0), paths, public_tokenizers.PATTERN).count() == 0


def test_rollup_is_what_the_batches_leave(spark, sf):
    """The totals are those of the documents that are left, in their last form, counted anew."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("new_text", token_counts.without_repeated_lines(F.col("text")))
    paths = {x: tokenizer_path(x) for x in (queries.WORD_BPE, queries.BYTE_BPE)}
    want: dict = {}
    for r in token_counts.counted(docs, paths, public_tokenizers.PATTERN).collect():
        if r.old_tokens >= 5:
            n, t = want.get((r.source, r.lang, r.tokenizer), (0, 0))
            want[r.source, r.lang, r.tokenizer] = (n + 1, t + (r.old_tokens if r.n_tokens is None else r.n_tokens))
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in queries.op10_token_counts(spark, sf).collect()}
    assert got == want


def test_long_texts_through_tokenizers(spark, long_docs):
    import public_tokenizers

    ranks = bpe.read_ranks(tokenizer_path(queries.BYTE_BPE))
    rows = bpe.digests(long_docs, ranks, public_tokenizers.PATTERN).collect()
    assert {r.decoded_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(LONG.encode()).hexdigest()} and len(rows) == 4
    pieces = packing.pack(long_docs, tokenizer_path(queries.WORD_BPE), with_ids=False)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {r.doc_id: r.n // r.of for r in whole} == {1: 1, 2: 1, 3: 2}


def test_coder_beats_order_zero():
    """On ids with structure, blocks are smaller than the order-0 entropy."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3000, (400, 12))
    ids = words[rng.zipf(1.5, 20_000) % 400].reshape(-1).astype("<u4")
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all() and 8 * len(block) / len(ids) < 0.8 * entropy


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_top_k_prunes_and_is_exact(spread):
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.normal(0, 1, (700, 64)) + spread * rng.normal(0, 1, (700, 1)))).astype(np.int64)
    ids = np.arange(700) * 3
    q, c, s = topk.block_top(ids[:40], x[:40], ids, x, 5)
    scores = x[:40] @ x.T
    for k in range(40):
        want = sorted(((-int(v), int(i)) for i, v in zip(ids, scores[k]) if i != ids[k]))[:5]
        assert [(-int(v), int(i)) for i, v in zip(c[q == ids[k]], s[q == ids[k]])] == want
    assert math.isfinite(float(s.max()))
