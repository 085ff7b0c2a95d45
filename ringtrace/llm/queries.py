"""The registered queries of this subpackage: each applies an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringtrace.llm import bpe, decontaminate, language, lexical, near_dup, negatives, packing, quality, secrets, token_counts, token_store, topk, url_filters
from ringtrace.llm.common import scratch, table, written
from ringtrace.llm.wordpiece import tokenizer_path

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False).select(*columns)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_BPE))
    return token_store.digests(spark, path)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(9, 10))


def page_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and dated list entries drawn from ``pages``: its tables have no fetch times or lists.

    A page was fetched on a day told by its id.  Each host is blocked from a day on, and one in three
    is cleared later; each domain is under review from another; host and first path segment are
    allowed for two months.
    """
    day = lambda n: (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(n.cast("int")))
    captures = pages.select("page_id", "url", day(F.col("page_id") % 366).alias("fetched_at"))
    host, head = url_filters.host_of(F.col("url")), url_filters.path_head(F.col("url"))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    first = lambda pattern: pages.filter("page_id IS NOT NULL").groupBy(pattern.alias("pattern")).agg(F.min("page_id").alias("p")).filter("pattern <> ''")
    hosts, domains, heads = first(host), first(domain), first(F.when(head == "", "").otherwise(F.concat_ws("/", host, head)))
    row = lambda df, name, action, n: df.select(F.lit(name).alias("list_name"), "pattern", F.lit(action).alias("action"), day(n).alias("listed_at"))
    p = F.col("p")
    parts = [row(hosts, "hosts", "block", p % 180), row(hosts.filter("p % 3 = 0"), "hosts", "clear", p % 180 + 120), row(domains, "domains", "review", p % 90 + 100), row(heads, "paths", "allow", p % 200), row(heads, "paths", "clear", p % 200 + 60)]
    entries = parts[0]
    for more in parts[1:]:
        entries = entries.unionByName(more)
    return captures, entries


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = page_lists(table(spark, sf_dir, "pages").select("page_id", "url"))
    out = url_filters.judged(captures, entries)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("fetched_at", "valid_from")})


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    out = language.predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), with_ids=False).drop("ids", "continued")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(docs, secrets.train(docs))
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        *[secrets.count_of(base, kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.written_out(base), 256).alias("base_sha256"),
        secrets.written_out(F.col("all_spans")).alias("spans"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(tokenizer_path(BYTE_BPE))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).drop("ids")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents with two public tokenizers: all are inserted, those of under
    five tokens are deleted, those with repeated lines are revised to their text without these, and the first
    two batches are sent again."""
    import public_tokenizers

    docs, store = table(spark, sf_dir, "documents"), scratch(spark, "rollup")
    versions = {x: tokenizer_path(x) for x in (WORD_BPE, BYTE_BPE)}
    texts = docs.select("source", "lang", "text", token_counts.without_repeated_lines(F.col("text")).alias("new_text"))
    counts = written(token_counts.counted(texts, versions, public_tokenizers.PATTERN), "counts")
    change = lambda df, op, new, old: df.select(F.lit(op).alias("op"), "source", "lang", "tokenizer", new.alias("n_tokens"), old.alias("old_tokens"))
    none, old = F.lit(None).cast("bigint"), F.col("old_tokens")
    inserts, deletes = change(counts, "insert", old, none), change(counts.filter(old < 5), "delete", none, old)
    revised = change(counts.filter((old >= 5) & F.col("n_tokens").isNotNull()), "revise", F.col("n_tokens"), old)
    for batch, changes in ((1, inserts), (2, deletes), (3, revised), (1, inserts), (2, deletes)):
        token_counts.commit(store, batch, changes)
    return token_counts.totals(spark, store)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from ringtrace.llm.oracles import ORACLES

    return dict(ORACLES)
