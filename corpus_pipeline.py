"""From raw documents to packed training sequences: each stage's decisions take effect for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringtrace.llm import language, near_dup, packing, quality, secrets
from ringtrace.llm.common import written
from ringtrace.llm.queries import WORD_BPE
from ringtrace.llm.wordpiece import tokenizer_path

#: Put before the columns that a stage adds, so that they do not clash with those of documents.
OWN = "_stage_"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and, on untrusted hosts, the further ones.

    A null or empty text has no words and goes; a null source is a host of its own; repeated rows share their fate.
    """
    return quality.judged(docs, prefix=OWN).filter(F.col(f"{OWN}kept")).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; the model learns from this stage's input.

    A null text, or one without letters, has no language and goes; repeated rows share their fate.
    """
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.predicted(docs, model, OWN).filter(~F.col(f"{OWN}rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id; documents without an id stay.

    A text has near copies if its sets of 5-word shingles have a similarity of 0.8 or more.  Null and
    empty texts have none and stay; rows that repeat an id are one document and stay together.
    """
    groups = near_dup.near_duplicates(docs, words=5, threshold=(4, 5))
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias(f"{OWN}id")).distinct()
    return docs.join(written(gone, "gone"), F.col("doc_id") == F.col(f"{OWN}id"), "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark; n_chars follows the new text.

    Null and empty texts, and those without secrets, stay as they are; repeated rows are masked alike.
    """
    found = secrets.scanned(docs, secrets.train(docs), OWN)
    spans = F.col(f"{OWN}all_spans")
    text = F.when(F.size(spans) > 0, secrets.masked(F.col("text"), spans, "<secret>")).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens; a null or empty text is its end id alone; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("packing", pack),
]

#: No SQL: the language and secret models, the tokenizer and the packing order are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
