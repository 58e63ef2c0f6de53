"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

All stages but the last return the columns of documents. A stage that drops documents numbers its rows first and decides by
these numbers, so that rows that share a doc_id, have none or stand repeatedly are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, line_dedup, ngram_join, packing, quality
from corpusflow.llm.text import small_enough
from corpusflow.session import dropped, kept, scratch, written

#: Numbers of dropped rows (8 bytes each) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def numbered(docs: DataFrame) -> DataFrame:
    """doc (the row as it came), row (its number), written so that the numbers are the same whenever they are read."""
    return written(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "pipeline-rows")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of numbered rows whose number is not in gone(row)."""
    gone = written(gone, "pipeline-gone")
    return rows.join(F.broadcast(gone) if small_enough(gone, BROADCAST_ROWS) else gone, "row", "left_anti").select("doc.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of docs, doesn't reject."""
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), "text")
    return quality.score(whole, weights).where(F.col("score") >= quality.THRESHOLD).select("doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated line runs."""
    return line_dedup.without_repeats(docs)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; documents without words stay."""
    rows = numbered(docs)
    return without(rows, ngram_join.later_copies(rows.select("doc.doc_id", "row", "doc.text")))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    rows = numbered(docs)
    hits = decontaminate.decontaminate(rows.select("doc.doc_id", "doc.text", "row"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), near=False, row="row")
    return without(rows, hits.where("contaminated").select("row"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", ngram_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the classifier, the line spans or the tokenizer: tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. A stage's intermediate tables, and its input, go when its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = kept(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            dropped(before)
        before = docs
    return docs
