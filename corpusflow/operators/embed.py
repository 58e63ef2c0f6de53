"""Embedding as a data step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.functions.vectors import hash_vector, normalise, vector_faults


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch_size: int = 16, model: str = "custom") -> DataFrame:
    """Id, embedding, embed_model, embed_dim of chunks(id, embed_text), batch_size texts for each call of embedder.

    Blank texts and duplicate ids are refused before any call. The callable goes to the tasks; it should load its model
    once, on first use, and be safe to call again for the same texts when a task is retried.
    """
    if not chunks.where(F.trim(F.coalesce("embed_text", F.lit(""))) == "").isEmpty():
        raise ValueError("blank text")
    if not chunks.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("duplicate ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, vectors = batch.column(1).to_pylist(), []
            for i in range(0, len(texts), batch_size):
                vectors += embedder(texts[i : i + batch_size])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

    out = chunks.select(F.col("id"), "embed_text").mapInArrow(run, f"id {dict(chunks.dtypes)['id']}, embedding array<float>")
    return out.withColumn("embed_model", F.lit(model)).withColumn("embed_dim", F.size("embedding"))


def hash_embed(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """The deterministic embedder that needs no model: unit vectors out of SHA-256 of the text, in built-in functions."""
    rows = chunks.withColumn("raw", hash_vector(F.col("embed_text"), dim)).withColumn("embedding", normalise(F.col("raw")).cast("array<float>"))
    return rows.drop("raw").withColumn("embed_model", F.lit(f"fake-hash-{dim}")).withColumn("embed_dim", F.lit(dim))


def quarantine_too_long(chunks: DataFrame, most: int, measure: str = "length(embed_text)") -> tuple[DataFrame, DataFrame]:
    """(chunks of healthy documents, rejects(rel_path, ids)): one row over the limit withholds its whole document."""
    long = chunks.where(F.expr(measure) > most)
    rejects = long.groupBy("rel_path").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return chunks.join(rejects.select("rel_path"), "rel_path", "left_anti"), rejects


def validate_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Id, rule of vectors that break one; duplicate ids too."""
    n = F.count("*").over(W.partitionBy("id"))
    rules = F.concat(vector_faults(F.col("embedding"), dim), F.when(n > 1, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")))
    return vectors.select("id", rules.alias("rules")).select("id", F.explode("rules").alias("rule"))


# The wordings that a question can be embedded in.
VARIANTS = {
    "instruct": "Instruct: Given a question about a codebase, retrieve the code that answers it\nQuery: {}",
    "raw": "{}",
    "alt": "Represent this question for searching relevant code: {}",
}


def query_variants(questions: DataFrame, variants: dict[str, str] = VARIANTS) -> DataFrame:
    """E5: question_id, variant, text: each question in each wording."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.replace(F.lit(t), F.lit("{}"), F.col("question")).alias("text")) for n, t in variants.items()))).alias("p")
    return questions.select("question_id", pairs).select("question_id", "p.*")


def batch_assign(chunks: DataFrame, mode: str, size: int) -> DataFrame:
    """chunks(seq, rel_path) with batch: per_file (a file that comes back later is new) or fixed batches across files.

    seq is the order of the run from 0 on. Fixed batches follow from it; for runs of a file, the starts are numbered.
    """
    if mode == "fixed":
        return chunks.withColumn("batch", F.floor(F.col("seq") / size).cast("long"))
    before = chunks.select((F.col("seq") + 1).alias("seq"), F.col("rel_path").alias("last_path"))
    rows = chunks.join(before, "seq", "left").withColumn("starts", ~F.col("rel_path").eqNullSafe(F.col("last_path")))
    starts = rows.where("starts").select("seq", "rel_path")
    # in each file's own rows the last start before a row is the row's run; the run's first seq names the batch
    mine = W.partitionBy("rel_path").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    runs = rows.withColumn("first", F.max(F.when(F.col("starts"), F.col("seq"))).over(mine))
    within = F.floor((F.col("seq") - F.col("first")) / size)
    return runs.join(starts.select(F.col("seq").alias("first")), "first").withColumn("batch", F.concat_ws(".", "first", within.cast("string"))).select(*chunks.columns, "batch")


def even_sample(docs: DataFrame, limit: int) -> DataFrame:
    """Whole documents(pos, n_chunks), spread evenly over their order (pos from 0), for about limit chunks."""
    total = docs.agg(F.count("*").alias("n"), F.sum("n_chunks").alias("c")).first()  # two numbers
    if not total.n:
        return docs
    wanted = max(1, min(total.n, round(limit * total.n / max(total.c, 1))))
    spread = (total.n - 1) / (wanted - 1) if wanted > 1 else 0
    picks = docs.sparkSession.range(wanted).select(F.floor(F.col("id") * spread + 0.5).cast("long").alias("pos")).distinct()
    rows = docs.join(F.broadcast(picks), "pos")  # at most `limit` documents
    upto = F.sum("n_chunks").over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < limit).drop("upto")
