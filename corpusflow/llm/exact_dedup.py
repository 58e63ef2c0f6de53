"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Memtables: each input task sorts the entries of its rows (digest, identifier, number of the row) by digest and flushes them
as a run; nothing is shuffled. Filters: from the runs' 64-bit keys, a table of those that stand more than once; it is
probed by all entries, and what it doesn't have is a text of its own. Compaction merges only what the filter lets through
into one entry for each digest: how many rows, the row that stays, and the smallest identifier of the group as the
entry's name. Only entries of two rows or more are hits; the texts of hits, and no others, are compared byte for byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.text import lower_az, small_enough
from corpusflow.session import written

#: At most so many keys or digests (8 and 32 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000


def flush_runs(docs: DataFrame) -> DataFrame:
    """The runs: digest, key, doc_id, number; each task's sorted by digest."""
    digest = F.unhex(F.sha2(lower_az(F.col("text")), 256))
    rows = docs.select("doc_id", digest.alias("digest"), F.monotonically_increasing_id().alias("number"))
    return rows.withColumn("key", F.xxhash64("digest")).sortWithinPartitions("digest")


def filter_of(runs: DataFrame) -> DataFrame:
    """key of those that several entries have. Entries fold in the tasks that read them, so a hot key moves once a task."""
    return runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def compact(entries: DataFrame) -> DataFrame:
    """One entry for each digest: first_id (the smallest), keep (the largest doc_id, and of its rows one number), group_size."""
    return entries.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max(F.struct("doc_id", "number")).alias("keep"), F.count("*").alias("group_size"))


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_DIGESTS) else df


def hit_texts(docs: DataFrame, index: DataFrame) -> DataFrame:
    """digest, doc_id and normalised text of the rows whose digest is a hit."""
    hits = few(index.where("group_size > 1").select("digest"))
    text = lower_az(F.col("text"))
    return docs.select("doc_id", text.alias("t"), F.unhex(F.sha2(text, 256)).alias("digest")).join(hits, "digest")


def clashes(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Digests that stand for more than one text, found by grouping the bytes themselves.

    SHA-256 makes this empty in practice; it is what makes the result exact without trusting the digest. Copies fold in
    the task that reads them, so that a large group of them moves once for each task.
    """
    texts = hit_texts(docs, index).groupBy("digest", "t").agg(F.lit(1).alias("one"))
    return texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, first_id for each row of docs(doc_id, text, ...).

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts the row with the
    largest doc_id stays; of rows that also share that doc_id, one. A null doc_id counts as smaller than any number, and
    a group of nothing else has a null keep_id. Other columns of docs are ignored. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    runs = written(flush_runs(docs), "dedup-runs")
    several = few(written(filter_of(runs), "dedup-filter"))
    found = runs.join(several, "key", "left_semi")
    index = written(compact(found), "dedup-index")
    odd = written(clashes(docs, index), "dedup-clashes")
    alone = runs.join(several, "key", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", F.col("doc_id").alias("first_id")
    )
    joined = found.join(few(index), "digest").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("number") == F.col("keep.number")).alias("kept"), "digest", "first_id")
    if not odd.isEmpty():
        joined = joined.join(odd, "digest", "left_anti").unionByName(split_by_text(docs, index, odd))
    return alone.unionByName(joined).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "first_id")


def split_by_text(docs: DataFrame, index: DataFrame, odd: DataFrame) -> DataFrame:
    """The rows of clashing digests, grouped by the text itself."""
    entry = [F.min("doc_id").alias("first_id"), F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")]
    others = hit_texts(docs, index).join(odd, "digest").groupBy("digest", "t", "doc_id").agg(F.count("*").alias("n"))
    own = others.join(others.groupBy("digest", "t").agg(*entry), ["digest", "t"])
    rows = own.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "first_id")
