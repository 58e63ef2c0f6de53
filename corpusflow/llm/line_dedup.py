"""Line-level deduplication by distributed prefix doubling over line identifiers.

A document is a sequence of lines, a line's identifier a 128-bit digest of its bytes. From each line starts a window: the
fewest lines from there on that have MIN_WORDS words together, and at each line ends one: the fewest lines up to it. A line
is removed if any window over it also starts earlier in the corpus (smaller doc_id, or the same document and an earlier
line). Both kinds of windows together cover exactly the maximal repeated runs of at least MIN_WORDS words: a line of such a
run either starts a window within it, or has less than a window up to the run's end and so lies in the window that ends there.
Without `whole` only windows that start at a line count, and the tails of runs stay.

Prefix doubling ranks the suffixes: rank 0 is the line's identifier, and rank k + 1 joins rank k here with rank k 2**k
lines on. Before each doubling, suffixes whose rank no other one has are dropped with all that they could still match:
after the first round only repeated lines move. A window of m lines, 2**k <= m < 2**(k + 1), equals another one exactly
if both overlapping stretches of 2**k lines that cover it have equal ranks. Ranks are 128-bit digests instead of places in
a sorted order, as only their equality is used; that spares a global sort each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.text import small_enough
from corpusflow.session import written

MIN_WORDS = 50
#: Documents with removed lines up to which their spans are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: A rank is hot if it has more than one in HOT of the repeated suffixes: so there are fewer than HOT hot ones.
HOT = 1000

SUFFIX = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("m", pa.int32()), ("back", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def key(docs: DataFrame) -> Column:
    """Rows that share identifier and text are one document, whose result each of them gets."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, row, pos, m, back, a, b for each line: m lines from it make its window (0: the text ends before), (a, b) is rank 0.

    back: so many lines up to it make the window that ends there (0: the text starts after, or that is a line's m already).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in SUFFIX]
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.encode().split(b"\n")
                n = len(lines)
                sums = np.cumsum([0, *(len(x.split()) for x in lines)])
                ends = np.searchsorted(sums, sums[:-1] + min_words)  # the first end with enough words
                m = np.where(ends <= n, ends - np.arange(n), 0)
                starts = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1  # the last start with enough words
                back = np.where((starts >= 0) & (ends[starts] != np.arange(n) + 1), np.arange(n) + 1 - starts, 0)
                ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), np.int64).reshape(-1, 2)
                for cs, v in zip(out, (np.full(n, doc_id or 0), np.full(n, row), np.arange(n), m, back, ids[:, 0], ids[:, 1])):
                    cs.append(v)
            if out[0]:
                cols = [np.concatenate(cs) for cs in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SUFFIX)], schema=SUFFIX)

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), key(docs).alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, pos int, m int, back int, a long, b long").dropDuplicates(["row", "pos"])


def ahead(some: DataFrame, suffix: DataFrame, far: Column) -> DataFrame:
    """some with (a2, b2), the rank of the suffix that starts `far` lines on in the same document."""
    other = suffix.select("row", F.col("pos").alias("at"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return some.withColumn("at", F.col("pos") + far).join(other, ["row", "at"])


def digest(*parts: str) -> list[Column]:
    """Two independent 64-bit digests of the parts."""
    return [F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *reversed(parts)).alias("b")]


def matched(rows: DataFrame, ranks: DataFrame, how: str) -> DataFrame:
    """rows joined with written ranks(a, b, n, ...): hot ones, such as that of a line that very many documents have, by a
    broadcast of fewer than HOT rows, so that they stay where they are; the others by a shuffle."""
    total = ranks.agg(F.sum("n")).first()[0] or 0
    hot = ranks.where(F.col("n") * HOT > total).drop("n")
    if hot.isEmpty():
        return rows.join(ranks.drop("n"), ["a", "b"], how)
    cold = rows.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti")
    return rows.join(F.broadcast(hot), ["a", "b"], how).unionByName(cold.join(ranks.where(F.col("n") * HOT <= total).drop("n"), ["a", "b"], how))


def repeated(suffix: DataFrame) -> DataFrame:
    """Those whose rank another suffix has too. The counts fold in the tasks that read the rows."""
    many = written(suffix.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"), "lines-many")
    return matched(suffix, many, "left_semi")


def windows(suffix: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, row, pos, m, a, b of windows, (a, b) a digest of their lines, leaving out those that can't be repeated."""
    out = None
    ends = suffix.where("back > 0").select("doc_id", "row", (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("m"))
    step, longest = 1, suffix.agg(F.max(F.greatest("m", "back") if whole else "m")).first()[0] or 0
    suffix = suffix.drop("back")
    while step <= longest:
        suffix = written(repeated(suffix), "lines-rank")
        mine = (F.col("m") >= step) & (F.col("m") < 2 * step)
        asked = suffix.where(mine)
        if whole:
            asked = asked.unionByName(ends.where(mine).join(suffix.drop("doc_id", "m"), ["row", "pos"]))
        last = ahead(asked, suffix, F.col("m") - step)
        done = written(last.select("doc_id", "row", "pos", "m", *digest("m", "a", "b", "a2", "b2")), "lines-window")
        out = done if out is None else out.unionByName(done)
        suffix = ahead(suffix, suffix, F.lit(step)).select("doc_id", "row", "pos", "m", *digest("a", "b", "a2", "b2"))
        step *= 2
    return suffix.limit(0) if out is None else out


def covered(docs: DataFrame, min_words: int = MIN_WORDS, whole: bool = True) -> DataFrame:
    """row, spans: the windows (pos, m) of each document that start earlier somewhere else."""
    found = windows(written(suffixes(docs, min_words), "lines-suffix"), whole)
    place = F.struct("doc_id", "row", "pos")
    first = written(found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "lines-first")
    later = matched(found, first, "inner").where(place != F.col("first"))
    return later.groupBy("row").agg(F.collect_list(F.struct("pos", "m")).alias("spans"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, whole: bool = True) -> DataFrame:
    """doc (the row of docs as it came), kept_text, n_lines, n_removed, n_spans for each row of docs(doc_id, text, ...).

    n_spans counts maximal runs of removed lines. A null text stays null and has no lines; an empty one has one empty
    line. A null doc_id counts as 0; rows that share doc_id and text are one document, rows that share only the doc_id
    follow each other by a hash of the text. Blank and short lines go only as parts of repeated windows. Other columns
    come along in doc, whatever their names; an empty table gives no rows. whole: repeated runs of at least min_words words
    go up to their last line; without it up to min_words - 1 words of their tails stay.
    """
    spans = written(covered(docs.select("doc_id", "text"), min_words, whole), "lines-covered")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), key(docs).alias("row"))
    few = F.broadcast(spans) if small_enough(spans, BROADCAST_ROWS) else spans
    joined = rows.join(few, "row", "left").select("doc", F.col("doc.text").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = [] if text is None else text.split("\n")
                gone = np.zeros(len(lines) + 2, np.int32)
                for s in spans or ():
                    gone[s["pos"]] += 1
                    gone[s["pos"] + s["m"]] -= 1
                gone = np.cumsum(gone)[: len(lines)] > 0
                runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(lines) else 0
                kept = text if not runs else "\n".join(x for x, g in zip(lines, gone) if not g)
                out.append((kept, len(lines), int(gone.sum()), runs))
            kept, n, removed, runs = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), *(pa.array(v, pa.int64()) for v in (n, removed, runs))],
                names=["doc", "kept_text", "n_lines", "n_removed", "n_spans"],
            )

    return joined.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, kept_text string, n_lines long, n_removed long, n_spans long")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_chars, where there is one, counted anew."""
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return line_dedup(docs, min_words).select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
