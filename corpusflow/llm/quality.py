"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its words and pairs of neighbouring words, each in two forms: as they stand (A-Z lower-cased) and
as shapes (letters and digits reduced to one sign for a run, marks kept), hashed to 2 ** BITS buckets; a feature's value
is its share of the words. A score is the sparse dot product with the weights, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import arrays

BITS = 18
#: At most so many labelled rows are learned from: those with the smallest hash of their identifier.
SAMPLE = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.1, 0.5
#: Words in a text at which a feature's share counts as one.
SCALE = 20.0
THRESHOLD = 0.3

#: a: letters beyond ASCII and a-z, A: capitals, 0: digits, white space as it is, marks as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48


def features(data: np.ndarray, bounds: np.ndarray, power: arrays.Powers) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text): four buckets for each word, of the word, its shape, and both with the word before it."""
    starts, ends, text = arrays.words(data, bounds)
    lower = arrays.span_hashes(arrays.prefix_sums(arrays.TO_LOWER[data], power), starts, ends, power)
    shape = SHAPE[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    kept = np.ones(len(data), bool)
    kept[1:] = (shape[1:] != shape[:-1]) | first[1:-1]  # of a run within a word the first sign stays
    at = np.concatenate([[0], np.cumsum(kept)])
    form = arrays.span_hashes(arrays.prefix_sums(shape[kept], power), at[starts], at[ends], power)
    out = []
    same_text = np.concatenate([[False], text[1:] == text[:-1]])[: len(text)]
    for salt, h in enumerate((lower, form)):
        before = np.where(same_text, np.concatenate([h[:1], h[:-1]]), np.uint64(0))
        again = same_text & (before == h)  # a repeated word is a feature whatever the word is
        pair = np.where(again & (salt == 0), np.uint64(1), before * np.uint64(31) + h)
        out += [arrays.mixed(h + np.uint64(4 * salt + 1)), arrays.mixed(pair ^ np.uint64(0x632BE59BD9B4E019 + salt))]
    return (np.stack(out, axis=1) >> np.uint64(64 - BITS)).astype(np.int64), text


def vectors(column: pa.Array, power: arrays.Powers) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, values) of each text that has words."""
    for first, data, bounds in arrays.chunks(column):
        buckets, text = features(data, bounds, power)
        n = np.bincount(text, minlength=len(bounds) - 1)
        for k, (lo, hi) in enumerate(zip(np.cumsum(n) - n, np.cumsum(n))):
            if hi > lo:
                found, counts = np.unique(buckets[lo:hi], return_counts=True)
                yield first + k, found, counts * (SCALE / (hi - lo))


def logistic(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Weights by per-coordinate FTRL-proximal updates over the rows in order; the last is the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (at, values), label in zip(rows, labels):
            at, values = np.append(at, size), np.append(values, 1.0)
            w = weights(at)
            g = (logistic(w @ values) - label) * values
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most `sample` labelled documents(doc_id, text) that aren't held out, in one task.

    labels(doc_id, quality): rows with a null are left out; of several rows of one document the smallest label counts, and of
    several texts of one doc_id the smallest.
    Without any labelled document all weights are 0 and every score one half.
    """
    own = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded set, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # so many rows, however often a doc_id stands
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marks, power = [], [], arrays.Powers()
        for batch in batches:
            quality = batch.column(2).to_pylist()
            for row, at, values in vectors(batch.column(1), power):
                seen.append((at.astype(np.int32), values.astype(np.float32)))
                marks.append(int(quality[row] > 0))
        w = learn(seen, marks) if seen else np.zeros(1)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["bucket", "weight"])

    out = np.zeros((1 << BITS) + 1)
    for bucket, weight in rows.mapInArrow(fit, "bucket long, weight double").collect():  # at most 2 ** BITS + 1 rows
        out[bucket] = weight
    return out


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with a column score appended, between 0 and 1. docs needs a column text and none called score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, w = arrays.Powers(), shared.value
        for batch in batches:
            z = np.full(batch.num_rows, float(w[-1]))
            for first, data, bounds in arrays.chunks(batch.column(batch.schema.get_field_index("text"))):
                buckets, text = features(data, bounds, power)
                if len(text):
                    n = np.bincount(text, minlength=len(bounds) - 1)
                    z[first : first + len(n)] += np.bincount(text, w[buckets].sum(axis=1), len(n)) * SCALE / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logistic(z))], names=[*batch.schema.names, "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{types}, score double")


def classify(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text, ...), learned from labelled and labels.

    Scores use the text alone. Empty, null and blank texts have the score of the bias. Repeated rows get equal scores.
    Rows with a null doc_id are not held out, and can't be labelled. Other columns are ignored; an empty table gives no
    rows.
    """
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), train(labelled, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
