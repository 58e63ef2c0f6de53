"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first WINDOW bytes of a suffix matter: two suffixes that agree so far are a repeat. Sorting them goes digit by
digit, the most significant first, and a suffix whose digits so far nobody shares leaves the sort. The order of a
window's digits is chosen by the window itself, so that neighbouring suffixes can go through the first passes together:

1. The first digit is the window's anchor, the SEED bytes in it with the smallest hash (the leftmost of equal ones). All
   suffixes of a stretch that have the same anchor are one item: key, the anchor's hash; context, the hash of all their
   bytes. Items of one context are copies of each other: all but the earliest are repeated throughout.
2. Where an anchor has several contexts, the earliest item of each goes on in blocks of BLOCK suffixes with the bytes
   common to the block as their key, again with a context.
3. Where those have several contexts, the earliest of each goes on suffix by suffix, with all WINDOW bytes.

Equal windows have equal anchors at equal places, so no repeat is lost on the way; after the last pass equal groups are
exactly the repeated windows. Each pass shuffles by key and sorts by key, context and place; tasks stream over their rows
and keep one row of state, however large a group is. Copies within one chunk of input are folded before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import arrays
from corpusflow.session import written

WINDOW = 100
SEED = 36
BLOCK = 16

#: kind 0: an item of `count + 1` suffixes from `start` on, its anchor `ahead` bytes after it; kind 1: bytes to remove.
#: at: start << 16 | count << 8 | ahead, or start << 16 | length.
ITEM = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("at", pa.int64())])
ITEM_DDL = "kind byte, key long, ctx long, doc long, tie long, at long"
#: A second polynomial, for contexts and whole windows. As both are modulo 2 ** 64, a third one modulo a prime goes with it.
SECOND = arrays.mixed(arrays.BYTE_VALUES)
NO_ID = -(1 << 63)


def identified(docs: DataFrame) -> DataFrame:
    """doc, tie, text: doc is the identifier (a null one the smallest); rows that share it but not the text differ in tie."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    unique = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return rows.withColumn("tie", F.lit(0).cast("long") if unique else F.xxhash64("doc", "text")).select("doc", "tie", "text")


def items_of(sums: np.ndarray, sums2: np.ndarray, prime: arrays.PrimeHashes, keys: tuple, start: np.ndarray, count: np.ndarray, ahead: np.ndarray, power) -> tuple:
    """(key, ctx) of items: keys is (start, end) of the bytes they are found by; places are those in the buffer."""
    key = arrays.mixed(arrays.span_hashes(sums, *keys, power) + (keys[1] - keys[0]).astype(np.uint64))
    ctx = arrays.span_hashes(sums2, start, start + count + WINDOW, power) ^ arrays.mixed(prime(start, start + count + WINDOW))
    return key, arrays.mixed(ctx + (count << 8 | ahead).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchored(data: np.ndarray, bounds: np.ndarray, sums: np.ndarray, power: arrays.Powers) -> tuple[np.ndarray, ...]:
    """(start, count, anchor) of the stretches of suffixes with one anchor, in places of the buffer."""
    n = len(data)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    s = np.arange(n - SEED + 1)
    small = arrays.mixed(arrays.span_hashes(sums, s, s + SEED, power))
    value = (small & np.uint64(0xFFFFFFFF00000000)) | s.astype(np.uint64)
    width, span = WINDOW - SEED + 1, 1
    while span * 2 <= width:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if width > span:
        value = np.minimum(value[: len(value) - (width - span)], value[width - span :])
    anchor = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
    p = np.arange(len(anchor))
    end = np.repeat(bounds[1:], np.diff(bounds))[: len(p)]
    p = p[p + WINDOW <= end]  # windows that don't cross into the next text
    anchor = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    return p[first], np.diff(np.append(first, len(p))) - 1, anchor[first]


def batch_of(kind, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int8)), *(pa.array(c.view(np.int64)) for c in cols)], schema=ITEM)


def covers(doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Removal of all bytes of items; the key only spreads the rows."""
    length = (at >> 8 & 0xFF) + WINDOW
    at = at >> 16 << 16 | length
    return batch_of(1, arrays.mixed(doc.view(np.uint64) + (at >> 16).view(np.uint64)), np.zeros(len(at), np.uint64), doc, tie, at)


def folded(key, ctx, doc, tie, at) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk, of items with equal key and context the earliest; the others are repeats already."""
    order = np.lexsort((at, tie, doc, ctx, key))
    key, ctx, doc, tie, at = (v[order] for v in (key, ctx, doc, tie, at))
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1])
    if again.any():
        yield covers(doc[again], tie[again], at[again])
    yield batch_of(0, *(v[~again] for v in (key, ctx, doc, tie, at)))


def first_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    power, prime = arrays.Powers(), arrays.PrimeHashes()
    for batch in batches:
        docs, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for first, data, bounds in arrays.chunks(batch.column(2)):
            sums, sums2 = arrays.prefix_sums(data, power), arrays.prefix_sums(data, power, SECOND)
            start, count, anchor = anchored(data, bounds, sums, power)
            if not len(start):
                continue
            text = np.searchsorted(bounds, start, "right") - 1
            prime.load(data)
            key, ctx = items_of(sums, sums2, prime, (anchor, anchor + SEED), start, count, anchor - start, power)
            at = (start - bounds[text]) << 16 | count << 8 | (anchor - start)
            yield from folded(key, ctx, docs[first + text], ties[first + text], at)


def next_digit(last: bool):
    """The items of docs(doc, tie, text, items) as finer ones: blocks, or single suffixes if last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, prime = arrays.Powers(), arrays.PrimeHashes()
        for batch in batches:
            docs, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            ends = np.asarray(lists.offsets)
            all_at = np.asarray(lists.values)
            for first, data, bounds in arrays.chunks(batch.column(2)):
                sums, sums2 = arrays.prefix_sums(data, power), arrays.prefix_sums(data, power, SECOND)
                own = ends[first : first + len(bounds)]
                at = all_at[own[0] : own[-1]]
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(own))
                start, count, ahead = (at >> 16) + bounds[text], at >> 8 & 0xFF, at & 0xFF
                anchor, far, near = start + ahead, ahead, ahead - count  # suffixes start far ... near before the anchor
                if last:
                    reps = far - near + 1
                    lo = hi = np.repeat(far, reps) - (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
                else:
                    reps = far // BLOCK - near // BLOCK + 1
                    block = np.repeat(near // BLOCK, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    lo = np.maximum(np.repeat(near, reps), block * BLOCK)
                    hi = np.minimum(np.repeat(far, reps), block * BLOCK + BLOCK - 1)
                anchor, text = np.repeat(anchor, reps), np.repeat(text, reps)
                start, count = anchor - hi, hi - lo
                if last:
                    keys, off = (start, start + WINDOW), np.zeros(len(start), np.int64)
                else:
                    keys, off = (anchor - block * BLOCK, anchor - block * BLOCK + WINDOW - BLOCK + 1), hi
                prime.load(data)
                key, ctx = items_of(sums, sums2, prime, keys, start, count, off, power)
                if len(start):
                    yield from folded(key, ctx, docs[first + text], ties[first + text], (start - bounds[text]) << 16 | count << 8 | off)

    return run


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, context and place: repeats become covers; where a key has several contexts, the earliest item
    of each stays an item. What spans batches is the last row, and the first item of its key if that still is the only one."""
    before: tuple | None = None  # (key, ctx, doc, tie, at) of the last row
    pending: tuple | None = None  # the only context's item of the last key
    for batch in batches:
        kind, *cols = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        done = kind == 1
        if done.any():
            yield batch.filter(pa.array(done))
        key, ctx, doc, tie, at = (c[~done] for c in cols)
        if not len(key):
            continue
        prior = before or (~key[0], 0, 0, 0, 0)
        shift = lambda v, i: np.concatenate([[prior[i]], v[:-1]])
        new_key = key != shift(key, 0)
        new_ctx = new_key | (ctx != shift(ctx, 1))
        same = ~new_ctx & (doc == shift(doc, 2)) & (tie == shift(tie, 3)) & (at == shift(at, 4))  # one row twice
        repeat = ~new_ctx & ~same
        if repeat.any():
            yield covers(doc[repeat], tie[repeat], at[repeat])
        run = np.cumsum(new_key)
        size = np.bincount(run, new_ctx, run[-1] + 1).astype(np.int64)
        several = size > 1
        if not new_key[0] and size[0]:  # the key of the last batch has a further context
            several[0] = True
            if pending:
                yield batch_of(0, *(np.array([v], np.int64) for v in pending))
                pending = None
        keep = new_ctx & several[run]
        if run[-1] > 0:
            tail = np.flatnonzero(new_ctx & (run == run[-1]))
            pending = tuple(v[tail[0]] for v in (key, ctx, doc, tie, at)) if len(tail) == 1 else None
        before = tuple(v[-1] for v in (key, ctx, doc, tie, at))
        if keep.any():
            yield batch_of(0, *(v[keep] for v in (key, ctx, doc, tie, at)))


def sorted_pass(items: DataFrame, name: str) -> DataFrame:
    return written(items.repartition("key").sortWithinPartitions("key", "ctx", "doc", "tie", "at").mapInArrow(grouped, ITEM_DDL), name)


def with_texts(items: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, tie, text, items of the documents that still have items."""
    lists = items.groupBy("doc", "tie").agg(F.collect_list("at").alias("items"))
    return docs.join(lists, ["doc", "tie"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc, tie, at: the stretches (start << 16 | length) of identified documents that also start earlier."""
    found = sorted_pass(docs.mapInArrow(first_digit, ITEM_DDL), "suffix-anchors")
    blocks = sorted_pass(with_texts(found.where("kind = 0"), docs).mapInArrow(next_digit(False), ITEM_DDL), "suffix-blocks")
    single = sorted_pass(with_texts(blocks.where("kind = 0"), docs).mapInArrow(next_digit(True), ITEM_DDL), "suffix-windows")
    parts = [t.where("kind = 1").select("doc", "tie", "at") for t in (found, blocks, single)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for each row of docs(doc_id, text, ...).

    Every byte covered by a string of WINDOW bytes that also starts earlier (smaller doc_id, or same document, earlier
    start) is removed; strings are judged on the input. Null and empty texts have no bytes. A null doc_id counts as the
    smallest. Rows that share doc_id and text are one document, whose result each of them gets; rows that share only the
    doc_id follow each other by a hash of the text. Other columns are ignored; an empty table gives no rows.
    """
    rows = identified(docs)
    gone = repeats(rows.where(F.octet_length("text") >= WINDOW)).groupBy("doc", "tie").agg(F.collect_list("at").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            for text, spans in zip(texts, batch.column(2)):
                data = np.frombuffer(text.as_py(), np.uint8)
                removed = runs = 0
                kept = data
                if spans.is_valid:
                    at = spans.values.to_numpy()
                    mark = np.zeros(len(data) + 1, np.int64)
                    np.add.at(mark, at >> 16, 1)
                    np.add.at(mark, (at >> 16) + (at & 0xFFFF), -1)
                    cut = np.cumsum(mark)[:-1] > 0
                    removed, runs = int(cut.sum()), int(np.count_nonzero(cut[1:] & ~cut[:-1]) + cut[:1].sum())
                    kept = data[~cut]
                own = kept.tobytes()
                out.append((len(data), removed, runs, hashlib.sha256(own).hexdigest(), own))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(gone, ["doc", "tie"], "left")
    own_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return joined.select(own_id, "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
