"""Best-fit packing of tokenised documents by length patterns.

The lengths of all pieces make a histogram of at most 2048 bins, whatever the corpus. Patterns of two and three lengths
that fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by non-negative least squares,
rounded, and what is left is packed best fit, longest first, on the histogram too. The plan is a table of intervals
(length, first and last index of that length, sequence, offset); each piece finds its place by its index among the pieces
of its length, which is counted in the task that made the piece and shifted by the counts of the tasks before it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.text import small_enough
from corpusflow.session import written

SEQUENCE = 2048
END_ID = 0
#: Steps of the least-squares fit, and patterns that take part: more would share the same pieces in ever smaller counts.
STEPS = 300
PATTERNS = 16384
#: Rows of interval or count tables up to which they are broadcast.
BROADCAST_ROWS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids array<int>"


class Tokens:
    """Token ids as the tokenizers library gives them for the file `<name>.json`.

    Plain text goes through tiktoken with the same vocabulary and pattern (`<name>.tiktoken`), which gives the same ids
    several times faster; text with characters past Latin, where the libraries' Unicode tables may differ, doesn't.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.slow = Tokenizer.from_file(json_path)
        self.special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def __call__(self, text: str) -> list[int]:
        if text.isascii() or max(text) < "ɐ":
            return self.fast.encode(text, allowed_special="all")
        return self.slow.encode(text, add_special_tokens=False).ids


def public_tokens(name: str = "byte_bpe_50k") -> Tokens:
    import public_tokenizers

    return Tokens(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, the others have the full size."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer=public_tokens, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row for each piece of docs(doc_id, text), with task and nth: its place among the task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = tokenizer(), Counter(), TaskContext.get().partitionId()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                for k, (start, n) in enumerate(cuts(len(ids), size)):
                    own = ids[start : start + n]
                    rows.append((doc_id, k, start, n, zlib.crc32(own.tobytes()), task, seen[n], own.tolist() if with_ids else None))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def exact_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of two or three lengths (0: none) out of lengths that add up to size: all pairs, and triples spread evenly."""
    has = np.zeros(size + 1, bool)
    has[lengths] = True
    out = [np.array([[a, size - a, 0] for a in lengths if a <= size - a and has[size - a]], dtype=np.int64).reshape(-1, 3)]
    for a in lengths[lengths <= size // 3]:
        b = lengths[(lengths >= a) & (lengths <= (size - a) // 2)]
        b = b[has[size - a - b]]
        out.append(np.stack([np.full_like(b, a), b, size - a - b], axis=1))
    pairs, triples = out[0], np.concatenate(out[1:]) if out[1:] else out[0][:0]
    room = max(1, PATTERNS - len(pairs))
    return np.concatenate([pairs, triples[:: -(-len(triples) // room) or 1]])


def fitted(histogram: np.ndarray, patterns: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 with the least squares of (lengths used by x) - histogram, by accelerated projected gradient.

    Each length weighs by its square root, so that long pieces, which are hard to place, are fitted first.
    """
    n = len(histogram)
    weight = np.arange(n, dtype=float)
    weight[0] = 0
    uses = lambda x: np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), minlength=n)
    # the largest row sum bounds the largest eigenvalue
    back = lambda r: (r * weight)[patterns].sum(axis=1)
    step = 1 / max(back(uses(np.ones(len(patterns)))).max(), 1e-9)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(uses(y) - histogram))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that pack the histogram `left`, longest first, each into the fullest sequence it fits."""
    open_: dict[int, list[list]] = {}  # room -> [lengths, repeats]
    rooms = np.zeros(size + 1, np.int64)
    for n in range(len(left) - 1, 0, -1):
        todo = int(left[n])
        while todo:
            fits = np.flatnonzero(rooms[n:])
            if not len(fits):
                each = size // n  # a new sequence takes as many of this length as it can
                for lengths, repeats in (((n,) * each, todo // each), ((n,) * (todo % each), 1)):
                    if lengths and repeats:
                        room = size - n * len(lengths)
                        open_.setdefault(room, []).append([lengths, repeats])
                        rooms[room] += repeats
                break
            room = n + int(fits[0])
            group = open_[room][-1]
            each = room // n
            k = min(group[1], -(-todo // each))
            now = min(each, todo // k)
            group[1] -= k
            rooms[room] -= k
            if not group[1]:
                open_[room].pop()
            open_.setdefault(room - n * now, []).append([group[0] + (n,) * now, k])
            rooms[room - n * now] += k
            todo -= k * now
    return [(lengths, repeats) for groups in open_.values() for lengths, repeats in groups]


def plan(histogram: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): sequences that hold every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    full = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    patterns = exact_patterns(np.flatnonzero(left), size)
    out = []
    if len(patterns):
        counts = np.floor(fitted(left.astype(float), patterns) + 0.25).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            if not counts[k]:
                break
            lengths = [int(v) for v in patterns[k] if v]
            times = min(int(counts[k]), *(int(left[v]) // c for v, c in Counter(lengths).items()))
            if times > 0:
                for v in lengths:
                    left[v] -= times
                out.append((tuple(lengths), times))
    return full + out + best_fit(left, size)


def intervals(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from index, to index, sequence of the first, offset)."""
    used: Counter = Counter()
    out, sequence = [], 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            out.append((n, used[n], used[n] + times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer=public_tokens, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for each piece of docs(doc_id, text, ...).

    A null text is empty and gives the end token alone; so does an empty one. Repeated rows give repeated pieces. Other
    columns are ignored; an empty table gives no rows. Only the histogram of lengths comes to the driver.
    """
    cut = written(pieces(docs, tokenizer, size, with_ids), "pack-pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    counts = written(counts.withColumn("base", F.coalesce(before, F.lit(0))), "pack-counts")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        histogram[length] = n
    rows = intervals(plan(histogram, size))
    placed = cut.join(F.broadcast(counts) if small_enough(counts, BROADCAST_ROWS) else counts, ["task", "length"])
    own = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return with_slots(placed.select(*own, (F.col("base") + F.col("nth")).alias("i")), rows)


def with_slots(placed: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """sequence_id and offset for each (length, i), by bisection among the plan's intervals."""
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column("i").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (batch.column("length").to_numpy(zero_copy_only=False) << 48) + i, "right") - 1
            own = [c for c in batch.schema.names if c != "i"]
            cols = [batch.column(c) for c in own] + [pa.array(table[at, 3] + i - table[at, 1]), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, "sequence_id", "offset"])

    types = ", ".join(f"{c} {t}" for c, t in placed.dtypes if c != "i")
    return placed.mapInArrow(find, f"{types}, sequence_id long, offset long")
