"""Vector search and re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.session import written

#: Questions in a block, which a task scores at a time.
QUESTION_BLOCK = 4096
#: Scores that a task holds at a time (8 bytes each, and about as much again for each step on them), however many questions there are.
SCORES = 1 << 20
#: Margin that a test or (twice) a changelog loses when hits are ordered, and the pool that is ordered anew.
DEMOTION, LEAST_POOL, POOL_FACTOR = 0.15, 30, 3

# Words by which a question asks for tests or changelogs.
WANTS_TESTS = r"(?i)\b(?:tests?|tested|testing|specs?|fixtures?|pytest)\b"
WANTS_CHANGELOG = r"(?i)\b(?:changelog|change log|release notes|what changed|what['’]?s new|release history)\b"


def unit_rows(lists: pa.Array, dim: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.sqrt((flat * flat).sum(axis=1))[:, None]


def best_of(best_id: np.ndarray, best: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of best and score together, ties by id: those that can be among them first, then sorted."""
    all_id = np.concatenate([best_id, np.broadcast_to(ids, score.shape)], axis=1)
    score = np.concatenate([best, score], axis=1)
    n = score.shape[1]
    if n > 4 * k:
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        wide = int((score >= least).sum(axis=1).max())  # more than k where scores tie
        some = np.argpartition(-score, min(wide, n - 1), axis=1)[:, :wide]
        all_id, score = np.take_along_axis(all_id, some, 1), np.take_along_axis(score, some, 1)
    order = np.lexsort((all_id, -score), axis=1)[:, :k]
    return np.take_along_axis(all_id, order, 1), np.take_along_axis(score, order, 1)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows at most; empty ones left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: A block of questions: their ids, unit vectors and least scores (of interest) or -inf.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Bytes of vectors that a task holds at a time, and of question vectors in a round, where questions come by the shuffle.
PIECE_BYTES, ROUND_BYTES = 32 << 20, 64 << 20


def block_of(ids: pa.Array, embeddings: pa.Array, least: pa.Array, dim: int) -> Block:
    return ids.to_numpy(zero_copy_only=False), unit_rows(embeddings, dim), least.to_numpy(zero_copy_only=False)


def per_question(questions: DataFrame, rows: DataFrame, run: Callable[[Block, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, block: int | None = None) -> DataFrame:
    """run(block of questions, batches of rows) over parts of rows and all questions(question_id, embedding, least).

    Up to QUESTION_BLOCK questions are one block, which is broadcast. More are numbered blocks in a table: rows are dealt into
    pieces of bounded size by the hash of their id, every piece meets every block of a round by the shuffle, and a round has
    blocks of ROUND_BYTES at most, so that rows are scanned once for it. Nothing of it passes through the driver.
    """
    block = block or QUESTION_BLOCK
    first = questions.select(F.size("embedding")).first()
    n, dim = questions.count() if first else 0, first[0] if first else 0
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([], schema)
    questions = questions.select("question_id", "embedding", F.col("least").cast("double").alias("least"))
    if n <= block:
        t = questions.toArrow().combine_chunks()  # `block` rows at most
        shared = spark.sparkContext.broadcast(block_of(*(t.column(c).combine_chunks() for c in range(3)), dim))
        return rows.mapInArrow(lambda batches: run(shared.value, batches), schema)
    count = -(-n // block)
    numbered = written(questions.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(count))), "question-blocks")
    pieces = max(1, -(-rows.count() * 8 * dim // PIECE_BYTES))
    left = rows.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces)))
    names = [f.name for f in rows.schema.fields]

    def meet(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for b in np.unique(asked.column("block").to_numpy()).tolist():
            t = asked.filter(pa.array(asked.column("block").to_numpy() == b))
            own = block_of(*(t.column(c).combine_chunks() for c in ("question_id", "embedding", "least")), dim)
            out += run(own, iter(mine.select(names).to_batches()))
        return pa.Table.from_batches(out) if out else pa.table({c.split()[0]: pa.array([], KINDS[c.split()[1]]) for c in schema.split(", ")})

    step, parts = max(1, ROUND_BYTES // (8 * dim * block)), []
    for at in range(0, count, step):
        some = numbered.where((F.col("block") >= at) & (F.col("block") < at + step)).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))
        parts.append(left.groupBy("piece").cogroup(some.groupBy("piece")).applyInArrow(meet, schema))
    return reduce(DataFrame.unionByName, parts)


KINDS = {"long": pa.int64(), "double": pa.float64()}


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores at 12 places, so that equal angles tie whatever the order of summation; -inf (no hit) stays."""
    return np.where(np.isneginf(score), score, np.clip(np.round(score, 12), -1, 1))


def first_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each number in found(number, id, score), ties by id, and each one's place from 0."""
    n, ids, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, -score, n))
    n, ids, score = n[order], ids[order], score[order]
    place = np.arange(len(n)) - np.searchsorted(n, n)
    ok = place < k
    return n[ok], ids[ok], score[ok], place[ok]


def best_rows(k: int, not_self: bool) -> Callable[[Block, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For per_question: question_id, id, score of the best k of some rows(id, embedding), ties by id.

    Only scores that reach their question's k-th so far are looked at again. They wait until they are as many as the k best of
    all questions, so that a task sorts seldom.
    """

    def run(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, questions, _ = block
        none = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0))
        found, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        kth, kth_id = np.full(len(own), -np.inf), np.zeros(len(own), np.int64)
        for batch in slices(batches, max(4 * k, SCORES // max(1, len(own)))):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            score = questions @ unit_rows(batch.column(1), questions.shape[1]).T
            if not_self:
                score[own[:, None] == ids] = -np.inf
            near = score > kth[:, None] - 1e-12  # what rounding can bring to the k-th
            if np.count_nonzero(near) > 2 * k * len(own):
                some_id, some = (x.ravel() for x in best_of(*none, ids, rounded(score), k))
                n = np.repeat(np.arange(len(own)), len(some) // len(own))
            else:
                n, at = np.nonzero(near)
                some_id, some = ids[at], rounded(score[n, at])
            ok = np.isfinite(some) & ((some > kth[n]) | ((some == kth[n]) & (some_id < kth_id[n])))
            found.append((n[ok], some_id[ok], some[ok]))
            waiting += len(found[-1][0])
            if waiting >= k * len(own):
                *best, place = first_of(found, k)
                found, waiting, last = [tuple(best)], 0, place == k - 1
                kth[best[0][last]], kth_id[best[0][last]] = best[2][last], best[1][last]
        n, ids, score, _ = first_of(found, k)
        yield pa.RecordBatch.from_arrays([pa.array(own[n], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["question_id", "id", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return found.withColumn("raw_rank", F.row_number().over(order)).where(F.col("raw_rank") <= k)


def topk(questions: DataFrame, vectors: DataFrame, k: int, not_self: bool = False, block: int | None = None) -> DataFrame:
    """V2: question_id, id, score, raw_rank; exact cosine, score descending, then id.

    questions(question_id long, embedding), vectors(id long, embedding). Each task keeps k rows a question, so only those are
    shuffled; see per_question() for how questions come to the vectors.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    asked = questions.select("question_id", "embedding", F.lit(float("-inf")).alias("least"))
    return ranked(per_question(asked.limit(0) if not k else asked, vectors.select("id", "embedding"), best_rows(k, not_self), "question_id long, id long, score double", block), k)


#: Sampled vectors for each cell that the centres are fitted on, and slack for rounding in bounds.
FITTED, SLACK = 64, 1e-9


class VectorIndex:
    """V3: codes(id, cell, code, scale, error) of all vectors, and of each cell the centre, radius (angle) and number of vectors."""

    def __init__(self, codes: DataFrame, centres: np.ndarray, radius: np.ndarray, sizes: np.ndarray) -> None:
        self.codes, self.centres, self.radius, self.sizes = codes, centres, radius, sizes


def hashed_sample(vectors: DataFrame, n: int, total: int) -> DataFrame:
    """About n of the total vectors (all, if there are no more): those whose id's hash is below the n / total part of all hashes.

    Each task decides about its own rows, so that none meets those of the others.
    """
    if n >= total:
        return vectors
    return vectors.where(F.xxhash64("id") < F.lit(-(1 << 63) + (n << 64) // total))


def build_index(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> VectorIndex:
    """V3: an index of vectors(id, embedding).

    A code has a byte for each dimension of the unit vector; error is the length of what it loses, so that a score from the code
    is wrong by that at most. Cells, by default as many as the root of the number of vectors, 4,096 at most, are those of the
    nearest centre; centres are fitted (k-means) on a hashed_sample() of about FITTED * cells vectors.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = vectors.count()
    cells = max(1, min(cells or round(total**0.5), 4096))
    some = hashed_sample(vectors, FITTED * cells, total).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=10).fit(some)
    centres = np.array(model.clusterCenters(), dtype=np.float64)
    centres /= np.sqrt((centres * centres).sum(axis=1))[:, None]
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, SCORES // len(shared.value))):
            unit = unit_rows(batch.column(1), shared.value.shape[1])
            near = unit @ shared.value.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            scale = np.abs(unit).max(axis=1) / 127
            digits = np.round(unit / scale[:, None]).astype(np.int8)
            lost = unit - digits * scale[:, None]
            raw = [row.tobytes() for row in digits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell), pa.array(raw, pa.binary()), pa.array(scale), pa.array(np.sqrt((lost * lost).sum(axis=1))), pa.array(angle)],
                names=["id", "cell", "code", "scale", "error", "angle"],
            )

    codes = written(vectors.select("id", "embedding").mapInArrow(code, "id long, cell long, code binary, scale double, error double, angle double"), "index-codes")
    sizes, radius = np.zeros(len(centres)), np.zeros(len(centres))
    for r in codes.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():  # a row a cell
        sizes[r.cell], radius[r.cell] = r.n, r.angle
    return VectorIndex(codes.drop("angle"), centres, radius, sizes)


def coded_rows(index: VectorIndex, k: int, probes: int, first: bool) -> Callable[[Block, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For per_question over codes: question_id, id, low, high (bounds of the score) of rows that can be among the best k.

    first: in each question's `probes` nearest cells; else in the other cells that can hold a score of `least`. A row stays if its
    high is at least `least` and the k-th low of these rows.
    """
    centres, radius = index.centres, index.radius

    def run(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, questions, least = block
        seen = visited(questions, least, centres, radius, probes, first)
        lows = np.full((len(own), k), -np.inf)
        out: list[tuple[np.ndarray, ...]] = []
        for batch in slices(batches, 1 << 14):
            ids, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            scale, error = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
            digits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(len(ids), -1)
            for asked, here in met(seen, cell):
                score = questions[asked] @ (digits[here] * scale[here, None]).T
                low = score - error[here] - SLACK
                kth = np.concatenate([lows[asked], low], axis=1)
                lows[asked] = -np.partition(-kth, k - 1, axis=1)[:, :k]
                limit = np.maximum(lows[asked].min(axis=1), least[asked])
                q, v = np.nonzero(score + error[here] + SLACK >= limit[:, None])
                out.append((asked[q], ids[here[v]], low[q, v], score[q, v] + error[here[v]] + SLACK))
        if out:
            q, v, low, high = (np.concatenate(c) for c in zip(*out))
            ok = high >= lows.min(axis=1)[q]
            yield pa.RecordBatch.from_arrays([pa.array(own[q[ok]], pa.int64()), pa.array(v[ok], pa.int64()), pa.array(low[ok]), pa.array(high[ok])], names=["question_id", "id", "low", "high"])

    return run


def met(seen: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each cell that a question visits, these questions and its rows, of SCORES pairs at most (but one row at least)."""
    order = np.argsort(cell, kind="stable")
    for here in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        asked = np.flatnonzero(seen[:, cell[here[0]]]) if len(here) else here
        if len(asked):
            step = max(1, SCORES // len(asked))
            for at in range(0, len(here), step):
                yield asked, here[at : at + step]


def visited(questions: np.ndarray, least: np.ndarray, centres: np.ndarray, radius: np.ndarray, probes: int, first: bool) -> np.ndarray:
    """Which cells each question visits: its nearest, or the others that its least score doesn't exclude."""
    step = max(1, SCORES // len(centres))
    out = np.empty((len(questions), len(centres)), bool)
    for at in range(0, len(questions), step):
        angle = np.arccos(np.clip(questions[at : at + step] @ centres.T, -1, 1))
        near = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1) < probes
        if not first:
            # no vector of a cell is nearer than the angle to its centre less its radius
            near = ~near & (np.cos(np.clip(angle - radius - 1e-6, 0, np.pi)) >= least[at : at + step, None] - SLACK)
        out[at : at + step] = near
    return out


def search_index(questions: DataFrame, vectors: DataFrame, index: VectorIndex, k: int, probes: int = 4, block: int | None = None) -> DataFrame:
    """V3: question_id, id, score, raw_rank, coded, scanned; the same top-k as exact search.

    The codes in a question's nearest cells give k scores that it reaches at least; other cells are visited unless their centre
    and radius exclude that score, and only vectors whose code allows it are scored exactly. coded and scanned are the shares of
    all vectors whose code, and whose vector, was looked at.
    """
    if not k:
        return vectors.sparkSession.createDataFrame([], "question_id long, id long, score double, raw_rank int, coded double, scanned double")
    asked = questions.select("question_id", "embedding", F.lit(float("-inf")).alias("least"))
    kinds = "question_id long, id long, low double, high double"
    codes = index.codes.select("id", "cell", "code", "scale", "error")
    kth = W.partitionBy("question_id").orderBy(F.desc("low"))

    def reached(rows: DataFrame) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(kth)).where(F.col("nth") == k).select("question_id", F.col("low").alias("least"))

    near = written(per_question(asked, codes, coded_rows(index, k, probes, True), kinds, block), "index-near")
    bounded = written(asked.drop("least").join(reached(near), "question_id", "left").fillna(float("-inf"), ["least"]), "index-questions")
    rest = written(near.unionByName(per_question(bounded, codes, coded_rows(index, k, probes, False), kinds, block)), "index-candidates")
    some = rest.join(reached(rest), "question_id", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("question_id", "id")
    some = written(some, "index-scored")
    total = index.codes.count()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            dim = index_dim
            score = np.clip(np.round((unit_rows(batch.column(2), dim) * unit_rows(batch.column(3), dim)).sum(axis=1), 12), -1, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["question_id", "id", "score"])

    index_dim = index.centres.shape[1]
    both = some if some.count() > BROADCAST_PAIRS else F.broadcast(some)
    pairs = vectors.select("id", "embedding").join(both, "id").join(questions.select("question_id", F.col("embedding").alias("asked")), "question_id")
    scored = pairs.select("question_id", "id", "asked", "embedding").mapInArrow(exact, "question_id long, id long, score double")
    sizes, centres, radius = index.sizes, index.centres, index.radius

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, SCORES // len(centres))):
            own, unit, least = block_of(batch.column(0), batch.column(1), batch.column(2), centres.shape[1])
            seen = visited(unit, least, centres, radius, probes, True) | visited(unit, least, centres, radius, probes, False)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen @ sizes / sizes.sum())], names=["question_id", "coded"])

    coded = bounded.select("question_id", "embedding", "least").mapInArrow(share, "question_id long, coded double")
    shares = coded.join(some.groupBy("question_id").agg((F.count("*") / F.lit(float(max(1, total)))).alias("scanned")), "question_id")
    return ranked(scored, k).join(shares, "question_id").select("question_id", "id", "score", "raw_rank", "coded", "scanned")


#: Pairs of question and vector (16 bytes each) up to which they are broadcast to the vectors.
BROADCAST_PAIRS = 500_000


def topk_cells(questions: DataFrame, vectors: DataFrame, k: int, cells: int | None = None, probes: int = 4, seed: int = 7) -> DataFrame:
    """V3 at once: build_index() and search_index()."""
    return search_index(questions, vectors, build_index(vectors, cells, seed), k, probes)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """V3: question_id, found, wanted of the exact hits that the approximate ones have."""
    hit = approximate.select("question_id", "id", F.lit(1).alias("found"))
    both = exact.select("question_id", "id").join(hit, ["question_id", "id"], "left")
    return both.groupBy("question_id").agg(F.sum(F.coalesce("found", F.lit(0))).alias("found"), F.count("*").alias("wanted"))


def visible(vectors: DataFrame, chunks: DataFrame, flagged: DataFrame) -> DataFrame:
    """V4: vectors that have a chunk row in an unflagged file; chunks(id, rel_path), flagged(rel_path)."""
    return vectors.join(chunks.join(flagged.select("rel_path"), "rel_path", "left_anti").select("id", "rel_path"), "id")


def cutoff(hits: DataFrame, min_score: float = 0.0, margin: float = 2.0) -> DataFrame:
    """V7: hits at or above max(min_score, best - margin) of their question, compared at 9 places, with `removed`."""
    mine = W.partitionBy("question_id")
    limit = F.greatest(F.lit(min_score), F.max("score").over(mine) - margin)
    kept = F.round("score", 9) >= F.round(limit, 9)
    marked = hits.withColumn("kept", kept)
    return marked.withColumn("removed", F.sum((~F.col("kept")).cast("int")).over(mine)).where("kept").drop("kept")


def intent(question: Column) -> tuple[Column, Column]:
    """V8: (wants_tests, wants_changelog)."""
    return F.rlike(question, F.lit(WANTS_TESTS)), F.rlike(question, F.lit(WANTS_CHANGELOG))


def demote(hits: DataFrame, questions: DataFrame, tags: DataFrame, k: int, margin: float = DEMOTION, changelog_margin: float | None = None) -> DataFrame:
    """V9: question_id, id, score, raw_rank, adjusted, rank of the first k after tests and changelogs lose their margin.

    hits(question_id, id, score, raw_rank), questions(question_id, question), tags(id, is_test, is_changelog). Only the
    first max(POOL_FACTOR * k, LEAST_POOL) raw hits are ordered anew; the score itself never changes.
    """
    tests, logs = intent(F.col("question"))
    asked = questions.select("question_id", tests.alias("wants_tests"), logs.alias("wants_changelog"))
    pool = hits.where(F.col("raw_rank") <= max(POOL_FACTOR * k, LEAST_POOL)).join(asked, "question_id").join(tags, "id", "left")
    loss = F.greatest(
        F.when(F.col("is_test") & ~F.col("wants_tests"), margin).otherwise(0.0),
        F.when(F.col("is_changelog") & ~F.col("wants_changelog"), 2 * margin if changelog_margin is None else changelog_margin).otherwise(0.0),
    )
    ranked = pool.withColumn("adjusted", F.round(F.col("score") - loss, 9))
    order = W.partitionBy("question_id").orderBy(F.desc("adjusted"), "raw_rank")
    out = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("question_id", "id", "score", "raw_rank", "adjusted", "rank")


def search(
    questions: DataFrame, vectors: DataFrame, chunks: DataFrame, flagged: DataFrame, tags: DataFrame, signature: tuple[str, int], expected: tuple[str, int],
    k: int = 10, min_score: float = 0.0, margin: float = 2.0,
) -> DataFrame:
    """V4, V2, V7, V9 in a row. Refuses before any work an index that was built for another model or dimension."""
    if signature != expected:
        raise ValueError(f"the index is for {signature}, the questions for {expected}")
    seen = visible(vectors, chunks, flagged)
    hits = topk(questions, seen, max(POOL_FACTOR * k, LEAST_POOL))
    return demote(cutoff(hits, min_score, margin), questions, tags, k)
