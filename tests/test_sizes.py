"""What only shows on larger tables: long texts, many questions, large samples."""

import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import passages, search, talk
from corpusflow.plans import catalogue
from tests.test_oracle import SF, rows_of


def test_contexts_whose_first_passage_does_not_fit(spark, tmp_path):
    """assemble leaves those questions out, as its SQL does; the operator shows their best passage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.rpad("text", 18_500, "long ")).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    ours, theirs = catalogue.queries()["assemble"](spark, str(tmp_path)), db.sql(catalogue.oracle_sql()["assemble"])
    want = theirs.fetchall()
    asked = catalogue.questions(spark, str(tmp_path)).count()
    assert 0 < len(want) < asked
    assert rows_of([tuple(r) for r in ours.select(theirs.columns).collect()], theirs.columns) == rows_of(want, theirs.columns)


def test_blank_texts_and_fenced_ones_are_a_part_of_prose(spark, tmp_path):
    """fences counts each text once, as its SQL does, and what its own open fence adds."""
    texts = ["", "  ", "\n", "\n" * 20_000, " \n\t\n", None, "a", "\n\na\n", "a\n```js\nb", "a\n```\nb\n```\n\nc", "```", "a\n  ````\nb"]
    rows = [(2 * i + odd, t) for i, t in enumerate(texts) for odd in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ours, theirs = catalogue.queries()["fences"](spark, str(tmp_path)), db.sql(catalogue.oracle_sql()["fences"])
    want = rows_of(theirs.fetchall(), theirs.columns)
    assert len(want) == 3 * len(texts) and rows_of([tuple(r) for r in ours.select(theirs.columns).collect()], theirs.columns) == want


def test_parts_of_blank_lines_are_left_out_or_kept(spark):
    """As many blank lines as a text can have; parts without lines are none."""
    many = "\n" * 20_000
    docs = spark.createDataFrame([(1, ""), (2, f"a{many}\n```py\n{many}\n b{many}```\n```\n```\n ")], "doc int, text string")
    shown = lambda keep: [(r.doc, r.kind, r.lang, r.text) for r in talk.split_fences(docs, keep).orderBy("doc", "seq").collect()]
    parts = [(2, "prose", None, "a"), (2, "code", "py", " b")]
    assert shown(False) == parts and shown(True) == [(1, "prose", None, ""), *parts, (2, "prose", None, " ")]


def test_what_fits_is_told_from_what_is_shown_all_the_same(spark):
    none = F.array().cast("array<struct<name:string,reason:string>>")
    asked = spark.range(1, 4).select(F.col("id").alias("question_id"), none.alias("hidden"), F.array().cast("array<string>").alias("deleted"))
    blocks = spark.createDataFrame([(1, 1, "x" * 170, None), (1, 2, "y" * 90, None), (2, 1, "z" * 900, None), (3, 1, "w" * 9, None)], "question_id long, rank int, block string, stale_path string")
    got = {r.question_id: (r.fits, r.shown, r.over_budget) for r in passages.assemble_context(blocks, asked, 59).collect()}
    assert got == {1: (False, 1, False), 2: (False, 1, True), 3: (True, 1, False)}


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def floats(r, n, dim=8):
    return pa.FixedSizeListArray.from_arrays(pa.array(r.normal(size=n * dim)), dim).cast(pa.list_(pa.float64()))


def block_of_questions(r):
    return np.arange(search.QUESTION_BLOCK), search.unit_rows(floats(r, search.QUESTION_BLOCK), 8), np.full(search.QUESTION_BLOCK, -np.inf)


def test_a_task_holds_few_scores_whatever_the_questions():
    """V2: as many questions as a block can have; an array of the scores of all rows would be 98 MB, and there are several."""
    r = np.random.default_rng(1)
    block = block_of_questions(r)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), floats(r, 3000)], names=["id", "embedding"])
    assert peak_mb(lambda: list(search.best_rows(30, False)(block, iter([rows])))) < 150


def test_a_task_sorts_seldom(monkeypatch):
    """V2: the scores of most rows are not sorted; 79 pieces of the rows were."""
    r = np.random.default_rng(1)
    block, calls, real = block_of_questions(r), [], search.best_of
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), floats(r, 20_000)], names=["id", "embedding"])
    monkeypatch.setattr(search, "best_of", lambda *a: calls.append(1) or real(*a))
    list(search.best_rows(10, False)(block, iter([rows])))
    assert len(calls) <= 2


def test_a_task_finds_the_best_whatever_their_order():
    """V2: ties, zero vectors, best last, the question itself and batches of any size, against a sort of everything."""
    r = np.random.default_rng(2)
    for kind in ("ties", "zero", "last"):
        x = r.normal(size=(3000, 4))
        x = np.sign(x) if kind == "ties" else x
        x[::7] *= kind != "zero"
        x = np.sort(x, axis=0) if kind == "last" else x
        ids, asked = r.permutation(3000), np.arange(1, 3000, 10)
        with np.errstate(invalid="ignore"):
            unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
            score = np.round(unit[asked] @ unit.T, 12)
            score[np.arange(len(asked)), asked] = np.nan
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 4).cast(pa.list_(pa.float64()))
            rows = pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["id", "embedding"])
            cuts = [0, 3, 40, 1000, 3000]
            got = pa.Table.from_batches(search.best_rows(5, True)((ids[asked], unit[asked], np.full(len(asked), -np.inf)), (rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])))).to_pydict()
        want = [(i, d) for i, s in zip(ids[asked], score) for _, d in sorted((-round(v, 9), d) for v, d in zip(s, ids) if v == v)[:5]]
        assert sorted(zip(got["question_id"], got["id"])) == sorted(want)


def test_a_task_of_the_index_holds_few_scores_whatever_the_cells():
    """V3: as many questions and cells as there can be."""
    r = np.random.default_rng(1)
    _, questions, least = block_of_questions(r)
    centres = search.unit_rows(floats(r, 4096), 8)
    assert peak_mb(lambda: search.visited(questions, least, centres, np.ones(4096), 4, True)) < 100
    cell = np.zeros(20_000, np.int64)
    pieces = list(search.met(np.ones((len(questions), 1), bool), cell))
    assert max(len(a) * len(b) for a, b in pieces) <= search.SCORES and np.array_equal(np.sort(np.concatenate([b for _, b in pieces])), np.arange(len(cell)))


def test_the_sample_for_the_centres_is_taken_in_each_task(spark):
    vectors = spark.range(0, 20_000, numPartitions=8).select("id", F.array(F.lit(1.0)).alias("embedding"))
    some = search.hashed_sample(vectors, 2000, 20_000)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search("TakeOrdered|Limit|Exchange", plan)
    ids = {x.id for x in some.collect()}
    assert 1800 < len(ids) < 2200 and ids == {x.id for x in search.hashed_sample(vectors.repartition(3), 2000, 20_000).collect()}
    assert search.hashed_sample(vectors, 20_000, 20_000).count() == 20_000


#: Queries by exact search, each of which is tried with many questions.
SEARCHES = [
    "context_summary", "retrieved", "stage_summary", "passages_of_hits", "holdout", "hit_rates", "costed_pool",
    "rank_grid", "gate", "floor_stats", "simulated", "search_visible", "topk_budget", "demote",
    "topk",
]


@pytest.fixture(scope="module")
def many_questions(tmp_path_factory):
    """A document and a label for each of 4,096 vectors, every second of which is a question."""
    at, r = tmp_path_factory.mktemp("many_questions"), np.random.default_rng(1)
    ids = np.arange(4096) // 2 * 50 + np.arange(4096) % 2
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(r.normal(size=len(ids) * catalogue.DIM).astype(np.float32)), catalogue.DIM).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": ids, "embedding": vectors, "label": (ids % 7).astype(np.int32)}), at / "embeddings.parquet")
    texts = [f"text {i}" for i in ids]
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": ["en"] * len(ids), "source": [f"src{i % 5}" for i in range(len(ids))], "n_chars": [len(x) for x in texts]}), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": ids, "quality": (ids % 3 > 0).astype(np.int32), "toxic": (ids % 4 == 0).astype(np.int32)}), at / "labels.parquet")
    return str(at)


@pytest.mark.parametrize("name", SEARCHES)
def test_a_query_holds_few_scores_in_each_task(spark, many_questions, monkeypatch, name):
    """An array of the scores of all questions and vectors would be 67 MB, and there are several."""
    real = search.best_rows

    def measured(k, not_self):
        run = real(k, not_self)

        def best(block, batches):
            import tracemalloc

            tracemalloc.start()
            try:
                yield from run(block, batches)
                peak = tracemalloc.get_traced_memory()[1] / 1e6
            finally:
                tracemalloc.stop()
            assert len(block[0]) == 2048 and peak < 150, f"{len(block[0])} questions, {peak:.0f} MB"

        return best

    monkeypatch.setattr(search, "best_rows", measured)
    catalogue.queries()[name](spark, many_questions).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", ["floor_stats", "floor_grid", "gate", "misses", "rank_grid", "costed_pool", "holdout", "stage_summary"])
def test_a_query_searches_once(spark, monkeypatch, name):
    """Queries that need the hits more than once don't score the vectors anew each time."""
    real, scored = search.best_rows, spark.sparkContext.accumulator(0)

    def counted(k, not_self):
        run = real(k, not_self)

        def best(block, batches):
            def seen():
                for b in batches:
                    scored.add(b.num_rows * len(block[0]))
                    yield b

            yield from run(block, seen())

        return best

    monkeypatch.setattr(search, "best_rows", counted)
    catalogue.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert scored.value == catalogue.vectors(spark, SF).count() * catalogue.questions(spark, SF).count()
