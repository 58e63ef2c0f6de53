"""V3: the cells find all that exact search finds, and scan less where cells can be excluded."""

import numpy as np

from corpusflow.operators import search
from corpusflow.plans import catalogue


def test_registered_query_reaches_full_recall(spark):
    rows = catalogue.queries()["approx_recall"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.found for r in rows) == sum(r.wanted for r in rows) > 0
    assert all(0 < r.scanned < 0.1 and r.coded <= 1 for r in rows)  # codes exclude what cells of scattered vectors don't


def test_clustered_vectors_are_mostly_excluded(spark):
    rows = catalogue.queries()["clustered_shares"](spark, "/root/testdata/sf0.01").collect()
    assert rows and sum(r.found for r in rows) >= 0.9 * sum(r.wanted for r in rows)
    assert all(r.few_codes and r.few_vectors for r in rows)


def test_questions_that_come_by_the_shuffle(spark):
    """Blocks of three questions: the same hits, by a plan that scans the vectors once and never passes the driver."""
    r = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, x) for i, x in enumerate(r.normal(size=(300, 8)).tolist())], "id long, embedding array<float>").repartition(4)
    questions = vectors.where("id % 40 = 0").withColumnRenamed("id", "question_id")
    key = lambda rows: sorted((x.question_id, x.raw_rank, x.id, x.score) for x in rows)
    for not_self in (False, True):
        many = search.topk(questions, vectors, 5, not_self, block=3)
        assert key(many.collect()) == key(search.topk(questions, vectors, 5, not_self).collect())
    plan = many._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
    assert key(search.search_index(questions, vectors, search.build_index(vectors, 5), 6, 2, block=3).collect()) == key(search.topk(questions, vectors, 6).collect())


def test_cells_equal_exact_search_and_skip_far_cells(spark):
    r = np.random.default_rng(3)
    heads = r.normal(size=(8, 16))
    v = (heads[np.arange(400) % 8] + r.normal(size=(400, 16)) * 0.05).tolist()
    vectors = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, embedding array<float>").repartition(3)
    questions = vectors.where("id % 40 < 3").withColumnRenamed("id", "question_id")
    key = lambda rows: sorted((x.question_id, x.raw_rank, x.id, x.score) for x in rows)
    got = search.topk_cells(questions, vectors, 7, cells=8, probes=1).collect()
    assert key(got) == key(search.topk(questions, vectors, 7).collect()) and max(x.coded for x in got) < 1
    assert key(search.topk_cells(questions, vectors, 90, cells=8, probes=1).collect()) == key(search.topk(questions, vectors, 90).collect())
    assert search.topk_cells(questions, vectors, 0, cells=8, probes=1).count() == 0
