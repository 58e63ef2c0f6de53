"""Every registered query of the library with an SQL twin, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from corpusflow.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    ours = catalogue.queries()[name](spark, SF)
    theirs = db.sql(catalogue.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of([tuple(r) for r in ours.collect()], ours.columns) == rows_of(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_flagship_plan_has_no_cartesian_product(spark):
    plan = catalogue.flagship(spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "MapInArrow" in plan


def test_scans_read_only_the_columns_they_need(spark):
    plan = catalogue.queries()["tag_paths"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_a_stored_side_in_buckets_is_not_shuffled(spark):
    """Only the run's own rows, and what is planned of them, are dealt out."""
    from corpusflow.operators import sync

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old, new = catalogue.stored_chunks(spark, SF), catalogue.new_chunks(spark, SF)
        plan = sync.plan_sync(old, new, "m1", 64)
        both = plan, sync.upsert_chunks(old, new, sync.to_embed(plan), "m1", 64)
        for df in both:
            lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
            stored = [i for i, x in enumerate(lines) if "stored_chunks" in x]
            assert stored
            for i in stored:
                depth = next(k for k, c in enumerate(lines[i]) if c not in " :+-|")
                above = []
                for x in reversed(lines[:i]):
                    k = next((k for k, c in enumerate(x) if c not in " :+-|*"), 0)
                    if k < depth:
                        above.append(x)
                        depth = k
                until = next(j for j, x in enumerate(above) if "Join" in x)
                assert not any("Exchange" in x for x in above[:until])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
