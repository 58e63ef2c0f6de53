import datetime as dt
import time

from pyspark.sql import functions as F

from corpusflow.operators import usage
from corpusflow.sources import schemas, store
from corpusflow.streaming import streams


def call(i, minute, provider="p"):
    return (i, dt.datetime(2024, 1, 1, 0, minute), provider, None, "answer", "done", 10, None, 5, False)


def test_ingest_is_safe_to_replay(spark, tmp_path):
    src, index = str(tmp_path / "src"), str(tmp_path / "index")
    for k in range(2):
        spark.range(k * 3, k * 3 + 4).write.mode("append").parquet(src)
        streams.stream_ingest(streams.file_stream(spark, src, "id long"), index, str(tmp_path / "cp"), ["id"]).awaitTermination()
    assert sorted(r.id for r in store.read_index(spark, index).collect()) == list(range(7))
    streams.stream_ingest(streams.file_stream(spark, src, "id long"), index, str(tmp_path / "cp2"), ["id"]).awaitTermination()  # batch 0 again
    assert sorted(r.id for r in store.read_index(spark, index).collect()) == list(range(7))


def test_a_build_sees_the_rows_of_its_documents_only(spark, tmp_path):
    src, index, seen = str(tmp_path / "src"), str(tmp_path / "index"), []

    def build(batch, old):
        seen.append([] if old is None else sorted(r.n for r in old.collect()))
        return batch if old is None else old.unionByName(batch).groupBy("id").agg(F.sum("n").alias("n"))

    for rows in ([(1, 10), (2, 20), (3, 30)], [(2, 5), (4, 40)]):
        spark.createDataFrame(rows, "id long, n long").write.mode("append").parquet(src)
        streams.stream_ingest(streams.file_stream(spark, src, "id long, n long"), index, str(tmp_path / "cp"), ["id"], build).awaitTermination()
    assert seen == [[], [20]]
    assert sorted(map(tuple, store.read_index(spark, index).collect())) == [(1, 10), (2, 25), (3, 30), (4, 40)]


def test_usage_windows_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([call(i, i % 7) for i in range(20)], schemas.USAGE_CALLS)
    rows.write.parquet(str(tmp_path / "calls"))
    q = streams.stream_usage(streams.file_stream(spark, str(tmp_path / "calls"), schemas.USAGE_CALLS), "1 minute").writeStream.format("memory").queryName("usage_now").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.requests, r.tokens) for r in spark.table("usage_now").collect()}
    batch = rows.groupBy(F.window("at", "1 minute")).agg(F.count("*").alias("n"), F.sum(F.lit(15)).alias("t"))
    assert got == {(r.window.start, r.n, r.t) for r in batch.collect()}


def test_latest_headers(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("p", {"X-RateLimit-A": "1"}, at), ("p", {"x-ratelimit-a": "2"}, at + dt.timedelta(1)), ("p", {"server": "x"}, at + dt.timedelta(2))]
    kind = "provider string, headers map<string,string>, at timestamp"
    df = spark.createDataFrame(rows, kind)
    df.write.parquet(str(tmp_path / "h"))
    q = streams.stream_latest(streams.file_stream(spark, str(tmp_path / "h"), kind)).writeStream.format("memory").queryName("headers_now").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r.headers for r in spark.table("headers_now").collect()] == [r.headers for r in usage.latest_snapshot(df).collect()] == [{"x-ratelimit-a": "2"}]


def test_answer_streams(spark, tmp_path):
    """Done and failed ones at once, silent ones as event time passes; a line that comes twice counts once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "stream_id string, seq long, type string, text string, at timestamp"
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = [
        [("a", 0, "delta", "he", t(0)), ("b", 0, "delta", "x", t(1)), ("c", 0, "error", None, t(2)), ("d", 0, "delta", "d", t(3))],
        [("a", 0, "delta", "he", t(4)), ("a", 1, "delta", "y", t(5)), ("a", 2, "done", None, t(6)), ("d", 1, "delta", "e", t(900))],
        [("clock", 0, "clock", None, t(1200))],
    ]
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    out = streams.stream_answers(streams.file_stream(spark, str(tmp_path / "e"), kind, 1), late="1 second")
    out.writeStream.format("memory").queryName("answers_now").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.stream_id, r.text, r.events, r.outcome) for r in spark.table("answers_now").collect()}
    assert got == {("a", "hey", 3, "done"), ("c", "", 1, "failed"), ("b", "x", 1, "stopped")}  # d is within 300 seconds of the newest event


def bytes_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_an_incremental_version_writes_what_changes(spark, tmp_path):
    path, root = str(tmp_path / "index"), tmp_path / "index"
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    assert store.publish(rows, rows, path, 0, ["id"])
    some = rows.where("id % 100 = 7").withColumn("text", F.sha2(F.concat("text", F.lit("!")), 512))
    assert store.publish(some, some, path, 1, ["id"]) and not store.publish(rows.limit(0), rows, path, 1, ["id"])
    share = (bytes_of(root / "data/version=1") + bytes_of(root / "keys/version=1")) / bytes_of(root / "data/version=0")
    assert share < 0.1  # 1 % of the rows, and a footer for each bucket
    gone = rows.where("id % 100 = 8")
    assert store.publish(rows.limit(0), gone, path, 2, ["id"])
    now = {r.id: r.text for r in store.read_index(spark, path).collect()}
    old = {r.id: r.text for r in rows.collect()}
    assert set(now) == {i for i in old if i % 100 != 8} and all((now[i] == old[i]) == (i % 100 != 7) for i in now)
    half = rows.where("id % 2 = 0").withColumn("text", F.lit("half"))
    assert store.publish(half, half, path, 3, ["id"])  # changes of more than half: written in full
    assert store._manifest(spark, path)["versions"] == [3]
    now = {r.id: r.text for r in store.read_index(spark, path).collect()}
    assert len(now) == 20_000 and sum(v == "half" for v in now.values()) == 10_000
    store.forget(spark, path, keep=1)
    assert store.versions(spark, path) == [3] and store.read_index(spark, path).count() == len(now)
    plan = store.read_index(spark, path, {"id": 77})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_lookups_read_one_folder(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = spark.range(300).select((F.col("id") % 5).alias("project_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("rel_path"), "id")
    store.publish(rows, rows, path, 0, ["project_id", "rel_path"], ["project_id"])
    one = store.read_index(spark, path, {"project_id": 3, "rel_path": "f13"})
    assert [r.id for r in one.collect()] == [13] and len(one.inputFiles()) <= 300
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "(project_id" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "(bucket" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
