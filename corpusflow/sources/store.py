"""Published snapshots, incremental indexes and runs (S6, S8): immutable folders, the highest complete version counts.

An incremental index has three folders for each version: data/version=N with the rows of the documents that the version
changes, laid out by hash bucket of the document (below columns of the caller's choice); keys/version=N with those documents, so that
older rows of them no longer count; and version=N, written last, which makes the version complete. A version whose changes since the
last full one would outgrow a share of it is written in full, so that a reader merges little and writing costs a
constant times what changes.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusflow.session import shared_dir

#: Hash buckets of an incremental index, and the share of the full version that later ones change before all is written anew.
BUCKETS, REWRITE = 32, 0.5


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions below path that were written to the end."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    found = [re.fullmatch(r"version=(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
    return sorted(int(m[1]) for m in found if m and fs.exists(_folder(spark, f"{path}/{m[0]}/_SUCCESS")[0]))


def write_snapshot(df: DataFrame, path: str, version: int, partition: str | None = None) -> bool:
    """Publish df as a version; False if that version is there already, so that a replayed batch changes nothing.

    A version that a lost job left half written has no _SUCCESS and is written anew. Row and vector are one row, so they
    are published together.
    """
    if version in versions(df.sparkSession, path):
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/version={version}")
    return True


def read_snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The highest complete version, or None."""
    known = versions(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/version={known[-1]}") if known else None


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the latest `keep` complete versions."""
    for v in versions(spark, path)[:-keep]:
        p, fs = _folder(spark, f"{path}/version={v}")
        fs.delete(p, True)


def write_runs(df: DataFrame, path: str, final: bool = False) -> None:
    """A run's rows by run_id, as JSON; final runs never overwrite."""
    df.write.mode("errorifexists" if final else "append").partitionBy("run_id").json(path)


def bucket_of(*key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """base (the last full version), schema, layout, changed (documents since) and full (documents in it) of the newest version."""
    known = versions(spark, path)
    if not known:
        return None
    row = spark.read.schema("base long, schema string, layout string, key string, changed long, full long, version long").json(f"{path}/version={known[-1]}").first()
    return row.asDict() | {"versions": [v for v in known if v >= row.base]}


def publish(rows: DataFrame, documents: DataFrame, path: str, version: int, key: list[str], layout: list[str] | None = None, rewrite: float = REWRITE) -> bool:
    """Publish a version in which the documents(key ...) have just these rows, those without rows none; other documents stay.

    False if that version is there already, so that a replayed batch changes nothing; one that was left half written is
    written anew. layout: columns of the key that folders are named by, above the buckets. Key values aren't null.
    """
    spark = rows.sparkSession
    if version in versions(spark, path):
        return False
    layout = layout or []
    documents = documents.select(*key).distinct()
    now = _manifest(spark, path)
    n = documents.count()
    full = now is None or now["changed"] + n > rewrite * now["full"]
    if now is not None and full:
        rows = read_index(spark, path).join(documents, key, "left_anti").unionByName(rows.select(*read_index(spark, path).columns))
    out = rows.withColumn("bucket", bucket_of(*(F.col(c) for c in key)))
    spread = [*layout, "bucket"]
    out.repartition(*spread).write.mode("overwrite").partitionBy(*spread).parquet(f"{path}/data/version={version}")
    if full:
        documents = documents.limit(0)
        n_full, changed, base = rows.select(*key).distinct().count(), 0, version
    else:
        n_full, changed, base = now["full"], now["changed"] + n, now["base"]
    documents.write.mode("overwrite").parquet(f"{path}/keys/version={version}")
    schema = now["schema"] if now else rows.schema.json()
    told = spark.createDataFrame([(base, schema, ",".join(layout), ",".join(key), changed, n_full)], "base long, schema string, layout string, key string, changed long, full long")
    told.coalesce(1).write.mode("overwrite").json(f"{path}/version={version}")
    return True


def read_index(spark: SparkSession, path: str, at: dict | None = None) -> DataFrame | None:
    """The rows of the newest complete version, or None. at: values of key columns; files of other folders aren't read.

    Rows of a full version and of those after it, without rows of documents that a later version names.
    """
    now = _manifest(spark, path)
    if now is None:
        return None
    kind = StructType.fromJson(json.loads(now["schema"]))
    layout, key = [c for c in now["layout"].split(",") if c], now["key"].split(",")
    stored = StructType([f for f in kind.fields if f.name not in layout] + [f for f in kind.fields if f.name in layout]).add("bucket", "integer").add("version", "long")
    folders = [f"{path}/data/version={v}" for v in now["versions"]]
    rows = spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*folders)
    for c, v in (at or {}).items():
        rows = rows.where(F.col(c) == F.lit(v))
    if at and set(key) <= set(at):
        rows = rows.where(F.col("bucket") == bucket_of(*(F.lit(at[c]).cast(kind[c].dataType) for c in key)))
    later = [v for v in now["versions"] if v > now["base"]]
    if later:
        named = spark.read.schema(StructType([kind[c] for c in key]).add("version", "long")).option("basePath", f"{path}/keys").parquet(*[f"{path}/keys/version={v}" for v in later])
        named = named.groupBy(*key).agg(F.max("version").alias("newest"))
        rows = rows.join(named, key, "left").where(F.col("newest").isNull() | (F.col("version") >= F.col("newest")))
    return rows.select(*kind.names)


def bucketed(df: DataFrame, name: str, key: str, buckets: int = 64) -> DataFrame:
    """Df as a table of the catalogue, in sorted buckets of key, that joins and groups by key read without a shuffle.

    Its files are in the shared folder. For what stays between runs: a run's own rows are dealt once, into as many buckets, and the stored side isn't moved. The
    number of buckets is the table's; make it so large that one fits a task.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete what no version from the last `keep` full ones on reads."""
    known = versions(spark, path)
    bases = sorted({spark.read.schema("base long").json(f"{path}/version={v}").first()[0] for v in known})
    for v in known if len(bases) > keep else []:
        if v < bases[-keep]:
            for folder in (f"{path}/version={v}", f"{path}/keys/version={v}", f"{path}/data/version={v}"):
                p, fs = _folder(spark, folder)
                fs.delete(p, True)
