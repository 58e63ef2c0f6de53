"""Incremental maintenance of chunk and vector tables.

Tables: files(rel_path, hash, settings, index_error), chunks(id, rel_path, content_hash, ..., embed_model, embed_dim),
vectors(id, embedding). Every operator returns new tables; publishing them is sources.store.write_snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields whose change moves a chunk without changing what is embedded.
ROW_FIELDS = ["rel_path", "ordinal", "part", "part_count", "names", "kind", "symbol", "parent", "start_line", "end_line", "text", "synthetic", "parse_error", "embed_text"]


def unrecorded(model: str, dim: int, prefix: str = "") -> Column:
    """The record of the vector is absent or of another model or dimension."""
    return ~F.col(f"{prefix}embed_model").eqNullSafe(F.lit(model)) | ~F.col(f"{prefix}embed_dim").eqNullSafe(F.lit(dim))


def skip_unchanged(scanned: DataFrame, state: DataFrame, settings: str, pending: DataFrame) -> DataFrame:
    """scanned(rel_path, hash) with `skip`: same bytes, same settings, no error, no chunk in pending(rel_path)."""
    old = state.select("rel_path", F.col("hash").alias("old_hash"), "settings", "index_error")
    todo = pending.select("rel_path").distinct().withColumn("pending", F.lit(True))
    rows = scanned.join(old, "rel_path", "left").join(todo, "rel_path", "left")
    same = F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("settings").eqNullSafe(F.lit(settings))
    return rows.select(*scanned.columns, (same & F.col("index_error").isNull() & F.col("pending").isNull()).alias("skip"))


def duplicates(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("id").count().where("count > 1").select("id")


def plan_sync(old: DataFrame, new: DataFrame, model: str, dim: int, fields: list[str] | None = None) -> DataFrame:
    """Id, bucket: new > changed > needs_vector > moved > unchanged, and gone. Duplicate ids are refused.

    old(id, content_hash, embed_model, embed_dim, fields), new(id, content_hash, fields), for the documents of both. A stored side
    in buckets of id (sources.store.bucketed) isn't shuffled, neither here nor in upsert_chunks.
    """
    for side in (old, new):
        if not duplicates(side).isEmpty():
            raise ValueError("duplicate chunk ids")
    fields = [f for f in fields or ROW_FIELDS if f in old.columns and f in new.columns]
    row = F.struct(*fields) if fields else F.lit(1)
    a = old.select("id", F.col("content_hash").alias("old_hash"), "embed_model", "embed_dim", row.alias("old_row"), F.lit(True).alias("was"))
    b = new.select("id", F.col("content_hash").alias("new_hash"), row.alias("new_row"), F.lit(True).alias("is"))
    bucket = (
        F.when(F.col("is").isNull(), "gone")
        .when(F.col("was").isNull(), "new")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
        .when(unrecorded(model, dim), "needs_vector")
        .when(~F.col("old_row").eqNullSafe(F.col("new_row")), "moved")
        .otherwise("unchanged")
    )
    return a.join(b, "id", "full_outer").select("id", bucket.alias("bucket"))


def to_embed(plan: DataFrame) -> DataFrame:
    """C3."""
    return plan.where(F.col("bucket").isin("new", "changed", "needs_vector"))


def upsert_chunks(old: DataFrame, new: DataFrame, embedded: DataFrame, model: str, dim: int) -> DataFrame:
    """C4: the rows of new with their vector record: kept where content_hash is the same, set where freshly embedded.

    embedded(id): an id that isn't in new is refused.
    """
    if not embedded.join(new, "id", "left_anti").isEmpty():
        raise ValueError("an embedded id is not among the chunks")
    record = old.select("id", F.col("content_hash").alias("old_hash"), F.col("embed_model").alias("m"), F.col("embed_dim").alias("d"))
    done = embedded.select("id").distinct().withColumn("fresh", F.lit(True))
    rows = new.drop("embed_model", "embed_dim").join(record, "id", "left").join(done, "id", "left")
    kept = F.col("old_hash").eqNullSafe(F.col("content_hash"))
    return rows.select(
        *[c for c in new.columns if c not in ("embed_model", "embed_dim")],
        F.when(F.col("fresh"), model).when(kept, F.col("m")).alias("embed_model"),
        F.when(F.col("fresh"), dim).when(kept, F.col("d")).cast("int").alias("embed_dim"),
    )


def gone_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored ids that their document no longer produces."""
    return old.join(new.select("rel_path").distinct(), "rel_path", "left_semi").select("id").join(new, "id", "left_anti")


def drop_vanished(table: DataFrame, scanned: DataFrame) -> DataFrame:
    """The rows of table whose document is still in the scan; for files, chunks and vectors with rel_path."""
    return table.join(scanned.select("rel_path").distinct(), "rel_path", "left_semi")


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """C7."""
    return vectors.join(chunks.select("id"), "id", "left_anti")


def lost_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows that claim a vector which is missing."""
    return chunks.where("embed_model is not null").join(vectors.select("id"), "id", "left_anti")


def heal_lost(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with the record of lost vectors cleared."""
    lost = lost_vectors(chunks, vectors).select("id", F.lit(True).alias("lost"))
    rows = chunks.join(lost, "id", "left")
    clear = {c: F.when(F.col("lost").isNull(), F.col(c)) for c in ("embed_model", "embed_dim")}
    return rows.withColumns(clear).select(*chunks.columns)


def match_signature(chunks: DataFrame, vectors: DataFrame, stored: tuple | None, wanted: tuple) -> tuple[DataFrame, DataFrame]:
    """Chunks and vectors, forgotten where the stored (model, dim) isn't the wanted one."""
    if stored == wanted:
        return chunks, vectors
    none = {"embed_model": F.lit(None).cast("string"), "embed_dim": F.lit(None).cast("int")}
    return chunks.withColumns(none), vectors.limit(0)


def needs_embedding(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    """With seq: the order by path, line, part and id, for callers that need it; range-partitioned sort, no single task."""
    return chunks.where(unrecorded(model, dim)).orderBy("rel_path", "start_line", F.coalesce("part", F.lit(0)), "id")


def files_needing_embedding(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    """C11."""
    return chunks.where(unrecorded(model, dim)).select("rel_path").distinct()


def models_in_use(chunks: DataFrame) -> DataFrame:
    """C12."""
    return chunks.where("embed_model is not null").select("embed_model", "embed_dim").distinct()


def flag_failures(state: DataFrame, failures: DataFrame, succeeded: DataFrame) -> DataFrame:
    """State with the reasons of failures(rel_path, reason) stored and those of succeeded(rel_path) cleared.

    An existing row keeps its hash; an unseen file gets a row without one.
    """
    bad = failures.groupBy("rel_path").agg(F.min("reason").alias("reason"))
    ok = succeeded.select("rel_path").distinct().withColumn("ok", F.lit(True))
    rows = state.join(bad, "rel_path", "full_outer").join(ok, "rel_path", "left")
    error = F.coalesce("reason", F.when(F.col("ok").isNull(), F.col("index_error")))
    return rows.withColumn("index_error", error).select(*state.columns)


def failed_files(state: DataFrame) -> DataFrame:
    """rel_path, index_error of the files whose last run failed; search hides their chunks."""
    return state.where("index_error is not null").select("rel_path", "index_error")


def skip_gate(failures: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """C14: new_failures, files, publish: whether failures that weren't known before stay within max(3, 5 %)."""
    new = failures.select("rel_path").distinct().join(known.select("rel_path"), "rel_path", "left_anti").agg(F.count("*").alias("new_failures"))
    total = files.agg(F.count("*").alias("files"))
    limit = F.greatest(F.lit(3.0), 0.05 * F.col("files"))
    return new.crossJoin(total).withColumn("publish", F.col("new_failures") <= limit)  # one row each


def index_report(plan: DataFrame) -> DataFrame:
    """One row of counts by bucket."""
    names = ["new", "changed", "needs_vector", "moved", "unchanged", "gone"]
    counts = [F.count_if(F.col("bucket") == n).alias(n) for n in names]
    return plan.agg(*counts, F.count_if(F.col("bucket").isin("new", "changed", "needs_vector")).alias("embedded"))


def document_chunks(chunks: DataFrame, rel_path: str) -> DataFrame:
    """The chunks of one document by line, part and id."""
    return chunks.where(F.col("rel_path") == rel_path).orderBy("start_line", F.coalesce("part", F.lit(0)), "id")


def document_ids(chunks: DataFrame, rel_path: str | None = None) -> DataFrame:
    """The ids of a document's chunks, or of all."""
    return (chunks if rel_path is None else chunks.where(F.col("rel_path") == rel_path)).select("id").distinct()


def file_states(files: DataFrame, rel_path: str | None = None) -> DataFrame:
    """rel_path, hash, chunker_version (null if never recorded) of all files, or of one: no row if it is unknown."""
    return (files if rel_path is None else files.where(F.col("rel_path") == rel_path)).select("rel_path", "hash", "chunker_version")


def get_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """C17: rows in the order of wanted(pos, id): the first place of a repeated id counts, unknown ids are skipped."""
    first = wanted.groupBy("id").agg(F.min("pos").alias("pos"))
    return chunks.join(first, "id").orderBy("pos")


def project_catalogue(projects: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Projects with counts of files, chunks and flagged files, and whether they are indexed."""
    f = files.groupBy("project_id").agg(F.count("*").alias("files"), F.count("index_error").alias("flagged"))
    c = chunks.groupBy("project_id").agg(F.count("*").alias("chunks"))
    rows = projects.join(f, "project_id", "left").join(c, "project_id", "left").fillna(0, ["files", "flagged", "chunks"])
    return rows.withColumn("indexed", F.col("files") > 0)


def delete_keys(tables: dict[str, DataFrame], keys: DataFrame, key: str = "project_id") -> dict[str, DataFrame]:
    """The tables without the rows of keys; tables without the key column stay as they are."""
    return {n: t.join(keys.select(key), key, "left_anti") if key in t.columns else t for n, t in tables.items()}


# Q1: rules as SQL predicates that a row must meet; null where a rule doesn't apply.
RULES = {
    "chunks": {
        "id": "id is not null",
        "text": "text is not null and length(text) > 0",
        "lines": "start_line >= 1 and end_line >= start_line",
        "part_pair": "(part is null) = (part_count is null)",
        "part_range": "part is null or (part >= 0 and part < part_count)",
        "record_pair": "(embed_model is null) = (embed_dim is null)",
    },
    "files": {"rel_path": "rel_path is not null", "hash": "hash is not null"},
    "usage_calls": {
        "at": "at is not null",
        "provider": "provider is not null and length(trim(provider)) > 0",
        "kind": "kind in ('answer', 'test')",
        "outcome": "outcome in ('done', 'stopped', 'failed')",
        "tokens": "coalesce(prompt_tokens, 0) >= 0 and coalesce(thinking_tokens, 0) >= 0 and coalesce(answer_tokens, 0) >= 0",
    },
}


def check_constraints(df: DataFrame, table: str | dict[str, str], key: str) -> DataFrame:
    """Rule, key for each rule that a row breaks; a predicate that is null counts as broken. One pass."""
    rules = RULES[table] if isinstance(table, str) else table
    broken = [F.when(~F.coalesce(F.expr(p), F.lit(False)), name) for name, p in rules.items()]
    return df.select(F.explode(F.array_compact(F.array(*broken))).alias("rule"), F.col(key).alias("key"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
