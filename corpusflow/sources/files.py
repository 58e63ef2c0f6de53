"""Scans (S1 to S5, S7, S9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import written
from corpusflow.sources.schemas import EVENT_SCHEMA, QUESTION_SCHEMA, RUN_SCHEMA

EVENT_TYPES = ("start", "stage", "thinking", "delta", "done", "error")
MAX_EVENT_BYTES = 1 << 20
MAX_SLICE, MAX_LINE = 500, 2000


FILE_DDL = "rel_path string, size long, mtime timestamp, content binary"


def system_of(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match("file:/[^/]", path):
        path = path.replace("file:/", "file:///", 1)
    return arrow_fs.FileSystem.from_uri(path)


def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rel_path, folder, size, mtime of what is in each folder (root, rel_path)."""
    for batch in batches:
        for root, rel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            system, top = system_of(root)
            found = system.get_file_info(arrow_fs.FileSelector(f"{top.rstrip('/')}/{rel}".rstrip("/"), recursive=False))
            names = [f"{rel}/{f.base_name}".lstrip("/") for f in found]
            folder = [f.type == arrow_fs.FileType.Directory for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(folder, pa.bool_()), pa.array([f.size for f in found], pa.int64()), pa.array([f.mtime for f in found], pa.timestamp("us", "UTC"))],
                names=["rel_path", "folder", "size", "mtime"],
            )


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, size, mtime of all files below root, whatever their names: folders are listed by tasks, a level at a time."""
    shape = "rel_path string, folder boolean, size long, mtime timestamp"
    level, parts = spark.createDataFrame([("",)], "rel_path string"), []
    while True:
        spread = level if not parts else level.repartition("rel_path")
        found = written(spread.select(F.lit(root).alias("root"), "rel_path").mapInArrow(list_folders, shape), "listing")
        parts.append(found.where("not folder").select("rel_path", "size", "mtime"))
        level = found.where("folder").select("rel_path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def write_files(rows: DataFrame, root: str) -> None:
    """Each row (rel_path, content) as a file below root, by tasks; a task that is run again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = system_of(f"{root}/{rel}")
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(name) as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select("rel_path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def is_hidden(rel_path: Column) -> Column:
    """Whether Spark's sources skip the path: a name in it begins with a dot or an underscore."""
    return F.rlike(rel_path, F.lit(r"(^|/)[._]"))


def read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content of path as another column, one file at a time."""
    for batch in batches:
        for i, path in enumerate(batch.column(0).to_pylist()):
            system, name = system_of(path)
            with system.open_input_stream(name) as f:
                content = f.read()
            own = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), own.column(3), pa.array([content], pa.binary())], names=["rel_path", "size", "mtime", "content"])


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, size, mtime, content of all files below root; unread columns are pruned, sizes filter at the source.

    Spark's sources skip names that begin with a dot or an underscore (`__init__.py`, `_private/`): these are listed and read
    by tasks.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    rel = F.substring_index("path", base + "/", -1)
    plain = rows.select(rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    hidden = listed_files(spark, root).where(is_hidden(F.col("rel_path"))).repartition("rel_path")
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("rel_path"))
    return plain.unionByName(hidden.select(path.alias("path"), "rel_path", "size", "mtime").mapInArrow(read_contents, FILE_DDL))


def scan_table(spark: SparkSession, directory: str, name: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema, only its columns are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{directory}/{name}.parquet")


def glob_regex(pattern: str) -> str:
    """The regex of one ignore pattern: `*` and `?` within a name, `**` across folders, classes, and escaped signs as such."""
    out, i = [], 0
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        end = rest.find("]", 3 if rest[1:2] in ("!", "^") else 2) if c == "[" else -1
        if rest.startswith("**/") and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif rest == "**" and i and pattern[i - 1] == "/":
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += len(rest) - len(rest.lstrip("*"))
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "\\" and len(rest) > 1:
            out.append(re.escape(rest[1]))
            i += 2
        elif end > 0:
            body = rest[1:end]
            negated = body[0] in "!^"
            signs = re.sub(r"([\[&^~])", r"\\\1", body[negated:])
            out.append(f"(?!/)[{'^' if negated else ''}{signs}]")
            i += end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regex, negated, dir_only) of a line of an ignore file; none of a blank line or comment.

    A pattern with a slash before its end is bound to the root; others match at any depth; what a directory pattern
    matches hides all below. A backslash takes the next sign's meaning away, that of a trailing space too.
    """
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    dir_only = line.endswith("/")
    line = line.removesuffix("/")
    if not line:
        return None
    bound = "/" in line.removeprefix("**/")
    return f"{'^' if bound else '^(?:.*/)?'}{glob_regex(line.removeprefix('/'))}{'/.*$' if dir_only else '(?:/.*)?$'}", negated, dir_only


def ignore_patterns(lines: DataFrame) -> DataFrame:
    """S3: pos, regex, negated, dir_only of ignore-file lines(pos, value); see ignore_rule()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(pos, *rule) for pos, line in zip(*(c.to_pylist() for c in batch.columns)) if (rule := ignore_rule(line or ""))]
            kinds = (pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["pos", "regex", "negated", "dir_only"])

    return lines.select(F.col("pos").cast("int"), "value").mapInArrow(run, "pos int, regex string, negated boolean, dir_only boolean")


def read_ignore_patterns(spark: SparkSession, root: str, name: str = ".gitignore") -> DataFrame:
    """S3: of the ignore file at the root; none where there is no such file.

    Spark's readers skip names with a leading dot, so this one small file is read through the file system itself.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    text = ""
    if fs.exists(path):
        stream = fs.open(path)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    return ignore_patterns(spark.createDataFrame(list(enumerate(text.splitlines())), "pos int, value string"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set of JSON lines; a damaged line stops the job."""
    return spark.read.schema(QUESTION_SCHEMA).option("mode", "FAILFAST").json(path)


def read_runs(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, run_questions, run_hits) of saved runs, one JSON document each; a hit's place is its rank from 1."""
    runs = spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    questions = runs.select("run_id", "repo", F.explode("questions").alias("q"))
    hits = questions.select("run_id", F.col("q.id").alias("question_id"), F.posexplode("q.hits").alias("pos", "h"))
    return (
        runs.drop("questions"),
        questions.select("run_id", "repo", "q.id", "q.kind", "q.split", "q.rank", "q.found_in_context"),
        hits.select("run_id", "question_id", (F.col("pos") + 1).alias("pos"), "h.*"),
    )


def parse_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of lines(stream_id, seq, line): blank lines skipped, a trailing CR dropped, unknown types,
    other shapes and over-long lines rejected with a reason."""
    rows = lines.withColumn("line", F.regexp_replace("line", "\r$", "")).where(F.trim("line") != "")
    rows = rows.withColumn("e", F.from_json("line", EVENT_SCHEMA))
    reason = (
        F.when(F.octet_length("line") > MAX_EVENT_BYTES, "too_long")
        .when(~F.rlike("line", F.lit(r"^\s*\{.*\}\s*$")) | F.col("e.type").isNull(), "shape")
        .when(~F.col("e.type").isin(*EVENT_TYPES), "type")
    )
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("stream_id", "seq", "e.*"), rows.where("reason is not null").select("stream_id", "seq", "reason")


def slice_lines(requests: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """request_id, status (ok, unknown, past_end), stale, lines (array of line_no, line) of requests(request_id,
    rel_path, start, end, hash) out of lines(rel_path, line_no, line) and files(rel_path, hash, n_lines)."""
    known = files.select("rel_path", F.col("hash").alias("own"), "n_lines")
    rows = requests.join(known, "rel_path", "left")
    last = F.least("end", "n_lines", F.col("start") + MAX_SLICE - 1)
    status = F.when(F.col("own").isNull(), "unknown").when(F.col("start") > F.col("n_lines"), "past_end").otherwise("ok")
    rows = rows.withColumns({"status": status, "last": last, "stale": ~F.col("hash").eqNullSafe(F.col("own"))})
    wanted = rows.where("status = 'ok'").select("request_id", "rel_path", F.explode(F.sequence("start", "last")).alias("line_no"))
    cut = F.when(F.length("line") > MAX_LINE, F.concat(F.substring("line", 1, MAX_LINE), F.lit("…"))).otherwise(F.col("line"))
    got = wanted.join(lines.select("rel_path", "line_no", cut.alias("line")), ["rel_path", "line_no"])
    lists = got.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    return rows.select("request_id", "status", "stale").join(lists, "request_id", "left")
