"""Admission of files or documents (A1 to A11): gates in order, the first that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx

# What is indexed and what never is.
EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".rb", ".php", ".md", ".rst", ".json", ".yaml", ".yml")
DENIED_DIRS = (".git", "node_modules", "venv", "env", "__pycache__", "dist", "build", ".next", ".cache", "coverage")
DENIED_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "composer.lock", "poetry.lock", "uv.lock")
DATA_EXTENSIONS = (".json", ".yaml", ".yml")
MAX_BYTES, MAX_DATA_BYTES = 1_000_000, 20_000
SNIFFED = 8192


def denied_directory(path: Column, denied=DENIED_DIRS) -> Column:
    """A2."""
    return F.arrays_overlap(tx.directories(path), F.array(*map(F.lit, denied)))


def denied_name(path: Column) -> Column:
    """A3."""
    return tx.file_name(path).isin(*DENIED_NAMES) | F.endswith(tx.file_name(path), F.lit(".min.js"))


def too_large(path: Column, size: Column) -> Column:
    """A6."""
    return (size > MAX_BYTES) | (tx.suffix(path).isin(*DATA_EXTENSIONS) & (size > MAX_DATA_BYTES))


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    return F.contains(F.substring(content, 1, SNIFFED), F.lit(bytearray(1)))


def ignored_paths(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """A5: rel_path of files that a pattern hides, by themselves or with a directory above them.

    For the path and each directory above it the last matching pattern decides; patterns are a small file of rules, read
    from one ignore file, and are broadcast.
    """
    parts = F.split("rel_path", "/")
    n = F.size(parts)
    above = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < n, "/").otherwise("")))
    each = files.select("rel_path").distinct().withColumn("prefix", F.explode(above))
    hits = each.join(F.broadcast(patterns), F.expr("rlike(prefix, regex)"))
    last = hits.groupBy("rel_path", "prefix").agg(F.max_by("negated", "pos").alias("negated"))
    return last.where("not negated").select("rel_path").distinct()


def admit(files: DataFrame, patterns: DataFrame | None = None, extensions=EXTENSIONS) -> DataFrame:
    """A1: files(rel_path, size, content or none) with admitted and reason.

    Gates in order: directory, name, extension, ignored, size, binary. Only names are looked at before the content is.
    """
    path = F.col("rel_path")
    ignored = F.lit(False)
    if patterns is not None:
        hidden = ignored_paths(files, patterns).withColumn("hidden", F.lit(True))
        files = files.join(hidden, "rel_path", "left")
        ignored = F.coalesce("hidden", F.lit(False))
    reason = F.coalesce(
        F.when(denied_directory(path), "directory"),
        F.when(denied_name(path), "name"),
        F.when(~tx.suffix(path).isin(*extensions), "extension"),
        F.when(ignored, "ignored"),
        F.when(too_large(path, F.col("size")), "size"),
        F.when(is_binary(F.col("content")), "binary") if "content" in files.columns else F.lit(None).cast("string"),
    )
    return files.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull()).drop("hidden")


def tag_paths(files: DataFrame) -> DataFrame:
    """A10: is_test, is_changelog, language by the path alone."""
    path = F.col("rel_path")
    return files.withColumns({"is_test": tx.is_test(path), "is_changelog": tx.is_changelog(path), "language": tx.language(path)})


def fingerprint(files: DataFrame) -> DataFrame:
    """The SHA-1 of the raw bytes."""
    return files.withColumn("hash", F.sha1("content"))
