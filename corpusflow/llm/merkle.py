"""A Merkle manifest of a table: sixteen-fold hash trees, one for each source, kept in blocks of van Emde Boas layout.

Leaves are digests of rows, sorted by (source, doc_id) over range partitions; a place in its source is the place in its
partition plus the rows of the source in the partitions before. An aligned subtree of HEIGHT levels is one block, built by
one task from at most FAN ** HEIGHT digests, and stored as one row: its nodes stand in van Emde Boas order, that is the top half of
its levels first, then each subtree below, each laid out in the same way. The roots of blocks are the leaves of the next
layer of blocks, until one is left for each source; the sources' roots form a last tree in the same way. Proofs come down the
layers: a block's path to the root is joined to the block, and addresses give the siblings within it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.text import lower_az, small_enough
from corpusflow.session import written

FAN = 16
#: Levels of nodes above the leaves of a block: 4,096 leaves.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a small side up to which it is broadcast, if its bytes allow it too.
BROADCAST_ROWS = 200_000
PATH = "siblings array<string>, places array<int>, subroot string, root string"


def encoded(c: Column) -> Column:
    """- for null, else the value behind its number of UTF-8 bytes, so that no two rows are written alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The digest of a row of documents with this text."""
    return F.sha2(F.concat(*(encoded(text if c == "text" else F.col(c)) for c in FIELDS)).cast("binary"), 256)


def tampered(text: Column) -> Column:
    """The text with A-Z lower-cased where 5 divides the crc32 of doc_id; null elsewhere."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return F.when(chosen, F.when(text.isNotNull(), lower_az(text)))


@lru_cache(maxsize=None)
def veb(levels: int) -> list[np.ndarray]:
    """Addresses of the nodes of a complete tree of so many levels, by depth: the top half, then the subtrees below it."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    top = levels // 2
    size = lambda n: (FAN**n - 1) // (FAN - 1)
    starts = size(top) + size(levels - top) * np.arange(FAN**top)
    return veb(top) + [(starts[:, None] + below).ravel() for below in veb(levels - top)]


def height(total: int, most: int) -> int:
    """Levels above the leaves of a block of a layer of so many leaves."""
    h = 0
    while h < most and FAN**h < total:
        h += 1
    return h


@lru_cache(maxsize=256)
def slots(n: int, h: int) -> list[np.ndarray]:
    """Where the nodes of a block of n leaves stand, by level from the leaves: the order of addresses without absent nodes."""
    there = [veb(h + 1)[h - level][: -(-n // FAN**level)] for level in range(h + 1)]
    place = np.argsort(np.argsort(np.concatenate(there)))
    ends = np.cumsum([len(x) for x in there])
    return [place[e - len(x) : e] for x, e in zip(there, ends)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def runs_of(level: str) -> list[str]:
    """The hex text of a level, cut into runs of FAN digests."""
    return [level[k : k + 64 * FAN] for k in range(0, len(level), 64 * FAN)]


def build(leaves: list[str], h: int) -> tuple[bytes, str]:
    """(nodes in order of address, root) of a block over its leaves."""
    levels = ["".join(leaves)]
    for _ in range(h):
        levels.append("".join(sha(run) for run in runs_of(levels[-1])))
    out = np.zeros((sum(len(x) // 64 for x in levels), 32), np.uint8)
    for place, level in zip(slots(len(leaves), h), levels):
        out[place] = np.frombuffer(bytes.fromhex(level), np.uint8).reshape(-1, 32)
    return out.tobytes(), levels[-1]


def levels_of(nodes: bytes, n: int, h: int) -> list[list[str]]:
    """The runs of each level below the root of a stored block, found by address."""
    data = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    return [runs_of(data[place].tobytes().hex()) for place in slots(n, h)[:h]]


def up_to(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(siblings to the left, to the right) of leaf i of a block and of each node above it."""
    out = []
    for runs in levels:
        run, k = runs[i // FAN], 64 * (i % FAN)
        out.append((run[:k], run[k + 64 :]))
        i //= FAN
    return out


def sorted_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows in order of keys over range partitions, written with `at`: partition number times 2 ** 33 plus place."""
    by = [F.col(c) for c in keys]
    return written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")


def shifts(rows: DataFrame, group: str) -> DataFrame:
    """group, task, shift, total: at + shift is a row's place in its group of sorted rows, total the group's rows."""
    counts = rows.groupBy(group, F.shiftrightunsigned("at", 33).alias("task")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    mine = W.partitionBy(group)
    before = F.sum("n").over(mine.orderBy("task").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    return counts.select(group, "task", (before - F.col("low")).alias("shift"), F.sum("n").over(mine).alias("total"))


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def forest(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """(layers of blocks(g, block, n, total, nodes), roots(g, digest)) over nodes(g, rank, total, digest)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        total = rows.column("total")[0].as_py()
        digests = rows.sort_by("rank").column("digest").to_pylist()
        stored, root = build(digests, height(total, most))
        return pa.table({"g": [key[0].as_py()], "block": [key[1].as_py()], "n": [len(digests)], "total": [total], "nodes": pa.array([stored], pa.binary()), "root": [root]})

    layers, roots, size = [], None, FAN**most
    while True:
        grouped = nodes.groupBy("g", F.floor(F.col("rank") / F.lit(FAN**most)).alias("block"))
        blocks = written(grouped.applyInArrow(run, "g long, block long, n long, total long, nodes binary, root string"), "merkle-blocks")
        layers.append(blocks)
        done = blocks.where(F.col("total") <= size).select("g", F.col("root").alias("digest"))
        roots = done if roots is None else roots.unionByName(done)
        more = blocks.where(F.col("total") > size)
        if more.isEmpty():
            return layers, roots
        nodes = more.select("g", F.col("block").alias("rank"), F.ceil(F.col("total") / size).alias("total"), F.col("root").alias("digest"))


def down(blocks: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """g, rank, siblings, places, subroot, root of the leaves of blocks, from paths(g, block, ...) of their roots."""

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                levels = levels_of(b["nodes"], b["n"], height(b["total"], most))
                own = [up_to(levels, i) for i in range(b["n"])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "g": [b["g"]] * b["n"], "rank": [b["block"] * FAN**most + i for i in range(b["n"])], "siblings": [[x + y for x, y in o] + b["siblings"] for o in own],
                        "places": [[len(x) // 64 for x, _ in o] + b["places"] for o in own], "subroot": [b["subroot"]] * b["n"], "root": [b["root"]] * b["n"],
                    },
                    schema=pa.schema([("g", pa.int64()), ("rank", pa.int64()), ("siblings", pa.list_(pa.string())), ("places", pa.list_(pa.int32())), ("subroot", pa.string()), ("root", pa.string())]),
                )

    both = blocks.drop("root").join(bounded(paths), ["g", "block"])
    return both.mapInArrow(run, f"g long, rank long, {PATH}")


def all_down(layers: list[DataFrame], starts: DataFrame, most: int) -> DataFrame:
    """g, block and path of the lowest layer's blocks. starts(g, siblings, ...): the paths of the trees' roots."""
    paths = None
    for k in reversed(range(len(layers))):
        ends = layers[k].where(F.col("total") <= FAN**most).select("g", "block").join(bounded(starts), "g")
        paths = ends if paths is None else ends.unionByName(written(down(layers[k + 1], paths, most), "merkle-paths").withColumnRenamed("rank", "block"))
    return paths


def manifest(docs: DataFrame, claimed: Callable[[Column], Column] | None = None, most: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs(doc_id, source, lang, n_chars, text, ...).

    claimed gives the text that a row is said to have (null: its own); the root is folded anew from the leaf of that text and
    the siblings that the manifest has, and verified says whether it is the root. Null values are encoded as such; rows
    without doc_id come first in their source, rows without source are a source of their own; rows of one doc_id stand in the
    order of their digests, and repeated rows are leaves of their own. most: levels of a block. Other columns are ignored; an empty table has no rows
    and no root.
    """
    text = F.col("text")
    other = claimed(text) if claimed else F.lit(None).cast("string")
    own = docs.select(*FIELDS).select("source", "doc_id", leaf_of(text).alias("leaf"), F.when(other.isNotNull(), leaf_of(other)).alias("claimed"))
    rows = sorted_rows(written(own, "merkle-leaves"), ["source", "doc_id", "leaf"])
    places = written(shifts(rows, "source"), "merkle-places")
    names = sorted_rows(places.select("source", F.lit(0).alias("one")).distinct(), ["source"])
    number = F.col("at") + F.col("shift")
    at = shifts(names, "one").drop("one")
    names = written(names.join(bounded(at), F.shiftrightunsigned("at", 33) == F.col("task")).select(F.col("source").alias("name"), number.alias("g"), F.col("total").alias("sources")), "merkle-names")
    places = places.join(bounded(names), F.col("source").eqNullSafe(F.col("name"))).select(F.col("source").alias("name"), "task", "shift", "total", "g")
    placed = rows.join(bounded(places), (F.shiftrightunsigned("at", 33) == F.col("task")) & F.col("source").eqNullSafe(F.col("name")))
    leaves = written(placed.select("g", number.alias("rank"), "total", "doc_id", "leaf", "claimed"), "merkle-ranked")

    layers, subroots = forest(leaves.select("g", "rank", "total", F.col("leaf").alias("digest")), most)
    subroots = written(subroots.join(bounded(names.select("g", "sources")), "g"), "merkle-subroots")
    tops, root = forest(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.col("sources").alias("total"), "digest"), most)
    none = F.array().cast("array<string>").alias("siblings"), F.array().cast("array<int>").alias("places")
    start = root.select("g", *none, F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    of_source = written(down(tops[0], all_down(tops, start, most), most), "merkle-paths").drop("g", "subroot").withColumnRenamed("rank", "g")
    starts = of_source.join(bounded(subroots.select("g", F.col("digest").alias("subroot"))), "g").select("g", "siblings", "places", "subroot", "root")
    paths = all_down(layers, starts, most)

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
        for b in right.to_pylist():
            levels = levels_of(b["nodes"], b["n"], height(b["total"], most))
            path = [(s[: 64 * k], s[64 * k :]) for s, k in zip(b["siblings"], b["places"])]
            tail = "".join(b["siblings"])
            for row in left.to_pylist():
                own = up_to(levels, row["rank"] % FAN**most)
                now = row["claimed"] or row["leaf"]
                for x, y in (*own, *path):
                    now = sha(x + now + y)
                proof = sha("".join(x + y for x, y in own) + tail)
                for c, v in zip(out, (row["doc_id"], row["leaf"], b["subroot"], b["root"], proof, now, now == b["root"])):
                    out[c].append(v)
        return pa.table(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
    blocks = layers[0].drop("root").join(bounded(paths), ["g", "block"])
    mine = leaves.withColumn("block", F.floor(F.col("rank") / F.lit(FAN**most))).withColumn("doc_id", F.col("doc_id").cast("long"))
    both = mine.groupBy("g", "block").cogroup(blocks.groupBy("g", "block"))
    return both.applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def oracle(levels: int = 4, top: int = 3) -> str:
    """DuckDB SQL of manifest(documents, tampered), for sources of at most 16 ** levels rows and 16 ** top sources."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}), CAST(4294967295 AS BIGINT))"
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    side = lambda rows: f"coalesce(string_agg(d, '') OVER (PARTITION BY g, r // {FAN} ORDER BY r ROWS BETWEEN {rows}), '')"

    def tree(name: str, n: int) -> list[str]:
        out = []
        for k in range(n):
            out.append(f"{name}{k + 1} AS (SELECT g, r // {FAN} AS r, sha256(string_agg(d, '' ORDER BY r)) AS d, (n + {FAN - 1}) // {FAN} AS n FROM {name}{k} WHERE n > 1 GROUP BY g, r // {FAN}, n)")
            out.append(f"{name}s{k} AS (SELECT g, r, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS x, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS y FROM {name}{k} WHERE n > 1)")
        roots = " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE n = 1" for k in range(n + 1))
        return [*out, f"{name}root AS ({roots})"]

    def fold(source: str, name: str, n: int, rank: str) -> list[str]:
        out = []
        for k in range(n):
            out.append(
                f"{name}f{k} AS (SELECT t.* REPLACE (CASE WHEN s.g IS NULL THEN f ELSE sha256(s.x || f || s.y) END AS f, proof || coalesce(s.x || s.y, '') AS proof) "
                f"FROM {source if not k else f'{name}f{k - 1}'} t LEFT JOIN {name}s{k} s ON s.g = {'t.g' if name == 'a' else '0'} AND s.r = t.{rank} // {FAN**k})"
            )
        return out

    parts = [
        f"""l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 AND text IS NOT NULL THEN {leaf(f"translate(text, {az})")} END AS claimed FROM documents)""",
        "o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM l)",
        "a0 AS (SELECT g, r, leaf AS d, n FROM o)", *tree("a", levels),
        "b0 AS (SELECT 0 AS g, g AS r, d, (SELECT count(*) FROM aroot) AS n FROM aroot)", *tree("b", top),
        "p AS (SELECT *, coalesce(claimed, leaf) AS f, '' AS proof FROM o)", *fold("p", "a", levels, "r"), *fold(f"af{levels - 1}", "b", top, "g"),
    ]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, aroot.d AS subroot, broot.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = broot.d AS verified "
        f"FROM bf{top - 1} JOIN aroot USING (g) CROSS JOIN broot"
    )
