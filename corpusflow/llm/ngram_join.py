"""Self-join of documents whose word n-gram sets have a Jaccard similarity of at least 0.8, with PartEnum signatures.

Sets fall into bands by size, each a quarter wider than the one before, so that similar sets are in one band or in
neighbouring ones; instance i of the join serves bands i and i + 1. Similar sets of an instance differ in at most k
features. The feature domain is cut into more than k partitions by ranges of the features' hashes; each partition in
which two sets agree is a signature that they share. All signatures are counted, so that it is known how many sets have
each. A set signs its k + 1 rarest partitions: as at most k of a set's partitions differ from those of a similar one, the
rarest partition in which the two agree is among the k + 1 rarest of both. Partitions that no other set has take up places
without making candidates; a set with k + 1 of them has no partner at all.

Sets that share a signature make a bucket. A bucket isn't expanded into pairs: its pivot, the member of the most buckets,
is compared with the others, and members in one component need no further look. Members of buckets that still hold several
components are joined by prefix filtering on their features, the rarest first, where only pairs of different components
count. Before features are compared, a parity sketch bounds the number in which two sets differ from below. All bounds
are exact: no linked pair is lost, and every link rests on the features themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm import arrays
from corpusflow.llm.components import components
from corpusflow.llm.text import small_enough
from corpusflow.session import dropped, written

N = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Partitions for each feature in which similar sets may differ, and the least number of them.
PARTS, FEWEST_PARTS = 2, 16
#: Copies of a set sign once within so many sets of a task; further copies are folded after the shuffle.
REMEMBERED = 1 << 20
#: Rows of identifiers up to which they are broadcast (16 bytes each).
BROADCAST_ROWS = 500_000

MULTIPLIERS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(N)]
SALT = np.uint64(0xA0761D6478BD642F)


def bands(longest: int) -> list[tuple[int, int]]:
    """(first, last) size of each band."""
    out = [(1, 1)]
    while out[-1][1] < longest:
        first = out[-1][1] + 1
        out.append((first, max(first, first * 100 // PERCENT)))
    return out


def differing(a, b):
    """The most features that similar sets of sizes a and b differ in: intersection >= (a + b) * PERCENT / (100 + PERCENT)."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def largest(size):
    """The largest size that a set similar to one of `size` may have."""
    return size * 100 // PERCENT


def shingles(data: np.ndarray, bounds: np.ndarray, power: arrays.Powers) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted by text and hash."""
    data = arrays.TO_LOWER[data]
    starts, ends, text = arrays.words(data, bounds)
    word = arrays.word_hashes(data, starts, ends, power)
    n = np.bincount(text, minlength=len(bounds) - 1)
    h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(word) >= N:
        last = len(word) - N + 1
        h = word[:last] * MULTIPLIERS[0]
        for k in range(1, N):
            h = h + word[k : last + k] * MULTIPLIERS[k]
        whole = text[:last] == text[N - 1 :]
        h, of = arrays.mixed(h[whole]), text[:last][whole]
    short = np.flatnonzero((n > 0) & (n < N))  # a shorter text is one shingle of all its words
    if len(short):
        at, own = np.cumsum(n)[short] - n[short], np.zeros(len(short), np.uint64)
        for k in range(N - 1):
            has = n[short] > k
            own[has] += word[at[has] + k] * MULTIPLIERS[k]
        h, of = np.concatenate([h, arrays.mixed(own + n[short].astype(np.uint64) * SALT)]), np.concatenate([of, short])
    order = np.argsort(h)
    narrow = np.uint16 if len(bounds) < 1 << 16 else np.uint32
    order = order[np.argsort(of[order].astype(narrow), kind="stable")]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def sums_by(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by sorted group numbers, modulo 2 ** 64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(np.bincount(of, minlength=n))
    return total[ends] - total[ends - np.bincount(of, minlength=n)]


def set_ids(of: np.ndarray, h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """An identifier of each set that depends on its features and the salt alone; of sets without features 0."""
    size = np.bincount(of, minlength=n)
    own = sums_by(of, arrays.mixed(h ^ (SALT ^ np.uint64(salt))), n)
    return np.where(size > 0, arrays.mixed(own + size.astype(np.uint64)), np.uint64(0))


def partitions(of: np.ndarray, h: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For both instances that each of n sets takes part in: instance, need (how many partitions it signs), parts, base, cell.

    The partitions of set i are base[i] ... base[i] + parts[i] - 1, cell is the partition of each feature. A set that can
    only be similar to equal ones has no partitions.
    """
    size = np.bincount(of, minlength=n)
    last = np.array([b for _, b in bands(int(size.max(initial=1)) + 1)])
    band = np.searchsorted(last, size)
    for instance, other in ((band - 1, size), (band, largest(size))):  # with sets of at most its own size, and larger ones
        k = differing(size, other)
        use = (instance >= 0) & (size > 0) & (k > 0)
        most = last[np.maximum(instance, 0)]
        parts = np.where(use, np.maximum(PARTS * (differing(most, largest(most)) + 1), FEWEST_PARTS), 0)
        base = np.cumsum(parts) - parts
        cell = base[of] + ((h >> np.uint64(32)) * parts[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        yield instance, np.where(use, k + 1, 0), parts, base, cell


def signed(of: np.ndarray, h: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For both instances of n sets: (text, signature) of their partitions, and how many each needs to sign.

    The two lowest bits of a signature are the lowest one of the instance's number and whether the partition is empty. Empty
    partitions come last in the order of partitions. They are left out unless a set has too few others; sets that agree in
    empty partitions only both have too few others.
    """
    size = np.bincount(of, minlength=n)
    content = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mixed(h + SALT), dtype=np.uint64)])
    for instance, need, parts, base, cell in partitions(of, h, n):
        use = parts[of] > 0
        count = np.bincount(cell[use], minlength=int(parts.sum()))
        text = np.repeat(np.arange(n), parts)
        filled = np.bincount(text, count > 0, minlength=n).astype(np.int64)
        told = np.flatnonzero((count > 0) | (filled < need)[text])
        text = text[told]
        # the features of a text lie in the order of their partitions
        before = np.cumsum(count) - count
        skipped = (np.cumsum(size) - size)[text] - before[base[text]]
        begin = before[told] + skipped
        where = (instance[text] << 32 | (told - base[text])).astype(np.uint64)
        sig = arrays.mixed(content[begin + count[told]] - content[begin] + arrays.mixed(where + SALT))
        slot = (instance[text] & 1) + 2 * (count[told] == 0)
        yield text, sig & ~np.uint64(3) | slot.astype(np.uint64), need


PROFILE = "doc_id long, row long, node long, check long, n long, spare array<long>"


def profiles(docs: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, row, node (the set's identifier), check (another one), n, spare for each row of docs.

    spare: how many of its partitions a set needn't sign, by the two lowest bits of their signatures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = arrays.Powers()
        for batch in batches:
            for first, data, bounds in arrays.chunks(batch.column(2)):
                count = len(bounds) - 1
                of, h = shingles(data, bounds, power)
                spare = np.zeros((count, 4), np.int64)
                for instance, need, parts, base, cell in partitions(of, h, count):
                    use = parts[of] > 0
                    filled = np.bincount(np.repeat(np.arange(count), parts), np.bincount(cell[use], minlength=int(parts.sum())) > 0, count).astype(np.int64)
                    spare[np.arange(count), instance & 1] = filled - need
                    spare[np.arange(count), (instance & 1) + 2] = parts - need
                ids = [set_ids(of, h, count, salt).view(np.int64), set_ids(of, h, count, salt + 1).view(np.int64), np.bincount(of, minlength=count)]
                own = batch.slice(first, count)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * count + 1, 4, dtype=np.int32)), pa.array(spare.ravel()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *map(pa.array, ids), lists], names=["doc_id", "row", "node", "check", "n", "spare"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, PROFILE)


def identified(docs: DataFrame) -> tuple[DataFrame, int]:
    """The written profiles and the salt with which no two different sets share an identifier."""
    salt = 0
    while True:
        profile = written(profiles(docs, salt), "ngram-profiles")
        if profile.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a != b").isEmpty():
            return profile, salt
        dropped(profile)
        salt += 2


def signatures(docs: DataFrame, salt: int = 0) -> DataFrame:
    """(key, node): the signatures of all partitions of all sets; of copies within a task only the first counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, seen = arrays.Powers(), set()
        for batch in batches:
            for _, data, bounds in arrays.chunks(batch.column(0)):
                count = len(bounds) - 1
                of, h = shingles(data, bounds, power)
                node = set_ids(of, h, count, salt)
                fresh = np.zeros(count, bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > REMEMBERED:
                    seen.clear()
                use = fresh[of]
                for text, sig, _ in signed(of[use], h[use], count):
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[text].view(np.int64))], names=["key", "node"])

    return docs.select("text").mapInArrow(run, "key long, node long")


def shared(rows: DataFrame) -> DataFrame:
    """The distinct rows(key, node) whose key several nodes have. Tasks stream over sorted rows and hold one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int] | None = None  # the last row, and whether it is the first of its key and not sent on yet
        lone = False
        for batch in batches:
            key, node = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(key):
                continue
            past = before or (~key[0], 0)
            old_key, old_node = (np.concatenate([[p], v[:-1]]) for p, v in zip(past, (key, node)))
            new = (key != old_key) | (node != old_node)
            first = (key != old_key)[new]
            key, node = key[new], node[new]
            if not len(key):
                continue
            if lone and not first[0]:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in before], names=["key", "node"])
            kept = ~first
            kept[:-1] |= ~first[1:]
            before, lone = (int(key[-1]), int(node[-1])), bool(first[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[kept])], names=["key", "node"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def ranked(rows: DataFrame, *group: str) -> DataFrame:
    """rows(key, node, ...) with pos, the place of the key among those of the node (and group), the rarest first, and held, how many it has."""
    each = W.partitionBy("node", *group)
    many = rows.groupBy("key").agg(F.count("*").alias("many"))
    return rows.join(many, "key").select(*rows.columns, F.row_number().over(each.orderBy("many", "key")).alias("pos"), F.count("*").over(each).alias("held"))


def buckets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bucket, node) of shared signatures(key, node) that several sets sign; nodes(node, spare)."""
    own = ranked(rows.withColumn("slot", F.col("key").bitwiseAND(3).cast("int")), "slot").join(nodes, "node")
    own = written(own.where(F.col("pos") <= F.col("held") - F.get("spare", "slot")).select(F.col("key").alias("bucket"), "node"), "ngram-signed")
    several = own.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    bucket = written(own.join(several, "bucket"), "ngram-buckets")
    dropped(own)
    return bucket


def feature_sets(docs: DataFrame, nodes: DataFrame, salt: int = 0) -> DataFrame:
    """node, n, sketch, features of each node of nodes(node, row), from the document that stands for it.

    sketch: the parities of the numbers of features in 64 * len(sketch) >= 2 * n cells; sketches of two lengths are compared
    by folding the longer one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = arrays.Powers()
        for batch in batches:
            for first, data, bounds in arrays.chunks(batch.column(1)):
                count = len(bounds) - 1
                of, h = shingles(data, bounds, power)
                n = np.bincount(of, minlength=count)
                same = set_ids(of, h, count, salt).view(np.int64) == batch.column(0).slice(first, count).to_numpy()
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                long = 1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(long)])
                cell = (at[of] + ((h >> np.uint64(6)).astype(np.int64) & (long[of] - 1))) * 64 + (h & np.uint64(63)).astype(np.int64)
                odd = (np.bincount(cell, minlength=int(at[-1]) * 64) & 1).astype(np.uint8)
                words = np.packbits(odd, bitorder="little").view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), pa.array(n), sketch, lists], names=["node", "n", "sketch", "features"])
                yield out.filter(pa.array(same))

    few = F.broadcast(nodes) if small_enough(nodes, BROADCAST_ROWS) else nodes
    rows = docs.join(few, "row").select("node", "text").mapInArrow(run, "node long, n long, sketch array<long>, features array<long>")
    return rows.dropDuplicates(["node"])


def may_link(nu: Column, nv: Column, same: Column) -> Column:
    """Whether sets of these sizes may be linked if at most `same` features are in both."""
    return same * (100 + PERCENT) >= PERCENT * (nu + nv)


def differ(a: Column, b: Column) -> Column:
    """A lower bound of the number of features in which two sets differ, from their sketches."""
    half = lambda s: F.zip_with(F.slice(s, 1, F.size(s) / 2), F.slice(s, F.size(s) / 2 + 1, F.size(s) / 2), lambda x, y: x.bitwiseXOR(y))
    bits = lambda s, t: F.aggregate(F.zip_with(s, t, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.when(F.size(a) == F.size(b), bits(a, b)).when(F.size(a) > F.size(b), bits(half(a), b)).otherwise(bits(a, half(b)))


def linked(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct edges(u, v) of linked sets: by sizes and sketches first, then by the features themselves."""
    side = lambda x, *cols: sets.select(F.col("node").alias(x), *(F.col(c).alias(c + x) for c in cols))
    both = edges.select("u", "v").distinct().join(side("u", "n", "sketch"), "u").join(side("v", "n", "sketch"), "v")
    sizes = may_link(F.col("nu"), F.col("nv"), F.least("nu", "nv"))
    near = both.where(sizes).where((F.col("nu") + F.col("nv") - differ(F.col("sketchu"), F.col("sketchv"))) * (100 + PERCENT) >= 2 * PERCENT * (F.col("nu") + F.col("nv")))
    near = written(near.select("u", "v", "nu", "nv"), "ngram-near")
    whole = near.join(side("u", "features"), "u").join(side("v", "features"), "v")
    same = F.size(F.array_intersect("featuresu", "featuresv"))
    found = written(whole.where(may_link(F.col("nu"), F.col("nv"), same)).select("u", "v"), "ngram-links")
    dropped(near)
    return found


def spokes(bucket: DataFrame) -> DataFrame:
    """u, v: in each bucket its pivot u, the member of the most buckets, with each other member v."""
    degree = bucket.groupBy("node").agg(F.count("*").alias("degree"))
    pivot = bucket.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("p"))
    return bucket.join(pivot.select("bucket", F.col("p.node").alias("u")), "bucket").where("node != u").select("u", F.col("node").alias("v"))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of their node; a node without links is its own."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def unresolved(bucket: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root of the members of buckets that hold several components."""
    own = rooted(bucket, roots)
    several = own.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("bucket")
    return own.join(several, "bucket").select("node", "root").distinct()


def prefix_pairs(open_nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: the pairs of different components among open_nodes(node, root) that prefix filtering lets be linked.

    With all features in one order, two sets that are linked share one of the first n - s + 1 of each, if s is the least
    that they then share; s >= PERCENT / 100 * n. The first feature that both have also tells how many more they can share.
    In each feature's list the pairs within its most frequent component, as a rule almost all, are left out.
    """
    own = written(sets.join(open_nodes, "node").select("node", "root", "n", "features"), "ngram-open")
    each = written(shared(own.select(F.explode("features").alias("key"), "node")), "ngram-features")
    rest = F.col("n") - F.col("held") + F.col("pos")  # features that no other set has come first
    first = ranked(each).join(own.select("node", "root", "n"), "node").withColumn("pos", rest)
    first = first.where(may_link(F.col("n"), F.ceil(F.col("n") * PERCENT / 100), F.col("n") - F.col("pos") + 1))
    first = written(first.select("key", "node", "root", "n", "pos"), "ngram-prefixes")
    by_root = first.groupBy("key", "root").agg(F.count("*").alias("many"))
    main = by_root.groupBy("key").agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    open_rows = written(first.join(main.select("key", "main"), "key"), "ngram-postings")
    a, b = open_rows.where("root != main").alias("a"), open_rows.alias("b")
    more = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) + 1
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & once & may_link(F.col("a.n"), F.col("b.n"), more)
    pairs = a.join(b, on).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    pairs = written(pairs, "ngram-pairs")
    dropped(own, each, first, open_rows)
    return pairs


def linked_components(bucket: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root for all nodes that have a link."""
    star = linked(spokes(bucket), sets)
    roots = written(components(star), "ngram-roots")
    open_nodes = written(unresolved(bucket, roots), "ngram-unresolved")
    pairs = prefix_pairs(open_nodes, sets)
    more = linked(pairs, sets)
    if not more.isEmpty():
        before = roots
        roots = written(components(more.unionByName(before.select(F.col("node").alias("u"), F.col("root").alias("v")))), "ngram-roots")
        dropped(before)
    dropped(star, open_nodes, pairs, more)
    return roots


def grouped(rows: DataFrame) -> DataFrame:
    """doc_id, row, n (size of the set), root for each row of rows(doc_id, row, text): linked sets have one root.

    Texts without words have no links, but all have one root.
    """
    profile, salt = identified(rows)
    own = profile.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("spare").alias("spare"))
    signs = written(shared(signatures(rows, salt)), "ngram-signatures")
    bucket = buckets(signs, own.select("node", "spare"))
    nodes = written(own.select("node", "row").join(bucket.select("node").distinct(), "node", "left_semi"), "ngram-nodes")
    sets = written(feature_sets(rows, nodes, salt), "ngram-sets")
    roots = linked_components(bucket, sets)
    dropped(signs, bucket, nodes, sets)
    return rooted(profile.select("doc_id", "row", "node", "n"), roots).drop("node")


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text, ...).

    Words are lower-cased (A-Z) runs of anything but white space; a set has the distinct shingles of N words, of a
    shorter text the whole sequence. Texts without words, and null ones, have no shingle and no link: their component is
    their own doc_id. Copies of a set are one node. Rows with a null doc_id take part, but a component is named by its
    smallest identifier that isn't null (null if it has no other). Other columns are ignored; an empty table gives no
    rows.
    """
    named = grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text"))
    lowest = written(named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "ngram-names")
    joined = named.join(lowest, "root", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def later_copies(rows: DataFrame) -> DataFrame:
    """row of each of rows(doc_id, row, text) that has a link to a smaller doc_id of its component, or to the same one and a
    smaller row. A null doc_id is the largest. Rows without words are never among them."""
    named = grouped(rows).where("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = written(named.groupBy("root").agg(F.min(place)["row"].alias("first")), "ngram-first")
    return named.join(first, "root").where("row != first").select("row")
