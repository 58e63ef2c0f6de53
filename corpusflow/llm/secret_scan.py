"""Secret scanning with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are the matches of three base patterns and, as a wide net, long mixed tokens. Each candidate's value is hashed;
one aggregate over the corpus counts the documents and the distinct repositories and owners that have it. Values that
many owners have are widely copied examples; values of one owner are live-looking credentials. Base candidates stay
whatever their counts; wide ones are reported only where the counts say that they belong to a single owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.text import small_enough
from corpusflow.session import written

#: Patterns in the order of report; group VALUE of each is the secret. \x20 is the space.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"(AKIA[A-Z0-9]+)", "hex": r"([0-9a-f]+)", "owned": r"([A-Za-z0-9_-]+)"}
#: The first ones are base patterns, whose matches stay; the last is the wide net.
BASE_KINDS = 3
#: Characters that a value must have; shorter matches are dropped.
LEAST = {"assign": 6, "access": 20, "hex": 24, "owned": 20}
#: The same, as cheap searches: a document without such a piece has no match of the kind.
#: hex and owned runs are maximal, so that the shorter ones need not be made only to be dropped.
SEARCH = PATTERNS | {"hex": r"([0-9a-f]{24,})", "access": r"(AKIA[A-Z0-9]{16,})", "owned": r"([A-Za-z0-9_-]{20,})"}
#: A wide candidate has a digit, a capital and a small letter, and is found in one repository of one owner.
MIXED = r"^(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])"
#: A value that so many distinct owners have is a widely copied example.
COPIED = 3
#: Rows of corpus counts up to which they are broadcast to the candidates; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def pieces_of(kind: str, text: Column) -> Column:
    """order, gaps, found: the matches of one kind, leftmost and without overlaps, and the lengths of what lies between them.

    The gaps come from splitting by the pattern, the matches from extracting it. Null where there is no match.
    """
    order = list(PATTERNS).index(kind)
    gaps = F.transform(F.split(text, SEARCH[kind]), F.length)
    found = F.regexp_extract_all(text, F.lit(SEARCH[kind]), F.lit(0))
    return F.when(F.rlike(text, F.lit(SEARCH[kind])), F.struct(F.lit(order).alias("kind"), gaps.alias("gaps"), found.alias("found")))


def candidates(docs: DataFrame) -> DataFrame:
    """id, row, owner, repository, start, end, kind (its order), value of each candidate in docs; id is that of the row of docs.

    Adding up the lengths of gaps and matches gives the places, in code points: a running sum over a document's own matches.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.array_compact(F.array(*(pieces_of(k, text) for k in PATTERNS))).alias("ps")
    numbered = docs.select(F.monotonically_increasing_id().alias("id"), "row", "owner", "repository", found)  # before a row is exploded
    rows = numbered.select("id", "row", "owner", "repository", F.explode("ps").alias("p"))
    # the array is a column of its own, so that it isn't carried along with each of its elements
    zipped = rows.select("id", "row", "owner", "repository", "p.kind", F.arrays_zip(F.col("p.gaps").alias("gap"), F.col("p.found").alias("match")).alias("zs"))
    each = zipped.select("id", "row", "owner", "repository", "kind", F.posexplode("zs").alias("i", "z"))
    each = each.where("z.match is not null")
    upto = W.partitionBy("id", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("z.gap") + F.length("z.match")).over(upto).cast("int")
    value, least, mixed = F.lit(None).cast("string"), F.lit(0), F.lit(True)
    for order, kind in enumerate(PATTERNS):
        mine = F.col("kind") == order
        value = F.when(mine, F.regexp_extract("z.match", PATTERNS[kind], 1)).otherwise(value)
        least = F.when(mine, LEAST[kind]).otherwise(least)
        mixed = F.when(mine, F.rlike("value", F.lit(MIXED))).otherwise(mixed) if kind == "owned" else mixed
    placed = each.select("id", "row", "owner", "repository", "kind", (end - F.length("z.match")).alias("start"), end.alias("end"), value.alias("value"), least.alias("least"))
    placed = placed.where((F.length("value") >= F.col("least")) & mixed).drop("least")
    # a wide candidate that touches a base one adds nothing
    base = F.col("kind") < BASE_KINDS
    upto_here = lambda order: W.partitionBy("id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)  # noqa: E731  grows by a row each step
    behind = F.max(F.when(base, F.col("end"))).over(upto_here(F.asc("start")))
    ahead = F.min(F.when(base, F.col("start"))).over(upto_here(F.desc("start")))
    touches = (F.coalesce(behind, F.lit(-1)) > F.col("start")) | F.coalesce(ahead < F.col("end"), F.lit(False))
    return placed.withColumn("touches", touches).where(base | ~F.col("touches")).drop("touches")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_docs, n_repositories, n_owners, verdict of each candidate value over the whole corpus.

    A value is counted once for each repository before repositories and owners are counted, so that a value that a third
    of the corpus has moves as few rows as it has repositories.
    """
    each = found.select("id", "owner", "repository", F.xxhash64("value").alias("hash")).distinct()
    by_repo = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("docs"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("docs").alias("docs"), F.count("*").alias("repositories"))
    total = by_owner.groupBy("hash").agg(
        F.sum("docs").alias("n_docs"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners")
    )
    verdict = F.when(F.col("n_owners") >= COPIED, "copied").when(F.col("n_owners") == 1, "owned").otherwise("shared")
    return total.withColumn("verdict", verdict)


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """doc_id, spans (array of start, end, kind, n_docs, n_repositories, n_owners, verdict) for each row of docs.

    docs(doc_id, text, and the columns named by owner and repository; one may serve as both). A null text is empty, a
    null owner or repository is one owner of its own. Repeated rows are reported each; they count as documents. Kinds are
    assign, access, hex and owned, spans in code points by start, then kind. Other columns are ignored; an empty table
    gives no rows.
    """
    docs = docs.select("doc_id", "text", F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text", "owner", "repository"))
    found = written(candidates(docs), "secret-candidates")
    counts = written(ownership(found), "secret-owners")
    # base spans stay; only those of the wide net depend on the counts, but all report them. Equal rows have equal spans
    each = found.select("row", "kind", "start", "end", F.xxhash64("value").alias("hash")).dropDuplicates(["row", "kind", "start"])
    joined = each.join(F.broadcast(counts) if small_enough(counts, BROADCAST_ROWS) else counts, "hash")
    kept = joined.where((F.col("kind") < BASE_KINDS) | (F.col("verdict") == "owned"))
    kind = F.element_at(F.array(*(F.lit(k) for k in PATTERNS)), F.col("kind") + 1)
    span = F.struct(
        F.col("start"), F.col("kind").alias("order"), F.col("end"), kind.alias("kind"),
        F.col("hash"), "n_docs", "n_repositories", "n_owners", "verdict",
    )
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return docs.select("doc_id", "row").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def digests(scanned: DataFrame) -> DataFrame:
    """The digest columns of op6."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["order"] < BASE_KINDS)
    return scanned.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "owned")).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "copied")).cast("long").alias("n_copied"),
    )
