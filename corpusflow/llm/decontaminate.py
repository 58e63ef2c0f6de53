"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index is a table of postings (term, doc_id, pos) of every word of the corpus that any benchmark item has, and a row
without a term for each document with its number of words. A window of ten item words can occur in a document only where its
rarest terms stand at the window's distances. So the postings of each window's rarest terms (by the whole corpus's counts)
are shifted by their offset in the item, and what is left after intersecting them are alignments: a document, an item and
the distance between their positions. Exact matches need the two rarest. A proximity match may lack any words, of ten as
many as NEAR allows: so many more terms are taken, of which any two must stand in place. At each alignment the item's words are laid beside the document's; runs
of ten equal words are exact phrase matches, and windows with at least eight of ten are proximity matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.text import lower_az, small_enough
from corpusflow.session import written

WINDOW = 10
#: Words of a proximity match that must stand in place, of ten.
NEAR = 8
#: Rows of benchmark terms, or candidate documents, up to which a table is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Everything that is not a digit, a lower-case letter or beyond ASCII, once A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(lower_az(text), GAPS), lambda w: w != "")


def hint(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small_enough(df, rows) else df


def item_words(items: DataFrame) -> DataFrame:
    """item_id, words for each distinct item text that has words. Rows that share an identifier are separate items."""
    rows = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return rows.dropDuplicates().withColumn("item", F.xxhash64("item_id", "words"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: row, term, pos of each word in terms(word, term); the row without a term has the number of words."""
    tokens = docs.select("row", words(F.col("text")).alias("words"))
    counted = F.concat("words", F.array(F.concat(F.lit(" "), F.size("words").cast("string"))))
    tokens = tokens.select("row", F.posexplode(counted).alias("pos", "word"))
    found = tokens.join(hint(terms), "word", "left")
    return found.where(F.startswith("word", F.lit(" ")) | F.col("term").isNotNull()).select("row", "term", F.col("pos").cast("int").alias("pos"))


def anchors(items: DataFrame, counts: DataFrame, near: bool = True) -> DataFrame:
    """For each window of each item its rarest terms: item, start, need, term, at (the term's place in the item).

    Two terms, and with near one more for each word of the window that a proximity match may lack.
    """
    placed = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    # a term that no document has can't be part of an exact match: its count is 0 and it is the rarest
    placed = placed.withColumn("term", F.xxhash64("word")).join(counts, "term", "left").fillna(0, ["df"])
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - (WINDOW - 1)), F.greatest(F.lit(0), F.least(F.col("at"), F.col("n") - WINDOW)))
    windows = placed.withColumn("start", F.explode(starts)).withColumn("need", F.least(F.lit(2), F.col("n")))
    order = W.partitionBy("item", "start").orderBy("df", "at")
    size = F.least(F.col("n"), F.lit(WINDOW))
    lacking = F.floor(size * (WINDOW - NEAR) / WINDOW) if near else F.lit(0)
    return windows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 + lacking).select("item", "start", "need", "term", "at")


def near_alignments(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """row, item, shift where two anchors less than a window apart stand in place: all alignments(), and a few more.

    An anchor counts once for all windows that it is of. Its place is a bit of a word that goes round: places that share a
    bit are 64 apart, so never in one window.
    """
    places = anchored.groupBy("item", "term", "at").agg(F.max("need").alias("need"))
    bit = F.expr("shiftleft(1L, at % 64)")
    hits = index.join(hint(places), "term").select("row", "item", "need", (F.col("pos") - F.col("at")).alias("shift"), bit.alias("bit"))
    held = hits.groupBy("row", "item", "shift").agg(F.bit_or("bit").alias("bits"), F.max("need").alias("need"))
    turned = lambda d: F.shiftleft("bits", d).bitwiseOR(F.shiftrightunsigned("bits", 64 - d))
    close = reduce(Column.bitwiseOR, [F.col("bits").bitwiseAND(turned(d)) for d in range(1, WINDOW)])
    return held.where((F.col("need") == 1) | (close != 0)).select("row", "item", "shift")


def alignments(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """row, item, shift where both rarest terms of some window stand in place."""
    hits = index.join(hint(anchored), "term").select("row", "item", "start", "need", "at", (F.col("pos") - F.col("at")).alias("shift"))
    held = hits.groupBy("row", "item", "shift", "start").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.max("need").alias("need"))
    return held.where("need = 1 or a < b").select("row", "item", "shift").distinct()


def compared(found: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """row, item_id, spans (start, end of runs of equal words that hold a window), near (windows with NEAR in place)."""
    few = hint(found.select("row").distinct())
    texts = docs.join(few, "row", "left_semi").select("row", words(F.col("text")).alias("doc_words"))
    pairs = found.join(hint(items), "item").join(texts, "row")
    # equal[i]: item word i stands at its place in the document
    equal = F.transform("words", lambda w, i: w.eqNullSafe(F.get(F.col("doc_words"), i + F.col("shift"))))
    pairs = pairs.select("row", "item_id", "shift", equal.alias("equal"), F.least(F.size("words"), F.lit(WINDOW)).alias("size"))
    starts = F.sequence(F.lit(0), F.size("equal") - F.col("size"))
    in_place = lambda i: F.size(F.filter(F.slice("equal", i + 1, F.col("size")), lambda e: e))
    pairs = pairs.withColumn("starts", starts).withColumn("held", F.transform("starts", in_place))
    full = F.filter("starts", lambda i: F.get(F.col("held"), i) == F.col("size"))
    near = F.size(F.filter("held", lambda h: (h < F.col("size")) & (h * WINDOW >= F.col("size") * NEAR)))
    pairs = pairs.select("row", "item_id", "shift", "size", full.alias("full"), near.alias("near"))
    return pairs.dropDuplicates(["row", "item_id", "shift", "size", "full"])  # repeated rows of docs


def decontaminate(docs: DataFrame, items: DataFrame, near: bool = True, row: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, hit_items, hit_spans for each row of docs.

    docs(doc_id, text), items(item_id, text); other columns are ignored. Null texts have no words and hit nothing, as do
    items without words; items of fewer than ten words are one window. Repeated rows of docs are judged each by itself;
    items that share an identifier count once in n_items and items_sha256; a null item_id counts as the text "null".
    An empty benchmark hits nothing, an empty corpus gives no rows. hit_spans are (start, end) in words. n_near counts the
    proximity matches: windows of an item, at a place of the document, with eight of ten words in place but not all. Without
    near, which spares their search, n_near is null. row names a column of docs that no two rows share, which then comes along.
    """
    docs = docs.select("doc_id", "text", F.col(row).alias("row") if row else F.xxhash64("doc_id", "text").alias("row"))
    items = written(item_words(items.select("item_id", "text")), "bench-items")
    terms = items.select(F.explode("words").alias("word")).distinct()
    index = written(postings(docs, terms.withColumn("term", F.xxhash64("word"))), "bench-postings")
    counts = index.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    found = written((near_alignments if near else alignments)(index, written(anchors(items, counts, near), "bench-anchors")), "bench-alignments")
    pairs = compared(found, items, docs)
    span = F.transform("full", lambda i: F.struct((i + F.col("shift")).alias("start"), (i + F.col("shift") + F.col("size")).alias("end")))
    per_item = pairs.select("row", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), span.alias("spans"), "near")
    hits = per_item.groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.size("spans") > 0, F.col("id")))).alias("ids"),
        F.sum("near").cast("long").alias("near"),
    )
    # the words of overlapping windows count once
    at = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    hits = hits.select("row", "ids", "near", at.alias("at"))
    after = F.transform("at", lambda p: p + 1)
    ends = F.arrays_zip(F.array_sort(F.array_except("at", after)).alias("start"), F.array_sort(F.array_except(after, "at")).alias("end"))
    hits = hits.select("row", "ids", "near", F.size("at").alias("n_hit"), ends.alias("hit_spans"))
    total = index.where("term is null").groupBy("row").agg(F.max("pos").alias("n_words"))
    return docs.select("doc_id", "row").join(total, "row", "left").join(hits, "row", "left").select(*digest_columns(near), *([F.col("row").alias(row)] if row else []))


def digest_columns(near: bool) -> list[Column]:
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return [
        F.col("doc_id"),
        F.coalesce(F.col("n_words"), F.lit(0)).cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        (F.coalesce(F.col("near"), F.lit(0)) if near else F.lit(None)).cast("long").alias("n_near"),
        ids.alias("hit_items"),
        F.coalesce("hit_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("hit_spans"),
    ]
