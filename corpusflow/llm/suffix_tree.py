"""A probabilistic suffix tree over words: a language model whose contexts are as long as they are worth it.

Nodes are contexts of up to DEPTH words. A context is kept if its next-word distribution diverges from that of its suffix (the
context without its first word): the gain in log-likelihood over the suffix's distribution is at least GAIN for each of its
parameters. Suffixes of kept contexts are kept, too. With N words after a context s, events (s, w) seen CUT times or more, T of
them, and the suffix r of s:

    P(w | s) = (c(s, w) + m * P(w | r)) / (N + T)    m = N + T - sum of the c(s, .)
    P(w) = (c(w) + 0.1) / (total + 0.1 * (V + 1))    at the root

where c(s, w) counts as 0 below CUT. A word's probability is that of the longest kept suffix of the words before it. The log of it
is a sum over n-grams: log P(w), plus for each kept context s that ends before w its log(m / (N + T)), plus for each event (s, w) of it
log P(w | s) - log P(w | r) - log(m / (N + T)). So every n-gram has one weight, and a text's score is a sparse dot product.

Counts come in one pass for each length: words, then events of contexts that can be kept (frequent ones, by the counts before).
A task adds up its own n-grams, sorted by hash, and sends them as packed slices of the hash range, so that a frequent n-gram
moves once a task and no slice depends on one key. Weights of the most frequent n-grams are broadcast, up to HEAD of them; those
of others meet the texts' n-grams in a join. N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import arrays
from corpusflow.llm.tokens import word_codes
from corpusflow.session import batches_of, dropped, written

DEPTH = 2
#: How often a context, and an event, stands at least.
CONTEXT, CUT = 16, 4
#: Nats that a context gains for each of its events and itself.
GAIN = 2.0
#: N-grams, the most frequent ones, that a broadcast holds at most (16 bytes each).
HEAD = 1 << 21
#: N-grams in a slice, about.
SLICE = 1 << 20
#: Texts that go to Python at a time.
ROWS = 500
SMOOTH = 0.1
#: The end of a text: one token more, which is no word's hash but by chance.
END = np.uint64(0x5851F42D4C957F2D)
EVENTS = "context long, word long, n long"


def word_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, codes, firsts) of the tokens of texts: keys[codes[i]] is token i's hash; text t has tokens firsts[t]:firsts[t + 1]."""
    codes, edge, at, packed, values = word_codes(arrays.TO_LOWER[data], bounds)
    length = at[values + 1] - at[values]
    ends = np.cumsum(length)
    own = packed[np.repeat(at[values] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]  # each word's bytes once
    keys = arrays.word_hashes(own, ends - length, ends, _powers)
    texts = len(bounds) - 1
    out = np.full(len(codes) + texts, len(keys), np.int64)
    firsts = edge + np.arange(texts + 1)
    out[np.arange(len(codes)) + np.repeat(np.arange(texts), np.diff(edge))] = codes
    return np.append(keys, END), out, firsts


_powers = arrays.Powers()


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of all but its last word and of that."""
    return arrays.mixed(context * np.uint64(arrays.BASE) + word + np.uint64(1))


def places(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """np.searchsorted(own, keys), within own: in the order of the keys, which reads a large table from one end to the other."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int32)
    out[order] = np.minimum(np.searchsorted(own, keys[order]), max(0, len(own) - 1))
    return out


def known(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether keys are in the table, their values or 0)."""
    own, values = table
    if not len(own):
        return np.zeros(len(keys), bool), np.zeros(len(keys), values.dtype)
    at = places(own, keys)
    there = own[at] == keys
    return there, np.where(there, values[at], values.dtype.type(0))


class Filter:
    """Which keys can be in a table of keys, by their first 24 bits: most that aren't are told without a search. It takes 2 MB."""

    def __init__(self, keys: np.ndarray) -> None:
        may = np.zeros(1 << 24, bool)
        may[(keys >> np.uint64(40)).astype(np.int64)] = True
        self.may = np.packbits(may, bitorder="little")

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        first = (keys >> np.uint64(40)).astype(np.int32)
        return (self.may[first >> 3] >> (first & 7).astype(np.uint8) & 1).astype(bool)


def seen_in(may: Filter, table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """known(), of keys that are mostly not there."""
    hit, out = np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.flatnonzero(may(keys))
    hit[at], out[at] = known(table, keys[at])
    return hit, out


def chunks_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first, data, bounds in arrays.chunks(batch.column(column)):
            yield (batch.slice(first, len(bounds) - 1), *word_keys(data, bounds))


def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows of (key, further columns ..., count) with counts added by key, sorted by key. The parts are used up."""
    columns = []
    for k in range(len(parts[0])):
        columns.append(np.concatenate([p[k] for p in parts]))
        parts[:] = [(*p[:k], None, *p[k + 1 :]) for p in parts]
    parts.clear()
    order = np.argsort(columns[0])
    columns[0] = columns[0][order]
    new = np.ones(len(order), bool)
    new[1:] = columns[0][1:] != columns[0][:-1]
    first = np.flatnonzero(new)
    n = np.add.reduceat(columns[-1][order], first, dtype=columns[-1].dtype) if len(first) else columns[-1]
    order = order[first]
    return (columns[0][first], *(c[order] for c in columns[1:-1]), n)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, keys, codes, _ in chunks_of(batches, 0):
            parts.append((keys, np.bincount(codes, minlength=len(keys)).astype(np.int64)))
            held += len(keys)
            if held > SLICE:
                yield pa.RecordBatch.from_arrays([signed(c) for c in added(parts)], names=["word", "n"])
                held = 0
        if parts:
            yield pa.RecordBatch.from_arrays([signed(c) for c in added(parts)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def head_of(table: DataFrame, key: str, value: str, most: int, by: str | None = None) -> tuple[Broadcast, float]:
    """(sorted keys and their values, least) of the rows whose `by` is at least `least`, which are `most` at most, as a broadcast.

    least is a power of two, 1 if all rows are in it.
    """
    by = by or value
    power = F.length(F.bin(F.col(by).cast("long"))) - 1
    sizes = table.groupBy(power.alias("b")).count().collect()  # a row for each power of two
    least, held = 0, 0
    for b, n in sorted(((r["b"], r["count"]) for r in sizes), reverse=True):
        if held + n > most:
            least = b + 1
            break
        held += n
    rows = table.where(power >= least).select(key, value).toArrow()
    keys, values = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return table.sparkSession.sparkContext.broadcast((keys[order], values[order])), float(2**least)


def events(docs: DataFrame, depth: int, words: tuple[Broadcast, float], contexts: Broadcast | None, slices: int) -> DataFrame:
    """context, word, n (CUT at least) of events after contexts of `depth` words.

    words: counts of frequent words, and the least of them; contexts: the keys of the contexts that can be kept, None: not known.
    """
    shared, least = words
    bits = max(0, (slices - 1).bit_length())
    # words of events are all among the frequent ones, unless these begin above CUT; then their places there stand for them,
    # and so do those of known contexts
    short = least <= CUT
    kinds = [np.int32 if contexts is not None or short and depth == 1 else np.uint64, np.int32 if short else np.uint64, np.int32]
    names = ["context", "word", "n"]

    def full(column: np.ndarray, known: bool = False) -> np.ndarray:
        """The hashes that places stand for, of words or of known contexts."""
        if column.dtype != np.int32:
            return column
        return (contexts.value if known else shared.value[0])[column]

    def pack(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        part = (rows[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(rows[0]), np.int64)
        order = np.lexsort((rows[1], part))  # equal contexts together: they take little room
        part = part[order]
        columns = [c[order] for c in rows[1:]]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cut[1:], len(part))
        blobs = [pa.array([c[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(part[cut]), *blobs], names=["slice", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, may = [], 0, None if contexts is None else Filter(contexts.value)
        for _, keys, codes, firsts in chunks_of(batches, 0):
            own = shared.value[0]
            place = places(own, keys)
            there = own[place] == keys if len(own) else np.zeros(len(keys), bool)
            n = np.where(there, shared.value[1][place] if len(own) else 0, least - 1)  # a word that isn't among the frequent ones stands less often
            ok = np.ones(len(codes), bool)  # position i ends an event
            for d in range(depth):
                ok[firsts[:-1][firsts[:-1] + d < firsts[1:]] + d] = False
            ok &= (n >= CUT)[codes]
            frequent = (n >= CONTEXT)[codes]
            at = np.flatnonzero(ok)
            for d in range(1, depth + 1):
                at = at[frequent[at - d]]
            context = keys[codes[at - depth]]
            for d in range(depth - 1, 0, -1):
                context = extended(context, keys[codes[at - d]])
            if contexts is not None:
                some = np.flatnonzero(may(context))
                table = contexts.value
                among = places(table, context[some])
                there = table[among] == context[some] if len(table) else np.zeros(len(some), bool)
                some, among = some[there], among[there]
                at, context = at[some], context[some]
            key = extended(context, keys[codes[at]])
            if contexts is not None:
                context = among
            elif short and depth == 1:
                context = place[codes[at - 1]]
            word = place[codes[at]] if short else keys[codes[at]]
            parts.append((key, context, word, np.ones(len(at), np.int32)))
            held += len(at)
            if held > SLICE:
                yield from pack(added(parts))
                held = 0
        if parts:
            yield from pack(added(parts))

    def count(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in rows:
            for i in range(batch.num_rows):
                c, w, n = (np.frombuffer(batch.column(x)[i].as_buffer(), t) for x, t in zip(names, kinds))
                parts.append((extended(full(c, contexts is not None), full(w)), c, w, n))
        _, c, w, n = added(parts)
        some = n >= CUT
        yield pa.RecordBatch.from_arrays([signed(x) for x in (full(c[some], contexts is not None), full(w[some]), n[some].astype(np.int64))], names=names)

    sent = docs.select("text").mapInArrow(run, "slice long, context binary, word binary, n binary")
    return sent.groupBy("slice").applyInArrow(count, EVENTS)


def key_of(context: str, word: str) -> Column:
    """extended() in a small table."""

    @F.arrow_udf("long")
    def run(c: pa.Array, w: pa.Array) -> pa.Array:
        return signed(extended(c.to_numpy(zero_copy_only=False).view(np.uint64), w.to_numpy(zero_copy_only=False).view(np.uint64)))

    return run(context, word)


def contexts_of(rows: DataFrame, gain: float) -> DataFrame:
    """rows(context, middle, word, n, total, below) with rest (m), size (N + T), p and keep, whether the context diverges; below: P(word | suffix)."""
    sums = rows.groupBy("context").agg(F.sum("n").alias("seen"), F.count("*").alias("kinds"), F.first("total").alias("total"))
    sums = sums.select("context", (F.col("total") + F.col("kinds") - F.col("seen")).alias("rest"), (F.col("total") + F.col("kinds")).alias("size"), (F.col("total") - F.col("seen")).alias("others"), "kinds")
    both = rows.drop("total").join(sums, "context").withColumn("p", (F.col("n") + F.col("rest") * F.col("below")) / F.col("size"))
    won = both.groupBy("context").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("below"))).alias("won"), F.first("others").alias("others"), F.first("rest").alias("rest"), F.first("size").alias("size"), F.first("kinds").alias("kinds"))
    worth = F.col("won") + F.col("others") * F.log(F.col("rest") / F.col("size")) >= gain * (1 + F.col("kinds"))
    return both.drop("others", "kinds").join(won.select("context", worth.alias("keep")), "context")


class Model:
    """words(word, n); contexts(key, n, weight) that are kept and gains(key, n, weight) of events after them, in log10; N and V."""

    def __init__(self, words: DataFrame, contexts: DataFrame, gains: DataFrame, total: int, kinds: int) -> None:
        self.words, self.contexts, self.gains, self.total, self.kinds = words, contexts, gains, total, kinds


def train(docs: DataFrame, depth: int = DEPTH, gain: float = GAIN, head: int = HEAD) -> Model:
    """The tree of docs(text), as weights of its n-grams, in log10."""
    with batches_of(docs.sparkSession, ROWS):
        words = written(word_counts(docs), "tree-words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    divisor = total + SMOOTH * (kinds + 1)
    frequent = head_of(words, "word", "n", head)
    slices = max(1, total // SLICE)
    ends = int(END.view(np.int64))
    # n-grams that can be contexts: key, n and middle, the key without the first word
    can, below = words.where(F.col("word") != ends).select(F.col("word").alias("context"), F.col("n").alias("total"), F.lit(0).cast("long").alias("middle")), None
    known_contexts, levels = None, []
    for d in range(1, depth + 1):
        with batches_of(docs.sparkSession, ROWS):
            found = written(events(docs, d, frequent, known_contexts, slices), "tree-events")
        if known_contexts:
            known_contexts.destroy()
        rows = found.join(can.where(F.col("total") >= CONTEXT), "context")
        if d == 1:
            rows = rows.join(words.select("word", ((F.col("n") + SMOOTH) / divisor).alias("below")), "word")
        else:  # an event after a context stands after its suffix at least as often
            rows = rows.join(below, ["middle", "word"])
        level = written(contexts_of(rows, gain).withColumn("key", key_of("context", "word")), "tree-contexts")
        dropped(found)
        levels.append(level)
        below = level.select(F.col("context").alias("middle"), "word", F.col("p").alias("below"))
        if d < depth:
            can = written(level.where((F.col("n") >= CONTEXT) & (F.col("word") != ends)).select(F.col("key").alias("context"), F.col("n").alias("total"), (F.col("word") if d == 1 else key_of("middle", "word")).alias("middle")), "tree-can")
            some = can.select("context").limit(head + 1)
            known_contexts = docs.sparkSession.sparkContext.broadcast(np.sort(some.toArrow().column(0).to_numpy().view(np.uint64))) if some.count() <= head else None
    frequent[0].destroy()
    gains, losses, inner = [], [], None
    for level in reversed(levels):
        kept = level.where("keep")
        if inner is not None:  # suffixes of kept contexts
            kept = kept.unionByName(level.where("not keep").join(inner, "context", "left_semi"))
        inner = kept.select(F.col("middle").alias("context")).distinct()
        lost = F.log10(F.col("rest") / F.col("size"))
        gains.append(kept.select("key", "n", (F.log10("p") - F.log10("below") - lost).alias("weight")))
        losses.append(kept.groupBy(F.col("context").alias("key")).agg(F.max("size").alias("n"), F.first(lost).alias("weight")))
    both = [written(reduce(DataFrame.unionByName, x), "tree-weights") for x in (losses, gains)]
    dropped(*levels)  # all that is left of them is in the weights
    return Model(words, *both, total, kinds)


def in_tenth() -> Column:
    """Held out: one document in ten, by the crc32 of doc_id; a null doc_id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def bits_of(keys: DataFrame) -> np.ndarray:
    """A table of 2 ** 27 bits (16 MB, however many keys there are) in which the bit of each key's first 27 bits is set."""
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 37) & 63 as int))")
    rows = keys.groupBy(F.shiftrightunsigned("key", 43).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2 ** 21 rows
    out = np.zeros(1 << 21, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that aren't among those of bits_of()."""
    return (bits[(keys >> np.uint64(43)).astype(np.int64)] >> ((keys >> np.uint64(37)) & np.uint64(63))) & np.uint64(1) == 1


#: What a text's n-gram can be: a word, a kept context, an event after one.
WORD, LOSS, WON = 0, 1, 2
FAR = "array<struct<key:long,kind:int,n:long>>"


def lists_of(texts: int, parts: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.Array:
    """FAR for each text from (texts, keys, kind), equal ones counted."""
    text, key = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    kind = np.concatenate([np.full(len(t), k) for t, _, k in parts] or [np.zeros(0, np.int64)])
    order = np.lexsort((key, kind, text))
    text, key, kind = text[order], key[order].astype(np.uint64).view(np.int64), kind[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(text)))
    rows = pa.StructArray.from_arrays([pa.array(key[first]), pa.array(kind[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "kind", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[first], np.arange(texts + 1)).astype(np.int32)), rows)


def score(docs: DataFrame, model: Model, depth: int = DEPTH, head: int = HEAD) -> DataFrame:
    """docs(doc_id, held_out, text) with n_tokens, n_known, base_score and score (log10) in place of the text.

    N-grams that the broadcast heads don't have, and that can be in the rest of the model, meet it in a join: events only where
    they follow a kept context, if all contexts are in their head, and n-grams only where a bit table of fixed size lets them be there.
    """
    words, least = head_of(model.words, "word", "n", head)
    contexts, rarest = head_of(model.contexts, "key", "weight", head, "n")
    gains, fewest = head_of(model.gains, "key", "weight", head, "n")
    divisor = model.total + SMOOTH * (model.kinds + 1)
    none = math.log10(SMOOTH / divisor)
    all_words, all_contexts, all_gains = least <= 1, rarest <= 1, fewest <= 1
    rest_of = model.contexts.where(F.col("n") < rarest).select("key").unionByName(model.gains.where(F.col("n") < fewest).select("key"))
    tail_bits = docs.sparkSession.sparkContext.broadcast(None if all_contexts and all_gains else bits_of(rest_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_lose, may_win = Filter(contexts.value[0]), Filter(gains.value[0])
        for some, keys, codes, firsts in chunks_of(batches, 3):
            texts = len(firsts) - 1
            text = np.repeat(np.arange(texts), np.diff(firsts))
            held = some.column(2).to_numpy(zero_copy_only=False).astype(bool)
            there, n = known(words.value, keys)
            often = np.where(there, n, least - 1) >= CUT  # no event ends with a rarer word
            once = np.zeros(len(codes), bool)
            if not all_words and least <= 2:  # a word of a text that was learned from stands once, if it isn't among those that stand twice
                once = ~there[codes] & ~held[text]
            log = np.log10((n + SMOOTH) / divisor)[codes]
            log[once] = math.log10((1 + SMOOTH) / divisor)
            sure = there[codes] | once
            base = np.bincount(text[sure], log[sure], texts).astype(float)
            count = np.bincount(text[sure], minlength=texts)
            far = [] if all_words else [(text[~sure], keys[codes[~sure]], WORD)]
            extra, gram, kept = np.zeros(texts), keys[codes], None
            for d in range(depth + 1):
                if d:
                    gram = extended(gram[:-1], keys[codes[d:]])
                t = text[: len(gram)]
                within = np.arange(len(gram)) + d < firsts[t + 1]
                if d:  # events after the d words before
                    at = np.flatnonzero(within & kept[: len(gram)] if all_contexts else within)
                    hit, w = seen_in(may_win, gains.value, gram[at])
                    extra += np.bincount(t[at], w, texts)
                    if not all_gains:
                        at = at[~hit]
                        at = at[often[codes[at + d]]]
                        at = at[in_bits(tail_bits.value, gram[at])]
                        far.append((t[at], gram[at], WON))
                if d < depth:
                    kept, w = seen_in(may_lose, contexts.value, gram if d else keys)
                    if not d:  # a word is looked up once for all its places
                        kept, w = kept[codes], w[codes]
                    kept &= within
                    extra += np.bincount(t[kept], w[kept], texts)
                    if not all_contexts:
                        rest = np.flatnonzero(within & ~kept)
                        rest = rest[in_bits(tail_bits.value, gram[rest])]
                        far.append((t[rest], gram[rest], LOSS))
            yield pa.RecordBatch.from_arrays(
                [*some.columns[:3], pa.array(np.diff(firsts)), pa.array(count), pa.array(base), pa.array(extra), lists_of(texts, far)],
                names=["row", "doc_id", "held_out", "n_tokens", "count", "base", "extra", "far"],
            )

    types = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, count long, base double, extra double"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    with batches_of(docs.sparkSession, ROWS):
        rows = written(rows.mapInArrow(run, f"{types}, far {FAR}"), "tree-scored")
    for used in (words, contexts, gains, tail_bits):
        used.destroy()  # the table is written, nothing asks for them again
    if not (all_words and all_contexts and all_gains):
        far = rows.select("row", F.explode("far").alias("f")).select("row", "f.key", "f.kind", F.col("f.n").alias("times"))
        log = F.log10((F.col("n") + SMOOTH) / divisor)
        tail = model.words.select(F.col("word").alias("key"), F.lit(WORD).alias("kind"), log.alias("weight"), "n").where(F.col("n") < least)
        for table, bound, kind in ((model.contexts, rarest, LOSS), (model.gains, fewest, WON)):
            tail = tail.unionByName(table.where(F.col("n") < bound).select("key", F.lit(kind).alias("kind"), "weight", "n"))
        word = F.col("kind") == WORD
        more = far.join(tail, ["key", "kind"]).groupBy("row").agg(
            F.sum(F.when(word, F.col("times")).otherwise(0)).alias("count2"), F.sum(F.when(word, F.col("times") * F.col("weight")).otherwise(0.0)).alias("base2"),
            F.sum(F.when(word, 0.0).otherwise(F.col("times") * F.col("weight"))).alias("extra2"),
        )
        rows = rows.join(more, "row", "left")
        for c in ("count", "base", "extra"):
            rows = rows.withColumn(c, F.col(c) + F.coalesce(F.col(f"{c}2"), F.lit(0)))
    base = F.col("base") + (F.col("n_tokens") - F.col("count")) * F.lit(none)
    return rows.select("doc_id", "held_out", "n_tokens", F.col("count").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("extra")).alias("score"))


def language_model(docs: DataFrame, depth: int = DEPTH, gain: float = GAIN, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text, ...).

    The tree is learned from the rows that aren't held out, as often as they stand; rows without doc_id are learned from. Null,
    empty and blank texts have one token, the end. Repeated rows score alike. With nothing to learn from all tokens are unknown
    and equally likely. Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select("doc_id", in_tenth().alias("held_out"), "text")
    return score(own, train(own.where("not held_out"), depth, gain, head), depth, head)
