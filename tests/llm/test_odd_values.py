"""Values, not only counts, for odd rows of packing, quality scores and decontamination; both tokenizers on random text."""

import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, packing, quality
from tests.llm import brute
from tests.llm.test_cases import ODD, frame


def test_packing_of_odd_rows(spark):
    """Each row's pieces hold its ids and the end, whole and in order; places in sequences are gapless."""
    encode = packing.public_tokens()
    got = defaultdict(list)
    places = defaultdict(list)
    for r in packing.pack(frame(spark, ODD)).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, text in ODD:
        ids = np.array([*encode(text or ""), 0], "<u4")
        want[i] += [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 2048))]
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert want[1] == [(0, 0, 1, zlib.crc32(bytes(4)))] == want[2]  # null and empty texts are their end alone
    for spans in places.values():
        spans = sorted(spans)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= 2048


def test_quality_of_odd_rows(spark):
    """Null, empty and blank texts score as the bias; rows that repeat score alike; the score is of the text, not of the row."""
    rows = ODD + [(8, "good words here"), (9, "good words here"), (10, "0 0 0 junk"), (11, "0 0 0 junk")]
    labels = spark.createDataFrame([(8, 1), (9, 1), (10, 0), (11, 0), (None, 1), (4, None), (8, 0)], "doc_id long, quality int")
    docs = frame(spark, rows)
    out = quality.classify(docs, docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(round(r.score, 12))
    assert by[1] == by[2] == by[3] and len(by[5]) == 1 and by[8] == by[9] and by[10] == by[11]
    assert {r.held_out for r in out if r.doc_id is None} == {False}


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"word{i % 977}x{i}" for i in range(500, 515))
    items = [(1, item), (2, None), (3, ""), (4, "same id a"), (4, "same id a"), (5, "é"), (None, "no id")]
    got = decontaminate.decontaminate(frame(spark, ODD), spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    want = []
    for i, text in ODD:
        w, hit, found = brute.bench_words(text), set(), set()
        for item_id, t in items:
            x = brute.bench_words(t)
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(item_id)
        want.append((i, len(w), len(hit), len([f for f in found if f is not None]) if None not in found else None, bool(hit)))
    ours = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got]
    assert sorted([r[:3] + r[4:] for r in ours], key=key) == sorted([r[:3] + r[4:] for r in want], key=key)
    assert {(r[0], r[3]) for r in ours if r[0] is not None} == {(r[0], r[3]) for r in want if r[0] is not None}


def test_both_tokenizers_agree_on_latin_text():
    t = packing.public_tokens()
    r = random.Random(17)
    special = list(t.special)
    signs = [chr(c) for c in range(0x20, 0x250)] + ["\n", "\t", "\r", "\x00", "  ", "'s", "'LL", *special, *(s[:-1] for s in special)]
    for _ in range(4000):
        text = "".join(r.choice(signs) for _ in range(r.randint(1, 40)))
        assert t(text) == t.slow.encode(text, add_special_tokens=False).ids, text
