"""Proximity matches against a plain version that tries every place."""

import random

from corpusflow.llm import decontaminate
from tests.llm.brute import bench_words


def near_matches(text, items):
    """Windows of an item, at a place of the text, with eight of ten words in place but not all."""
    doc, n = bench_words(text), 0
    for item in items:
        w = bench_words(item)
        size = min(len(w), 10)
        for shift in range(-len(w), len(doc)):
            equal = [0 <= i + shift < len(doc) and doc[i + shift] == x for i, x in enumerate(w)]
            for s in range(len(w) - size + 1):
                held = sum(equal[s : s + size])
                n += held < size and 10 * held >= 8 * size
    return n


def test_near_matches_equal_brute_force(spark):
    r = random.Random(4)
    common = [f"c{i}" for i in range(8)]
    item = "one two three four five six rarest eight nine ten eleven"
    items = [item] + [" ".join(r.choice(common) if r.random() < 0.4 else f"u{k}x{i}" for i in range(n)) for k, n in enumerate((2, 4, 5, 8, 9, 10, 14, 25))]
    docs = [(0, item.replace("rarest", "misspelt")), (1, item), (2, None), (3, item.replace("rarest", "x").replace("two", "y"))]
    for i in range(10, 90):
        w = r.choice(items).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice([*common, "typo"])
        docs.append((i, " ".join([r.choice(common) for _ in range(r.randrange(12))] + w + ["end"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.decontaminate(frame, bench).collect()}
    assert {i: x.n_near for i, x in got.items()} == {i: near_matches(t, items) for i, t in docs}
    assert got[0].n_near == 2 and not got[0].contaminated  # the rarest word is nowhere in its place
    exact = {x.doc_id: x for x in decontaminate.decontaminate(frame, bench, near=False).collect()}
    assert all((x.n_hit, x.n_items, x.hit_spans) == (exact[i].n_hit, exact[i].n_items, exact[i].hit_spans) and exact[i].n_near is None for i, x in got.items())
