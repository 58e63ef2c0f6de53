"""Periodic runs and the Merkle manifest against plain versions, and their odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import merkle, period_runs
from tests.llm.test_cases import LONG, ODD, frame


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_runs(w):
    """(start, length, period) of every run, by trying each period at each place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s = i - q
            if j - s >= max(6, 4 * q) and not any(q % d == 0 and all(w[x] == w[x + d] for x in range(s, j - d)) for d in range(1, q)):
                out.append((s, j - s, q))
            i = j + 1
    return sorted(out)


def plain_row(doc_id, text, plant):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def random_words(r):
    w = []
    for _ in range(r.randint(0, 6)):
        if r.random() < 0.4:
            w += [f"w{r.randint(0, r.choice([1, 3, 60]))}" for _ in range(r.randint(0, 25))]
        else:
            p = [f"w{r.randint(0, r.choice([1, 2, 6]))}" for _ in range(r.randint(1, 8))]
            w += (p * 9)[: r.randint(1, 60)]
    return w


@pytest.mark.parametrize("plant", [False, True])
def test_period_runs_equal_brute_force(spark, plant):
    r = random.Random(11 + plant)
    rows = [(i, r.choice([" ", "\n", " \t"]).join(random_words(r))) for i in range(250)]
    rows += [(None, "x " * 9), (300, None), (301, ""), (302, " \n "), (303, "é " * 7), (303, "é " * 7), (304, "|" * 50), (305, rows[7][1])]
    got = period_runs.period_runs(frame(spark, rows), period_runs.planted if plant else None).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(i, t, plant) for i, t in rows), key=key)


def test_grammar_gives_the_texts_back_and_repeats_no_pair():
    r = np.random.default_rng(3)
    ids = r.integers(0, 9, 4000).astype(np.int32)
    joins = r.random(3999) > 0.01
    g = period_runs.Grammar(ids, joins)

    def words(symbol):
        return [symbol] if symbol < g.base else words(g.left[symbol - g.base]) + words(g.right[symbol - g.base])

    assert [x for s in g.seq.tolist() for x in words(s)] == ids.tolist() and len(g.left) > 50
    cuts = set((np.flatnonzero(~joins) + 1).tolist())
    pairs = [(a, b, p) for a, b, p in zip(g.seq.tolist(), g.seq.tolist()[1:], g.pos.tolist()[1:]) if p not in cuts]
    assert max(pairs.count(x) for x in pairs) == 1 and len({x[:2] for x in pairs if x[0] != x[1]}) == len([x for x in pairs if x[0] != x[1]])
    assert all(words(g.base + k) == ids[f : f + n].tolist() for k, (f, n) in enumerate(zip(g.first.tolist(), g.length[g.base :].tolist())))


def test_period_runs_of_long_and_of_odd_texts(spark):
    texts = {1: "a " * 50_000, 2: "a b " * 30_000 + "c", 3: LONG, 4: " ".join(f"x{i % 5000}" for i in range(30_000))}
    got = {r.doc_id: r for r in period_runs.period_runs(frame(spark, list(texts.items()))).collect()}
    assert [(got[i].n_runs, got[i].start, got[i].length, got[i].period) for i in texts] == [(1, 0, 50_000, 1), (1, 0, 60_000, 2), (0, None, None, None), (1, 0, 30_000, 5000)]
    assert got[2].collapsed_sha256 == sha("a b c") and got[3].collapsed_sha256 == sha(LONG)
    odd = period_runs.period_runs(frame(spark, ODD))
    assert odd.count() == len(ODD) and period_runs.period_runs(frame(spark, []).limit(0)).count() == 0


FULL = "doc_id long, source string, lang string, n_chars long, text string"


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows, fan=16):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + fan])) for k in range(0, len(out[-1]), fan)])
        return out

    def path(tree, i):
        out = []
        for level in tree[:-1]:
            run = level[i // fan * fan : i // fan * fan + fan]
            out.append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            i //= fan
        return out

    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for i, (_, _, own, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, g)
            now = own
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                now = leaf((*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4])))
            for x, y in steps:
                now = sha(x + now + y)
            out.append((row[0], own, trees[s][-1][0], top[-1][0], sha("".join(x + y for x, y in steps)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_equals_plain_trees(spark, height):
    """With blocks of one to three levels, so that small tables have several layers of blocks in both trees."""
    r = random.Random(height)
    rows = [(i, r.choice(["hot", "hot", None, "", "a", "É", *(f"s{k}" for k in range(40))]), r.choice(["en", None]), r.choice([None, i]), r.choice(["Text A", None, "", "é", f"B{i}"])) for i in range(700)]
    rows += [(None, "hot", None, None, "X"), (None, None, None, None, None), (5, "hot", "en", 1, "twice"), (5, "hot", "en", 1, "twice"), (9, "hot", "en", 1, LONG)]
    df = spark.createDataFrame(rows, FULL).withColumns({c: F.lit(1) for c in ("g", "at", "rank", "block", "leaf", "name", "total")}).repartition(5)
    got = merkle.manifest(df, merkle.tampered, height)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_manifest_without_rows_or_with_one(spark):
    assert merkle.manifest(spark.createDataFrame([], FULL)).count() == 0
    one = (1, None, None, None, "Ab")
    got = merkle.manifest(spark.createDataFrame([one], FULL)).first()
    assert got.leaf == got.subroot == got.root == leaf(one) and got.proof_sha256 == sha("") and got.verified


def test_addresses_are_van_emde_boas():
    """Every subtree that the recursion makes is contiguous, and addresses are a permutation."""
    four = merkle.veb(4)
    assert sorted(np.concatenate(four).tolist()) == list(range(1 + 16 + 256 + 4096))
    assert sorted(np.concatenate(four[:2]).tolist()) == list(range(17))
    for k in range(256):
        under = [four[2][k], *four[3][16 * k : 16 * k + 16]]
        assert under == list(range(17 + 17 * k, 34 + 17 * k))
    assert [len(x) for x in merkle.slots(300, 3)] == [300, 19, 2, 1]
