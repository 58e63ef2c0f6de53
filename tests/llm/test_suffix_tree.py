"""The suffix tree against a plain one that walks to the longest kept suffix of each history."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusflow.llm import suffix_tree as st
from corpusflow.session import BATCH_ROWS, batches_of
from tests.llm.test_cases import LONG, ODD, frame

END = ("end",)


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain_scores(rows, depth, gain):
    train = [tokens(t) for i, t in rows if not held(i)]
    words = Counter(w for t in train for w in t)
    total, kinds = sum(words.values()), len(words)
    root = lambda w: (words[w] + 0.1) / (total + 0.1 * (kinds + 1))
    after = defaultdict(Counter)
    for t in train:
        for i in range(len(t)):
            for d in range(1, min(i, depth) + 1):
                after[tuple(t[i - d : i])][t[i]] += 1
    seen = {s: {w: n for w, n in c.items() if n >= st.CUT} for s, c in after.items() if sum(c.values()) >= st.CONTEXT}

    def p(s, w):
        if not s:
            return root(w)
        e, n = seen.get(s, {}), sum(after[s].values())
        return (e.get(w, 0) + (n + len(e) - sum(e.values())) * p(s[1:], w)) / (n + len(e))

    keep = set()
    for s, e in seen.items():
        n = sum(after[s].values())
        lost = (n + len(e) - sum(e.values())) / (n + len(e))
        if e and sum(c * math.log(p(s, w) / p(s[1:], w)) for w, c in e.items()) + (n - sum(e.values())) * math.log(lost) >= gain * (1 + len(e)):
            keep |= {s[k:] for k in range(len(s))}
    out = []
    for i, text in rows:
        t = tokens(text)
        score = 0.0
        for k, w in enumerate(t):
            s = next((tuple(t[k - d : k]) for d in range(min(k, depth), 0, -1) if tuple(t[k - d : k]) in keep), ())
            score += math.log10(p(s, w))
        out.append((i, held(i), len(t), sum(words[w] > 0 for w in t), total, sum(math.log10(root(w)) for w in t), score))
    return out, keep


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"Word{k}" for k in range(60)]
    lines = [[r.choice(vocabulary) for _ in range(r.randint(3, 9))] for _ in range(12)]
    rows = []
    for i in range(400):
        t = []
        for _ in range(r.randint(0, 5)):
            t += r.choice(lines) if r.random() < 0.5 else [r.choice(vocabulary) if r.random() < 0.9 else f"rare{r.randint(0, 400)}" for _ in range(r.randint(1, 12))]
        rows.append((i, " ".join(t)))
    return rows + [(None, "Word1 word2"), (500, None), (501, ""), (502, " \n"), (503, rows[3][1]), (503, rows[3][1]), (504, "é \x00 never seen")]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("depth,head", [(2, st.HEAD), (1, st.HEAD), (3, st.HEAD), (2, 1), (2, 30), (3, 100)])
def test_scores_equal_those_of_longest_kept_suffixes(spark, depth, head):
    """With all n-grams in the broadcast, and with few or none of them, so that the rest meet by the join."""
    rows = corpus(depth)
    want, keep = plain_scores(rows, depth, st.GAIN)
    assert {len(s) for s in keep} == set(range(1, depth + 1))
    got = st.language_model(frame(spark, rows), depth, st.GAIN, head).collect()
    assert [r[:5] for r in ordered(map(tuple, got))] == [r[:5] for r in ordered(want)]
    for a, b in zip(ordered(map(tuple, got)), ordered(want)):
        assert a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_next_word_probabilities_add_up_to_one_and_foretell_held_out_texts(spark):
    rows = corpus(9)
    want, _ = plain_scores(rows, 2, st.GAIN)
    seen = sorted({w for i, t in rows if not held(i) for w in tokens(t) if w != END})
    for start in ("", "word3", "word3 word4", " ".join(tokens(rows[3][1])[:2])):
        base = rows + [(10_000 + k, f"{start} {w}") for k, w in enumerate(seen)]
        base = [(i, t) for i, t in base if i is None or i < 10_000 or held(i)]
        plain, _ = plain_scores(base, 2, st.GAIN)
        assert all(s <= 0 for *_, s in plain)
    unseen = [r for r in want if r[1] and r[2] > 1]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)


def test_odd_rows(spark):
    got = st.language_model(frame(spark, ODD)).collect()
    want, _ = plain_scores(ODD, 2, st.GAIN)
    key = lambda r: (r[0] is not None, r[0] or 0, r[6])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)
    assert st.language_model(frame(spark, []).limit(0)).count() == 0
    alone = st.language_model(frame(spark, [(i, LONG[:50]) for i in range(300) if held(i)])).collect()
    assert alone and all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score for r in alone)


def test_few_texts_go_to_python_at_a_time(spark, monkeypatch):
    """2,000 texts in one task; with the session's 10,000 rows they were one batch. The session's own setting stays."""
    real, before = st.chunks_of, spark.conf.get(BATCH_ROWS)

    def few(batches, column):
        def seen():
            for b in batches:
                assert b.num_rows <= 500, f"{b.num_rows} texts in a batch"
                yield b

        return real(seen(), column)

    monkeypatch.setattr(st, "chunks_of", few)
    rows = frame(spark, [(i, f"word{i % 7} and word{i % 3}") for i in range(2000)]).coalesce(1)
    assert st.language_model(rows).count() == 2000
    assert spark.conf.get(BATCH_ROWS) == before


def test_a_session_with_fewer_rows_in_a_batch_keeps_them(spark):
    before = spark.conf.get(BATCH_ROWS)
    try:
        for own, within in (("100", "100"), ("10000", "500"), ("0", "500")):
            spark.conf.set(BATCH_ROWS, own)
            with batches_of(spark, 500):
                assert spark.conf.get(BATCH_ROWS) == within
            assert spark.conf.get(BATCH_ROWS) == own
    finally:
        spark.conf.set(BATCH_ROWS, before)


def test_words_have_the_same_key_in_any_piece_and_lookups_find_them():
    """Words of any length, one beside itself and none; keys in no order, more than once and absent, and an empty table."""
    texts = ["A b a", "", " ", "é", "x" * 23, "x" * 24, "x" * 25, "y" * 300, "b\x00 b", "A b a"]
    ends = np.cumsum([len(t.encode()) for t in texts])
    keys, codes, firsts = st.word_keys(np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, ends))
    found = [keys[codes[a:b]].tolist() for a, b in zip(firsts, firsts[1:])]
    for text, mine in zip(texts, found):
        raw = np.frombuffer(text.encode(), np.uint8)
        k, c, _ = st.word_keys(raw, np.array([0, len(raw)]))
        assert mine == k[c].tolist() and len(mine) == len(tokens(text))
    assert len(set(sum(found, []))) == len({w for t in texts for w in tokens(t)})
    own, asked = np.array([3, 5, 9], np.uint64), np.array([9, 1, 5, 10, 9, 4], np.uint64)
    there, n = st.known((own, np.array([30, 50, 90])), asked)
    assert there.tolist() == [True, False, True, False, True, False] and n.tolist() == [90, 0, 50, 0, 90, 0]
    assert st.places(own[:0], asked).tolist() == [0] * 6 and not st.known((own[:0], own[:0]), asked)[0].any()


def test_the_filter_lets_all_keys_of_its_table_through():
    r = np.random.default_rng(3)
    keys, others = (r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) for _ in range(2))
    may = st.Filter(keys)
    assert may.may.nbytes <= 2 << 20 and may(keys).all() and may(others).mean() < 0.01 and not st.Filter(keys[:0])(keys).any()
