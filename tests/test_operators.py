import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import admit, budget, embed, evaluate, passages, search, sync, talk, usage
from corpusflow.sources import files, store


def test_admission_gates(spark):
    rows = [
        ("src/a.py", 10, b"x"), ("node_modules/a.py", 10, b"x"), ("build.py", 10, b"x"), ("yarn.lock", 5, b"x"), ("a.min.js", 5, b"x"), (".py", 5, b"x"), ("a.txt", 5, b"x"),
        ("a.json", 20_000, b"x"), ("b.json", 20_001, b"x"), ("c.py", 1_000_000, b"x"), ("d.py", 1_000_001, b"x"), ("e.py", 9000, b"x" * 8191 + b"\0"), ("f.py", 9000, b"x" * 8192 + b"\0"),
        ("gen/g.py", 3, b"x"), ("gen/keep.py", 3, b"x"), ("h.gen.py", 3, b"x"), ("keep.gen.py", 3, b"x"),
    ]
    lines = spark.createDataFrame(list(enumerate(["# c", "", "gen/", "*.gen.py", "!keep.gen.py", "!gen/keep.py"])), "pos int, value string")
    got = {r.rel_path: r.reason for r in admit.admit(spark.createDataFrame(rows, "rel_path string, size long, content binary"), files.ignore_patterns(lines)).collect()}
    assert got == {
        "src/a.py": None, "node_modules/a.py": "directory", "build.py": None, "yarn.lock": "name", "a.min.js": "name", ".py": "extension", "a.txt": "extension",
        "a.json": None, "b.json": "size", "c.py": None, "d.py": "size", "e.py": "binary", "f.py": None, "gen/g.py": "ignored", "gen/keep.py": "ignored", "h.gen.py": "ignored", "keep.gen.py": None,
    }


def test_tags(spark):
    cases = {
        "tests/a.py": (True, False, "python"), "src/Contest.java": (False, False, "java"), "src/FooTest.java": (True, False, "java"), "a/app.spec.tsx": (True, False, "typescript"),
        "RELEASE_NOTES.md": (False, True, "markdown"), "NEWS": (False, True, None), "changes/1.rst": (False, True, "rst"), "history.py": (False, False, "python"), "Spec/x.go": (True, False, "go"),
    }
    rows = admit.tag_paths(spark.createDataFrame([(k,) for k in cases], "rel_path string")).collect()
    assert {r.rel_path: (r.is_test, r.is_changelog, r.language) for r in rows} == cases


def test_decode(spark):
    got = spark.createDataFrame([(bytearray(b"a\r\nb\xffc"),)], "c binary").select(tx.decode_text(F.col("c"))).first()[0]
    assert got == "a\nb�c"


def vec(s):
    return [s, math.sqrt(1 - s * s)]


def test_topk_ties_and_edges(spark):
    vs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.9, 0.1])], "id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "question_id long, embedding array<float>")
    assert [r.id for r in search.topk(q, vs, 3).orderBy("raw_rank").collect()] == [1, 3, 4]
    assert search.topk(q, vs, 0).count() == 0 and search.topk(q, vs.limit(0), 3).count() == 0 and search.topk(q, vs, 9).count() == 4
    with pytest.raises(ValueError):
        search.topk(q, vs, -1)


def test_topk_blocks_of_questions(spark, monkeypatch):
    r = random.Random(1)
    vs = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(60)], "id long, embedding array<float>").repartition(3)
    q = vs.where("id < 10").withColumnRenamed("id", "question_id")
    whole = sorted(map(tuple, search.topk(q, vs, 5).collect()))
    monkeypatch.setattr(search, "QUESTION_BLOCK", 3)
    assert sorted(map(tuple, search.topk(q, vs, 5).collect())) == whole


def test_cutoff_and_demotion(spark):
    hits = spark.createDataFrame([(1, i, s, i) for i, s in enumerate([0.9, 0.85, 0.8, 0.3], 1)], "question_id long, id long, score double, raw_rank int")
    assert [r.id for r in search.cutoff(hits, 0.8).orderBy("id").collect()] == [1, 2, 3]
    q = spark.createDataFrame([(1, "where is it")], "question_id long, question string")
    tags = spark.createDataFrame([(1, True, False), (2, False, True)], "id long, is_test boolean, is_changelog boolean")
    assert [r.id for r in search.demote(hits, q, tags, 3).orderBy("rank").collect()] == [3, 1, 2]
    asks = spark.createDataFrame([(1, "which tests, and the release notes?")], "question_id long, question string")
    assert [r.id for r in search.demote(hits, asks, tags, 3).orderBy("rank").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        search.search(q, hits, hits, hits, tags, ("a", 1), ("b", 1))


def test_budgets_equal_the_sequential_rules(spark):
    r = random.Random(2)
    rows, prefix, squeeze = [], set(), set()
    for q in range(60):
        costs = [r.randrange(0, 50) for _ in range(r.randrange(1, 9))]
        used, going = 0, True
        for i, c in enumerate(costs, 1):
            rows.append((q, i, c))
            going = going and (i == 1 or used + c <= 90)
            if going:
                used += c
                prefix.add((q, i))
                going = used <= 90
        used = 0
        for i, c in enumerate(costs, 1):
            if i == 1 or used + c <= 90:
                used += c
                squeeze.add((q, i))
    df = spark.createDataFrame(rows, "question_id long, rank int, cost int")
    assert {(x.question_id, x.rank) for x in budget.fit_to_budget(df, 90).where("kept").collect()} == prefix
    assert {(x.question_id, x.rank) for x in budget.squeeze_budget(df, 90).where("kept").collect()} == squeeze


def test_ranges(spark):
    df = spark.createDataFrame([(1, n) for n in (14, 15, 16, 30, 30, 2)], "k int, n int")
    assert budget.compress_ranges(df, ["k"], "n").first().ranges == "2, 14-16, 30"


CHUNK = "id string, rel_path string, content_hash string, start_line int, embed_model string, embed_dim int"


def test_sync_plan_buckets(spark):
    old = spark.createDataFrame([("same", "a", "h", 1, "m", 2), ("chg", "a", "h", 1, "m", 2), ("mv", "a", "h", 1, "m", 2), ("vec", "a", "h", 1, None, None), ("dim", "a", "h", 1, "m", 3), ("gone", "a", "h", 1, "m", 2)], CHUNK)
    new = spark.createDataFrame([("same", "a", "h", 1), ("chg", "a", "x", 1), ("mv", "a", "h", 5), ("vec", "a", "h", 9), ("dim", "a", "h", 1), ("new", "a", "h", 1)], "id string, rel_path string, content_hash string, start_line int")
    got = {r.id: r.bucket for r in sync.plan_sync(old, new, "m", 2).collect()}
    assert got == {"same": "unchanged", "chg": "changed", "mv": "moved", "vec": "needs_vector", "dim": "needs_vector", "gone": "gone", "new": "new"}
    done = spark.createDataFrame([("chg",), ("new",)], "id string")
    up = {r.id: r.embed_model for r in sync.upsert_chunks(old, new, done, "m", 2).collect()}
    assert up == {"same": "m", "chg": "m", "mv": "m", "vec": None, "dim": "m", "new": "m"}
    with pytest.raises(ValueError):
        sync.plan_sync(old.union(old), new, "m", 2)
    with pytest.raises(ValueError):
        sync.upsert_chunks(old, new, spark.createDataFrame([("zz",)], "id string"), "m", 2)


def test_sync_converges(spark):
    """After any edits, an incremental run gives what a rebuild gives, and a second one has nothing to do."""
    r = random.Random(3)
    schema = "id string, rel_path string, content_hash string, start_line int"
    state = spark.createDataFrame([], CHUNK)
    for _ in range(3):
        new = spark.createDataFrame([(f"c{i}", f"f{i % 3}", f"h{r.randrange(3)}", r.randrange(5)) for i in range(12) if r.random() < 0.7], schema)
        work = sync.to_embed(sync.plan_sync(state, new, "m", 2)).select("id")
        state = spark.createDataFrame(sync.upsert_chunks(state, new, work, "m", 2).collect(), CHUNK)
        assert {tuple(x)[:4] for x in state.collect()} == {tuple(x) for x in new.collect()} and state.where("embed_model is null").count() == 0
        assert {x.bucket for x in sync.plan_sync(state, new, "m", 2).collect()} <= {"unchanged"}


def test_constraints(spark):
    rows = [("a", "t", 1, 2, None, None, None, None), ("b", "", 3, 2, 0, None, "m", None), ("c", "t", 1, 1, 2, 2, None, None)]
    df = spark.createDataFrame(rows, "id string, text string, start_line int, end_line int, part int, part_count int, embed_model string, embed_dim int")
    got = sorted((r.key, r.rule) for r in sync.check_constraints(df, "chunks", "id").collect())
    assert got == [("b", "lines"), ("b", "part_pair"), ("b", "part_range"), ("b", "record_pair"), ("b", "text"), ("c", "part_range")]


def test_embedding_steps(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id long, embed_text string").repartition(3)
    for size in (7, 16, 100):
        out = embed.embed(docs, lambda texts: [[float(len(t)), float(t[1:])] for t in texts], size)
        assert all(r.embedding[1] == r.id for r in out.collect()) and out.count() == 40
    with pytest.raises(ValueError):
        embed.embed(docs.union(docs), lambda t: [])
    v = [r.embedding for r in embed.hash_embed(docs, 40).orderBy("id").collect()]
    import hashlib

    raw = [b / 127.5 - 1 for b in (hashlib.sha256(b"0:t0").digest() + hashlib.sha256(b"1:t0").digest())[:40]]
    length = math.sqrt(sum(x * x for x in raw))
    assert all(abs(a - b / length) < 1e-6 for a, b in zip(v[0], raw))
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, None), (1, [1.0, 1.0])], "id long, embedding array<float>")
    assert sorted((r.id, r.rule) for r in embed.validate_vectors(bad, 2).collect()) == [(1, "duplicate"), (1, "duplicate"), (2, "dimension"), (3, "zero"), (4, "not_finite"), (5, "null")]


def test_stitching(spark):
    parts = [
        (1, 0, 1, 3, "a\nb\nc", 3), (1, 1, 3, 5, "c\nd\ne", 3), (1, 2, 6, 6, "f", 3),  # fits
        (2, 0, 1, 2, "a\nb", 2), (2, 1, 4, 4, "d", 2),  # a gap
        (3, 0, 1, 2, "a\nb", 2), (3, 1, 2, 3, "x\nc", 2),  # not a repeat
        (4, 0, 1, 2, "a", 1),  # a line short
        (5, 0, 1, 1, "a", 3), (5, 2, 3, 3, "c", 3),
    ]
    df = spark.createDataFrame(parts, "pid int, part int, start_line int, end_line int, text string, part_count int")
    got = {r.pid: r.text for r in passages.stitch_lines(df, ["pid"]).collect()}
    assert got == {1: "a\nb\nc\nd\ne\nf", 2: None, 3: None, 4: None, 5: None}
    marked = {r.pid: r.text for r in passages.stitch_markers(df, ["pid"]).collect()}
    assert marked[5] == "a\n[... part 2 of 3 not available ...]\nc"
    over = spark.createDataFrame([(1, 0, "h\nc\nx"), (1, 1, "h\nc\ny"), (2, 0, "a"), (2, 1, "b")], "pid int, part int, text string")
    assert {r.pid: r.text for r in passages.stitch_overview(over, ["pid"]).collect()} == {1: "h\nc\nx\ny", 2: None}


def chosen_parts(costs, scores, target):
    """The greedy choice in plain Python."""
    hits = sorted((n for n in scores if n in costs), key=lambda n: (-scores[n], n)) or [sorted(costs)[len(costs) // 2]]
    taken, room = [hits[0]], target - 24 - costs[hits[0]]
    for n in hits[1:]:
        if costs[n] > room:
            break
        taken.append(n)
        room -= costs[n]
    for n in [m for c in taken for m in (c - 1, c + 1)]:
        if n in costs and n not in taken and costs[n] <= room:
            taken.append(n)
            room -= costs[n]
    return sorted(taken)


def test_narrow_choice(spark):
    assert chosen_parts({0: 10, 1: 10, 2: 10, 3: 10}, {2: 0.9}, 24 + 30) == [1, 2, 3]
    r = random.Random(4)
    cases = [({0: 10, 1: 10, 2: 10, 3: 10}, {2: 0.9}), ({0: 10, 1: 99, 2: 10}, {0: 0.9, 1: 0.8, 2: 0.7}), ({0: 10, 1: 10, 2: 10}, {})]
    for _ in range(60):
        n = r.randrange(1, 12)
        cases.append(({k: r.randrange(1, 40) for k in range(n) if r.random() < 0.9 or k == 0}, {r.randrange(n): r.choice([0.5, 0.7, 0.9]) for _ in range(r.randrange(5))}))
    parts = spark.createDataFrame([(i, k, "x" * 3 * (c - 1)) for i, (costs, _) in enumerate(cases) for k, c in costs.items()], "pid long, part int, text string")
    hits = spark.createDataFrame([(0, i, s) for i, (_, s) in enumerate(cases)], "question_id long, pid long, part_scores map<int,double>")
    got = {}
    for row in passages.narrow(parts, hits, 24 + 50).collect():
        got.setdefault(row.pid, []).append(row.part)
    for i, (costs, scores) in enumerate(cases):
        assert sorted(got[i]) == chosen_parts(costs, scores, 24 + 50)
    assert passages.ceiling_tokens(100) == 1 and passages.narrow_target(100) == 1 and passages.narrow_target(1000) == 750


def test_freshness_and_notes(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d")], "question_id long, rel_path string")
    stored = spark.createDataFrame([(x, "h") for x in "abcd"], "rel_path string, hash string")
    live = spark.createDataFrame([("a", "h"), ("b", "x"), ("c", None)], "rel_path string, hash string")
    got = passages.freshness(p, stored, live)
    assert {r.rel_path: r.status for r in got.collect()} == {"a": "fresh", "b": "stale", "c": "stale", "d": "deleted"}
    assert passages.stale_lists(got).first()[1:] == (["b", "c"], ["d"])


def test_context_never_gives_up_the_best_passage(spark):
    none = F.array().cast("array<struct<name:string,reason:string>>")
    asked = spark.range(1, 4).select(F.col("id").alias("question_id"), none.alias("hidden"), F.array().cast("array<string>").alias("deleted"))
    blocks = spark.createDataFrame([(1, 1, "x" * 90, None), (1, 2, "y" * 90, None), (2, 1, "z" * 900, None)], "question_id long, rank int, block string, stale_path string")
    got = {r.question_id: r for r in passages.assemble_context(blocks, asked, 59).collect()}
    assert got[1].shown == 1 and not got[1].over_budget and "1 more matching result did not fit and was left out." in got[1].text
    assert got[2].over_budget and passages.OVER_BUDGET in got[2].text
    assert got[3].text == passages.NONE_FOUND and got[3].shown == 0


def test_render(spark):
    df = spark.createDataFrame([("a.py", 1, 2, None, "f", "function", ["f"], "x ```` y"), ("b.md", 1, 2, None, None, "group", [f"n{i}" for i in range(10)], "t")], "p string, a int, b int, parent string, s string, k string, n array<string>, t string")
    out = [r[0] for r in df.select(passages.render_passage(F.col("p"), F.col("a"), F.col("b"), F.col("parent"), F.col("s"), F.col("k"), F.col("n"), F.col("t"))).collect()]
    assert out[0] == "### a.py:1-2 · f (function)\n`````python\nx ```` y\n`````"
    assert out[1].startswith("### b.md:1-2 · n0, n1, n2, n3, n4, n5, n6, n7, +2 more (group)\n```markdown")


def test_pair_turns_equals_the_sequential_rule(spark):
    r = random.Random(4)
    rows, want = [], set()
    for c in range(80):
        waiting = None
        for i in range(r.randrange(0, 12)):
            role, called = r.choice(["user", "assistant", "system"]), r.random() < 0.6
            rows.append((c, i, role, called))
            if role == "user":
                waiting = i
            elif role == "assistant" and called and waiting is not None:
                want.add((c, waiting, i))
                waiting = None
    got = talk.pair_turns(spark.createDataFrame(rows, "conversation_id long, id long, role string, called boolean"))
    assert {tuple(x) for x in got.collect()} == want


def test_thinking_and_chunks(spark):
    cases = {" <think>a\nb</think>\n\nok": ("a\nb", "ok"), "<think>open": ("open", ""), "x <think>y</think>": ("", "x <think>y</think>"), "<thinker>": ("", "<thinker>"), "": ("", "")}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    think, answer = talk.split_thinking(F.col("t"))
    assert {r.t: (r.a, r.b) for r in df.select("t", think.alias("a"), answer.alias("b")).collect()} == cases
    lines = [(1, 0, 'data: {"model":"m","choices":[{"delta":{"content":"he"}}]}'), (1, 1, ": ping"), (1, 2, 'data: {"choices":[{"delta":{"content":"y"},"finish_reason":"stop"}]}'), (1, 3, "data: [DONE]"), (1, 4, 'data: {"choices":[{"delta":{"content":"late"}}]}'), (2, 0, 'data: {"choices":[{"delta":{"content":"a"}}]}')]
    got = {r.stream_id: r for r in talk.assemble_stream(spark.createDataFrame(lines, "stream_id int, seq long, line string")).collect()}
    assert got[1].text == "hey" and got[1].finish == "stop" and not got[1].incomplete and got[1].model == "m"
    assert got[2].incomplete


def test_exchanges_titles_and_fences(spark):
    t0, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    convs = spark.createDataFrame([(1, 1, None, t0, t0), (2, 1, "old", t0, t0)], "id long, project_id long, title string, created_at timestamp, updated_at timestamp")
    msgs = spark.createDataFrame([(5, 2, "user", "q", None, t0)], "id long, conversation_id long, role string, content string, meta string, created_at timestamp")
    batch = spark.createDataFrame([(1, 1, " hello \n world ", "a", "{}"), (2, 1, "more", "b", "{}"), (1, 2, "again", "c", "{}")], "conversation_id long, seq int, question string, answer string, meta string")
    c, m = talk.add_exchanges(convs, msgs, batch, now)
    assert {r.id: r.title for r in c.collect()} == {1: "hello world", 2: "old"} and m.count() == 7 and m.select("id").distinct().count() == 7
    docs = spark.createDataFrame([("a", "x\n```py\ncode\n\n```\n\ny see src/a.py:3-9 【src/b.py:1-2】")], "doc string, text string")
    assert [(r.kind, r.lang, r.text) for r in talk.split_fences(docs).orderBy("seq").collect()] == [("prose", None, "x"), ("code", "py", "code"), ("prose", None, "y see src/a.py:3-9 【src/b.py:1-2】")]
    assert sorted((r.rel_path, r.start_line, r.end_line) for r in talk.extract_citations(docs).collect()) == [("src/a.py", 3, 9), ("src/b.py", 1, 2)]


def test_windows_know_the_zone(spark):
    b = {r.window: r for r in usage.window_bounds(spark, "2024-03-10 20:00:00", "America/New_York").collect()}
    assert (b["day"].next_start - b["day"].start) == dt.timedelta(hours=23)
    b = {r.window: r for r in usage.window_bounds(spark, "2024-11-03 20:00:00", "America/New_York").collect()}
    assert (b["day"].next_start - b["day"].start) == dt.timedelta(hours=25)
    b = {r.window: r for r in usage.window_bounds(spark, "2024-12-31 23:00:00", "Asia/Dhaka").collect()}
    assert b["month"].start == dt.datetime(2024, 12, 31, 18) and b["week"].start == dt.datetime(2024, 12, 29, 18) and b["minute"].rolling


def test_durations(spark):
    cases = {"1m26.4s": 86.4, "450ms": 0.45, "1d2h": 93600.0, "12.5": 12.5, "": None, "5x": None, "-1s": None, "401d": None, "1m 2s": None, "٣s": None, "1s\n": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.v for r in df.select("t", usage.parse_duration(F.col("t")).alias("v")).collect()}
    assert all(got[k] == v or abs(got[k] - v) < 1e-9 for k, v in cases.items())


def test_buckets_drain(spark):
    at = dt.datetime(2024, 1, 1)
    h = {"x-ratelimit-limit-tokens": "100", "x-ratelimit-remaining-tokens": "40", "x-ratelimit-reset-tokens": "60s", "x-ratelimit-limit-requests": "0", "x-ratelimit-remaining-requests": "1"}
    df = spark.createDataFrame([("p", h, at)], "provider string, headers map<string,string>, at timestamp")
    for now, left in (("2024-01-01 00:00:30", 70), ("2024-01-01 00:01:00", 100), ("2023-12-31 23:59:00", 40)):
        assert [(r.kind, r.remaining) for r in usage.bucket_now(df, now).collect()] == [("tokens", left)]


def test_limits(spark):
    saved = spark.createDataFrame([("a", '{"day":{"tokens":5}}'), ("b", "{}"), ("c", "broken")], "provider string, value string")
    day = F.create_map(F.lit("day"), F.struct(F.lit(9).cast("long").alias("tokens"), F.lit(1).cast("long").alias("requests")))
    published = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "provider string").withColumn("limits", day)
    got = {r.provider: r.origin for r in usage.load_limits(saved, published).collect()}
    assert got == {"a": "yours", "b": "none", "c": "published", "d": "published"}


def test_matching_whole_names(spark):
    q = spark.createDataFrame([("q", [("a.py", "C.run")]), ("r", [("a.py", None)]), ("s", [("a.py", "ru")]), ("t", [("b.py", "x"), ("a.py", "inner")])], "id string, expect array<struct<path:string,symbol:string>>")
    hits = spark.createDataFrame([(i, p, path, sym, par, n) for i in "qrst" for p, path, sym, par, n in ((1, "z.py", "run", "C", []), (2, "a.py", "run", "C", ["inner"]))], "question_id string, pos int, path string, symbol string, parent string, names array<string>")
    assert {r.question_id: r.rank for r in evaluate.rank_of(q, hits).collect()} == {"q": 2, "r": 2, "s": None, "t": 2}


def test_compare_and_guards(spark):
    a = spark.createDataFrame(list(enumerate([None, 5, 2, 3, 1])), "question_id int, rank int")
    b = spark.createDataFrame(list(enumerate([4, 2, 2, None, 3])), "question_id int, rank int")
    assert tuple(evaluate.compare_runs(a, b).first()) == (2, 2, 1, "tie")
    with pytest.raises(ValueError):
        evaluate.compare_runs(a, b.limit(3))
    runs = spark.createDataFrame([("tune", False), ("holdout", False), ("holdout", True)], "split string, final boolean")
    assert evaluate.only_final(runs).count() == 2


def test_floor_proposal(spark):
    rows = [(1, "r", "code", 1, 0.66, 0.66), (2, "r", "negative", None, None, 0.52), (3, "r", "code", 9, 0.6, 0.7)]
    stats = evaluate.floor_stats(spark.createDataFrame(rows, "question_id int, repo string, kind string, rank int, answer_score double, best_score double"))
    got = evaluate.floor_proposal(stats).first()
    assert (got.w, got.n, got.gap, got.floor) == (0.66, 0.52, 0.14, 0.59)


def test_snapshots_and_runs(spark, tmp_path):
    path = str(tmp_path / "idx")
    assert store.read_snapshot(spark, path) is None
    assert store.write_snapshot(spark.range(3), path, 0) and not store.write_snapshot(spark.range(9), path, 0)
    store.write_snapshot(spark.range(5), path, 1)
    (tmp_path / "idx" / "version=2").mkdir()  # left half written
    assert store.read_snapshot(spark, path).count() == 5
    store.write_snapshot(spark.range(7), path, 2)
    store.prune(spark, path)
    assert store.versions(spark, path) == [1, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x\ny")
    (tmp_path / ".gitignore").write_text("d/\n")
    assert [r.rel_path for r in files.scan_files(spark, str(tmp_path)).where("rel_path like '%.py'").collect()] == ["d/a.py"]
    assert files.read_ignore_patterns(spark, str(tmp_path)).count() == 1 and files.read_ignore_patterns(spark, str(tmp_path / "d")).count() == 0
    lines = [(1, 0, '{"type":"delta","text":"a"}\r'), (1, 1, "  "), (1, 2, "[1]"), (1, 3, '{"type":"odd"}'), (1, 4, "{broken")]
    ok, bad = files.parse_events(spark.createDataFrame(lines, "stream_id int, seq int, line string"))
    assert [r.text for r in ok.collect()] == ["a"] and sorted((r.seq, r.reason) for r in bad.collect()) == [(2, "shape"), (3, "type"), (4, "shape")]
    req = spark.createDataFrame([(1, "a", 2, 99, "h"), (2, "a", 9, 10, "h"), (3, "z", 1, 1, "h"), (4, "a", 1, 1, "old")], "request_id int, rel_path string, start int, end int, hash string")
    ls = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y" * 3000)], "rel_path string, line_no int, line string")
    fs = spark.createDataFrame([("a", "h", 2)], "rel_path string, hash string, n_lines int")
    got = {r.request_id: r for r in files.slice_lines(req, ls, fs).collect()}
    assert got[1].status == "ok" and len(got[1].lines[0].line) == 2001 and got[2].status == "past_end" and got[3].status == "unknown" and got[4].stale


def test_ignore_rules_follow_their_signs():
    def hides(rules, path):
        hidden = False
        for line in rules:
            rule = files.ignore_rule(line)
            if rule and re.search(rule[0], path):
                hidden = not rule[1]
        return hidden

    cases = {
        "file[0-9].py": (["file1.py", "d/file9.py"], ["filex.py", "file10.py"]),
        "x[!a-c]": (["xd"], ["xa", "x/"]),
        r"\#x": (["#x"], ["\\#x", "x"]),
        r"\!y": (["!y"], ["y"]),
        r"a\*b": (["a*b"], ["axb"]),
        "trail\\ ": (["trail "], ["trail"]),
        "blank   ": (["blank"], ["blank   "]),
        "/top": (["top", "top/z"], ["d/top"]),
        "a/**/b": (["a/b", "a/x/y/b"], ["ab"]),
        "**/c/d": (["c/d", "x/c/d"], ["xc/d"]),
        "e/**": (["e/f", "e/f/g"], ["e"]),
        "dir/": (["dir/x", "z/dir/x"], ["dir"]),
        "q?": (["q1"], ["q", "q12", "q/"]),
        "[]x]": (["]", "x"], ["[]x]"]),
        "[open": (["[open"], ["o"]),
    }
    for rule, (yes, no) in cases.items():
        assert all(hides([rule], p) for p in yes) and not any(hides([rule], p) for p in no), rule
    assert files.ignore_rule("# c") is None and files.ignore_rule("  ") is None and files.ignore_rule("/") is None


def test_scan_finds_hidden_names(spark, tmp_path):
    for name in ("pkg/a.py", "pkg/__init__.py", "_private/x.py", ".hidden/y z.txt", "_top.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = {r.rel_path: bytes(r.content) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {n: n.encode() for n in ("pkg/a.py", "pkg/__init__.py", "_private/x.py", ".hidden/y z.txt", "_top.md")}
    assert files.scan_files(spark, str(tmp_path / "pkg")).where("rel_path = '__init__.py' and size = 15").count() == 1


def test_best_of_equals_a_sort():
    r = np.random.default_rng(3)
    for k in (1, 3, 10):
        score, ids = r.integers(0, 6, (5, 200)) / 5, r.permutation(200)
        got_id, got = search.best_of(np.zeros((5, 0), np.int64), np.zeros((5, 0)), ids, score, k)
        for row in range(5):
            want = sorted(zip(-score[row], ids))[:k]
            assert list(zip(-got[row], got_id[row])) == want


def test_narrowed_notes_and_holdout(spark):
    none = F.array().cast("array<string>")
    hidden = F.array().cast("array<struct<name:string,reason:string>>")
    one = F.array(F.struct(*(F.lit(v).alias(n) for n, v in (("rel_path", "a.py"), ("name", "f"), ("first_line", 1), ("last_line", 900), ("part_count", 7), ("parts", "2-3"), ("lines", "120-360")))))
    text = spark.range(1).select(passages.notes(hidden, none, none, F.lit(1), F.lit(False), one)).first()[0]
    assert text == (
        "[Notes]\n- `a.py` (f) is very long (lines 1-900, 7 parts): only parts 2-3 (lines 120-360) are shown. The rest can be read from the file.\n"
        "- 1 more matching result did not fit and was left out."
    )
    kind = "question_id int, split string, kind string, rank int"
    off = spark.createDataFrame([(1, "holdout", "code", 1), (2, "holdout", "code", 2), (3, "holdout", "code", None), (4, "tune", "code", 1)], kind)
    on = spark.createDataFrame([(1, "holdout", "code", 4), (2, "holdout", "code", 1), (3, "holdout", "code", 9), (4, "tune", "code", 9)], kind)
    assert tuple(evaluate.holdout_verdict(off, on, True).first()) == (-1, 0, "ok")
    worse = on.withColumn("kind", F.lit("tests"))
    assert evaluate.holdout_verdict(off.withColumn("kind", F.lit("tests")), worse, True).first().verdict == "bad"
    with pytest.raises(ValueError):
        evaluate.holdout_verdict(off, on, False)
    runs = spark.createDataFrame([("per_file", 10.0, 10), ("per_file", 20.0, 10), ("per_file", 90.0, 10), ("cross_file", 9.0, 10)], "mode string, seconds double, chunks int")
    r = evaluate.batching_decision(runs, 100).first()
    assert (r.per_file, r.cross_file, round(r.speedup, 3), r.seconds, r.decision) == (2000.0, 900.0, 2.222, 200.0, "build")
    assert evaluate.batching_decision(runs, 50).first().decision == "skip"


def test_retrieve_in_order(spark):
    """A hit on a part is the whole chunk, gone files drop out before the budget, stale ones stay, flagged ones never show."""
    kind = "id string, rel_path string, kind string, parent string, symbol string, ordinal int, part int, part_count int, start_line int, end_line int, text string, names array<string>"
    rows = [
        ("a0", "a.py", "function", None, "f", 0, 0, 2, 1, 2, "one\ntwo", ["f"]), ("a1", "a.py", "function", None, "f", 0, 1, 2, 2, 3, "two\nthree", ["f"]),
        ("b", "b.py", "function", None, "g", 0, None, None, 1, 1, "b" * 300, ["g"]), ("c", "c.py", "function", None, "h", 0, None, None, 1, 1, "gone", ["h"]),
        ("d", "d.py", "function", None, "i", 0, None, None, 1, 1, "flagged", ["i"]), ("e", "test_e.py", "function", None, "j", 0, None, None, 1, 1, "e" * 600, ["j"]),
    ]
    chunks = spark.createDataFrame(rows, kind)
    score = {"d": 0.99, "c": 0.98, "a1": 0.97, "e": 0.96, "b": 0.9, "a0": 0.5}
    vectors = spark.createDataFrame([(i, [s, math.sqrt(1 - s * s)]) for i, s in score.items()], "id string, embedding array<double>").join(
        spark.createDataFrame([(i, k) for k, i in enumerate(score)], "id string, number long"), "id"
    )
    names = vectors.select("id", "number")
    numbered = lambda df: df.join(names, "id").drop("id").withColumnRenamed("number", "id")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "where")], "question_id long, embedding array<double>, question string")
    tags = numbered(chunks.select("id", F.startswith("rel_path", F.lit("test_")).alias("is_test"), F.lit(False).alias("is_changelog")))
    stored = spark.createDataFrame([(f"{x}.py", "1") for x in ("a", "b", "c", "test_e")], "rel_path string, hash string")
    live = spark.createDataFrame([("a.py", "2"), ("b.py", "1"), ("test_e.py", "1")], "rel_path string, hash string")
    flagged = spark.createDataFrame([("d.py",)], "rel_path string")
    for budget_, kept in ((1000, [True, True, True]), (24 + 4 + 24 + 100, [True, True, False]), (24 + 4 + 24 + 99, [True, False, False])):
        out = passages.retrieve(asked, numbered(vectors.select("id", "embedding")), numbered(chunks), flagged, tags, stored, live, ("m", 2), 10, budget_).orderBy("rank").collect()
        assert [(r.rel_path, r.status, r.text[:13], r.parts) for r in out] == [
            ("a.py", "stale", "one\ntwo\nthree", [0, 1]), ("b.py", "fresh", "b" * 13, [0]), ("test_e.py", "fresh", "e" * 13, [0])
        ]
        assert [r.kept for r in out] == kept and [r.cost for r in out] == [28, 124, 224]


PART = "pid string, rel_path string, kind string, part int, part_count int, start_line int, end_line int, synthetic boolean, split boolean, text string"


def test_texts_of_split_chunks_in_their_order(spark):
    """What counts as whole, when the file is read, and what is left shows its gaps."""
    f = lambda pid, rel, *parts, kind="function": [(pid, rel, kind, *p[:-1], True, p[-1]) for p in parts]
    rows = [
        *f("whole", "a.py", (0, 3, 1, 2, False, "1\n2"), (1, 3, 2, 3, False, "2\n3"), (2, 3, 4, 4, False, "4")),
        *f("middle", "a.py", (0, 3, 1, 1, False, "1"), (2, 3, 3, 4, False, "3\n4")),
        *f("first", "a.py", (1, 3, 2, 3, False, "2\n3"), (2, 3, 3, 4, False, "3\n4")),
        *f("last", "a.py", (0, 3, 1, 1, False, "1"), (1, 3, 2, 2, False, "2")),
        *f("two runs", "b.py", (0, 6, 1, 2, False, "1\n2"), (1, 6, 2, 3, False, "2\n3"), (3, 6, 5, 5, False, "5"), (5, 6, 8, 8, False, "8")),
        *f("misfit", "a.py", (0, 2, 1, 2, False, "1\n2"), (1, 2, 2, 3, False, "x\n3")),
        *f("misfit, changed", "b.py", (0, 2, 1, 2, False, "1\n2"), (1, 2, 2, 3, False, "x\n3")),
        *f("misfit, gone", "gone.py", (0, 2, 1, 1, False, "1"), (1, 2, 4, 4, False, "4")),
        *f("beyond the file", "a.py", (0, 2, 1, 1, False, "1"), (1, 2, 4, 9, False, "4")),
        *f("overview", "a.py", (0, 2, 1, 4, True, "class C:\n    x"), (1, 2, 1, 4, True, "class C:\n    y"), kind="class_overview"),
        *f("overview without a header", "b.py", (0, 2, 1, 4, True, "a"), (1, 2, 1, 4, True, "b"), kind="class_overview"),
        *f("overview, a part missing", "b.py", (0, 3, 1, 4, True, "class C:\n    x"), (2, 3, 1, 4, True, "class C:\n    z"), kind="class_overview"),
        *f("cut line", "a.py", (0, 2, 3, 3, True, "3"), (1, 2, 3, 3, True, "")),
    ]
    rows.append(("plain", "a.py", "function", 0, 1, 1, 9, False, False, "not nine lines"))
    lines = spark.createDataFrame([("a.py", k, str(k)) for k in range(1, 5)] + [("b.py", k, "new") for k in range(1, 9)], "rel_path string, line_no int, line string")
    stored = spark.createDataFrame([("a.py", "1"), ("b.py", "1"), ("gone.py", "1")], "rel_path string, hash string")
    live = spark.createDataFrame([("a.py", "1"), ("b.py", "2")], "rel_path string, hash string")
    got = {r.pid: (r.text, r.source, r.complete, r.missing) for r in passages.whole_texts(spark.createDataFrame(rows, PART), stored, live, lines).collect()}
    gap = "[... part {} of {} not available ...]".format
    assert got == {
        "whole": ("1\n2\n3\n4", "index", True, []), "middle": ("1\n2\n3\n4", "file", True, [1]), "first": (gap(1, 3) + "\n2\n3\n4", "index", False, [0]), "last": ("1\n2\n" + gap(3, 3), "index", False, [2]),
        "two runs": (f"1\n2\n3\n{gap(3, 6)}\n5\n{gap(5, 6)}\n8", "index", False, [2, 4]), "misfit": ("1\n2\n3", "file", True, []), "misfit, changed": ("1\n2\nx\n3", "index", False, []),
        "misfit, gone": ("1\n4", "index", False, []), "beyond the file": ("1\n4", "index", False, []), "overview": ("class C:\n    x\n    y", "index", True, []), "overview without a header": ("a\nb", "index", False, []),
        "overview, a part missing": (f"class C:\n    x\n{gap(2, 3)}\nclass C:\n    z", "index", False, [1]), "cut line": ("3", "file", True, []), "plain": ("not nine lines", "index", True, []),
    }
    closed = {r.pid: r.source for r in passages.whole_texts(spark.createDataFrame(rows, PART)).collect()}
    assert set(closed.values()) == {"index"}


def test_narrowed_passages_name_what_they_leave_out(spark):
    """P9 in P16: runs of shown parts with a line for each gap, by line or, where parts stand for other lines, by part."""
    kind = "id long, rel_path string, kind string, parent string, symbol string, ordinal int, part int, part_count int, start_line int, end_line int, text string, names array<string>, synthetic boolean"
    body = lambda k: "\n".join(f"{k}{'x' * 297}" for _ in range(3))  # noqa: E731  900 characters: 301 tokens
    rows = [(k, "a.py", "function", None, "f", 0, k, 10, 3 * k + 1, 3 * k + 3, body(k), ["f"], False) for k in range(10)]
    rows += [(20 + k, "b.py", "class_overview", None, "C", 0, k, 10, 1, 90, "class C:\n" + body(k), ["C"], True) for k in range(10)]
    chunks = spark.createDataFrame(rows, kind)
    hits = spark.createDataFrame([(1, 7, 0.9, 1), (1, 2, 0.8, 2), (1, 27, 0.7, 3), (2, 0, 0.5, 1)], "question_id long, id long, score double, rank int")
    out = {(r.question_id, r.rel_path): r for r in passages.expanded(hits, chunks, 1250).collect()}
    r = out[1, "a.py"]
    assert r.narrowed and not r.complete and (r.parts, r.start_line, r.end_line) == ([2, 6, 7], 7, 24)
    assert r.text.split("\n") == ["[... lines 1-6 not shown ...]", *body(2).split("\n"), "[... lines 10-18 not shown ...]", *body(6).split("\n"), *body(7).split("\n"), "[... lines 25-30 not shown ...]"]
    assert [tuple(x) for x in r.ranges] == [(7, 9), (19, 24)] and tuple(r.whole) == (1, 30)
    r = out[1, "b.py"]
    assert (r.parts, r.start_line, r.end_line, [tuple(x) for x in r.ranges]) == ([6, 7, 8], 1, 90, [(1, 90)])
    assert r.text.split("\n")[0] == "[... parts 1-6 not shown ...]" and r.text.split("\n")[-1] == "[... parts 10-10 not shown ...]"
    r = out[2, "a.py"]
    assert r.parts == [0, 1] and r.text.split("\n")[-1] == "[... lines 7-30 not shown ...]" and r.text.startswith("0xxx")
