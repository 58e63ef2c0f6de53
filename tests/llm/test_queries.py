"""The registered queries against their SQL twins or plain versions, on the smallest tables."""

import os
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from corpusflow.llm import html_extract, packing, quality, queries
from tests.llm import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    ours, theirs = queries.queries()[name](spark, SF), db.sql(queries.oracle_sql()[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in cols]
    assert sorted(map(repr, map(list, ours.select(*cols).collect()))) == sorted(repr([r[i] for i in order]) for r in theirs.fetchall())


def test_op1_gives_the_article(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    for r in queries.op1_html_extract(spark, SF).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id] or "", re.S)
        blocks = re.split("</?(?:p|h1)>", re.sub("</?b>", "", inner[1]).replace("<br>", " ")) if inner else []
        blocks = [re.sub("[ \t\n\f\r]+", " ", html.unescape(b)).strip(" ") for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op3_is_an_exact_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op3_pack(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 2048) and all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[r.start : r.start + r.length]))
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(by_sequence) <= least * 1.02 + 1


def test_op4_equals_brute_force(spark, docs):
    assert sorted(map(tuple, queries.op4_ngram_join(spark, SF).collect())) == brute.components(docs)


def test_op5_equals_brute_force(spark, docs):
    assert sorted(map(tuple, queries.op5_suffix_dedup(spark, SF).collect())) == brute.cut_repeats(docs)


def test_op10_held_out(spark, docs):
    sf = SF.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = queries.op10_quality(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95


def test_pipeline_equals_the_plain_stages(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    weights = quality.train(frame, labels)
    kept = {r.doc_id for r in quality.score(frame.select("doc_id", "text"), weights).collect() if r.score >= 0.3}
    texts = brute.line_dedup([d for d in docs if d[0] in kept])
    rows = sorted(texts.items())
    rows = [r for r, (i, _, c) in zip(rows, brute.components(rows)) if i == c]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    bad = brute.contaminated(rows, items)
    encode = packing.public_tokens()
    want = {(i, k, s, n) for i, t in rows if i not in bad for k, (s, n) in enumerate(packing.cuts(len(encode(t or "")) + 1, 2048))}
    got = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.piece, r.start, r.length) for r in got.collect()} == want


def test_stages_keep_the_columns(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, SF).schema == frame.schema


def test_region_is_the_best_run():
    assert html_extract.region([-1, 2, -0.5, 3, -9, 4]) == (1, 4)
    assert html_extract.region([-1.0]) == (0, 0)
