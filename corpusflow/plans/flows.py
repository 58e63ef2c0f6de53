"""Registered queries of sources, maintenance, passages, reports and streams: whatever they read is given or derived by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import chunk, embed, evaluate, passages, search, sync, talk, usage
from corpusflow.plans.catalogue import (
    BUCKET_SQL, COS, DIM, FRESH_SQL, HITS_SQL, MODEL, NOW, OVERHEAD, PATH_SQL, Q_SQL, RANK_SQL, REPORT_SQL, TALK_SQL, TOKENS, ZONE, asked_texts, calls, eval_scores, hits_to_reuse, limits_of, messages, new_chunks, old_chunks, page_files,
    query, questions, ranked_passages, raw_hits, snapshots, table, tags, vectors, window_parts,
)
from corpusflow.session import shared_dir, written
from corpusflow.sources import files as source_files
from corpusflow.sources import store
from corpusflow.streaming import streams


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources ---------------------------------------------------------------------------------------------------------


@query("SELECT CAST(item_id AS VARCHAR) AS id, text AS question, 'docs/' || item_id || '.md' AS path FROM benchmark")
def question_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a question set of JSON lines."""
    b = table(spark, sf_dir, "benchmark")
    path = scratch_path(spark, "questions")
    want = F.array(F.struct(F.concat(F.lit("docs/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("symbol")))
    b.select(F.col("item_id").cast("string").alias("id"), F.lit("r").alias("repo"), F.lit("code").alias("kind"), F.lit("tune").alias("split"), F.col("text").alias("question"), want.alias("expect")).write.json(path)
    return source_files.read_questions(spark, path).select("id", "question", F.get("expect", F.lit(0))["path"].alias("path"))


@query(f"WITH {HITS_SQL} SELECT 'r' || (question_id // 50 % 3) AS run_id, CAST(question_id AS VARCHAR) AS question_id, CAST(raw_rank AS INTEGER) AS pos, CAST(id AS VARCHAR) AS id, round(score, 6) AS score FROM hits WHERE raw_rank <= 10")
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits saved as runs, a document each, and read again."""
    hit = F.struct("raw_rank", F.struct(F.col("id").cast("string").alias("id"), "score").alias("h"))
    lists = raw_hits(spark, sf_dir, 10).groupBy("question_id").agg(F.sort_array(F.collect_list(hit)).alias("hs"))
    each = F.struct(F.col("question_id").cast("string").alias("id"), F.lit("code").alias("kind"), F.lit("tune").alias("split"), F.lit(1).alias("rank"), F.lit(True).alias("found_in_context"), F.transform("hs", lambda x: x["h"]).alias("hits"))
    run = F.concat(F.lit("r"), (F.floor(F.col("question_id") / 50) % 3).cast("string")).alias("run_id")
    runs = lists.groupBy(run).agg(F.collect_list(each).alias("questions")).select("run_id", F.lit("r").alias("repo"), F.lit(MODEL).alias("model"), F.lit(DIM).alias("dim"), F.lit(10).alias("k"), F.lit(TOKENS).alias("max_tokens"), F.lit(False).alias("final"), "questions")
    path = scratch_path(spark, "runs")
    store.write_runs(runs, path)
    hits = source_files.read_runs(spark, path)[2]
    return hits.select("run_id", "question_id", "pos", "id", F.round("score", 6).alias("score"))


EVENT_SQL = """SELECT conv_id AS stream_id, turn AS seq, CASE turn % 4 WHEN 2 THEN 'type' WHEN 3 THEN 'shape' END AS reason, CASE WHEN turn % 4 < 2 THEN sha256(text) END AS sha256 FROM conversations"""


@query(EVENT_SQL)
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each four turns one has a carriage return, one an unknown type, one another shape; blank lines follow each."""
    c = table(spark, sf_dir, "conversations")
    of = lambda kind: F.to_json(F.struct(F.lit(kind).alias("type"), F.col("text").alias("text")))
    line = F.when(F.col("turn") % 4 == 0, of("delta")).when(F.col("turn") % 4 == 1, F.concat(of("done"), F.lit("\r"))).when(F.col("turn") % 4 == 2, of("other")).otherwise(F.to_json(F.array("text")))
    rows = c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), line.alias("line"))
    good, bad = source_files.parse_events(rows.unionByName(rows.withColumn("line", F.lit("  "))))
    told = good.select("stream_id", "seq", F.lit(None).cast("string").alias("reason"), F.sha2("text", 256).alias("sha256"))
    return told.unionByName(bad.select("stream_id", "seq", "reason", F.lit(None).cast("string").alias("sha256")))


@query("SELECT doc_id AS id, sha1(text) AS hash FROM documents")
def published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two snapshots; a version that is there isn't written again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("hash"))
    path = scratch_path(spark, "index")
    store.write_snapshot(d.where("id % 2 = 0"), path, 1)
    store.write_snapshot(d, path, 2)
    store.write_snapshot(d.limit(0), path, 2)
    return store.read_snapshot(spark, path)


@query("""SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN sha1(text || 'new') ELSE sha1(text) END AS hash, CASE WHEN doc_id % 100 = 7 THEN 2 ELSE 1 END AS rows FROM documents WHERE doc_id % 100 <> 8
UNION ALL SELECT -1 - doc_id, sha1(text), 1 FROM documents WHERE doc_id % 100 = 9""")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each hundred documents one changes and has two rows, one goes, one is new; the second version has those only, a replay nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("hash"), "text", F.lit(1).alias("rows"))
    path = scratch_path(spark, "index")
    store.publish(d.drop("text"), d, path, 0, ["doc_id"])
    changed = d.where("doc_id % 100 = 7").withColumns({"hash": F.sha1(F.concat("text", F.lit("new"))), "rows": F.lit(2)}).drop("text")
    fresh = d.where("doc_id % 100 = 9").withColumn("doc_id", -1 - F.col("doc_id")).drop("text")
    touched = d.where("doc_id % 100 in (7, 8)").select("doc_id").unionByName(fresh.select("doc_id"))
    for _ in range(2):
        store.publish(changed.unionByName(changed).unionByName(fresh), touched, path, 1, ["doc_id"])
    return store.read_index(spark, path).groupBy("doc_id", "hash").agg(F.sum(F.lit(1)).cast("int").alias("rows"))


@query("""SELECT p, 'src1' AS rel_path, id, hash FROM (SELECT doc_id % 3 AS p, source, doc_id AS id, sha1(text) AS hash FROM documents) WHERE source = 'src1' AND p = 1
UNION ALL SELECT doc_id % 3, source, NULL, CASE WHEN source = 'src2' THEN 'changed' ELSE sha1(source) END FROM documents WHERE doc_id % 3 = 2 GROUP BY ALL""")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of stores laid out by project and path, the chunk ids and texts' hashes of one file of a project and the states of another's files."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("project_id"), F.col("source").alias("rel_path"), F.col("doc_id").alias("id"), F.sha1("text").alias("hash"))
    chunks, files, key = scratch_path(spark, "chunks"), scratch_path(spark, "files"), ["project_id", "rel_path"]
    store.publish(d, d, chunks, 0, key, ["project_id"])
    states = d.select(*key).distinct().select(*key, F.sha1("rel_path").alias("hash"), F.lit("v1").alias("chunker_version"))
    store.publish(states, states, files, 0, key, ["project_id"])
    changed = states.where("rel_path = 'src2'").withColumn("hash", F.lit("changed"))
    store.publish(changed, changed, files, 1, key, ["project_id"])
    one = store.read_index(spark, chunks, {"project_id": 1, "rel_path": "src1"})
    ids = sync.document_ids(one).join(one, "id").select(F.col("project_id").alias("p"), "rel_path", "id", "hash")
    own = sync.file_states(store.read_index(spark, files, {"project_id": 2}))
    return ids.unionByName(own.select(F.lit(2).cast("long").alias("p"), "rel_path", F.lit(None).cast("long").alias("id"), "hash"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '_private/' WHEN 1 THEN '.hidden/deep/' WHEN 2 THEN 'plain/' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN '__init__' ELSE 'page' END || page_id || '.html' AS rel_path, html FROM pages WHERE html IS NOT NULL)
SELECT rel_path, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS sha256 FROM p""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, some with names, or in folders with names, that begin with a dot or an underscore."""
    top = F.when(F.col("page_id") % 4 == 0, "_private/").when(F.col("page_id") % 4 == 1, ".hidden/deep/").when(F.col("page_id") % 4 == 2, "plain/").otherwise("")
    name = F.concat(top, F.when(F.col("page_id") % 3 == 0, "__init__").otherwise("page"), F.col("page_id").cast("string"), F.lit(".html"))
    root = scratch_path(spark, "tree")
    source_files.write_files(table(spark, sf_dir, "pages").where("html is not null").select(name.alias("rel_path"), F.col("html").cast("binary").alias("content")), root)
    out = source_files.scan_files(spark, root)
    return out.select("rel_path", "size", F.sha2("content", 256).alias("sha256"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id AS request_id, CASE WHEN doc_id % 10 = 9 THEN 'unknown' WHEN len(l) < 3 THEN 'past_end' ELSE 'ok' END AS status, doc_id % 10 = 9 OR doc_id % 2 = 1 AS stale,
  CASE WHEN doc_id % 10 <> 9 AND len(l) >= 3 THEN sha1(array_to_string(list_transform(l[3:8], lambda x: CASE WHEN length(x) > 2000 THEN left(x, 2000) || '…' ELSE x END), chr(10))) END AS sha1 FROM l""")
def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 8 of each document; every tenth isn't known, every second has another hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("rel_path"), "text", F.sha1("text").alias("hash"))
    lines = chunk.explode_lines(d.select("rel_path", "text"))
    known = d.where("doc_id % 10 != 9").select("rel_path", "hash", F.size(F.split("text", "\n")).alias("n_lines"))
    asked = d.select(F.col("doc_id").alias("request_id"), "rel_path", F.lit(3).alias("start"), F.lit(8).alias("end"), F.when(F.col("doc_id") % 2 == 0, F.col("hash")).otherwise("x").alias("hash"))
    out = source_files.slice_lines(asked, lines, known)
    return out.select("request_id", "status", "stale", F.sha1(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("sha1"))


# --- maintenance -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id, CAST(NULL AS VARCHAR) AS embed_model, CAST(NULL AS INTEGER) AS embed_dim, 0 AS vectors FROM documents WHERE doc_id % 11 <> 0")
def other_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of another model forgets its vectors."""
    chunks, kept = sync.match_signature(old_chunks(spark, sf_dir), vectors(spark, sf_dir), ("m0", DIM), (MODEL, DIM))
    return chunks.crossJoin(F.broadcast(kept.agg(F.count("*").cast("int").alias("vectors")))).select("id", "embed_model", "embed_dim", "vectors")


@query("SELECT source AS rel_path, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 19 <> 0")
def chunks_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of two files, in their order."""
    chunks = new_chunks(spark, sf_dir).withColumn("part", F.lit(None).cast("int"))
    order = chunk.W.partitionBy("rel_path").orderBy("start_line", F.coalesce("part", F.lit(0)), "id")
    both = [sync.document_chunks(chunks, s) for s in ("src1", "src2")]
    return sync.union_all(both).select("rel_path", "id", F.row_number().over(order).cast("long").alias("place"))


@query("""WITH w AS (SELECT id, min(pos) AS pos FROM (SELECT vec_id AS id, -vec_id AS pos FROM embeddings UNION ALL SELECT vec_id, vec_id FROM embeddings WHERE vec_id % 2 = 0) GROUP BY id)
SELECT id, source AS rel_path, pos FROM w JOIN documents ON doc_id = id WHERE doc_id % 19 <> 0""")
def wanted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: chunks of all vectors, the even ones asked for twice."""
    v = vectors(spark, sf_dir)
    wanted = v.select("id", (-F.col("id")).alias("pos")).unionByName(v.where("id % 2 = 0").select("id", F.col("id").alias("pos")))
    return sync.get_chunks(new_chunks(spark, sf_dir), wanted).select("id", "rel_path", "pos")


@query("SELECT 'chunks' AS name, doc_id AS id FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'vectors', vec_id FROM embeddings")
def deleted_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language is a project; vectors don't have its key and stay."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("project_id"))
    left = sync.delete_keys({"chunks": d, "vectors": vectors(spark, sf_dir)}, d.where("project_id = 'fr'").select("project_id").distinct())
    return sync.union_all([t.select(F.lit(n).alias("name"), "id") for n, t in left.items()])


@query(f"SELECT doc_id AS id, length(text) AS chars, strlen(text) AS bytes, '{MODEL}' AS embed_model, 2 AS embed_dim FROM documents WHERE length(trim(text)) > 0")
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's embedder, here of lengths."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("embed_text")).where("length(trim(embed_text)) > 0")
    out = embed.embed(rows, lambda texts: [[float(len(t)), float(len(t.encode()))] for t in texts], 16, MODEL)
    at = lambda i: F.get("embedding", F.lit(i)).cast("long")
    return out.select("id", at(0).alias("chars"), at(1).alias("bytes"), "embed_model", "embed_dim")


@query("""WITH d AS (SELECT doc_id AS pos, CAST(ceil(greatest(n_chars, 1) / 2400) AS BIGINT) AS n_chunks FROM documents), t AS (SELECT count(*) AS n, sum(n_chunks) AS c FROM d),
w AS (SELECT n, CAST(greatest(1, least(n, round_even(200.0 * n / c, 0))) AS BIGINT) AS wanted FROM t),
p AS (SELECT DISTINCT CAST(floor(i * (CASE WHEN wanted > 1 THEN (n - 1) / (wanted - 1) ELSE 0 END) + 0.5) AS BIGINT) AS pos FROM (SELECT *, unnest(range(wanted)) AS i FROM w)),
u AS (SELECT d.*, coalesce(sum(n_chunks) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM d JOIN p USING (pos))
SELECT pos, n_chunks FROM u WHERE upto < 200""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.ceil(F.greatest(F.col("n_chars"), F.lit(1)) / 2400).cast("long").alias("n_chunks"))
    return embed.even_sample(d, 200)


# --- search and passages ---------------------------------------------------------------------------------------------


@query(f"""WITH {Q_SQL}, a AS (SELECT question_id, v.vec_id AS id, round(greatest(-1, least(1, {COS})), 12) AS score FROM q, embeddings v),
h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS raw_rank FROM a)
SELECT question_id, id, round(score, 6) AS score, raw_rank FROM h WHERE raw_rank <= 11""")
def cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: the index gives what exact search gives."""
    out = search.topk_cells(questions(spark, sf_dir), vectors(spark, sf_dir), 11)
    return out.select("question_id", "id", F.round("score", 6).alias("score"), "raw_rank")


#: Copies of each vector in a clustered table, moved a little in each dimension by a rule.
COPIES = 20
CLUSTER_SQL = f"""c AS (SELECT vec_id * {COPIES} + j AS id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + ((vec_id * 31 + j * 17 + (i - 1) * 7) % 101 - 50) / 2500.0) AS embedding FROM embeddings, range({COPIES}) t(j)),
cq AS (SELECT id AS question_id, embedding AS qv FROM c WHERE id % {50 * COPIES} = 0),
ca AS (SELECT question_id, id, round(greatest(-1, least(1, list_dot_product(qv, embedding) / sqrt(list_dot_product(qv, qv)) / sqrt(list_dot_product(embedding, embedding)))), 12) AS score FROM cq, c),
ch AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS raw_rank FROM ca)"""


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    moved = F.transform("embedding", lambda x, i: x.cast("double") + ((F.col("id") * 31 + F.col("j") * 17 + i * 7) % 101 - 50) / 2500.0)
    return v.withColumn("embedding", moved).select((F.col("id") * COPIES + F.col("j")).alias("id"), "embedding")


@query(f"WITH {CLUSTER_SQL} SELECT question_id, id, round(score, 6) AS score, raw_rank FROM ch WHERE raw_rank <= 10")
def clustered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 over a table of narrow clusters; a question is one of the vectors."""
    v = clustered(spark, sf_dir)
    asked = v.where(F.col("id") % (50 * COPIES) == 0).withColumnRenamed("id", "question_id")
    return search.topk_cells(asked, v, 10).select("question_id", "id", F.round("score", 6).alias("score"), "raw_rank")


@query(f"WITH {CLUSTER_SQL} SELECT question_id, count(*) AS wanted, count(*) AS found, true AS few_codes, true AS few_vectors FROM ch WHERE raw_rank <= 10 GROUP BY question_id")
def clustered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: what the index finds of exact search, and whether less than half of the codes and a tenth of the vectors were looked at."""
    v = clustered(spark, sf_dir)
    asked = v.where(F.col("id") % (50 * COPIES) == 0).withColumnRenamed("id", "question_id")
    found = search.topk_cells(asked, v, 10)
    shares = found.where("raw_rank = 1").select("question_id", (F.col("coded") < 0.5).alias("few_codes"), (F.col("scanned") < 0.1).alias("few_vectors"))
    return search.recall(found, search.topk(asked, v, 10)).join(shares, "question_id").select("question_id", F.col("wanted").cast("long").alias("wanted"), F.col("found").cast("long").alias("found"), "few_codes", "few_vectors")


PARTS_SQL = """n AS (SELECT doc_id, string_split(text, chr(10)) AS l, CAST(ceil(len(string_split(text, chr(10))) / 9) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id AS pid, l, n, CAST(unnest(range(n)) AS INTEGER) AS part FROM n), have AS (SELECT *, array_to_string(l[part * 9 + 1:part * 9 + 12], chr(10)) AS text FROM p WHERE NOT (pid % 7 = 0 AND part = 1))"""


@query(f"""WITH {PARTS_SQL}, o AS (SELECT p.pid, p.part, coalesce(have.text, '[... part ' || (p.part + 1) || ' of ' || p.n || ' not available ...]') AS text FROM p LEFT JOIN have ON have.pid = p.pid AND have.part = p.part)
SELECT pid, string_agg(text, chr(10) ORDER BY part) AS text FROM o GROUP BY pid""")
def stitch_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    return passages.stitch_markers(window_parts(spark, sf_dir), ["pid"])


@query("""WITH n AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id AS pid, 'class ' || doc_id || ':' || chr(10) || '    x' || chr(10) || string_agg(array_to_string(list_transform(l[i * 9 + 1:i * 9 + 9], lambda x, k: i || '.' || k || ' ' || x), chr(10)), chr(10) ORDER BY i) AS text
FROM (SELECT *, unnest(range(CAST(ceil(len(l) / 9) AS BIGINT))) AS i FROM n) GROUP BY doc_id""")
def stitch_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: parts that share two lines; what follows differs from part to part."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), F.split("text", "\n").alias("ls"))
    rows = d.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.size("ls") / 9).cast("int") - 1)).alias("part"))
    own = F.transform(F.slice("ls", F.col("part") * 9 + 1, 9), lambda x, k: F.concat(F.col("part").cast("string"), F.lit("."), (k + 1).cast("string"), F.lit(" "), x))
    head = F.concat(F.lit("class "), F.col("pid").cast("string"), F.lit(":\n    x\n"))
    return passages.stitch_overview(rows.select("pid", "part", F.concat(head, F.array_join(own, "\n")).alias("text")), ["pid"])


@query("""WITH n AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id AS pid, CASE WHEN len(l) >= 4 THEN array_to_string(l[2:4], chr(10)) END AS text FROM n WHERE doc_id % 3 <> 0""")
def stitch_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of live documents; every third has changed since it was stored."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), F.col("doc_id").cast("string").alias("rel_path"), "text", F.sha1("text").alias("hash"))
    stored = d.select("rel_path", F.when(F.col("pid") % 3 != 0, F.col("hash")).otherwise("x").alias("hash"))
    wanted = d.select("pid", "rel_path", F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return passages.stitch_from_source(wanted, chunk.explode_lines(d.select("rel_path", "text")), d.select("rel_path", "hash"), stored)


@query(f"""WITH {PARTS_SQL}, c AS (SELECT *, length(text) // 3 + 1 AS cost FROM have),
big AS (SELECT pid, list(part ORDER BY part) AS ps, map(list(part ORDER BY part), list(cost ORDER BY part)) AS m FROM c GROUP BY pid HAVING sum(length(text) // 3) + {OVERHEAD} > 1750),
a AS (SELECT *, CASE WHEN list_contains(ps, 2) THEN 2 ELSE ps[len(ps) // 2 + 1] END AS x FROM big), b AS (SELECT *, 1000 - {OVERHEAD} - m[x] AS room FROM a),
f AS (SELECT *, coalesce(m[x - 1] <= room, false) AS t1 FROM b), g AS (SELECT *, coalesce(m[x + 1] <= room - CASE WHEN t1 THEN m[x - 1] ELSE 0 END, false) AS t2 FROM f)
SELECT CAST(0 AS BIGINT) AS question_id, pid, CAST(x AS INTEGER) AS part FROM g UNION ALL SELECT 0, pid, x - 1 FROM g WHERE t1 UNION ALL SELECT 0, pid, x + 1 FROM g WHERE t2""")
def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages over the ceiling of a small budget, each hit in its third part."""
    parts = window_parts(spark, sf_dir)
    long = parts.groupBy("pid").agg(F.sum(tx.estimate_tokens(F.col("text"))).alias("t")).where(F.col("t") + OVERHEAD > passages.ceiling_tokens(1000)).select("pid")
    hits = long.select(F.lit(0).cast("long").alias("question_id"), "pid", F.create_map(F.lit(2), F.lit(0.9)).alias("part_scores"))
    return passages.narrow(parts.join(long, "pid", "left_semi").select("pid", "part", "text"), hits, 1000)


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks that aren't split."""
    none, no = F.lit(None).cast("string"), F.lit(None).cast("int")
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("rel_path"), F.lit("doc_text").alias("kind"), none.alias("parent"), F.col("lang").alias("symbol"), F.lit(0).alias("ordinal"),
        no.alias("part"), no.alias("part_count"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), "text", F.array("lang").alias("names"),
    )


@query(FRESH_SQL.replace("raw_rank <= 10)", "raw_rank <= 10)", 1) + f""", o AS (SELECT *, sum(cost) OVER (PARTITION BY question_id ORDER BY rank) AS used, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i FROM s WHERE status <> 'deleted')
SELECT question_id, rank, id, status, cost, used <= {TOKENS} OR i = 1 AS kept FROM o""")
def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No margins and no floor, so that the order is that of exact search; files change as in `freshness`."""
    chunks = whole_chunks(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), "doc_id", F.sha1("text").alias("hash"))
    live = d.where("doc_id % 10 != 3").select("rel_path", F.when(F.col("doc_id") % 10 == 4, "x").when(F.col("doc_id") % 10 != 5, F.col("hash")).alias("hash"))
    asked = questions(spark, sf_dir).select("question_id", "embedding").withColumn("question", F.lit("where"))
    # a question is a vector of the index, so the caller ranks without its own chunk
    plain = tags(spark, sf_dir).withColumns({"is_test": F.lit(False), "is_changelog": F.lit(False)})
    hits = raw_hits(spark, sf_dir, 30).join(asked.select("question_id"), "question_id")
    ranked = search.demote(hits, asked.select("question_id", "question"), plain, 10)
    out = passages.retrieve_hits(ranked.select("question_id", "id", "score", "rank"), chunks, d, live, TOKENS)
    return out.select("question_id", F.col("rank").cast("int").alias("rank"), F.col("rel_path").cast("long").alias("id"), "status", "cost", "kept")


CASES_SQL = f"""d AS (SELECT doc_id, doc_id % 8 AS c, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS k FROM documents),
n AS (SELECT *, CASE WHEN c = 6 THEN k WHEN c = 7 THEN greatest(1, CAST(ceil(length(text) / 60) AS BIGINT)) ELSE greatest(1, CAST(ceil((k - 1) / 2) AS BIGINT)) END AS n FROM d),
m AS (SELECT *, CASE WHEN c = 3 AND n >= 2 THEN 'first' WHEN c = 4 AND n >= 2 THEN 'last' WHEN c IN (2, 5) AND n >= 3 THEN 'middle' ELSE 'none' END AS miss FROM n),
t AS (SELECT doc_id, c, n, miss, CASE WHEN c = 5 THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN c = 7 OR (c = 2 AND miss = 'middle') THEN 'file' ELSE 'index' END AS source,
  miss = 'none' OR c = 2 AS complete, CASE WHEN miss = 'first' THEN 3 ELSE 1 END AS start_line, CASE WHEN miss = 'last' THEN 2 * n - 1 ELSE k END AS end_line,
  CASE WHEN c = 6 THEN 'class ' || doc_id || ':' || chr(10) || array_to_string(list_transform(l, lambda x, i: (i - 1) || ' ' || x), chr(10))
    WHEN miss = 'first' THEN '[... part 1 of ' || n || ' not available ...]' || chr(10) || array_to_string(l[3:], chr(10))
    WHEN miss = 'last' THEN array_to_string(l[:2 * n - 1], chr(10)) || chr(10) || '[... part ' || n || ' of ' || n || ' not available ...]'
    WHEN miss = 'middle' AND c = 5 THEN array_to_string(l[:3], chr(10)) || chr(10) || '[... part 2 of ' || n || ' not available ...]' || chr(10) || array_to_string(l[5:], chr(10))
    ELSE text END AS text FROM m)"""


def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks in eight cases by doc_id: whole; three-line windows that share a line, complete, without the second part, the
    first, the last, the second again; overview parts of one line behind a header; cuts of 60 characters."""
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 8).cast("int").alias("c"), F.split("text", "\n").alias("l")).withColumn("k", F.size("l"))
    n = F.when(F.col("c") == 6, F.col("k")).when(F.col("c") == 7, F.greatest(F.lit(1), F.ceil(F.length("text") / 60).cast("int"))).otherwise(F.greatest(F.lit(1), F.ceil((F.col("k") - 1) / 2).cast("int")))
    rows = d.withColumn("n", F.when(F.col("c") == 0, 1).otherwise(n)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    i, c = F.col("i"), F.col("c")
    lost = ((c == 3) & (F.col("n") >= 2) & (i == 0)) | ((c == 4) & (F.col("n") >= 2) & (i == F.col("n") - 1)) | (c.isin(2, 5) & (F.col("n") >= 3) & (i == 1))
    window = F.array_join(F.slice("l", 2 * i + 1, 3), "\n")
    head = F.concat(F.lit("class "), F.col("doc_id").cast("string"), F.lit(":\n"), i.cast("string"), F.lit(" "), F.get("l", i))
    odd = c >= 6
    return rows.where(~lost).select(
        F.concat_ws(":", "doc_id", i.cast("string")).alias("id"), F.col("doc_id").cast("string").alias("rel_path"), F.when(c == 6, "class_overview").otherwise("doc_text").alias("kind"), none.alias("parent"), none.alias("symbol"),
        F.lit(0).alias("ordinal"), F.when(c > 0, i).alias("part"), F.when(c > 0, F.col("n")).alias("part_count"), F.when(odd | (c == 0), 1).otherwise(2 * i + 1).alias("start_line"),
        F.when(odd | (c == 0), F.col("k")).otherwise(F.least(2 * i + 3, F.col("k"))).alias("end_line"), odd.alias("synthetic"),
        F.when(c == 0, F.col("text")).when(c == 6, head).when(c == 7, F.substring("text", 60 * i + 1, F.lit(60))).otherwise(window).alias("text"), F.array().cast("array<string>").alias("names"),
    )


@query(f"""WITH {HITS_SQL}, {CASES_SQL}
SELECT question_id, CAST(2 * raw_rank - 1 AS INTEGER) AS rank, id, status, source, complete, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(CASE WHEN miss = 'none' THEN 0 ELSE 1 END AS INTEGER) AS n_missing,
  length(text) AS n_chars, sha256(text) AS text_sha256, length(text) // 3 + {OVERHEAD} AS cost FROM hits JOIN t ON doc_id = id WHERE raw_rank <= 10 AND doc_id % 16 <> 15""")
def retrieved_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16 over split chunks with parts missing, overviews, cuts of lines, changed and deleted files; two parts of each chunk are hit."""
    chunks = split_chunks(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), "doc_id", "text", F.sha1("text").alias("hash"))
    live = d.where("doc_id % 16 != 15").select("rel_path", F.when(F.col("doc_id") % 8 == 5, "x").otherwise(F.col("hash")).alias("hash"))
    ends = chunks.groupBy(F.col("rel_path").cast("long").alias("doc_id")).agg(F.min_by("id", "part").alias("a"), F.max_by("id", "part").alias("b"), F.first("id").alias("own"))
    top = raw_hits(spark, sf_dir, 10).join(ends, F.col("id") == F.col("doc_id"))
    hit = lambda c, extra: top.select("question_id", F.col(c).alias("id"), "score", (2 * F.col("raw_rank") - 1 + extra).alias("rank"))
    hits = hit("a", 0).unionByName(hit("b", 1)).where("id is not null").unionByName(top.where("a is null").select("question_id", F.col("own").alias("id"), "score", (2 * F.col("raw_rank") - 1).alias("rank")))
    out = passages.retrieve_hits(hits, chunks, d.select("rel_path", "hash"), live, 1 << 20, chunk.explode_lines(d.select("rel_path", "text")))
    return out.select(
        "question_id", F.col("rank").cast("int").alias("rank"), F.col("rel_path").cast("long").alias("id"), "status", "source", "complete", "start_line", "end_line", F.size("missing").alias("n_missing"),
        F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.col("cost").cast("long").alias("cost"),
    )


@query(f"""WITH {HITS_SQL} SELECT question_id, CAST(raw_rank AS INTEGER) AS pos, id, round(score, 6) AS score, coalesce(l.toxic = 1, false) AS is_test, coalesce(l.quality = 0, false) AS is_changelog,
  id || '|doc_text||' || lang || '|0|1' AS passage_key, length('### ' || id || ':1-' || len(string_split(text, chr(10))) || ' · ' || lang || ' (doc_text)' || chr(10) || '```' || chr(10) || text || chr(10) || '```') // 3 AS cost
FROM hits JOIN documents d ON d.doc_id = id LEFT JOIN labels l ON l.doc_id = id WHERE raw_rank <= 30""")
def costed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R24."""
    files = tags(spark, sf_dir).select(F.col("id").cast("string").alias("rel_path"), "is_test", "is_changelog")
    out = passages.pool_with_cost(hits_to_reuse(spark, sf_dir, 30), whole_chunks(spark, sf_dir), files, 1 << 20)
    return out.select("question_id", "pos", "id", F.round("score", 6).alias("score"), "is_test", "is_changelog", "passage_key", "cost")


# --- reports ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {HITS_SQL}, e AS (SELECT question_id, raw_rank AS pos, source AS k, length(text) // 3 + {OVERHEAD} AS cost, good FROM hits JOIN documents ON doc_id = id WHERE raw_rank <= 10),
g AS (SELECT question_id, k, min(pos) AS rank, min_by(cost, pos) AS cost, bool_or(good) AS good FROM e GROUP BY ALL),
u AS (SELECT *, sum(cost) OVER (PARTITION BY question_id ORDER BY rank) AS used, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i FROM g)
SELECT question_id, bool_or(good AND (i = 1 OR used <= 2000)) AS found FROM u GROUP BY question_id""")
def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source share a passage."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("own"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("passage_key"), (tx.estimate_tokens(F.col("text")) + OVERHEAD).alias("cost"))
    rows = raw_hits(spark, sf_dir, 10).join(docs, "id").join(own, "id").join(questions(spark, sf_dir).select("question_id", "label"), "question_id")
    return evaluate.simulate_context(rows.select("question_id", F.col("raw_rank").alias("pos"), "passage_key", "cost", (F.col("own") == F.col("label")).alias("good")), 2000)


@query(f"""WITH {RANK_SQL}, r AS (SELECT split, kind, coalesce(rank, 1 << 30) AS r0, CASE WHEN question_id % 4 = 0 THEN 1 << 30 ELSE coalesce(rank, 1 << 30) END AS r1 FROM ranks WHERE split = 'holdout'),
v AS (SELECT count(*) FILTER (r1 <= 3) - count(*) FILTER (r0 <= 3) AS gain, count(*) FILTER (kind = 'tests' AND r1 > r0) AS tests_lower FROM r)
SELECT *, CASE WHEN gain <= -3 OR tests_lower > 0 THEN 'bad' ELSE 'ok' END AS verdict FROM v""")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run that misses every question whose number four divides."""
    off = written(eval_scores(spark, sf_dir).select("question_id", "split", "kind", "rank"), "scores")
    return evaluate.holdout_verdict(off, off.withColumn("rank", F.when(F.col("question_id") % 4 != 0, F.col("rank"))), True)


@query("""WITH m AS (SELECT median(abs(value) * 1000 / 7) FILTER (event_id % 2 = 0) AS per_file, median(abs(value) * 1000 / 7) FILTER (event_id % 2 = 1) AS cross_file FROM events), s AS (SELECT *, per_file / cross_file AS speedup, per_file * 1000 / 1000 AS seconds FROM m)
SELECT round(per_file, 4) AS per_file, round(cross_file, 4) AS cross_file, round(speedup, 4) AS speedup, round(seconds, 4) AS seconds, CASE WHEN speedup >= 2 AND seconds > 120 THEN 'build' ELSE 'skip' END AS decision FROM s""")
def batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second event is a run of one mode over seven chunks."""
    e = table(spark, sf_dir, "events")
    runs = e.select(F.when(F.col("event_id") % 2 == 0, "per_file").otherwise("cross_file").alias("mode"), F.abs("value").alias("seconds"), F.lit(7).alias("chunks"))
    out = evaluate.batching_decision(runs, 1000)
    return out.select(*(F.round(c, 4).alias(c) for c in ("per_file", "cross_file", "speedup", "seconds")), "decision")


@query("""SELECT 'p' || p AS provider, w AS "window", kind, rule FROM range(3) t(p), (VALUES ('year', 'tokens', 'window'), ('day', 'requests', 'range')) u(w, kind, rule) WHERE p IN (SELECT user_id % 3 FROM events)""")
def limit_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider with a window that there is not and a limit of 0."""
    n = lambda v: F.lit(v).cast("long")
    bad = F.map_concat("limits", F.create_map(F.lit("year"), F.struct(n(5).alias("tokens"), n(None).alias("requests"))))
    zero = F.transform_values(bad, lambda k, v: F.when(k == "day", F.struct(v["tokens"].alias("tokens"), n(0).alias("requests"))).otherwise(v))
    return usage.validate_limits(limits_of(spark, sf_dir).withColumn("limits", zero))


GRID_SQL = f"""{RANK_SQL}, g AS (SELECT question_id, coalesce(CAST(CASE WHEN rank <= 10 THEN rank END AS VARCHAR), 'miss') AS cell, coalesce(rank <= 3, false) AS seen FROM ranks)"""


@query(f"""WITH {GRID_SQL} SELECT question_id, cell AS first, CASE WHEN question_id % 100 = 0 THEN '-' ELSE cell || CASE WHEN seen THEN '*' ELSE '' END END AS last,
  CASE WHEN question_id % 100 = 0 OR NOT seen THEN CASE WHEN question_id % 150 = 0 THEN 'no pool saved' ELSE 'low' END END AS cause FROM g""")
def rank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages; the second lacks every second question, and causes are known but for those about tests."""
    r = written(eval_scores(spark, sf_dir).select("question_id", "kind", F.when(F.col("rank") <= 10, F.col("rank")).alias("rank")), "scores")
    first = r.select("question_id", "rank", F.lit("first").alias("stage"), F.lit(False).alias("found"))
    last = r.where("question_id % 100 != 0").select("question_id", "rank", F.lit("last").alias("stage"), F.coalesce(F.col("rank") <= 3, F.lit(False)).alias("found"))
    causes = r.where("question_id % 150 != 0").select("question_id", F.lit("low").alias("cause"))
    return evaluate.rank_grid(first.unionByName(last), ["first", "last"], causes)


@query(f"""WITH {REPORT_SQL}, {BUCKET_SQL}, c AS (SELECT provider, count(*) AS requests, CAST(sum(coalesce(pt, 0) + coalesce(tt, 0) + coalesce(at_, 0)) AS BIGINT) AS tokens, count(*) FILTER (estimated) AS estimated_calls,
  round(sum(coalesce(tt, 0)) / sum(coalesce(tt, 0) + coalesce(at_, 0)), 4) AS thinking_share FROM calls GROUP BY provider),
r AS (SELECT provider, string_agg(win || ' ' || kind || ' ' || used || '/' || lim, ', ' ORDER BY win_order, kind_order) AS limits FROM rep GROUP BY provider),
t AS (SELECT provider, string_agg(kind || ' ' || remaining, ', ') AS reported FROM bucket GROUP BY provider),
u AS (SELECT provider, 0 AS source, win_order, kind_order, round(100.0 * used / lim, 1) AS percent FROM rep UNION ALL SELECT provider, 1, 9, 1, round_even(100.0 * (lim - remaining) / lim, 1) FROM bucket),
n AS (SELECT provider, max(percent) AS closest FROM u GROUP BY provider)
SELECT provider, 'published' AS origin, requests, tokens, estimated_calls, thinking_share, limits, reported, closest FROM c LEFT JOIN r USING (provider) LEFT JOIN t USING (provider) LEFT JOIN n USING (provider)""")
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed report of each provider, its lists as text."""
    bounds = usage.window_bounds(spark, NOW, ZONE)
    out = usage.usage_report(calls(spark, sf_dir), limits_of(spark, sf_dir), bounds, snapshots(spark, sf_dir).withColumn("at", F.col("at.at")), NOW)
    told = F.transform("limits", lambda r: F.format_string("%s %s %d/%d", r["window"], r["kind"], r["used"], r["limit"]))
    reported = F.transform("provider_reported", lambda r: F.format_string("%s %d", r["kind"], r["remaining"]))
    return out.select("provider", "origin", "requests", "tokens", "estimated_calls", "thinking_share", F.array_join(told, ", ").alias("limits"), F.array_join(reported, ", ").alias("reported"), F.col("closest.percent").alias("closest"))


# --- conversations ---------------------------------------------------------------------------------------------------


@query(f"WITH {TALK_SQL}, one AS (SELECT min(conversation_id) AS c FROM m) SELECT conversation_id, id, role, called FROM m JOIN one ON c = conversation_id")
def one_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the first conversation."""
    m = messages(spark, sf_dir)
    first = m.agg(F.min("conversation_id")).first()[0]
    convs = m.select(F.col("conversation_id").alias("id"), F.lit(1).alias("project_id")).distinct()
    rows = m.withColumn("meta", F.to_json(F.struct("called"))).drop("called")
    return talk.conversation_messages(convs, rows, 1, first).select("conversation_id", "id", "role", "meta.called")


@query("""WITH c AS (SELECT conv_id, left(regexp_replace(trim(min_by(text, turn) FILTER (role = 'user')), '\\s+', ' ', 'g'), 60) AS title FROM conversations GROUP BY conv_id),
b AS (SELECT max(turn) AS base FROM conversations), e AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS n FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0))
SELECT conv_id AS conversation_id, title, turn AS id, role FROM conversations JOIN c USING (conv_id)
UNION ALL SELECT conv_id, title, base + 2 * n - 1, 'user' FROM e JOIN c USING (conv_id), b UNION ALL SELECT conv_id, title, base + 2 * n, 'assistant' FROM e JOIN c USING (conv_id), b""")
def added_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exchange more in every second conversation, whose title is set already."""
    m = messages(spark, sf_dir).drop("called").withColumns({"meta": F.lit(None).cast("string"), "created_at": F.lit(NOW).cast("timestamp")})
    first = m.groupBy("conversation_id").agg(F.min_by("content", F.when(F.col("role") == "user", F.col("id"))).alias("q"))
    convs = first.select(F.col("conversation_id").alias("id"), talk.title_of(F.col("q")).alias("title"), F.lit(NOW).cast("timestamp").alias("updated_at"))
    batch = convs.where("id % 2 = 0").select(F.col("id").alias("conversation_id"), F.lit(0).alias("seq"), F.lit("more?").alias("question"), F.lit("no").alias("answer"), F.lit(None).cast("string").alias("meta"))
    new_convs, new = talk.add_exchanges(convs, m, batch, NOW)
    return new.join(new_convs.select(F.col("id").alias("conversation_id"), "title"), "conversation_id").select("conversation_id", "title", "id", "role")


# --- streams: the given tables as a source, read to their end ---------------------------------------------------------


def streamed(spark: SparkSession, df: DataFrame, files: int = 3) -> DataFrame:
    """df as a stream of so many files, one for each micro-batch."""
    path = scratch_path(spark, "stream")
    df.repartition(files).write.parquet(path)
    return streams.file_stream(spark, path, df.schema, 1)


def run_to_end(spark: SparkSession, df: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """The result table of a stream. In update mode the last row of each key counts."""
    out = scratch_path(spark, "stream-out")
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")
    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(df.schema.add("batch", "long")).option("recursiveFileLookup", True).parquet(out)
    order = chunk.W.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "batch")


@query("SELECT doc_id AS id, sha1(text) AS hash FROM documents")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: an index that grows by micro-batches of documents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("hash"))
    index = scratch_path(spark, "stream-index")
    streams.stream_ingest(streamed(spark, d), index, scratch_path(spark, "stream-state"), ["id"]).awaitTermination()
    return store.read_index(spark, index)


ANSWERS_SQL = """WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS stream_id, sha256(string_agg(text, '' ORDER BY seq)) AS text_sha256, max(n) + CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END AS events,
  CASE conv_id % 3 WHEN 0 THEN 'stopped' WHEN 1 THEN 'done' ELSE 'failed' END AS outcome FROM r GROUP BY conv_id"""


@query(ANSWERS_SQL)
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: each conversation is a stream of its texts, a second apart; of each three one is done, one fails, one falls silent. Rows come
    turn by turn; an event much later keeps time, so that silent ones end."""
    c = table(spark, sf_dir, "conversations")
    mine = chunk.W.partitionBy("conv_id").orderBy("turn")
    rows = c.select("conv_id", "text", (F.row_number().over(mine) - 1).cast("long").alias("seq"), F.count("*").over(chunk.W.partitionBy("conv_id")).alias("n"))
    at = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    said = rows.select(F.col("conv_id").cast("string").alias("stream_id"), "seq", F.lit("delta").alias("type"), "text", at(F.col("seq")).alias("at"))
    last = rows.where("seq = n - 1 and conv_id % 3 != 0").select(
        F.col("conv_id").cast("string"), F.col("n"), F.when(F.col("conv_id") % 3 == 1, "done").otherwise("error"), F.lit(None).cast("string"), at(F.col("n"))
    )
    events, path = said.union(last), scratch_path(spark, "answers")
    middle = events.where("seq >= 2").unionByName(events.limit(0))
    for some in (events.where("seq < 2"), middle, spark.range(1).select(F.lit("clock").alias("stream_id"), F.lit(0).cast("long").alias("seq"), F.lit("clock").alias("type"), F.lit(None).cast("string").alias("text"), at(F.lit(1_000_000)).alias("at"))):
        some.coalesce(1).write.mode("append").parquet(path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streams.stream_answers(streams.file_stream(spark, path, events.schema, 1))
        done = scratch_path(spark, "answers-out")
        out.writeStream.format("parquet").option("path", done).outputMode("append").option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return spark.read.schema(out.schema).parquet(done).select("stream_id", F.sha2("text", 256).alias("text_sha256"), "events", "outcome")


def rolling_sql(length: str, slide: str, n: int) -> str:
    """Sliding windows that begin on multiples of slide, n of them over each row."""
    return f"""WITH c AS (SELECT 'p' || (user_id % 3) AS provider, ts, coalesce(CASE WHEN event_id % 9 <> 0 THEN CAST(floor(abs(value)) AS BIGINT) END, 0) + coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(floor(abs(value) / 2) AS BIGINT) END, 0) + CAST(floor(abs(value) / 3) AS BIGINT) AS tokens FROM events)
SELECT provider, time_bucket(INTERVAL '{slide}', ts) - i * INTERVAL '{slide}' AS starts, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM c, range({n}) t(i) GROUP BY ALL"""


def rolling(spark: SparkSession, sf_dir: str, length: str, slide: str) -> DataFrame:
    """Every seventh event comes in the last of three parts, behind events that are days newer, so that its windows are closed."""
    c = calls(spark, sf_dir).select("id", "at", "provider", "prompt_tokens", "thinking_tokens", "answer_tokens")
    path, side = scratch_path(spark, "stream"), scratch_path(spark, "late")
    cut = F.lit("2024-01-15").cast("timestamp")
    for some in (c.where((F.col("id") % 7 != 0) & (F.col("at") < cut)), c.where((F.col("id") % 7 != 0) & (F.col("at") >= cut)), c.where("id % 7 = 0")):
        some.drop("id").coalesce(1).write.mode("append").parquet(path)
    source = lambda: streams.file_stream(spark, path, c.drop("id").schema, 1)
    kept = run_to_end(spark, streams.stream_usage(source(), length, slide), "update", ["provider", "window"])
    streams.keep_late(source(), side, scratch_path(spark, "stream-state")).awaitTermination()
    late = spark.read.schema(c.drop("id").schema).option("recursiveFileLookup", True).parquet(f"{side}/rows")
    out = streams.recounted(kept, late, spark.read.schema(c.drop("id").schema).parquet(path), length, slide)
    return out.select("provider", F.col("window.start").cast("timestamp_ntz").alias("starts"), "requests", "tokens")


@query(rolling_sql("1 hour", "15 minutes", 4))
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the last hour at every quarter, with events far behind the watermark."""
    return rolling(spark, sf_dir, "1 hour", "15 minutes")


@query(rolling_sql("1 minute", "20 seconds", 3))
def stream_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the last minute, every twenty seconds, the same way."""
    return rolling(spark, sf_dir, "1 minute", "20 seconds")


@query("""SELECT 'p' || (user_id % 3) AS provider, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS requests,
  CAST(sum(coalesce(CASE WHEN event_id % 9 <> 0 THEN CAST(floor(abs(value)) AS BIGINT) END, 0) + coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(floor(abs(value) / 2) AS BIGINT) END, 0) + CAST(floor(abs(value) / 3) AS BIGINT)) AS BIGINT) AS tokens
FROM events GROUP BY ALL""")
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: usage of each day; no event is later than the watermark."""
    source = streamed(spark, calls(spark, sf_dir).select("at", "provider", "prompt_tokens", "thinking_tokens", "answer_tokens"))
    out = run_to_end(spark, streams.stream_usage(source, "1 day", late="365 days"), "update", ["provider", "window"])
    return out.select("provider", F.col("window.start").cast("timestamp_ntz").alias("day"), "requests", "tokens")


@query("""SELECT 'p' || (user_id % 3) AS provider, CAST(max_by(event_id, (ts, event_id)) AS VARCHAR) AS remaining FROM events WHERE event_id % 50 = 0 GROUP BY 1""")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: of all events every fiftieth has rate headers."""
    e = table(spark, sf_dir, "events")
    none = F.create_map(F.lit("server"), F.lit("x"))
    headers = F.when(F.col("event_id") % 50 == 0, F.create_map(F.lit("X-RateLimit-Remaining-Requests"), F.col("event_id").cast("string"))).otherwise(none)
    at = F.struct(F.col("ts").alias("ts"), "event_id").alias("at")
    source = streamed(spark, e.select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), headers.alias("headers"), at))
    out = run_to_end(spark, streams.stream_latest(source), "update", ["provider"])
    return out.select("provider", F.element_at("headers", "x-ratelimit-remaining-requests").alias("remaining"))
