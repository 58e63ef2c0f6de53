"""The registered queries of this subpackage and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import (
    chat_format, decontaminate, exact_dedup, html_extract, line_dedup, merkle, ngram_join, packing, period_runs, quality, secret_scan, suffix_dedup, suffix_tree,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat_format.digests(chat_format.format_chats(rows.unionByName(odd)))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches by the contract, and n_near: how many windows of items have eight or nine of ten words in place."""
    hits = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.drop("hit_items", "hit_spans").withColumn("n_near", F.col("n_near").cast("long"))


def op8_decontaminate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by its earlier name."""
    return op8_decontaminate(spark, sf_dir)


def line_digests(out: DataFrame) -> DataFrame:
    kept = F.coalesce("kept_text", F.lit(""))
    return out.select(
        "doc.doc_id", "n_lines", "n_removed", "n_spans", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op9_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by its earlier name."""
    return line_digests(line_dedup.line_dedup(table(spark, sf_dir, "documents"), whole=True))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, docs, table(spark, sf_dir, "labels"))


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.period_runs(table(spark, sf_dir, "documents"), period_runs.planted)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.language_model(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


ORACLES = {}

ORACLES["op2_chat_format"] = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, contains(text, '</turn>') AS odd, replace(replace(role, '\', '\\'), ':', '\:') AS safe_role,
         replace(replace(text, '\', '\\'), '</turn>', '<\/turn>') AS safe FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length('### ' || safe_role || ': ' || '</turn>') + 1 + CASE WHEN odd THEN length(safe) + 1 ELSE length(text) END) AS BIGINT) AS formatted_chars,
  CAST(max(CASE WHEN odd THEN 1 ELSE 0 END) AS INTEGER) AS escape_level
FROM e GROUP BY conv_id
"""

ORACLES["op7_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256, min(doc_id) OVER w AS first_id
FROM t WINDOW w AS (PARTITION BY t)
"""


ORACLES["op8_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM d),
ip AS (SELECT item_id, len(w) AS n, least(len(w), 10) AS size, unnest(w) AS x, unnest(range(len(w))) AS p FROM i),
al AS (SELECT doc_id, item_id, pos - p AS shift, n, size, list(p) AS ats FROM dp JOIN ip USING (x) GROUP BY ALL HAVING count(*) * 10 >= size * 8),
held AS (SELECT doc_id, size, unnest(list_transform(range(n - size + 1), lambda s: len(list_filter(ats, lambda a: a >= s AND a < s + size)))) AS h FROM al),
nw AS (SELECT doc_id, count(*) AS n_near FROM held WHERE h < size AND h * 10 >= size * 8 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN nw USING (doc_id)
"""


ORACLES["op8_decontaminate_near"] = ORACLES["op8_decontaminate"]

ASSIGN_SQL = secret_scan.ASSIGN.replace("'", "''")

ORACLES["op6_secret_scan"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
p(kind, re, k, least) AS (VALUES ('assign', '{ASSIGN_SQL}', 0, 6), ('access', '(AKIA[A-Z0-9]+)', 1, 20),
  ('hex', '([0-9a-f]+)', 2, 24), ('owned', '([A-Za-z0-9_-]+)', 3, 20)),
m AS (
  SELECT doc_id, source, 'assign' AS kind, 0 AS k, unnest(list_zip(string_split_regex(t, '{ASSIGN_SQL}'), regexp_extract_all(t, '{ASSIGN_SQL}', 0), regexp_extract_all(t, '{ASSIGN_SQL}', 1))) AS z,
    unnest(range(len(string_split_regex(t, '{ASSIGN_SQL}')))) AS i FROM d
  UNION ALL SELECT doc_id, source, 'access', 1, unnest(list_zip(string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0))),
    unnest(range(len(string_split_regex(t, 'AKIA[A-Z0-9]+')))) FROM d
  UNION ALL SELECT doc_id, source, 'hex', 2, unnest(list_zip(string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0))),
    unnest(range(len(string_split_regex(t, '[0-9a-f]+')))) FROM d
  UNION ALL SELECT doc_id, source, 'owned', 3, unnest(list_zip(string_split_regex(t, '[A-Za-z0-9_-]+'), regexp_extract_all(t, '[A-Za-z0-9_-]+', 0), regexp_extract_all(t, '[A-Za-z0-9_-]+', 0))),
    unnest(range(len(string_split_regex(t, '[A-Za-z0-9_-]+')))) FROM d),
s AS (
  SELECT doc_id, source, kind, k, z[3] AS v, z[2] AS match,
         CAST(sum(length(z[1]) + coalesce(length(z[2]), 0)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS e FROM m),
c AS (
  SELECT doc_id, source, kind, k, v, e - length(match) AS b, e FROM s
  WHERE match IS NOT NULL AND length(v) >= [6, 20, 24, 20][k + 1]
    AND (k < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')))),
x AS (
  SELECT c.* FROM c WHERE k < 3 OR NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.k < 3 AND o.b < c.e AND c.b < o.e)),
n AS (SELECT v, count(DISTINCT source) AS owners FROM x GROUP BY v),
r AS (SELECT x.*, owners FROM x JOIN n USING (v) WHERE k < 3 OR owners = 1)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k IS NOT NULL), '') AS spans,
  count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= 3) AS n_copied
FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id
"""


ORACLES["op9_line_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS l FROM documents),
l AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
w AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
e AS (SELECT s.doc_id, s.pos, min(t.pos) AS last FROM s JOIN s t ON t.doc_id = s.doc_id AND t.pos >= s.pos AND t.upto - s.upto + s.n >= 50 GROUP BY ALL),
b AS (SELECT s.doc_id, max(t.pos) AS pos, s.pos AS last FROM s JOIN s t ON t.doc_id = s.doc_id AND t.pos <= s.pos AND s.upto - t.upto + t.n >= 50 GROUP BY s.doc_id, s.pos),
w2 AS (SELECT doc_id, pos, last FROM e UNION SELECT doc_id, pos, last FROM b),
k AS (SELECT e.doc_id, e.pos, e.last, list_slice(d.l, e.pos + 1, e.last + 1) AS win FROM w2 e JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM r WHERE nth > 1),
x AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone FROM l LEFT JOIN g USING (doc_id, pos)),
y AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM x),
z AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  length(coalesce(kept, '')) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)
"""


ORACLES["op9_line_dedup_whole"] = ORACLES["op9_line_dedup"]


ORACLES["op12_merkle_manifest"] = merkle.oracle()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
