"""Registered queries of the chunking operators (K2 to K20), over texts and units that Spark derives from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import chunk
from corpusflow.plans.catalogue import FILES_SQL, page_files, query, table

LINES_SQL = "l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"


@query(f"""WITH {FILES_SQL}, x AS (SELECT page_id, lower(regexp_extract(string_split(rel_path, '/')[-1], '^.+?(\\.[^.]+)$', 1)) AS ext FROM f)
SELECT page_id, CASE WHEN ext IN ('.md', '.markdown') THEN 'markdown' WHEN ext IN ('.json', '.yaml', '.yml') THEN 'config' WHEN ext = '.rst' THEN 'rst' WHEN ext IN ('.py', '.js', '.java') THEN 'code' END AS route FROM x""")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2."""
    return page_files(spark, sf_dir).select("page_id", chunk.route(F.col("rel_path")).alias("route"))


# Windows of whole lines, one step of the recursion for each window. An over-long line is a step of its own and is cut by
# characters afterwards. len(l) lines, e[i + 1] the characters of the first i lines with their line feeds.
WINDOWS_SQL = f"""{LINES_SQL},
s AS (SELECT doc_id, l, len(l) AS n, list_transform(l, lambda x: length(x)) AS c FROM (SELECT doc_id, CASE WHEN regexp_replace(array_to_string(l, chr(10)), chr(10) || '+$', '') = '' THEN [''] ELSE string_split(regexp_replace(array_to_string(l, chr(10)), chr(10) || '+$', ''), chr(10)) END AS l FROM l)),
d AS (SELECT *, list_transform(range(n + 1), lambda i: CAST(coalesce(list_sum(c[1:i]), 0) AS BIGINT) + i) AS e, (coalesce(list_sum(c), 0) + n - 1) // 3 > 800 AS large FROM s),
w AS (
  SELECT doc_id, 0 AS a, CAST(NULL AS BIGINT) AS b, 0 AS step, false AS cut FROM d WHERE large
  UNION ALL
  SELECT doc_id, CASE WHEN stop IS NULL THEN a + 1 WHEN stop >= n THEN n ELSE greatest(a + 1, stop - back) END, stop, step + 1, stop IS NULL FROM (
    SELECT *, CASE WHEN stop IS NOT NULL THEN len(list_filter(range(1, stop - a), lambda x: e[stop + 1] - e[stop - x + 1] <= 150)) END AS back FROM (
      SELECT w.doc_id, w.a, w.step, d.n, d.e, CASE WHEN c[w.a + 1] < 2400 THEN w.a + len(list_filter(range(w.a, n), lambda x: e[x + 2] - e[w.a + 1] <= 2400 AND coalesce(list_max(c[w.a + 1:x + 1]), 0) < 2400)) END AS stop
      FROM w JOIN d ON d.doc_id = w.doc_id WHERE w.a < d.n))),
v AS (SELECT doc_id, step, cut, b, lag(a) OVER (PARTITION BY doc_id ORDER BY step) AS a FROM w),
g AS (
  SELECT v.doc_id, step, 0 AS k, v.a, v.b - 1 AS b, array_to_string(l[v.a + 1:v.b], chr(10)) AS text, false AS synthetic FROM v JOIN d ON d.doc_id = v.doc_id WHERE step > 0 AND NOT cut
  UNION ALL SELECT doc_id, step, k, a, a, substr(line, k * 2250 + 1, 2400), true
  FROM (SELECT v.doc_id, step, v.a, l[v.a + 1] AS line, unnest(range(CAST(1 + greatest(0, ceil((length(l[v.a + 1]) - 2400) / 2250)) AS BIGINT))) AS k FROM v JOIN d ON d.doc_id = v.doc_id WHERE step > 0 AND cut)),
p AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step, k) - 1 AS part, count(*) OVER (PARTITION BY doc_id) AS part_count, a + 1 AS start_line, b + 1 AS end_line, text, synthetic FROM g
  UNION ALL SELECT doc_id, NULL, NULL, 1, n, array_to_string(l, chr(10)), false FROM d WHERE NOT large),
parts AS (SELECT CAST(doc_id AS VARCHAR) AS doc, doc_id, CAST(CASE WHEN part_count > 1 OR synthetic THEN part END AS INTEGER) AS part, CAST(CASE WHEN part_count > 1 OR synthetic THEN part_count END AS INTEGER) AS part_count,
  CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, synthetic, length(text) AS n_chars, sha1(text) AS sha1 FROM p)"""


@query(f"WITH RECURSIVE {WINDOWS_SQL} SELECT doc, part, part_count, start_line, end_line, synthetic, n_chars, sha1 FROM parts")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, K9, K10, K12."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    parts = chunk.split_oversized(chunk.plain_chunks(docs, "doc_text"))
    return parts.select("doc", "part", "part_count", "start_line", "end_line", "synthetic", F.length("text").alias("n_chars"), F.sha1("text").alias("sha1"))


@query(f"WITH RECURSIVE {WINDOWS_SQL} SELECT doc, part, part_count, start_line, end_line, 'text_fallback' AS kind, true AS parse_error, sha1 FROM parts WHERE doc_id % 3 = 0")
def fallback_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser fails on every third document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", (F.col("doc_id") % 3 == 0).alias("parse_error"))
    return chunk.parse_failures(docs).select("doc", "part", "part_count", "start_line", "end_line", "kind", "parse_error", F.sha1("text").alias("sha1"))


@query("""SELECT doc_id AS doc, CAST(i AS INTEGER) AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, text FROM documents)
WHERE doc_id % 5 = 0 AND trim(line) <> '' AND length(regexp_replace(text, chr(10) || '+$', '')) // 3 <= 800""")
def uncovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the whole chunks of every fifth document; the parts of split ones leave no line uncovered."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    parts = chunk.split_oversized(chunk.plain_chunks(docs, "doc_text")).withColumn("doc", F.col("doc").cast("long"))
    return chunk.coverage_check(parts.where("not (doc % 5 = 0 and part is null)"), chunk.explode_lines(docs))


@query("SELECT doc_id AS doc, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 5 IN (1, 2)")
def wrong_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each five documents one is a chunk that has another text than its lines, one a line too few, one is synthetic."""
    own = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), own.alias("text"), F.size(F.split(own, "\n")).alias("n"))
    text = F.when(F.col("doc") % 5 == 1, F.concat("text", F.lit("x"))).when(F.col("doc") % 5 == 2, F.concat("text", F.lit("\nnot there"))).otherwise(F.col("text"))
    chunks = d.select("doc", F.col("doc").cast("string").alias("id"), F.when(F.col("doc") % 5 == 3, "made up").otherwise(text).alias("text"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"), (F.col("doc") % 5 == 3).alias("synthetic"))
    return chunk.pointer_check(chunks, chunk.explode_lines(d.select("doc", "text")))


SECTIONS_SQL = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS f, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id AS doc, 'doc_intro' AS kind, CAST(NULL AS VARCHAR) AS symbol, 1 AS start_line, CAST(1 + f AS INTEGER) AS end_line FROM d
UNION ALL SELECT doc_id, 'doc_section', 'A', CAST(3 + f AS INTEGER), CAST(7 + f + n AS INTEGER) FROM d
UNION ALL SELECT doc_id, 'doc_section', 'A > B > C', CAST(9 + f + n AS INTEGER), CAST(12 + f + n AS INTEGER) FROM d
UNION ALL SELECT doc_id, 'doc_section', 'T', CAST(14 + f + n AS INTEGER), CAST(16 + f + n AS INTEGER) FROM d"""


@query(SECTIONS_SQL)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 to K6: texts between headings of both kinds, with a fenced block that holds no heading, and every second with front matter."""
    front = F.when(F.col("doc_id") % 2 == 0, "---\n# x\n---\n").otherwise("")
    text = F.concat(front, F.lit("intro\n\n# A #\n\n"), F.col("text"), F.lit("\n~~~\n# no\n~~~\n\n## B\n\n### C\nend\n\nT\n===\nlast\n"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.alias("text"))
    return chunk.markdown_sections(docs).drop("text")


# --- units of code: a line of a document is a unit, its category follows from its row -----------------------------------

CATEGORY_SQL = "CASE r % 8 WHEN 0 THEN 'import' WHEN 1 THEN 'import' WHEN 2 THEN 'comment' WHEN 3 THEN 'other' WHEN 5 THEN 'comment' WHEN 6 THEN 'comment' ELSE 'definition' END"
UNITS_SQL = f"u AS (SELECT doc_id, r, {CATEGORY_SQL} AS category FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS r FROM documents))"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunk.explode_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))
    row = (F.col("line_no") - 1).cast("int")
    return lines.select("doc", row.alias("start_row"), row.alias("end_row"), F.expr(CATEGORY_SQL.replace("r % 8", "(line_no - 1) % 8")).alias("category"), "line")


@query(f"""WITH {UNITS_SQL},
n AS (SELECT *, first_value(CASE WHEN category <> 'comment' THEN category END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM u),
s AS (SELECT *, CASE WHEN category = 'definition' THEN 'definition' WHEN after = 'import' THEN 'imports' ELSE 'module_code' END AS side FROM n),
g AS (SELECT *, r - row_number() OVER (PARTITION BY doc_id, side ORDER BY r) AS i FROM s)
SELECT doc_id AS doc, CAST(min(r) AS INTEGER) AS start_row, CAST(max(r) AS INTEGER) AS end_row, side AS kind FROM g WHERE side <> 'definition' GROUP BY doc_id, side, i""")
def code_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K16."""
    return chunk.unit_runs(units(spark, sf_dir))


@query(f"""WITH {UNITS_SQL}, m AS (SELECT *, max(r) OVER (PARTITION BY doc_id) AS last FROM u)
SELECT doc_id AS doc, CAST(r AS INTEGER) AS start_row, CASE WHEN r % 8 = 4 AND r < last THEN 'other' ELSE category END AS category FROM m""")
def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first definition of eight rows reaches into the next row."""
    wide = units(spark, sf_dir).withColumn("end_row", F.col("end_row") + F.when(F.col("start_row") % 8 == 4, 1).otherwise(0))
    return chunk.demote_crowded(wide).select("doc", "start_row", "category")


@query(f"WITH {UNITS_SQL} SELECT doc_id AS doc, CAST(r AS INTEGER) AS start_row, CAST(CASE r % 8 WHEN 7 THEN r - 2 WHEN 3 THEN r - 1 ELSE r END AS INTEGER) AS from_row FROM u")
def led_by_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K18."""
    return chunk.attach_comments(units(spark, sf_dir)).select("doc", "start_row", "from_row")


@query(f"""WITH {LINES_SQL}, e AS (SELECT doc_id, unnest(range(len(l))) AS r, unnest(l) AS line FROM l),
o AS (SELECT doc_id, r, '    def m_' || sha1(line) || CASE WHEN r % 2 = 0 THEN ' = 1' ELSE '(): ' || chr(10) || '        pass' END AS entry, r % 2 = 1 AS member FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY member, r) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(entry) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM o),
k AS (SELECT *, sum(length(entry) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM q),
f AS (
  SELECT doc_id, i, 0 AS part, 0 AS base FROM k WHERE i = 0
  UNION ALL SELECT k.doc_id, k.i, CASE WHEN (k.upto - f.base - 1) // 3 <= 797 OR total + 9 < 2403 THEN f.part ELSE f.part + 1 END, CASE WHEN (k.upto - f.base - 1) // 3 <= 797 OR total + 9 < 2403 THEN f.base ELSE k.upto - length(k.entry) - 1 END
  FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1)
SELECT k.doc_id AS doc, CASE WHEN any_value(total) + 9 >= 2403 THEN part END AS part, 1 AS start_line, CAST(any_value(n) AS INTEGER) AS end_line, sha1('class C:' || chr(10) || string_agg(entry, chr(10) ORDER BY k.i)) AS sha1, true AS synthetic
FROM k JOIN f USING (doc_id, i) GROUP BY k.doc_id, part""".replace("WITH ", "WITH RECURSIVE ", 1))
def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a class, an odd line a method of two lines, an even one another statement."""
    odd = F.col("start_row") % 2 == 1
    entry = F.concat(F.lit("def m_"), F.sha1("line"), F.when(odd, "(): \n        pass").otherwise(" = 1"))
    rows = units(spark, sf_dir).select("doc", F.lit("C").alias("container"), F.lit("class C:").alias("header"), F.lit(1).alias("start_line"), (F.col("end_row") + 1).alias("end_line"), F.col("start_row").alias("at"), entry.alias("entry"), odd.alias("is_member"))
    return chunk.overview_rows(rows).select("doc", "part", "start_line", "end_line", F.sha1("text").alias("sha1"), "synthetic")


# Functions of two lines with a line between them, as many as a document has.
@query(f"""WITH RECURSIVE {LINES_SQL},
u AS (SELECT doc_id, l, unnest(range(CAST((len(l) + 1) // 3 AS BIGINT))) AS i FROM l),
c AS (SELECT *, 3 * i + 1 AS a, 3 * i + 2 AS b, (length(l[3 * i + 1]) + length(l[3 * i + 2]) + 1) // 3 < 125 AS tiny FROM u),
g AS (
  SELECT doc_id, i, i AS first, tiny FROM c WHERE i = 0
  UNION ALL SELECT c.doc_id, c.i, CASE WHEN c.tiny AND g.tiny AND length(array_to_string(c.l[3 * g.first + 1:c.b], chr(10))) // 3 <= 800 THEN g.first ELSE c.i END, c.tiny FROM g JOIN c ON c.doc_id = g.doc_id AND c.i = g.i + 1),
r AS (SELECT doc_id, first, count(*) AS n, max(i) AS last FROM g GROUP BY doc_id, first)
SELECT doc_id AS doc, CASE WHEN n > 1 THEN 'group' ELSE 'function' END AS kind, doc_id || '.' || first AS id_key, CAST(3 * first + 1 AS INTEGER) AS start_line, CAST(3 * last + 2 AS INTEGER) AS end_line,
  array_to_string(list_transform(range(first, last + 1), lambda x: 'f' || x), ', ') AS label, sha1(array_to_string(l[3 * first + 1:3 * last + 2], chr(10))) AS sha1, CAST(n AS INTEGER) AS members FROM r JOIN l USING (doc_id)""")
def small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    ls = F.split("text", "\n")
    i = F.explode(F.sequence(F.lit(0), F.floor((F.size(ls) + 1) / 3).cast("int") - 1)).alias("i")
    rows = docs.where(F.size(ls) >= 2).select("doc", ls.alias("ls"), i)
    chars = lambda n: F.length(F.array_join(F.slice("ls", 1, n), "\n"))
    no, name = F.lit(False), F.concat(F.lit("f"), F.col("i").cast("string"))
    chunks = rows.select(
        "doc", F.lit(None).cast("string").alias("parent"), F.lit("function").alias("kind"), (3 * F.col("i") + 1).alias("start_line"), (3 * F.col("i") + 2).alias("end_line"),
        F.array_join(F.slice("ls", 3 * F.col("i") + 1, 2), "\n").alias("text"), no.alias("synthetic"), no.alias("parse_error"), F.lit(None).cast("int").alias("part"),
        F.concat_ws(".", "doc", "i").alias("id"), F.array(name).alias("names"), F.when(F.col("i") == 0, 0).otherwise(chars(3 * F.col("i")) + 1).alias("from_char"), chars(3 * F.col("i") + 2).alias("to_char"),
    )
    out = chunk.group_chunks(chunk.group_small(chunks), chunk.explode_lines(docs))
    return out.select("doc", "kind", "id_key", "start_line", "end_line", "label", F.sha1("text").alias("sha1"), "members")


@query("""WITH w AS (SELECT doc_id, i, n FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT doc_id, CAST(greatest(0, ceil((length(text) - 2400) / 2250)) AS BIGINT) + 1 AS n FROM documents))),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM documents)
SELECT w.doc_id, CAST(i AS INTEGER) AS part, CAST(ordinal AS BIGINT) AS ordinal, left(sha1(source || '::S::function::' || ordinal || CASE WHEN n > 1 THEN '.' || i ELSE '' END), 16) AS id,
  left(sha1(source || ' · S' || CASE WHEN n > 1 THEN ' (part ' || (i + 1) || '/' || n || ')' ELSE '' END || chr(10) || CASE WHEN n > 1 AND i > 0 THEN 'def s():' || chr(10) ELSE '' END || substr(text, i * 2250 + 1, 2400)), 16) AS content_hash
FROM w JOIN o USING (doc_id) JOIN documents USING (doc_id)""")
def shuffled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that start on one line, in any order; later ones carry the signature."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("rel_path"), "text")
    n = F.count("*").over(chunk.W.partitionBy("doc_id"))
    parts = chunk.char_windows(docs).withColumn("n", n).orderBy(F.xxhash64("doc_id", "part"))
    split = F.col("n") > 1
    chunks = parts.select(
        "doc_id", "rel_path", F.lit("function").alias("kind"), F.lit(None).cast("string").alias("parent"), F.lit("S").alias("symbol"), F.when(split, F.col("part")).alias("part"),
        F.when(split, F.col("n").cast("int")).alias("part_count"), F.col("doc_id").alias("start_line"), F.col("window").alias("text"), F.when(split & (F.col("part") > 0), "def s():").alias("context"),
    )
    return chunk.assign_identity(chunks).select("doc_id", F.coalesce("part", F.lit(0)).alias("part"), "ordinal", "id", "content_hash")
