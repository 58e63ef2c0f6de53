"""Documents to chunk rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.functions import text as tx

MAX_TOKENS, OVERLAP_TOKENS, MERGE_TOKENS = 800, 50, 125
MAX_CHARS, OVERLAP_CHARS = MAX_TOKENS * 3, OVERLAP_TOKENS * 3

MARKDOWN, CONFIG, RST = (".md", ".markdown"), (".json", ".yaml", ".yml"), (".rst",)
# The signs of Markdown, and the kinds of chunks that may merge.
HEADING = r"^ {0,3}(#{1,6})[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
SETEXT = r"^ {0,3}(=+|-+)[ \t]*$"
NOT_SETEXT = r"^ {0,3}(>|[-*+][ \t]|\d+[.)][ \t]|\||    )"
SMALL_KINDS = ("function", "method", "module_code", "imports", "interface", "type", "enum")


def explode_lines(docs: DataFrame) -> DataFrame:
    """K1: line_no (from 1) and line in place of text; a trailing empty piece is a line too."""
    lines = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no") + 1)


def route(path: Column) -> Column:
    """K2: markdown, config, rst, code or null by extension."""
    ext = F.lower(tx.suffix(path))
    known = tx.language(path)
    return F.when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*CONFIG), "config").when(ext.isin(*RST), "rst").when(known.isNotNull(), "code")


def fence_flags(lines: Column) -> Column:
    """K3: for each line whether it is in a fenced block, its fences included. A fold that carries the open fence."""
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("flags"))

    def step(acc: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, FENCE, 1)
        inside = acc["open"] != ""
        same = (F.substring(mark, 1, 1) == F.substring(acc["open"], 1, 1)) & (F.length(mark) >= F.length(acc["open"]))
        alone = F.rlike(F.trim(line), F.lit(r"^(`*|~*)$"))
        after = F.when(~inside, mark).when((mark != "") & same & alone, "").otherwise(acc["open"])
        return F.struct(after.alias("open"), F.concat(acc["flags"], F.array(inside | (mark != ""))).alias("flags"))

    return F.aggregate(lines, zero, step)["flags"]


def markdown_lines(docs: DataFrame) -> DataFrame:
    """K3, K4: doc, row (from 0), line, fenced, level and title (null: no heading), last_row of the heading.

    docs(doc, text). A leading `---` block up to `---` or `...` is front matter and holds no heading.
    """
    lines = F.split("text", "\n")
    rows = docs.select("doc", F.posexplode(F.arrays_zip(lines.alias("line"), fence_flags(lines).alias("fenced"))).alias("row", "z"))
    rows = rows.select("doc", "row", "z.line", "z.fenced", F.trim("z.line").alias("bare"))
    doc = W.partitionBy("doc")
    by_row = doc.orderBy("row")
    opens = F.max(F.when((F.col("row") == 0) & (F.col("bare") == "---"), True)).over(doc)
    close = F.min(F.when((F.col("row") > 0) & F.col("bare").isin("---", "..."), F.col("row"))).over(doc)
    rows = rows.withColumn("first", F.when(opens & close.isNotNull(), close + 1).otherwise(0))
    live = ~F.col("fenced") & (F.col("row") >= F.col("first"))
    atx = live & F.rlike("line", F.lit(HEADING))
    under = F.lead("line").over(by_row)
    setext = (
        live & ~atx & (F.col("bare") != "") & ~F.coalesce(F.lead("fenced").over(by_row), F.lit(True)) & F.rlike(under, F.lit(SETEXT))
        & ~F.rlike("line", F.lit(NOT_SETEXT)) & ((F.col("row") == F.col("first")) | (F.coalesce(F.lag("bare").over(by_row), F.lit("")) == ""))
    )
    level = F.when(atx, F.length(F.regexp_extract("line", HEADING, 1))).when(setext, F.when(F.startswith(F.trim(under), F.lit("=")), 1).otherwise(2))
    title = F.when(atx, F.trim(F.regexp_extract("line", HEADING, 2))).when(setext, F.col("bare"))
    return rows.select("doc", "row", "line", "fenced", level.alias("level"), title.alias("title"), (F.col("row") + F.when(setext, 1).otherwise(0)).alias("last_row"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """K5, K6: doc, kind (doc_intro, doc_section), symbol (heading path), start_line, end_line, text.

    A heading without a body folds into the next section unless it is the last; blank edges are trimmed; empty sections
    give no row. A document without headings is one intro.
    """
    rows = markdown_lines(docs)
    by_row = W.partitionBy("doc").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("h", F.count("level").over(by_row))
    # the heading path: of each level the last title, unless a shallower heading is later
    at = {n: F.max(F.when(F.col("level") == n, F.col("row"))).over(by_row) for n in range(1, 7)}
    titles = {n: F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(by_row) for n in range(1, 7)}
    rows = rows.withColumns({f"at{n}": c for n, c in at.items()} | {f"t{n}": c for n, c in titles.items()})
    shown = []
    for n in range(1, 7):
        shallower = F.greatest(F.lit(-1), *(F.coalesce(f"at{m}", F.lit(-1)) for m in range(1, n)), F.lit(-1))
        shown.append(F.when(F.col(f"at{n}") > shallower, F.col(f"t{n}")))
    rows = rows.withColumn("path", F.concat_ws(" > ", *shown))
    head_end = F.max(F.when(F.col("level").isNotNull(), F.col("last_row"))).over(W.partitionBy("doc", "h"))
    body = (F.col("row") > F.coalesce(head_end, F.lit(-1))) & (F.trim("line") != "")
    rows = rows.withColumn("body", body)
    heads = rows.groupBy("doc", "h").agg(F.max("body").alias("has_body"), F.last("path").alias("p"))
    order = W.partitionBy("doc").orderBy("h")
    # a section closes at its end if it has a body or is the last; the ones before that don't carry on
    closes = F.col("has_body") | F.lead("h").over(order).isNull() | (F.col("h") == 0)
    heads = heads.withColumn("closes", closes)
    before = F.sum(F.col("closes").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    heads = heads.withColumn("section", F.coalesce(before, F.lit(0)))
    whole = rows.select("doc", "row", "line", "h", "path").join(heads.select("doc", "h", "section"), ["doc", "h"])
    item = F.struct("row", "line")
    out = whole.groupBy("doc", "section").agg(F.sort_array(F.collect_list(item)).alias("ls"), F.max("h").alias("h"), F.max_by("path", "row").alias("path"))
    filled = F.filter("ls", lambda x: F.trim(x["line"]) != "")
    out = out.withColumns({"a": F.get(filled, F.lit(0))["row"], "b": F.element_at(filled, -1)["row"]}).where("a is not null")
    inside = F.filter("ls", lambda x: (x["row"] >= F.col("a")) & (x["row"] <= F.col("b")))
    return out.select(
        "doc",
        F.when(F.col("h") == 0, "doc_intro").otherwise("doc_section").alias("kind"),
        F.when(F.col("h") > 0, F.col("path")).alias("symbol"),
        (F.col("a") + 1).alias("start_line"),
        (F.col("b") + 1).alias("end_line"),
        F.array_join(F.transform(inside, lambda x: x["line"]), "\n").alias("text"),
    )


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """K7: doc, start_row, end_row of paragraphs, lists and fenced blocks; a fence right after text starts its own."""
    rows = markdown_lines(docs)
    by_row = W.partitionBy("doc").orderBy("row")
    solid = (F.trim("line") != "") | F.col("fenced")
    opens = F.col("fenced") & ~F.coalesce(F.lag("fenced").over(by_row), F.lit(False))
    rows = rows.withColumn("solid", solid).withColumn("opens", opens)
    starts = F.col("solid") & (~F.coalesce(F.lag("solid").over(by_row), F.lit(False)) | F.col("opens"))
    rows = rows.withColumn("starts", starts)
    island = F.sum(F.col("starts").cast("int")).over(by_row.rowsBetween(W.unboundedPreceding, 0))
    blocks = rows.withColumn("island", island).where("solid").groupBy("doc", "island")
    return blocks.agg(F.min("row").alias("start_row"), F.max("row").alias("end_row")).drop("island")


def plain_chunks(docs: DataFrame, kind: str) -> DataFrame:
    """K8: the whole document as one chunk, trailing line feeds taken off."""
    text = F.regexp_replace("text", "\n+$", "")
    return docs.select("doc", F.lit(kind).alias("kind"), F.lit(1).alias("start_line"), F.size(F.split(text, "\n")).alias("end_line"), text.alias("text"))


def char_windows(docs: DataFrame, size: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Keys, part, start, window of a text as one over-long line; the last window is the first to reach the end."""
    step = max(1, size - overlap)
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    rows = docs.select("*", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    start = F.col("part") * step
    return rows.select(*[c for c in docs.columns if c != "text"], "part", start.alias("start"), F.substring(F.col("text"), start + 1, F.lit(size)).alias("window"))


def line_windows(lines: list[str], lo: int, hi: int, cap: int = MAX_TOKENS) -> list[tuple[int, int, str | None]]:
    """(first, last, text of a cut line or None): whole lines up to the cap, each next window a few lines back.

    ends[i] is the number of characters of lines lo .. lo + i - 1 with their line feeds, so both the end of a window and
    the start of the next are found by bisection.
    """
    size, out, at = cap * 3, [], lo
    ends = [0, *accumulate(len(x) + 1 for x in lines[lo : hi + 1])]
    long = [i for i in range(lo, hi + 1) if len(lines[i]) >= size]
    while at <= hi:
        wall = long[bisect_left(long, at)] if long and long[-1] >= at else hi + 1  # windows stop before an over-long line
        if wall == at:
            count = 1 + max(0, -((size - len(lines[at])) // max(1, size - OVERLAP_CHARS)))
            out += [(at, at, lines[at][k * (size - OVERLAP_CHARS) :][:size]) for k in range(count)]
            at += 1
            continue
        stop = min(wall, lo + bisect_right(ends, ends[at - lo] + size) - 1)
        out.append((at, stop - 1, None))
        if stop > hi:
            break
        at = max(at + 1, lo + bisect_left(ends, ends[stop - lo] - OVERLAP_CHARS))
    return out


def statement_groups(lines: list[str], starts: list[int], cap: int) -> list[tuple[int, int, str | None]]:
    """Segments from one statement to the next, packed while they fit; one that is too large by itself is cut by
    lines, from the start of what was waiting."""
    marks = sorted({0, *(s for s in starts if 0 < s < len(lines))})
    ends = [0, *accumulate(len(x) + 1 for x in lines)]
    fits = lambda a, b: (ends[b] - ends[a] - 1) // 3 <= cap  # noqa: E731  lines a .. b - 1
    out: list[tuple[int, int, str | None]] = []
    open_at = 0
    for here, after in zip(marks, [*marks[1:], len(lines)]):
        if not fits(here, after):
            out += line_windows(lines, open_at, after - 1, cap)
            open_at = after
        elif not fits(open_at, after):
            out.append((open_at, here - 1, None))
            open_at = here
    return [*out, (open_at, len(lines) - 1, None)] if open_at < len(lines) else out


PART = pa.schema([
    ("doc", pa.string()), ("part", pa.int32()), ("part_count", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string()), ("synthetic", pa.bool_()),
    ("context", pa.string()),
])
PART_DDL = "doc string, part int, part_count int, start_line int, end_line int, text string, synthetic boolean, context string"


def split_oversized(chunks: DataFrame) -> DataFrame:
    """Doc, part, part_count (null: not split), start_line, end_line, text, synthetic, context.

    chunks(doc string, start_line, text), and if there are such columns starts (array<int>, the first lines of statements within
    the text), prefix, signature and whole_end. A prefix is repeated before each part and shrinks the cap by its size, to a
    quarter at most. The signature is the context of each part but the first. A chunk with a whole_end is a built summary: its
    parts all have its line range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, first, text, starts, prefix, signature, whole_end in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (text or "").split("\n")
                cap = max(MAX_TOKENS - len(prefix + "\n") // 3, MAX_TOKENS // 4) if prefix else MAX_TOKENS
                groups = statement_groups(lines, starts or [], cap) if len(text or "") // 3 > MAX_TOKENS or prefix else [(0, len(lines) - 1, None)]
                built = whole_end is not None
                if len(groups) == 1 and groups[0][2] is None and not prefix:
                    rows.append((doc, None, None, first, whole_end if built else first + len(lines) - 1, text, built, None))
                    continue
                head = prefix + "\n" if prefix else ""
                for n, (a, b, own) in enumerate(groups):
                    body = "\n".join(lines[a : b + 1]) if own is None else own
                    place = (first, whole_end) if built else (first + a, first + b)
                    rows.append((doc, n, len(groups), *place, head + body, built or own is not None, signature if n else None))
            yield pa.RecordBatch.from_pylist([dict(zip(PART.names, r)) for r in rows], schema=PART)

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in chunks.columns else F.lit(None).cast(kind).alias(name)

    own = chunks.select(
        F.col("doc").cast("string"), "start_line", "text", given("starts", "array<int>"), given("prefix", "string"), given("signature", "string"), given("whole_end", "int")
    )
    return own.mapInArrow(run, PART_DDL)


def group_small(chunks: DataFrame) -> DataFrame:
    """Doc, parent, members (array of chunk structs in order) of groups, single chunks being groups of one.

    chunks(doc, parent, kind, start_line, end_line, text, synthetic, parse_error, part, id, names, lines_chars) where
    upto is the number of characters of the document before a chunk's first line. Neighbours of one scope merge while
    each is small and the lines from the first to the last stay under the cap; imports only with imports.
    """
    item = F.struct("start_line", "end_line", "kind", "text", "synthetic", "parse_error", "part", "id", "names", "from_char", "to_char")
    lists = chunks.groupBy("doc", "parent").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = lists.schema["items"].dataType.simpleString()

    def small(c: Column) -> Column:
        return c["kind"].isin(*SMALL_KINDS) & ~c["synthetic"] & ~c["parse_error"] & c["part"].isNull() & (tx.estimate_tokens(c["text"]) < MERGE_TOKENS)

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        first = F.element_at(last, 1)
        merged = F.floor((c["to_char"] - first["from_char"]) / 3)
        alike = (first["kind"] == "imports") == (c["kind"] == "imports")
        joins = (F.size(acc) > 0) & small(c) & small(F.element_at(last, -1)) & alike & (merged <= MAX_TOKENS)
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(c))))).otherwise(F.concat(acc, F.array(F.array(c))))

    groups = F.aggregate("items", F.array().cast(f"array<{kind}>"), step)
    return lists.select("doc", "parent", F.explode(groups).alias("members"))


def group_chunks(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """Doc, parent, kind (group, or that of a single chunk), id_key, names, label, start_line, end_line, text, members.

    groups of group_small(), lines(doc, line_no, line). A group is keyed by its first member's id, labelled by the names of all
    members, and its text is all lines from its first member to its last.
    """
    first, last, many = F.get("members", F.lit(0)), F.element_at("members", -1), F.size("members") > 1
    names = F.flatten(F.transform("members", lambda m: F.coalesce(m["names"], F.array().cast("array<string>"))))
    rows = groups.select(
        "doc", "parent", F.when(many, "group").otherwise(first["kind"]).alias("kind"), first["id"].alias("id_key"), names.alias("names"), first["kind"].alias("first_kind"),
        first["start_line"].alias("start_line"), last["end_line"].alias("end_line"), F.size("members").alias("members"), F.when(~many, first["text"]).alias("own"),
    )
    rows = rows.withColumn("label", F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise(F.col("first_kind")))
    wanted = rows.where("members > 1").select("doc", "id_key", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    texts = wanted.join(lines, ["doc", "line_no"]).groupBy("doc", "id_key").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    joined = rows.join(texts, ["doc", "id_key"], "left")
    text = F.coalesce("own", F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text")
    return joined.select("doc", "parent", "kind", "id_key", "names", "label", "start_line", "end_line", text, "members")


def assign_identity(chunks: DataFrame) -> DataFrame:
    """Ordinal, id, names, embed_text, content_hash, tokens for chunks(rel_path, kind, parent, symbol, part,
    part_count, start_line, text), and context, names, label and id_key where there are such columns.

    Chunks that share path, kind, parent and symbol are numbered by line; the parts of one chunk share its number. Whole chunks
    that start on one line go by their text. Names are the symbol unless given; a context stands between label and text.
    """
    given = lambda name, kind: F.col(name) if name in chunks.columns else F.lit(None).cast(kind)
    same = W.partitionBy("rel_path", "kind", "parent", "symbol").orderBy("start_line", F.coalesce("part", F.lit(0)), "text")
    # the parts of one chunk share its ordinal
    rows = chunks.withColumn("ordinal", F.sum(F.when(F.coalesce("part", F.lit(0)) == 0, 1).otherwise(0)).over(same.rowsBetween(W.unboundedPreceding, 0)) - 1)
    number = F.concat(F.col("ordinal").cast("string"), F.when(F.col("part").isNull(), "").otherwise(F.concat(F.lit("."), F.col("part").cast("string"))))
    qualified = F.coalesce(given("id_key", "string"), tx.qualified_name(F.col("parent"), F.col("symbol")))
    key = F.concat_ws("::", "rel_path", qualified, "kind", number)
    label = tx.chunk_label(F.col("rel_path"), F.col("parent"), F.col("symbol"), F.col("kind"), F.col("part"), F.col("part_count"), given("label", "string"))
    context = F.coalesce(F.concat(given("context", "string"), F.lit("\n")), F.lit(""))
    names = F.coalesce(given("names", "array<string>"), F.when(F.col("symbol").isNotNull(), F.array("symbol")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("id", tx.short_sha1(key)).withColumn("names", names).withColumn("embed_text", F.concat(label, F.lit("\n"), context, F.col("text")))
    return rows.withColumn("content_hash", tx.short_sha1(F.col("embed_text"))).withColumn("tokens", tx.estimate_tokens(F.col("text")))


def unit_runs(units: DataFrame) -> DataFrame:
    """Doc, start_row, end_row, kind of runs of unclaimed units: imports or module_code.

    units(doc, start_row, end_row, category: definition, import, comment or other). A run closes at a definition and where
    its category flips; comments right above a flip move to the next run.
    """
    order = W.partitionBy("doc").orderBy("start_row")
    upwards = W.partitionBy("doc").orderBy(F.desc("start_row")).rowsBetween(W.unboundedPreceding, 0)  # a frame that only grows
    after = F.last(F.when(F.col("category") != "comment", F.col("category")), ignorenulls=True).over(upwards)
    # a comment counts as what follows it; at the end of a document or above a definition, as other code
    side = F.when(F.col("category") == "definition", "definition").otherwise(F.when(after == "import", "imports").otherwise("module_code"))
    rows = units.withColumn("side", side)
    flips = (F.col("side") != F.lag("side").over(order)).cast("int")
    runs = rows.withColumn("run", F.sum(F.coalesce(flips, F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.where("side != 'definition'").groupBy("doc", "run", "side").agg(F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"))
    return out.select("doc", "start_row", "end_row", F.col("side").alias("kind"))


def demote_crowded(units: DataFrame) -> DataFrame:
    """Definitions that share a line with another unit become other code."""
    order = W.partitionBy("doc").orderBy("start_row", "end_row")
    shared = (F.lag("end_row").over(order) >= F.col("start_row")) | (F.lead("start_row").over(order) <= F.col("end_row"))
    crowded = (F.col("category") == "definition") & F.coalesce(shared, F.lit(False))
    return units.withColumn("category", F.when(crowded, "other").otherwise(F.col("category")))


def attach_comments(units: DataFrame, most: int = 30) -> DataFrame:
    """Units with `from_row`: where the comment block starts that stands right above, without a blank line.

    A comment that trails another unit on its line isn't leading, and ends the block below it; a block of more than `most` rows
    isn't attached.
    """
    order = W.partitionBy("doc").orderBy("start_row", "end_row")
    trails = F.coalesce(F.lag("end_row").over(order) == F.col("start_row"), F.lit(False))
    rows = units.withColumn("c", (F.col("category") == "comment") & ~trails)
    joined = F.col("c") & F.lag("c").over(order) & (F.lag("end_row").over(order) + 1 == F.col("start_row"))
    rows = rows.withColumn("island", F.sum((~F.coalesce(joined, F.lit(False))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    blocks = rows.where("c").groupBy("doc", "island").agg(F.min("start_row").alias("from_row"), F.max("end_row").alias("to_row"))
    blocks = blocks.where(F.col("to_row") - F.col("from_row") < most).select("doc", "from_row", (F.col("to_row") + 1).alias("start_row"))
    own = units.join(blocks, ["doc", "start_row"], "left")
    return own.withColumn("from_row", F.when(F.col("category") != "comment", F.coalesce("from_row", "start_row")).otherwise(F.col("start_row")))


def overview_rows(members: DataFrame) -> DataFrame:
    """Doc, container, part, part_count, start_line, end_line, text, synthetic of a summary of each container.

    members(doc, container, header, start_line, end_line (of the container), at (order of a member), entry, is_member). The
    header line, then all other statements, then the members' signatures, each indented. A summary over the cap is cut between
    its entries, and every part starts with the header. A container without entries has one row with a null entry.
    """
    item = F.struct("is_member", "at", "entry")
    lists = members.groupBy("doc", "container").agg(
        F.min("header").alias("header"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.sort_array(F.collect_list(F.when(F.col("entry").isNotNull(), item))).alias("ms"),
    )
    entries = F.transform("ms", lambda m: F.concat(F.lit("    "), m["entry"]))
    rows = lists.withColumn("entries", entries).withColumn("body", F.array_join("entries", "\n"))
    whole = F.concat(F.col("header"), F.when(F.size("entries") > 0, F.concat(F.lit("\n"), F.col("body"))).otherwise(""))
    rows = rows.withColumn("whole", whole).withColumn("cut", (tx.estimate_tokens(whole) > MAX_TOKENS) & (F.size("entries") > 0))
    # the rows at which the entries start within the body
    heights = F.transform("entries", lambda e: F.size(F.split(e, "\n")))
    starts = F.transform("entries", lambda _, i: F.aggregate(F.slice(heights, 1, i), F.lit(0), lambda a, n: a + n))
    name = F.to_json(F.struct("doc", "container")).alias("doc")
    parts = split_oversized(
        rows.select(
            name, "start_line", F.when(F.col("cut"), F.col("body")).otherwise(F.col("whole")).alias("text"), F.when(F.col("cut"), starts).alias("starts"),
            F.when(F.col("cut"), F.col("header")).alias("prefix"), F.col("end_line").alias("whole_end"),
        )
    )
    kinds = ", ".join(f"{c} {dict(members.dtypes)[c]}" for c in ("doc", "container"))
    key = F.from_json("doc", kinds)
    return parts.select(key["doc"].alias("doc"), key["container"].alias("container"), "part", "part_count", "start_line", "end_line", "text", "synthetic")


def parse_failures(docs: DataFrame) -> DataFrame:
    """Documents flagged by their parser as plain text, cut by lines where it is over the cap: kind text_fallback."""
    plain = plain_chunks(docs.where("parse_error").withColumn("doc", F.col("doc").cast("string")), "text_fallback")
    return split_oversized(plain).withColumns({"kind": F.lit("text_fallback"), "parse_error": F.lit(True)})


def coverage_check(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Doc, line_no of lines that aren't blank and are in no chunk. chunks(doc, start_line, end_line)."""
    spans = chunks.select("doc", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct()
    return lines.where(F.trim("line") != "").join(spans, ["doc", "line_no"], "left_anti").select("doc", "line_no")


def pointer_check(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """The chunks that aren't synthetic and whose text isn't that of their lines, joined; lines that there aren't count as none.

    Lines are compared by their SHA-256, so that neither a text nor a line is shuffled: a document's lines become one list of
    digests, which meets its chunks, whose texts are cut into lines where they stand.
    """
    digest = lambda c: F.unhex(F.sha2(c, 256))
    have = lines.select("doc", F.struct("line_no", digest(F.col("line")).alias("own")).alias("l")).groupBy("doc").agg(F.sort_array(F.collect_set("l")).alias("ls"))
    told = chunks.where("not synthetic").select("doc", "id", "start_line", "end_line", (F.col("text") == "").alias("empty"), F.transform(F.split("text", "\n"), digest).alias("told"))
    inside = F.filter("ls", lambda x: (x["line_no"] >= F.col("start_line")) & (x["line_no"] <= F.col("end_line")))
    found = F.coalesce(F.transform(inside, lambda x: x["own"]), F.array().cast("array<binary>"))
    rows = told.join(have, "doc", "left")
    return rows.where((F.col("told") != found) & ~(F.col("empty") & (F.size(found) == 0))).select("doc", "id")
