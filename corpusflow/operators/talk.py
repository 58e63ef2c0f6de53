"""Conversations and model text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.functions.text import estimate_tokens
from corpusflow.session import written

TITLE_CHARS, ANSWER_CHARS, HISTORY_TOKENS = 60, 2000, 1500
CHUNK_SCHEMA = (
    "model string, choices array<struct<finish_reason: string, delta: struct<content: string, reasoning: string, reasoning_content: string>>>, "
    "usage struct<prompt_tokens: long, completion_tokens: long>, error struct<message: string>"
)


def list_conversations(conversations: DataFrame, messages: DataFrame, project_id: int) -> DataFrame:
    """The conversations of a project with their message count (0 too), latest first."""
    n = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"))
    rows = conversations.where(F.col("project_id") == project_id).join(n, F.col("id") == F.col("conversation_id"), "left").drop("conversation_id")
    return rows.fillna(0, ["messages"]).orderBy(F.desc("updated_at"), F.desc("id"))


def conversation_messages(conversations: DataFrame, messages: DataFrame, project_id: int, conversation_id: int, meta: str = "called boolean") -> DataFrame:
    """The messages of a conversation in id order, meta parsed; none if another project owns it."""
    own = conversations.where((F.col("project_id") == project_id) & (F.col("id") == conversation_id)).select(F.col("id").alias("conversation_id"))
    return messages.join(own, "conversation_id", "left_semi").withColumn("meta", F.from_json("meta", meta)).orderBy("id")


def title_of(question: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(question), r"\s+", " "), 1, TITLE_CHARS)


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their number, from 1, in order of keys: places in range partitions plus the rows of the partitions before."""
    by = [F.col(c) for c in keys]
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "numbered")
    task = F.shiftrightunsigned("place", 33)
    counts = placed.groupBy(task.alias("task")).agg(F.count("*").alias("n"), F.min("place").alias("low"))  # a row a partition
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("task").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    shifts = counts.select(F.col("task").alias("of"), (before - F.col("low") + 1).alias("shift"))
    return placed.join(F.broadcast(shifts), task == F.col("of")).withColumn(name, F.col("place") + F.col("shift")).drop("place", "of", "shift")


def add_exchanges(conversations: DataFrame, messages: DataFrame, batch: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages with batch(conversation_id, seq, question, answer, meta) added.

    Question and answer rows come together; a title is set once, from the first question; ids go on from the largest, in
    order of conversation and seq.
    """
    base = messages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
    first = W.partitionBy("conversation_id").orderBy("seq")
    rows = numbered(batch, ["conversation_id", "seq"], "n").withColumn("first", F.row_number().over(first) == 1).crossJoin(F.broadcast(base))
    pair = F.array(
        F.struct((F.col("base") + 2 * F.col("n") - 1).alias("id"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("meta")),
        F.struct((F.col("base") + 2 * F.col("n")).alias("id"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("meta").alias("meta")),
    )
    new = rows.select("conversation_id", F.explode(pair).alias("p")).select("p.id", "conversation_id", "p.role", "p.content", "p.meta", F.lit(now).cast("timestamp").alias("created_at"))
    titles = rows.where("first").select(F.col("conversation_id").alias("id"), title_of(F.col("question")).alias("new_title"))
    touched = conversations.join(titles, "id", "left").withColumns(
        {
            "title": F.coalesce("title", "new_title"),
            "updated_at": F.when(F.col("new_title").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")),
        }
    )
    return touched.select(*conversations.columns), messages.unionByName(new.select(*messages.columns))


def pair_turns(messages: DataFrame) -> DataFrame:
    """T4: conversation_id, user_id, assistant_id: each question with the first later answer that called the model.

    messages(conversation_id, id, role, called). A newer question replaces a waiting one; uncalled answers don't count.
    """
    order = W.partitionBy("conversation_id").orderBy("id")
    rows = messages.where("role = 'user' or (role = 'assistant' and called)")
    waiting = F.last(F.when(F.col("role") == "user", F.col("id")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("user_id", waiting).where("role = 'assistant' and user_id is not null")
    return rows.groupBy("conversation_id", "user_id").agg(F.min("id").alias("assistant_id"))


def entries(messages: DataFrame) -> DataFrame:
    """T5: conversation_id, question_id, answer_id: an answer follows its question at once, else it is missing (null)."""
    order = W.partitionBy("conversation_id").orderBy("id")
    rows = messages.withColumns({"next_role": F.lead("role").over(order), "next_id": F.lead("id").over(order), "last_role": F.lag("role").over(order)})
    asked = F.when(F.col("next_role") == "assistant", F.col("next_id"))
    alone = (F.col("role") == "assistant") & ~F.col("last_role").eqNullSafe(F.lit("user"))
    out = rows.where((F.col("role") == "user") | alone)
    return out.select("conversation_id", F.when(F.col("role") == "user", F.col("id")).alias("question_id"), F.when(F.col("role") == "user", asked).otherwise(F.col("id")).alias("answer_id"))


def history_budget(turns: DataFrame, max_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """turns(conversation_id, turn, question, answer) that fit, newest first until one doesn't; answers cut first."""
    cut = F.when(F.length("answer") > ANSWER_CHARS, F.concat(F.substring("answer", 1, ANSWER_CHARS), F.lit("…"))).otherwise(F.col("answer"))
    rows = turns.withColumn("answer", cut)
    cost = estimate_tokens(F.col("question")) + estimate_tokens(F.col("answer"))
    newest = W.partitionBy("conversation_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(newest)).where(F.col("used") <= max_tokens)


def split_thinking(text: Column) -> tuple[Column, Column]:
    """(thinking, answer): a <think> block at the very start; unclosed, all is thinking; elsewhere it is plain text."""
    opens = F.rlike(text, F.lit(r"^\s*<think>"))
    closed = F.rlike(text, F.lit(r"(?s)^\s*<think>.*?</think>"))
    thinking = F.when(closed, F.regexp_extract(text, r"(?s)^\s*<think>(.*?)</think>", 1)).when(opens, F.regexp_extract(text, r"(?s)^\s*<think>(.*)\z", 1)).otherwise("")
    answer = F.when(closed, F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>\s*", "")).when(opens, "").otherwise(text)
    return thinking, answer


def parse_model_chunks(lines: DataFrame) -> DataFrame:
    """lines(stream_id, seq, data) with thinking, text, finish, usage, model, failed, valid."""
    rows = lines.withColumn("j", F.from_json("data", CHUNK_SCHEMA))
    first = F.get("j.choices", F.lit(0))
    count = lambda c: F.coalesce(F.col(f"j.usage.{c}"), F.lit(0)) >= 0
    is_object = F.rlike("data", F.lit(r"^\s*\{"))
    return rows.select(
        *lines.columns,
        F.concat(F.coalesce(first["delta"]["reasoning"], F.lit("")), F.coalesce(first["delta"]["reasoning_content"], F.lit(""))).alias("thinking"),
        F.coalesce(first["delta"]["content"], F.lit("")).alias("text"),
        first["finish_reason"].alias("finish"),
        F.col("j.usage").alias("usage"),
        F.col("j.model").alias("model"),
        F.col("j.error").isNotNull().alias("failed"),
        (is_object & F.col("j").isNotNull() & count("prompt_tokens") & count("completion_tokens")).alias("valid"),
    )


def assemble_stream(chunks: DataFrame) -> DataFrame:
    """stream_id, text, finish, usage, model, incomplete. chunks(stream_id, seq, line): `data:` lines, up to [DONE]."""
    rows = chunks.where(F.startswith("line", F.lit("data:"))).select("stream_id", "seq", F.trim(F.substring("line", 6, 1 << 30)).alias("data"))
    done = rows.where("data = '[DONE]'").groupBy("stream_id").agg(F.min("seq").alias("done_at"))
    live = rows.join(done, "stream_id", "left").where("data != '[DONE]' and (done_at is null or seq < done_at)")
    parsed = parse_model_chunks(live).where("valid")
    out = parsed.groupBy("stream_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("ts"),
        F.max_by("finish", F.when(F.col("finish").isNotNull(), F.col("seq"))).alias("finish"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("usage"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"),
        F.max("done_at").alias("done_at"),
    )
    text = F.array_join(F.transform("ts", lambda t: t["text"]), "")
    return out.select("stream_id", text.alias("text"), "finish", "usage", "model", (F.col("finish").isNull() & F.col("done_at").isNull()).alias("incomplete"))


def coalesce_events(events: DataFrame) -> DataFrame:
    """events(stream_id, seq, type, text): neighbouring deltas joined, of neighbouring thinking the last, others kept."""
    order = W.partitionBy("stream_id").orderBy("seq")
    new = (F.col("type") != F.lag("type").over(order)) | ~F.col("type").isin("delta", "thinking")
    rows = events.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy("stream_id", "run").agg(F.min("seq").alias("seq"), F.first("type").alias("type"), F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("ts"))
    joined = F.array_join(F.transform("ts", lambda t: t["text"]), "")
    return out.select("stream_id", "seq", "type", F.when(F.col("type") == "delta", joined).otherwise(F.element_at("ts", -1)["text"]).alias("text"))


def stream_outcome(events: DataFrame) -> DataFrame:
    """stream_id, outcome: done or failed by its terminal event, stopped if none came."""
    last = F.max_by("type", F.when(F.col("type").isin("done", "error"), F.col("seq")))
    out = events.groupBy("stream_id").agg(last.alias("type"))
    return out.select("stream_id", F.when(F.col("type") == "done", "done").when(F.col("type") == "error", "failed").otherwise("stopped").alias("outcome"))


def split_fences(docs: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Doc, seq, kind (prose, code), lang, text of docs(doc, text); an unclosed fence is code to the end.

    Parts of blank lines only are left out unless keep_blank; a part without lines is none.
    """
    rows = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    order = W.partitionBy("doc").orderBy("n")
    rows = rows.withColumn("mark", F.rlike("line", F.lit(r"^\s*```")))
    rows = rows.withColumn("marks", F.sum(F.col("mark").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    lang = F.max(F.when(F.col("mark"), F.trim(F.regexp_replace("line", r"^\s*```", ""))))
    parts = rows.groupBy("doc", "marks").agg(lang.alias("lang"), F.sort_array(F.collect_list(F.when(~F.col("mark"), F.struct("n", "line")))).alias("ls"))
    text = F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), r"^(?:[ \t]*+\n)++|(?:\n[ \t]*+)++$", "")
    code = F.col("marks") % 2 == 1
    kept = parts.where(F.size("ls") > 0 if keep_blank else F.trim(text) != "")
    return kept.select("doc", F.col("marks").alias("seq"), F.when(code, "code").otherwise("prose").alias("kind"), F.when(code, F.col("lang")).alias("lang"), text.alias("text"))


def extract_citations(docs: DataFrame) -> DataFrame:
    """Doc, citation, rel_path, start_line, end_line of `path:start-end` references, bracketed or plain."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w./-]+\.\w+:\d+-\d+"), F.lit(0)))).alias("citation")
    rows = docs.select("doc", found)
    part = lambda k, t: F.regexp_extract("citation", r"^(.*):(\d+)-(\d+)$", k).cast(t)
    return rows.select("doc", "citation", part(1, "string").alias("rel_path"), part(2, "int").alias("start_line"), part(3, "int").alias("end_line"))


def stage_timings(asked: Column, found: Column, first: Column, answer: Column, end: Column) -> dict[str, Column]:
    """Whole milliseconds of search, wait, thinking, writing and total; null for a stage that didn't happen."""
    ms = lambda a, b: F.when((b - a).isNotNull(), F.greatest(F.lit(0), F.round((b - a) * 1000)).cast("long"))
    return {
        "search": ms(asked, found),
        "wait": ms(found, F.coalesce(first, answer)),
        "thinking": ms(first, F.coalesce(answer, end)),
        "writing": ms(answer, end),
        "total": ms(asked, end),
    }


def token_summary(reported: Column, completion: Column, thinking: Column, pieces: Column, text: Column) -> dict[str, Column]:
    """Answer and thinking tokens: reported counts win, else pieces or an estimate, flagged."""
    known = F.coalesce(reported, F.lit(False)) & completion.isNotNull()
    think = F.coalesce(thinking, F.lit(0))
    return {
        "answer_tokens": F.when(known, F.greatest(F.lit(0), completion - think)).otherwise(F.coalesce(pieces, estimate_tokens(text))),
        "thinking_tokens": think,
        "estimated": ~known,
    }
