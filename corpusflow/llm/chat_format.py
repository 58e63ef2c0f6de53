"""Chat formatting with a grammar round trip, in DataFrame operations only.

The grammar: a conversation is a sequence of turns, each `### ROLE: BODY</turn>` and a line feed; a body whose control
strings are escaped has the header `###\\ ROLE: `. In roles a backslash stands before a colon or backslash. In escaped
bodies and all roles the slash of `</turn>` and every backslash have a backslash before them, so that the end of a turn
never occurs inside one and taking the backslashes off restores the text.

Each conversation is rendered plainly, parsed again and compared with its source; where they differ, turns that hold a
control string are escaped, and if that isn't enough, all turns. What still differed would be an error and stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"
#: The parts of a turn: escape mark, role, body.
TURN = r"(?s)^###(\\?) ((?:[^\\:]++|\\.)*+): (.*)$"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\|(?<=<)/(?=turn>)", r"\\$0")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def rendered(turns: Column, level: int) -> Column:
    """turns: array of (role, text). level: 0 plain, 1 escapes turns with a control string, 2 escapes all."""

    def one(t: Column) -> Column:
        role = F.regexp_replace(escaped(t["role"]), ":", r"\\:")
        plain = F.concat(F.lit("### "), role, F.lit(": "), t["text"], F.lit(END + "\n"))
        safe = F.concat(F.lit("###\\ "), role, F.lit(": "), escaped(t["text"]), F.lit(END + "\n"))
        return plain if level == 0 else safe if level == 2 else F.when(F.contains(t["text"], F.lit(END)), safe).otherwise(plain)

    return F.array_join(F.transform(turns, one), "")


def parsed(c: Column) -> Column:
    """array of (role, text) read back from a rendered conversation."""

    def one(t: Column) -> Column:
        body = F.regexp_extract(t, TURN, 3)
        return F.struct(
            unescaped(F.regexp_extract(t, TURN, 2)).alias("role"),
            F.when(F.startswith(t, F.lit("###\\ ")), unescaped(body)).otherwise(body).alias("text"),
        )

    pieces = F.split(c, END + "\n?")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, escape_level, turns (read back), loss_spans for rows(conv_id, turn, role, text).

    Turns go by number, null first; rows with the same number by role, then text, and repeated rows count as often as
    they stand. A null role or text is empty. Rows with a null conv_id make one conversation. loss_spans has (start, end)
    in code points of each assistant body in formatted, escapes included. An empty table gives no rows. Other columns of
    rows are ignored. A conversation is one value, as its digest and its text are; only its own turns meet in it.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    source = source.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    tried = source.withColumn("formatted", rendered(F.col("source"), 0)).withColumn("escape_level", F.lit(0))
    for level in (1, 2):
        same = parsed(F.col("formatted")) == F.col("source")
        tried = tried.select(
            "conv_id",
            "source",
            F.when(same, F.col("formatted")).otherwise(rendered(F.col("source"), level)).alias("formatted"),
            F.when(same, F.col("escape_level")).otherwise(level).alias("escape_level"),
        )
    back = tried.withColumn("turns", parsed(F.col("formatted")))
    sure = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(
        F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )
    return back.select("conv_id", "formatted", "escape_level", sure.alias("turns"), loss_spans(F.col("formatted")).alias("loss_spans"))


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once, however often and wherever it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Turns whose lengths are added up at a time.
RUN = 256


def loss_spans(formatted: Column) -> Column:
    """(start, end) of the assistant bodies: what a loss mask covers.

    A turn starts after all turns before it. Their lengths are added up by runs of RUN turns first, and of the turn's own run
    those before it, so that long conversations don't add up everything for each turn.
    """
    add = lambda a, n: a + n
    total = lambda lengths, first, n: F.aggregate(F.slice(lengths, first + 1, n), F.lit(0).cast("long"), add)

    def spans(turns: Column) -> Column:
        lengths = F.transform(turns, lambda t: (F.length(t) + len(END) + 1).cast("long"))
        return bound(lengths, lambda ls: bound(runs(ls), lambda before: placed(turns, ls, before)))

    def runs(ls: Column) -> Column:
        """The length of all turns before each run."""
        numbers = F.sequence(F.lit(0), F.floor(F.size(ls) / RUN).cast("int"))
        sums = F.transform(numbers, lambda r: total(ls, r * RUN, F.lit(RUN)))
        return bound(sums, lambda ss: F.transform(ss, lambda _, r: total(ss, F.lit(0), r)))

    def placed(turns: Column, ls: Column, before: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            run = F.floor(i / RUN).cast("int")
            start = F.get(before, run) + total(ls, run * RUN, i % RUN)
            head = F.length(t) - F.length(F.regexp_extract(t, TURN, 3))
            mine = F.regexp_extract(t, TURN, 2) == "assistant"
            return F.when(mine, F.struct((start + head).alias("start"), (start + F.length(t)).alias("end")))

        return F.array_compact(F.transform(turns, one))

    return bound(F.split(formatted, END + "\n?"), lambda ps: bound(F.slice(ps, 1, F.size(ps) - 1), spans))


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns of op2, read back from the formatted text and its loss mask."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def covered(s: Column) -> Column:
        body = F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        head = F.substring(F.col("formatted"), (s["start"] - 15).cast("int"), F.lit(16))
        return F.when(head == "###\\ assistant: ", unescaped(body)).otherwise(body)

    loss = F.array_join(F.transform("loss_spans", covered), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escape_level",
    )
