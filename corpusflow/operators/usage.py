"""The usage log: windows, totals, limits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Windows in the order of reports.
WINDOWS = ("minute", "hour", "day", "week", "month")
ROLLING = {"minute": 60, "hour": 3600}
UNIT_SECONDS = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
MAX_SECONDS = 400 * 86400.0
MAX_LIMIT = 10**12
DANGER, WARN = 90, 75


def window_bounds(spark: SparkSession, now: str, zone: str) -> DataFrame:
    """Window, start, next_start, rolling: minute and hour back from now, the others by the calendar of the zone."""
    at = F.lit(now).cast("timestamp")
    rows = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(w).alias("window"), F.lit(i).alias("window_order")) for i, w in enumerate(WINDOWS)))).alias("w")).select("w.*")
    local = F.from_utc_timestamp(at, zone)
    start, end = F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")
    for w, seconds in ROLLING.items():
        start = F.when(F.col("window") == w, at - F.expr(f"interval {seconds} seconds")).otherwise(start)
    for w in ("day", "week", "month"):
        begin = F.date_trunc(w, local)
        start = F.when(F.col("window") == w, F.to_utc_timestamp(begin, zone)).otherwise(start)
        end = F.when(F.col("window") == w, F.to_utc_timestamp(begin + F.expr(f"interval 1 {w}"), zone)).otherwise(end)
    return rows.select("window", "window_order", start.alias("start"), end.alias("next_start"), F.col("window").isin(*ROLLING).alias("rolling"))


def totals(calls: DataFrame, bounds: DataFrame) -> DataFrame:
    """Provider, window, requests, tokens, estimated_calls, oldest of the calls at or after the window's start.

    One pass over the calls for all windows and providers; the five bounds are broadcast.
    """
    rows = calls.join(F.broadcast(bounds), F.col("at") >= F.col("start"))
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("thinking_tokens", F.lit(0)) + F.coalesce("answer_tokens", F.lit(0))
    return rows.groupBy("provider", "window").agg(
        F.count("*").alias("requests"), F.sum(tokens).alias("tokens"), F.count_if("estimated").alias("estimated_calls"), F.min("at").alias("oldest")
    )


def frees_at(total: DataFrame) -> DataFrame:
    """U4: total with frees_at: when the oldest call leaves a rolling window."""
    length = F.when(F.col("window") == "minute", ROLLING["minute"]).when(F.col("window") == "hour", ROLLING["hour"])
    return total.withColumn("frees_at", F.timestamp_micros(F.unix_micros("oldest") + length.cast("long") * 1_000_000))


def load_limits(saved: DataFrame, published: DataFrame) -> DataFrame:
    """Provider, limits (map of window to tokens and requests), origin: yours, none or published.

    saved(provider, value) is JSON text; damaged or absent falls back to published(provider, limits).
    """
    kind = "map<string, struct<tokens: bigint, requests: bigint>>"
    mine = saved.select("provider", F.from_json("value", kind).alias("own"), F.rlike("value", F.lit(r"^\s*\{\s*\}\s*$")).alias("empty"))
    rows = mine.join(published.select("provider", F.col("limits").alias("pub")), "provider", "full_outer")
    usable = F.col("own").isNotNull() & (F.size("own") > 0)
    origin = F.when(usable, "yours").when(F.col("empty"), "none").when(F.col("pub").isNotNull(), "published").otherwise("none")
    return rows.select("provider", F.when(origin == "yours", F.col("own")).when(origin == "published", F.col("pub")).alias("limits"), origin.alias("origin"))


def explode_limits(limits: DataFrame) -> DataFrame:
    """provider, window, kind, limit: one row for each limit that is set."""
    rows = limits.select("provider", F.explode("limits").alias("window", "l"))
    pair = F.array(F.struct(F.lit("tokens").alias("kind"), F.lit(0).alias("kind_order"), F.col("l.tokens").alias("limit")), F.struct(F.lit("requests").alias("kind"), F.lit(1).alias("kind_order"), F.col("l.requests").alias("limit")))
    return rows.select("provider", "window", F.explode(pair).alias("p")).select("provider", "window", "p.*").where("limit is not null")


def validate_limits(limits: DataFrame) -> DataFrame:
    """Provider, window, kind, rule of limits that are broken: unknown window or a number out of 1 .. 10^12."""
    rows = explode_limits(limits)
    rule = F.when(~F.col("window").isin(*WINDOWS), "window").when(~F.col("limit").between(1, MAX_LIMIT), "range")
    return rows.select("provider", "window", "kind", rule.alias("rule")).where("rule is not null")


def tone(percent: Column, reached: Column) -> Column:
    return F.when(reached | (percent >= DANGER), "danger").when(percent >= WARN, "warn").otherwise("quiet")


def limit_report(limits: DataFrame, total: DataFrame, bounds: DataFrame, now: str) -> DataFrame:
    """Provider, window, kind, limit, used, percent, reached, resets_at, resets_in, tone; a row for each limit."""
    rows = explode_limits(limits).join(frees_at(total), ["provider", "window"], "left").join(F.broadcast(bounds), "window")
    used = F.coalesce(F.when(F.col("kind") == "tokens", F.col("tokens")).otherwise(F.col("requests")), F.lit(0))
    resets = F.when(F.col("rolling"), F.col("frees_at")).otherwise(F.col("next_start"))
    rows = rows.withColumns({"used": used, "percent": F.round(100 * used / F.col("limit"), 1), "reached": used >= F.col("limit"), "resets_at": resets})
    seconds = (F.unix_micros("resets_at") - F.unix_micros(F.lit(now).cast("timestamp"))) / 1e6
    return rows.select(
        "provider", "window", "window_order", "kind", "kind_order", "limit", "used", "percent", "reached", "resets_at", seconds.alias("resets_in"),
        tone(F.col("percent"), F.col("reached")).alias("tone"),
    )


def rate_headers(headers: Column) -> Column:
    """U8: lower-cased x-ratelimit-* and retry-after headers, values cut to 64 characters."""
    lowered = F.transform_values(F.transform_keys(headers, lambda k, v: F.lower(k)), lambda k, v: F.substring(v, 1, 64))
    return F.map_filter(lowered, lambda k, v: F.startswith(k, F.lit("x-ratelimit-")) | (k == "retry-after"))


def latest_snapshot(replies: DataFrame) -> DataFrame:
    """U8: provider, headers, at of the newest reply that has any rate header. replies(provider, headers, at)."""
    rows = replies.withColumn("headers", rate_headers(F.col("headers"))).where(F.size(F.map_keys("headers")) > 0)
    return rows.groupBy("provider").agg(F.max_by("headers", "at").alias("headers"), F.max("at").alias("at"))


def parse_duration(c: Column) -> Column:
    """Seconds of `1m26.4s`, `450ms`, `1d2h` or a plain number; null for anything else or above 400 days."""
    number = r"[0-9]+(?:\.[0-9]+)?"
    parts = F.regexp_extract_all(c, F.lit(rf"({number}(?:ms|d|h|m|s))"), F.lit(1))
    unit = lambda p: F.regexp_extract(p, "(ms|d|h|m|s)$", 1)
    factor = lambda p: F.element_at(F.create_map(*(F.lit(x) for kv in UNIT_SECONDS.items() for x in kv)), unit(p))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.regexp_extract(p, f"^({number})", 1).cast("double") * factor(p))
    value = F.when(F.rlike(c, F.lit(rf"^{number}\z")), c.try_cast("double")).when(F.rlike(c, F.lit(rf"^(?:{number}(?:ms|d|h|m|s))+\z")), total)
    return F.when(value <= MAX_SECONDS, value)


def bucket_now(snapshots: DataFrame, now: str) -> DataFrame:
    """Provider, kind, limit, remaining, used, percent, full_again_in, age: provider limits as they would be now.

    Between the reply and its reset the used part drains in proportion; past the reset the bucket is full.
    """
    kinds = F.explode(F.array(F.lit("requests"), F.lit("tokens"))).alias("kind")
    head = lambda name: F.try_element_at("headers", F.concat(F.lit(f"x-ratelimit-{name}-"), F.col("kind")))
    whole = lambda c: F.when(F.rlike(c, F.lit(r"^[0-9]+\z")), c.try_cast("long"))
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("at")) / 1e6)
    rows = snapshots.select("provider", "headers", "at", kinds)
    rows = rows.select("provider", "kind", whole(head("limit")).alias("limit"), whole(head("remaining")).alias("left"), parse_duration(head("reset")).alias("reset"), age.alias("age"))
    rows = rows.where("limit > 0 and left is not null").withColumn("left", F.least("left", "limit"))
    drained = F.bround(F.col("left") + (F.col("limit") - F.col("left")) * F.col("age") / F.col("reset")).cast("long")
    remaining = F.when(F.col("reset").isNull(), F.col("left")).when(F.col("age") >= F.col("reset"), F.col("limit")).otherwise(drained)
    rows = rows.withColumn("remaining", remaining).withColumn("used", F.col("limit") - F.col("remaining"))
    full = F.when(F.col("reset").isNotNull(), F.greatest(F.lit(0.0), F.bround(F.col("reset") - F.col("age"), 3)))
    return rows.select("provider", "kind", "limit", "remaining", "used", F.bround(100 * F.col("used") / F.col("limit"), 1).alias("percent"), full.alias("full_again_in"), "age")


def closest_limit(own: DataFrame, provider_rows: DataFrame) -> DataFrame:
    """Provider and the one limit nearest to being reached; own limits first on ties, then windows and kinds in order."""
    a = own.select("provider", F.lit(0).alias("source"), "window", "window_order", "kind", "kind_order", "percent")
    kind = F.when(F.col("kind") == "tokens", 0).otherwise(1)
    b = provider_rows.select("provider", F.lit(1).alias("source"), F.lit(None).cast("string").alias("window"), F.lit(9).alias("window_order"), "kind", kind.alias("kind_order"), "percent")
    order = W.partitionBy("provider").orderBy(F.desc("percent"), "source", "window_order", "kind_order")
    return a.unionByName(b).withColumn("r", F.row_number().over(order)).where("r = 1").select("provider", "source", "window", "kind", "percent")


def thinking_share(calls: DataFrame) -> DataFrame:
    """Provider, calls, thinking_share of thinking and answer tokens at 4 places, null without any."""
    think, answer = F.sum(F.coalesce("thinking_tokens", F.lit(0))), F.sum(F.coalesce("answer_tokens", F.lit(0)))
    rows = calls.groupBy("provider").agg(F.count("*").alias("calls"), think.alias("t"), answer.alias("a"))
    return rows.select("provider", "calls", F.when(F.col("t") + F.col("a") > 0, F.round(F.col("t") / (F.col("t") + F.col("a")), 4)).alias("thinking_share"))


def usage_report(calls: DataFrame, limits: DataFrame, bounds: DataFrame, snapshots: DataFrame, now: str) -> DataFrame:
    """A row for each provider that has limits, calls or a snapshot: origin, limits (rows of U7 in order), provider_reported
    (rows of U10), closest (U11), requests, tokens, estimated_calls and thinking_share of all calls.

    limits(provider, limits, origin) as of U5, snapshots(provider, headers, at) as of U8.
    """
    own = limit_report(limits, totals(calls, bounds), bounds, now)
    told = bucket_now(snapshots, now)
    rows = ["window_order", "kind_order", "window", "kind", "limit", "used", "percent", "reached", "resets_at", "resets_in", "tone"]
    lists = own.groupBy("provider").agg(F.sort_array(F.collect_list(F.struct(*rows))).alias("limits"))
    told_lists = told.groupBy("provider").agg(F.sort_array(F.collect_list(F.struct("kind", "limit", "remaining", "used", "percent", "full_again_in", "age"))).alias("provider_reported"))
    near = closest_limit(own, told).select("provider", F.struct("source", "window", "kind", "percent").alias("closest"))
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("thinking_tokens", F.lit(0)) + F.coalesce("answer_tokens", F.lit(0))
    counts = calls.groupBy("provider").agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"), F.count_if("estimated").alias("estimated_calls"))
    out = limits.select("provider", "origin").join(counts, "provider", "full_outer").join(thinking_share(calls).drop("calls"), "provider", "left")
    for part in (lists, told_lists, near):
        out = out.join(part, "provider", "full_outer")
    return out.fillna(0, ["requests", "tokens", "estimated_calls"]).withColumn("origin", F.coalesce("origin", F.lit("none")))
