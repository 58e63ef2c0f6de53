"""Streaming forms (M1 to M4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from corpusflow.operators import usage
from corpusflow.session import written
from corpusflow.sources import store

IDLE_MS = 300_000


def stream_ingest(source: DataFrame, index: str, checkpoint: str, key: list[str], build: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None) -> StreamingQuery:
    """M1: each micro-batch of source becomes a version of an incremental index: of its documents (by key) the rows are those of
    build(batch, the documents' rows until now or None), by default the batch's own.

    Only those documents are written. The version is the batch's number, so a replayed batch changes nothing; one checkpoint
    is one writer.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in store.versions(spark, index):
            return
        batch = written(batch, "stream-batch")
        documents = batch.select(*key).distinct()
        if build:
            now = store.read_index(spark, index)
            batch = build(batch, now if now is None else now.join(documents, key, "left_semi"))
        store.publish(batch, documents, index, number, key)
        store.forget(spark, index)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(calls: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """provider, window, requests, tokens by event time."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("thinking_tokens", F.lit(0)) + F.coalesce("answer_tokens", F.lit(0))
    window = F.window("at", length, slide) if slide else F.window("at", length)
    return calls.groupBy("provider", window).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))


def stream_usage(calls: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """M2: usage_windows of a stream; rows later than the watermark are dropped, keep_late() and recounted() make up for them."""
    return usage_windows(calls.withWatermark("at", late), length, slide)


def keep_late(calls: DataFrame, path: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """M2: the side table path/rows of rows that are later than `late` behind the newest of their micro-batch and those before.

    path/marks has each batch's newest time. Both are written by batch number, so a replayed batch writes the same again. If
    both queries read the source in the same order, no row that a watermark drops is missing here.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = written(batch, "late-batch")
        batch.agg(F.max("at").alias("at")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        marks = spark.read.schema("at timestamp, batch long").option("basePath", f"{path}/marks").parquet(f"{path}/marks")
        newest = marks.where(F.col("batch") <= number).agg(F.max("at")).first()[0]
        old = batch.where(F.col("at") < F.lit(newest) - F.expr(f"interval {late}"))
        old.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return calls.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recounted(streamed: DataFrame, late: DataFrame, calls: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """M2: streamed windows, with those that late rows fall in counted anew over all calls."""
    touched = usage_windows(late, length, slide).select("provider", "window")
    again = usage_windows(calls, length, slide).join(touched, ["provider", "window"], "left_semi")
    return streamed.join(touched, ["provider", "window"], "left_anti").select("provider", "window", "requests", "tokens").unionByName(again)


def stream_latest(replies: DataFrame) -> DataFrame:
    """M3: the latest rate headers of each provider, for update mode."""
    rows = replies.withColumn("headers", usage.rate_headers(F.col("headers"))).where(F.size(F.map_keys("headers")) > 0)
    return rows.groupBy("provider").agg(F.max_by("headers", "at").alias("headers"), F.max("at").alias("at"))


class AnswerStream(StatefulProcessor):
    """M4: the text of a stream so far; a terminal event, or IDLE_MS of event time without one, ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", "text string, seq long, events long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, last, n, at = self.state.get() if self.state.exists() else ("", -1, 0, 0)
        outcome = None
        for batch in rows:
            for seq, kind, piece, ms in batch.sort_values("seq")[["seq", "type", "text", "ms"]].itertuples(index=False):
                if seq <= last:
                    continue  # a replayed line
                last, n, at = int(seq), n + 1, max(at, int(ms))
                if kind == "delta":
                    text += piece or ""
                elif kind in ("done", "error") and outcome is None:
                    outcome = "done" if kind == "done" else "failed"
        if outcome:
            self.drop_timers()
            self.state.clear()
            yield self.result(key, text, n, outcome)
        else:
            self.state.update((text, last, n, at))
            self.drop_timers()
            self.handle.registerTimer(max(at + IDLE_MS, timerValues.getCurrentWatermarkInMs() + 1))

    def drop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            text, _, n, _ = self.state.get()
            self.state.clear()
            yield self.result(key, text, n, "stopped")

    def result(self, key, text: str, n: int, outcome: str) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [key[0]], "text": [text], "events": [n], "outcome": [outcome]})

    def close(self) -> None:
        pass


def stream_answers(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """M4: stream_id, text, events, outcome of events(stream_id, seq, type, text, at). Needs the RocksDB state store.

    Timers are of event time: a stream is `stopped` when the watermark is IDLE_MS past its last event. So a run over what is
    there ends all streams but those within IDLE_MS and `late` of the newest event; a later event of any stream (one that only
    keeps time) ends these, too. The table has the outcomes of streams that ended.
    """
    timed = events.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return timed.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=AnswerStream(), outputStructType="stream_id string, text string, events long, outcome string", outputMode="Append", timeMode="EventTime"
    )


def file_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
