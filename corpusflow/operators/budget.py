"""Token budgets over ranked passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PASSAGE_OVERHEAD = 24


def fit_to_budget(passages: DataFrame, max_tokens: int | Column) -> DataFrame:
    """P10: used (running cost), kept, over_budget. The longest prefix in rank order that fits; the first always stays."""
    upto = F.sum("cost").over(W.partitionBy("question_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = passages.withColumn("used", upto)
    first = F.col("rank") == F.min("rank").over(W.partitionBy("question_id"))
    return rows.withColumn("kept", (F.col("used") <= max_tokens) | first).withColumn("over_budget", first & (F.col("used") > max_tokens))


def squeeze_budget(passages: DataFrame, max_tokens: int) -> DataFrame:
    """question_id, rank, cost, kept: a passage that doesn't fit is skipped and the next one tried; the first stays.

    The choice depends on all earlier ones, so it is a fold over the question's ordered passages, inside Catalyst.
    """
    item = F.struct(F.col("rank").cast("long").alias("rank"), F.col("cost").cast("long").alias("cost"))
    lists = passages.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc: Column, it: Column) -> Column:
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + it["cost"] <= max_tokens)
        return F.struct((acc["used"] + F.when(fits, it["cost"]).otherwise(0)).alias("used"), F.concat(acc["kept"], F.array(fits)).alias("kept"))

    kept = lists.select("question_id", "items", F.aggregate("items", zero, step)["kept"].alias("kept"))
    rows = kept.select("question_id", F.explode(F.arrays_zip("items", "kept")).alias("r"))
    return rows.select("question_id", F.col("r.items.rank").alias("rank"), F.col("r.items.cost").alias("cost"), F.col("r.kept").alias("kept"))


def compress_ranges(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Keys, ranges: the distinct numbers of each key as "14-16, 30"."""
    each = rows.select(*keys, number).distinct()
    island = F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number))
    runs = each.withColumn("island", island).groupBy(*keys, "island").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    one = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    lists = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", one.alias("t")))).alias("ts"))
    return lists.select(*keys, F.array_join(F.transform("ts", lambda t: t["t"]), ", ").alias("ranges"))
