"""Connected components over a table of edges, by rounds of grouping and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import dropped, written


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round: each node ties its larger (large) or smaller neighbours to the smallest one it knows.

    The smallest neighbour comes from an aggregate and is joined back, so that a node with very many neighbours is folded
    before it moves and its rows can be split over tasks.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return tied.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of edges(u, v). Loops (u = v) are left out.

    Large and small stars alternate until the edges no longer change; each round is a written table.
    """
    now = written(edges.where("u != v").select("u", "v").distinct(), "stars")
    before = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = size
        nxt = written(stars(stars(now, True).distinct(), False).distinct(), "stars")
        dropped(now)
        now = nxt
