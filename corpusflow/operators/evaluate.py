"""Scoring of retrieval experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.operators.budget import fit_to_budget, squeeze_budget

# Rules that were set before the runs.
TIE, SWITCH_MIN, SWITCH_BUDGET = 2, 3, 4000
FLOOR_GAP, FLOOR_STEP = 0.05, 0.01
GATE_SHARE, GATE_MISSES = 0.85, 3
HOLDOUT_LOSS = 3
SPEEDUP, FULL_SECONDS = 2, 120
#: The rank of a miss where ranks are compared.
MISS = 1 << 30


def validate_questions(questions: DataFrame, repos: DataFrame) -> DataFrame:
    """Id, rule of questions that break one: unique ids, known repo, kind and split, text, answers as the kind asks."""
    n = F.count("*").over(W.partitionBy("id"))
    known = repos.select(F.col("repo"), F.lit(True).alias("known"))
    rows = questions.withColumn("n", n).join(F.broadcast(known), "repo", "left")
    size = F.coalesce(F.size("expect"), F.lit(0))
    rules = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, "unique"),
            F.when(F.col("known").isNull(), "repo"),
            F.when(~F.coalesce(F.col("split").isin("tune", "holdout"), F.lit(False)), "split"),
            F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "text"),
            F.when((F.col("kind") == "negative") & (size > 0), "negative_with_answer"),
            F.when((F.col("kind") != "negative") & (size == 0), "no_answer"),
            F.when(F.exists(F.coalesce("expect", F.array().cast("array<struct<path:string,symbol:string>>")), lambda e: e["path"].isNull() | (e["path"] == "")), "path"),
        )
    )
    return rows.select("id", F.explode(rules).alias("rule"))


def matches(symbol: Column, parent: Column, names: Column, wanted: Column) -> Column:
    """R2: whole names: no symbol asked for, the symbol, Parent.symbol, or one of the names."""
    qualified = F.concat(parent, F.lit("."), symbol)
    return wanted.isNull() | F.coalesce(symbol == wanted, F.lit(False)) | F.coalesce(qualified == wanted, F.lit(False)) | F.coalesce(F.array_contains(names, wanted), F.lit(False))


def rank_of(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, rank: the first hit (pos from 1) that any expected entry matches, null without one."""
    wanted = questions.select(F.col("id").alias("question_id"), F.explode("expect").alias("e")).select("question_id", F.col("e.path").alias("path"), F.col("e.symbol").alias("wanted"))
    found = hits.join(wanted, ["question_id", "path"]).where(matches(F.col("symbol"), F.col("parent"), F.col("names"), F.col("wanted")))
    best = found.groupBy("question_id").agg(F.min("pos").alias("rank"))
    return questions.select(F.col("id").alias("question_id")).join(best, "question_id", "left")


def in_context(questions: DataFrame, shown: DataFrame) -> DataFrame:
    """question_id, found: whether a passage that was shown answers it."""
    return rank_of(questions, shown).select("question_id", F.col("rank").isNotNull().alias("found"))


def score_questions(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, repo, kind, split, rank, top1, top3, top10; negatives aren't counted, unasked questions ignored."""
    asked = questions.join(hits.select(F.col("question_id").alias("id")).distinct(), "id", "left_semi").where("kind != 'negative'")
    rows = rank_of(asked, hits).join(asked.select(F.col("id").alias("question_id"), "repo", "kind", "split"), "question_id")
    return rows.withColumns({f"top{n}": F.coalesce(F.col("rank") <= n, F.lit(False)) for n in (1, 3, 10)})


def hit_rates(scores: DataFrame) -> DataFrame:
    """Split, kind (null: all), n, top1, top3, top10 rates, misses (sorted ids)."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return scores.rollup("split", "kind").agg(
        F.count("*").alias("n"), rate("top1").alias("top1"), rate("top3").alias("top3"), rate("top10").alias("top10"),
        F.sort_array(F.collect_list(F.when(F.col("rank").isNull(), F.col("question_id")))).alias("misses"),
    )


def change(before: Column, after: Column) -> Column:
    """Better, worse or same; a miss (null) is worst."""
    a, b = F.coalesce(before, F.lit(1 << 30)), F.coalesce(after, F.lit(1 << 30))
    return F.when(b < a, "better").when(b > a, "worse").otherwise("same")


def verdict(better: Column, worse: Column) -> Column:
    return F.when(F.abs(better - worse) <= TIE, "tie").when(better > worse, "better").otherwise("worse")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: better, worse, same, verdict of run b against run a; both (question_id, rank) over the same questions."""
    if not a.join(b, "question_id", "left_anti").isEmpty() or not b.join(a, "question_id", "left_anti").isEmpty():
        raise ValueError("the runs don't have the same questions")
    both = a.select("question_id", F.col("rank").alias("ra")).join(b.select("question_id", F.col("rank").alias("rb")), "question_id")
    counts = both.select(change(F.col("ra"), F.col("rb")).alias("c")).agg(*(F.count_if(F.col("c") == n).alias(n) for n in ("better", "worse", "same")))
    return counts.withColumn("verdict", verdict(F.col("better"), F.col("worse")))


def replay(pool: DataFrame, policies: DataFrame, k: int = 10) -> DataFrame:
    """Policy, question_id, id, rank of pool(question_id, pos, id, score, is_test, is_changelog, wants_tests,
    wants_changelog) under each of policies(policy, kind, amount).

    kind: none, hide, hide_gated, multiply, demote, demote_ungated; gated ones spare what the question asks for. The
    policies are a handful of parameters and broadcast; one ranking serves all of them.
    """
    rows = pool.crossJoin(F.broadcast(policies))
    gated = ~F.col("kind").isin("hide", "demote_ungated")
    test = F.col("is_test") & ~(gated & F.col("wants_tests"))
    log = F.col("is_changelog") & ~(gated & F.col("wants_changelog"))
    hit = test | log
    loss = F.greatest(F.when(test, F.col("amount")).otherwise(0.0), F.when(log, 2 * F.col("amount")).otherwise(0.0))
    score = (
        F.when(F.col("kind") == "multiply", F.when(hit, F.col("score") * F.col("amount")).otherwise(F.col("score")))
        .when(F.col("kind").startswith("demote"), F.col("score") - loss)
        .otherwise(F.col("score"))
    )
    kept = rows.where(~(F.col("kind").startswith("hide") & hit)).withColumn("adjusted", F.round(score, 9))
    order = W.partitionBy("policy", "question_id").orderBy(F.desc("adjusted"), "pos")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("policy", "question_id", "id", "adjusted", "rank")


def first_of_passage(entries: DataFrame, k: int = 10) -> DataFrame:
    """question_id, passage_key, rank, cost: distinct passages among the first k, with the cost of their first member."""
    rows = entries.where(F.col("pos") <= k).groupBy("question_id", "passage_key").agg(F.min("pos").alias("rank"), F.min_by("cost", "pos").alias("cost"))
    return rows


def simulate_context(entries: DataFrame, budget: int, rule: str = "prefix", k: int = 10) -> DataFrame:
    """question_id, found: whether a kept passage answers, of entries(question_id, pos, passage_key, cost, good).

    Passages are the distinct keys among the first k entries; one answers if any of those entries does. prefix: the first that
    doesn't fit ends the list; squeeze: it is skipped. The first passage always stays.
    """
    if rule not in ("prefix", "squeeze"):
        raise ValueError(f"unknown budget rule {rule!r}")
    own = first_of_passage(entries, k)
    kept = (fit_to_budget(own, budget) if rule == "prefix" else squeeze_budget(own, budget)).select("question_id", "rank", "kept")
    good = entries.where(F.col("pos") <= k).groupBy("question_id", "passage_key").agg(F.max("good").alias("good"))
    both = own.join(kept, ["question_id", "rank"]).join(good, ["question_id", "passage_key"])
    return both.groupBy("question_id").agg(F.max(F.col("kept") & F.col("good")).alias("found"))


def agreement(simulated: DataFrame, recorded: DataFrame) -> DataFrame:
    """Questions, agree of two (question_id, found) tables."""
    both = simulated.select("question_id", F.col("found").alias("a")).join(recorded.select("question_id", F.col("found").alias("b")), "question_id")
    return both.agg(F.count("*").alias("questions"), F.count_if(F.col("a") == F.col("b")).alias("agree"))


def policy_table(ranks: DataFrame, base: str = "none") -> DataFrame:
    """Policy, top1, top3, top10, better, worse, same, verdict, tests_worse of ranks(policy, question_id, kind, rank)."""
    start = ranks.where(F.col("policy") == base).select("question_id", F.col("rank").alias("r0"))
    rows = ranks.join(start, "question_id").withColumn("c", change(F.col("r0"), F.col("rank")))
    tops = [F.count_if(F.coalesce(F.col("rank") <= n, F.lit(False))).alias(f"top{n}") for n in (1, 3, 10)]
    counts = [F.count_if(F.col("c") == n).alias(n) for n in ("better", "worse", "same")]
    worse_tests = F.count_if((F.col("c") == "worse") & (F.col("kind") == "tests")) > 0
    out = rows.groupBy("policy").agg(*tops, *counts, worse_tests.alias("tests_worse"))
    return out.withColumn("verdict", verdict(F.col("better"), F.col("worse")))


def budget_table(found: DataFrame) -> DataFrame:
    """Budget, questions, prefix, squeeze, recovered, switch of found(budget, question_id, prefix, squeeze)."""
    out = found.groupBy("budget").agg(
        F.count("*").alias("questions"), F.count_if("prefix").alias("prefix"), F.count_if("squeeze").alias("squeeze"), F.count_if(F.col("squeeze") & ~F.col("prefix")).alias("recovered")
    )
    return out.withColumn("switch", (F.col("recovered") >= SWITCH_MIN) & (F.col("budget") >= SWITCH_BUDGET))


def floor_stats(questions: DataFrame) -> DataFrame:
    """Repo (null: all), w, n, a10, gap: questions(question_id, repo, kind, rank, answer_score, best_score).

    w: the smallest score of an answer in the top 3; n: the best score of any negative; a10: the smallest in the top 10.
    """
    counted = F.col("kind") != "negative"
    out = questions.groupingSets([["repo"], []], "repo").agg(
        F.min(F.when(counted & (F.col("rank") <= 3), F.col("answer_score"))).alias("w"),
        F.max(F.when(~counted, F.col("best_score"))).alias("n"),
        F.min(F.when(counted & (F.col("rank") <= 10), F.col("answer_score"))).alias("a10"),
    )
    return out.withColumn("gap", F.round(F.col("w") - F.col("n"), 9))


def floor_proposal(stats: DataFrame) -> DataFrame:
    """Floor: halfway between n and w, down to a hundredth, where the gap is wide enough and no top-10 answer is lost."""
    middle = F.floor(F.round((F.col("n") + F.col("w")) / 2 / FLOOR_STEP, 9)) * FLOOR_STEP
    ok = (F.col("gap") >= FLOOR_GAP) & (F.round(F.col("a10"), 9) >= F.round(middle, 9))
    return stats.where("repo is null").select("w", "n", "a10", "gap", F.when(ok, F.round(middle, 2)).alias("floor"))


def floor_simulation(hits: DataFrame, questions: DataFrame, grid: DataFrame) -> DataFrame:
    """Rule, value, answers_lost, negatives_silenced, mean_kept for grid(rule: floor or margin, value).

    hits(question_id, pos, score), questions(question_id, kind, rank). The grid is a handful of parameters.
    """
    best = W.partitionBy("question_id")
    rows = hits.withColumn("best", F.max("score").over(best)).crossJoin(F.broadcast(grid))
    limit = F.when(F.col("rule") == "floor", F.col("value")).otherwise(F.col("best") - F.col("value"))
    rows = rows.withColumn("kept", F.round("score", 9) >= F.round(limit, 9)).join(questions, "question_id")
    counted = F.col("kind") != "negative"
    per = rows.groupBy("rule", "value", "question_id").agg(
        F.max(counted).alias("counted"), F.count_if("kept").alias("kept"), F.count_if((F.col("pos") == F.col("rank")) & ~F.col("kept")).alias("lost")
    )
    return per.groupBy("rule", "value").agg(
        F.sum("lost").alias("answers_lost"), F.count_if(~F.col("counted") & (F.col("kept") == 0)).alias("negatives_silenced"), F.avg(F.when(F.col("counted"), F.col("kept"))).alias("mean_kept")
    )


def label_misses(ranks: DataFrame) -> DataFrame:
    """question_id, cause of ranks(question_id, pool_rank, found): why an answer isn't in the context."""
    cause = (
        F.when(F.col("found"), "in_context")
        .when(F.col("pool_rank").isNull(), "not_retrieved")
        .when(F.col("pool_rank") <= 3, "top3_not_shown")
        .when(F.col("pool_rank") <= 10, "rank_4_10")
        .otherwise("rank_11_30")
    )
    return ranks.select("question_id", cause.alias("cause"))


def gate(causes: DataFrame) -> DataFrame:
    """N, found, not_retrieved, target, passed: fails only below the target with several that weren't retrieved."""
    out = causes.agg(F.count("*").alias("n"), F.count_if(F.col("cause") == "in_context").alias("found"), F.count_if(F.col("cause") == "not_retrieved").alias("not_retrieved"))
    target = F.ceil(GATE_SHARE * F.col("n") - 1e-9)
    return out.withColumn("target", target).withColumn("passed", ~((F.col("found") < target) & (F.col("not_retrieved") >= GATE_MISSES)))


def only_final(runs: DataFrame) -> DataFrame:
    """Rows that may be reported: holdout ones only from runs flagged final."""
    return runs.where((F.col("split") != "holdout") | F.col("final"))


def stage_summary(stages: DataFrame) -> DataFrame:
    """Stage, split, n, top1, top3, top10, in_context of stages(stage, split, rank, found)."""
    tops = [F.count_if(F.coalesce(F.col("rank") <= n, F.lit(False))).alias(f"top{n}") for n in (1, 3, 10)]
    return stages.groupBy("stage", "split").agg(F.count("*").alias("n"), *tops, F.count_if("found").alias("in_context"))


def rank_grid(stages: DataFrame, names: list[str], causes: DataFrame | None = None) -> DataFrame:
    """question_id and a column for each stage: the rank (`miss` without one), `*` after it when in context, `-` where the
    stage doesn't have the question; with causes(question_id, cause) the cause of those that the last stage misses in context."""
    cell = F.concat(F.coalesce(F.col("rank").cast("string"), F.lit("miss")), F.when(F.col("found"), "*").otherwise(""))
    out = stages.withColumn("cell", cell).groupBy("question_id").pivot("stage", names).agg(F.first("cell")).fillna("-", names)
    if causes is None:
        return out
    seen = F.col(names[-1]).endswith("*")
    return out.join(causes.select("question_id", "cause"), "question_id", "left").withColumn("cause", F.when(~seen, F.coalesce("cause", F.lit("no pool saved"))))


def holdout_verdict(off: DataFrame, on: DataFrame, final: bool) -> DataFrame:
    """Gain (of holdout answers in the first three, on less off), tests_lower, verdict (bad, ok) of two
    (question_id, split, kind, rank) tables, with demotion off and on. Refused unless the run is final.

    bad: three answers fewer, or a question about tests that ranks lower.
    """
    if not final:
        raise ValueError("the holdout is for final runs only")
    a = off.where("split = 'holdout'").select("question_id", "kind", F.coalesce("rank", F.lit(MISS)).alias("r0"))
    rows = a.join(on.select("question_id", F.coalesce("rank", F.lit(MISS)).alias("r1")), "question_id")
    out = rows.agg(
        (F.count_if(F.col("r1") <= 3) - F.count_if(F.col("r0") <= 3)).alias("gain"), F.count_if((F.col("kind") == "tests") & (F.col("r1") > F.col("r0"))).alias("tests_lower")
    )
    return out.withColumn("verdict", F.when((F.col("gain") <= -HOLDOUT_LOSS) | (F.col("tests_lower") > 0), "bad").otherwise("ok"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Repo, queries, median_ms, max_ms, rest_ms (median of the total less the known stages, not below 0)."""
    known = F.aggregate(F.map_values(F.map_filter("stages", lambda k, v: k != "total")), F.lit(0.0), lambda a, v: a + v)
    rest = F.greatest(F.lit(0.0), F.col("total_ms") - known)
    return timings.groupBy("repo").agg(F.count("*").alias("queries"), F.percentile("total_ms", 0.5).alias("median_ms"), F.max("total_ms").alias("max_ms"), F.percentile(rest, 0.5).alias("rest_ms"))


def batching_decision(runs: DataFrame, total_chunks: int) -> DataFrame:
    """per_file, cross_file (medians in ms a chunk), speedup, seconds (of a full index, per file), decision (build, skip) of
    runs(mode, seconds, chunks). Built only if it is SPEEDUP times as fast and a full index takes more than FULL_SECONDS."""
    ms = F.col("seconds") * 1000 / F.col("chunks")
    out = runs.agg(*(F.percentile(F.when(F.col("mode") == m, ms), 0.5).alias(m) for m in ("per_file", "cross_file")))
    out = out.withColumn("speedup", F.col("per_file") / F.col("cross_file")).withColumn("seconds", F.col("per_file") * total_chunks / 1000)
    return out.withColumn("decision", F.when((F.col("speedup") >= SPEEDUP) & (F.col("seconds") > FULL_SECONDS), "build").otherwise("skip"))
