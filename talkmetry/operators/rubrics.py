"""Judge scores: parsing, leaderboards, summaries and agreement with preferences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmetry.constants import KEYS, Rubric
from talkmetry.functions.rubric import add_outcome, kept_raw
from talkmetry.functions.stats import wilson_95
from talkmetry.functions.text import backend_label, exact_mean, round_exact


def parse_responses(responses: DataFrame, rubric: Rubric, raw: str = "raw", error: str | None = None) -> DataFrame:
    """Add status, scores, mean_component_score; ``raw`` stays only on a parse error.

    ``error`` names a column that holds a failed call's message; such rows get
    status ``error`` and are not parsed.
    """
    out = add_outcome(responses, raw, rubric)
    status = F.when(F.col("_scores").isNotNull(), F.lit("ok")).otherwise(F.lit("parse_error"))
    if error:
        status = F.when(F.col(error).isNotNull(), F.lit("error")).otherwise(status)
    return out.withColumn("status", status).select(
        *[c for c in responses.columns if c != raw],
        "status",
        F.when(F.col("status") == "ok", F.col("_scores")).alias("scores"),
        F.when(F.col("status") == "ok", F.col("_mean")).alias("mean_component_score"),
        F.when(F.col("status") == "parse_error", kept_raw(F.col(raw))).alias("raw"),
    )


def criterion_scores(parsed: DataFrame) -> DataFrame:
    """One row per scored criterion of the ok responses."""
    ids = [c for c in parsed.columns if c not in ("status", "scores", "mean_component_score", "raw")]
    # Only ok rows have scores. The outer form keeps Catalyst from adding a filter on the
    # parsed map, which would parse every response twice.
    return (
        parsed.select(*ids, F.explode_outer("scores").alias("criterion", "s"))
        .filter(F.col("criterion").isNotNull())
        .select(*ids, "criterion", F.col("s.score").alias("score"), F.col("s.rationale").alias("rationale"))
    )


def comparison_scores(parsed: DataFrame, rubric: Rubric) -> DataFrame:
    """Score of each comparison key: a criterion, or the mean of the components."""
    ids = [c for c in parsed.columns if c not in ("status", "scores", "mean_component_score", "raw")]
    items = F.array(
        *[
            F.struct(
                F.lit(k).alias("comparison_key"),
                (
                    F.col("mean_component_score")
                    if k == "mean_component_score"
                    else F.try_element_at("scores", F.lit(k))["score"].cast("double")
                ).alias("score"),
            )
            for k in rubric.compare
        ]
    )
    kept = parsed.select(*ids, F.explode_outer(F.when(F.col("status") == "ok", items)).alias("c"))
    return kept.filter(F.col("c").isNotNull()).select(*ids, "c.comparison_key", "c.score")


def axis_of(criterion: Column, rubric: Rubric) -> Column:
    """Axis of a criterion as a literal CASE: the map is fixed and tiny."""
    out = F.lit(None).cast("string")
    for axis, keys in rubric.axes.items():
        out = F.when(criterion.isin(*keys), F.lit(axis)).otherwise(out)
    return out


def label_scores(scored: DataFrame, convs: DataFrame) -> DataFrame:
    """Scores with the backend label of their conversation; unmatched ones show ``?``."""
    names = convs.select(*KEYS, "tutor_backend", "student_backend")
    return scored.join(names, list(KEYS), "left").withColumn(
        "label", backend_label(F.col("tutor_backend"), F.col("student_backend"))
    )


def leaderboard(labelled: DataFrame, rubric: Rubric, sort_by: str) -> DataFrame:
    """One row per backend label: criterion means, pooled axis means, n and rank.

    An axis pools the scores of its criteria. ``n`` counts the first criterion of the
    first axis that has any score. Labels without a ``sort_by`` score come last. The
    rank window runs over one row per label.
    """
    score = F.col("score")
    crit = F.col("criterion")
    sums = []
    for k in rubric.keys:
        sums += [
            F.coalesce(F.sum(F.when(crit == k, score)), F.lit(0)).alias(f"_s_{k}"),
            F.count_if(crit == k).alias(f"_n_{k}"),
        ]
    board = labelled.groupBy("label").agg(F.min(F.struct("run", "conv_index")).alias("_seen"), *sums)

    def mean(keys: Sequence[str]) -> Column:
        total = sum((F.col(f"_s_{k}") for k in keys), F.lit(0))
        count = sum((F.col(f"_n_{k}") for k in keys), F.lit(0))
        return round_exact(F.try_divide(total, count), 2)

    n = F.lit(0).cast("long")
    for keys in reversed(list(rubric.axes.values())):
        any_score = sum((F.col(f"_n_{k}") for k in keys), F.lit(0)) > 0
        n = F.when(any_score, F.col(f"_n_{keys[0]}")).otherwise(n)
    exact = F.try_divide(F.col(f"_s_{sort_by}"), F.col(f"_n_{sort_by}"))
    order = Window.orderBy(exact.desc_nulls_last(), F.col("_seen"))
    return board.select(
        F.row_number().over(order).alias("rank"),
        "label",
        F.col("_seen.run").alias("first_run"),
        n.alias("n"),
        *[mean(keys).alias(axis.lower().replace(" ", "_")) for axis, keys in rubric.axes.items()],
        *[mean([k]).alias(k) for k in rubric.keys],
    )


def score_distribution(scored: DataFrame, by: Sequence[str] = ("label", "criterion")) -> DataFrame:
    """How many scores of 0 to 5, zero-filled, with the mean."""
    return scored.groupBy(*by).agg(
        *[F.count_if(F.col("score") == i).alias(f"n{i}") for i in range(6)],
        round_exact(F.sum("score") / F.count("score"), 2).alias("mean"),
    )


def axis_summary(scored: DataFrame, rubric: Rubric, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, sample deviation (0 for one value) and n per axis and criterion.

    Grouping sets give axis rows (``criterion`` null) and criterion rows in one pass.
    """
    rows = scored.withColumn("axis", axis_of(F.col("criterion"), rubric))
    per_axis = [F.col(c) for c in (*by, "axis")]
    per_criterion = [*per_axis, F.col("criterion")]
    return rows.groupingSets([per_axis, per_criterion], *per_criterion).agg(
        F.count("score").alias("n"),
        F.round(F.avg("score"), 6).alias("mean"),
        F.median("score").alias("median"),
        F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("sd"),
    )


def judge_run_summary(parsed: DataFrame, rubric: Rubric) -> DataFrame:
    """Per (run, judge_model): ok count and mean of each criterion, ok rows only."""
    ok = F.col("status") == "ok"

    def mean(value: Column) -> Column:
        return exact_mean(F.when(ok, value), 3)

    return parsed.groupBy("run", "judge_model").agg(
        F.count_if(ok).alias("n_ok"),
        *[mean(F.try_element_at("scores", F.lit(k))["score"]).alias(k) for k in rubric.keys],
        mean(F.col("mean_component_score")).alias("mean_component_score"),
    )


def judge_matrix(parsed: DataFrame, rubric: Rubric, models: Sequence[str]) -> DataFrame:
    """Per run: one row per criterion, then the mean component and the ok count, with one
    column per judge model. The models are given, so the pivot needs no extra job."""
    summary = judge_sums(parsed, rubric)
    return (
        summary.groupBy("run", "criterion")
        .pivot("judge_model", list(models))
        .agg(F.first("value"))
    )


def judge_sums(parsed: DataFrame, rubric: Rubric) -> DataFrame:
    """(run, judge_model, criterion, value) including the two summary rows."""
    items = [
        F.struct(F.lit(k).alias("criterion"), F.try_element_at("scores", F.lit(k))["score"].cast("double").alias("v"))
        for k in rubric.keys
    ] + [
        F.struct(F.lit("MEAN COMPONENT").alias("criterion"), F.col("mean_component_score").alias("v")),
        F.struct(F.lit("n (ok convs)").alias("criterion"), F.lit(1.0).alias("v")),
    ]
    kept = F.explode_outer(F.when(F.col("status") == "ok", F.array(*items)))
    rows = parsed.select("run", "judge_model", kept.alias("i")).filter(F.col("i.v").isNotNull())
    return rows.groupBy("run", "judge_model", F.col("i.criterion").alias("criterion")).agg(
        F.when(F.first("i.criterion") == "n (ok convs)", F.sum("i.v"))
        .otherwise(exact_mean(F.col("i.v"), 2))
        .alias("value")
    )


PAIR_KEYS = ("split", "row_idx", "rubric", "judge_model", "comparison_key")


def pair_verdicts(sides: DataFrame) -> DataFrame:
    """Score of both sides of each pair, their margin and the verdict.

    ``sides``: split, row_idx, side (pos/neg), rubric, judge_model, comparison_key, score.
    A conditional aggregate puts the sides side by side: one shuffle and no self-join.
    """
    both = sides.groupBy(*PAIR_KEYS).agg(
        F.max(F.when(F.col("side") == "pos", F.col("score"))).alias("score_pos"),
        F.max(F.when(F.col("side") == "neg", F.col("score"))).alias("score_neg"),
    )
    margin = F.col("score_pos") - F.col("score_neg")
    verdict = (
        F.when(margin > 0, F.lit("correct")).when(margin == 0, F.lit("tie")).otherwise(F.lit("wrong"))
    )
    return both.filter(F.col("score_pos").isNotNull() & F.col("score_neg").isNotNull()).select(
        "*", margin.alias("margin"), verdict.alias("verdict")
    )


def agreement(verdicts: DataFrame) -> DataFrame:
    """Accuracy with ties as half, Wilson interval, tie rate and mean margin."""
    out = verdicts.groupBy("split", "judge_model", "rubric", "comparison_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "correct").alias("_c"),
        F.count_if(F.col("verdict") == "tie").alias("_t"),
        F.sum("margin").alias("_m"),
    )
    n = F.col("n")
    k = F.col("_c") + 0.5 * F.col("_t")
    low, high = wilson_95(k, n)
    return out.select(
        "split",
        "n",
        "judge_model",
        "rubric",
        "comparison_key",
        round_exact(k / n, 4).alias("accuracy"),
        round_exact(low, 4).alias("ci_low"),
        round_exact(high, 4).alias("ci_high"),
        round_exact(F.col("_t") / n, 4).alias("tie_rate"),
        round_exact(F.col("_m") / n, 4).alias("mean_margin"),
    )
