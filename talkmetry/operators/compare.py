"""Comparison of systems on per-conversation scores.

Long input everywhere: ``run, conv_index, <family columns>, score``. A family
(channel and axis, or a label) is a column of the group key, so all families of a
table run in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from talkmetry.constants import AXES, FRAME_LABELS, KEYS
from talkmetry.functions.stats import ci95_half, two_sided_normal_p
from talkmetry.operators.ordered import Scan, scan

FAMILY = ("channel", "axis")
EXACT_MAX_N = 50


def means_ci(scores: DataFrame, by: Sequence[str], value: str = "score", mean: str = "mean", digits: int = 6) -> DataFrame:
    """n, mean, half width and bounds of the 95 % t interval; nulls do not count."""
    out = scores.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd")
    )
    half = ci95_half(F.col("_sd"), F.col("n"))
    return out.select(
        *by,
        "n",
        F.round("_m", digits).alias(mean),
        F.round(half, digits).alias("ci_half"),
        F.round(F.col("_m") - half, digits).alias("lo"),
        F.round(F.col("_m") + half, digits).alias("hi"),
    )


def label_percentages(frames: DataFrame) -> DataFrame:
    """Share (%) of each frame label per conversation; unknown without frames.

    ``frames``: run, conv_index, label. Labels outside the five count as frames only.
    """
    counts = frames.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_frames"),
        *[F.count_if(F.col("label") == x).alias(x) for x in FRAME_LABELS],
    )
    items = F.array(
        *[
            F.struct(F.lit(x).alias("label"), F.try_divide(100.0 * F.col(x), F.col("n_frames")).alias("pct"))
            for x in FRAME_LABELS
        ]
    )
    return counts.select(*KEYS, "n_frames", F.explode(items).alias("i")).select(*KEYS, "n_frames", "i.label", "i.pct")


def label_shares(frames: DataFrame) -> DataFrame:
    """Mean share of each label per run with its interval."""
    return means_ci(label_percentages(frames), ["run", "label"], "pct", "mean_pct")


def label_matrix(shares: DataFrame) -> DataFrame:
    """Runs by labels, in the fixed label order."""
    return shares.groupBy("run").agg(
        *[F.max(F.when(F.col("label") == x, F.col("mean_pct"))).alias(x) for x in FRAME_LABELS]
    )


def axis_correlations(scores: DataFrame, channel: str = "mixed", axes: Sequence[str] = AXES) -> DataFrame:
    """Pearson correlation of every axis pair per run, pairwise complete.

    The axes are few and fixed: one pass lays them side by side, one pass correlates.
    """
    wide = (
        scores.filter(F.col("channel") == channel)
        .groupBy(*KEYS)
        .agg(*[F.max(F.when(F.col("axis") == a, F.col("score"))).alias(a) for a in axes])
    )
    pairs = [(a, b) for a in axes for b in axes]
    out = wide.groupBy("run").agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    items = F.array(
        *[
            F.struct(F.lit(a).alias("axis_a"), F.lit(b).alias("axis_b"), F.round(f"{a}_{b}", 6).alias("r"))
            for a, b in pairs
        ]
    )
    return out.select("run", F.explode(items).alias("i")).select("run", "i.*")


def role_gap(scores: DataFrame, axis: str = "PQ") -> DataFrame:
    """Tutor mean, student mean and their difference per run."""
    t = F.avg(F.when(F.col("channel") == "tutor", F.col("score")))
    s = F.avg(F.when(F.col("channel") == "student", F.col("score")))
    return (
        scores.filter(F.col("axis") == axis)
        .groupBy("run")
        .agg(
            F.round(t, 6).alias("tutor"),
            F.round(s, 6).alias("student"),
            F.round(t - s, 6).alias("delta_tutor_minus_student"),
        )
    )


def quality_and_labels(quality_wide: DataFrame, labels_wide: DataFrame) -> DataFrame:
    """Everything known about a conversation from either side."""
    return quality_wide.join(labels_wide, list(KEYS), "full_outer")


# --- paired tests ----------------------------------------------------------------
def paired_differences(scores: DataFrame, family: Sequence[str] = FAMILY) -> DataFrame:
    """Score difference of every system pair on the conversations both have.

    Pairs follow run-name order (or ``ord`` where the input has one). The join key is
    (conversation, family): each key holds one row per system.
    """
    order = "ord" if "ord" in scores.columns else "run"
    rows = scores.filter(F.col("score").isNotNull())
    a = rows.select(*family, "conv_index", F.col("run").alias("system_a"), F.col(order).alias("_oa"), F.col("score").alias("_sa"))
    b = rows.select(*family, "conv_index", F.col("run").alias("system_b"), F.col(order).alias("_ob"), F.col("score").alias("_sb"))
    return (
        a.join(b, [*family, "conv_index"])
        .filter(F.col("_oa") < F.col("_ob"))
        .select(*family, "system_a", "system_b", "conv_index", (F.col("_sa") - F.col("_sb")).alias("d"))
    )


def signed_rank_sums(diffs: DataFrame, family: Sequence[str] = FAMILY, limit: int | None = None) -> DataFrame:
    """W+, W-, counts and the tie term of the signed-rank test per family and pair.

    Equal |d| are first counted together, map-side. A value's average rank is the number
    of values below it plus half its own count (+ 1/2), so ranking is a running sum over
    the distinct values, cut into value blocks where a pair has very many.
    """
    pair = [*family, "system_a", "system_b"]
    values = (
        diffs.groupBy(*pair, F.abs("d").alias("a"))
        .agg(F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") < 0).alias("neg"), F.count(F.lit(1)).alias("c"))
    )
    nonzero = values.filter(F.col("a") > 0).withColumn("t", F.col("pos") + F.col("neg"))
    ranked = scan(nonzero, pair, ["a"], Scan(sum_before={"below": "t"}), limit)
    rank = F.col("below") + (F.col("t") + 1) / 2.0
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*pair).agg(
        F.sum(F.col("pos") * rank).alias("w_plus"),
        F.sum(F.col("neg") * rank).alias("w_minus"),
        F.sum("t").alias("n_nonzero"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    totals = values.groupBy(*pair).agg(
        F.sum("c").alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("a") == 0, F.col("c"))), F.lit(0)).alias("n_zero")
    )
    return totals.join(sums, pair, "left")


def _signed_rank_exact(n: int) -> np.ndarray:
    """Cumulative null distribution of W+ for n untied differences (small n)."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[: len(ways) - k]
    return np.cumsum(ways) / 2.0**n


@F.pandas_udf(DoubleType())
def exact_p(w: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of min(W+, W-); runs on one row per system pair."""
    tables: dict[int, np.ndarray] = {}
    out = []
    for stat, size in zip(w, n):
        if pd.isna(stat) or pd.isna(size) or size > EXACT_MAX_N:
            out.append(None)
            continue
        cdf = tables.setdefault(int(size), _signed_rank_exact(int(size)))
        out.append(min(1.0, 2.0 * float(cdf[int(stat)])))
    return pd.Series(out, dtype="float64")


def paired_wilcoxon(
    scores: DataFrame,
    family: Sequence[str] = FAMILY,
    method: str = "auto",
    limit: int | None = None,
    digits: int | None = 6,
) -> DataFrame:
    """Two-sided paired signed-rank test of every system pair, Holm-adjusted per family.

    Zero differences count in ``n_pairs`` but are not ranked. Below two pairs there is no
    test; if all differences are zero p = 1. ``auto`` takes the exact distribution for at
    most 50 differences without ties or zeros, else the normal approximation with tie
    correction.
    """
    order = "ord" if "ord" in scores.columns else "run"
    pair = [*family, "system_a", "system_b"]
    runs = scores.select(*family, "run", F.col(order).alias("_o")).distinct()
    # One row per system and family: the grid is as small as the number of systems.
    grid = (
        runs.select(*family, F.col("run").alias("system_a"), F.col("_o").alias("_oa"))
        .join(runs.select(*family, F.col("run").alias("system_b"), F.col("_o").alias("_ob")), list(family))
        .filter(F.col("_oa") < F.col("_ob"))
        .drop("_oa", "_ob")
    )
    sums = signed_rank_sums(paired_differences(scores, family), family, limit)
    t = grid.join(sums, pair, "left").fillna(0, ["n_pairs", "n_zero"])
    n = F.col("n_nonzero").cast("double")
    w = F.least(F.col("w_plus"), F.col("w_minus"))
    testable = F.col("n_pairs") >= 2
    all_zero = testable & F.col("n_nonzero").isNull()
    variance = (n * (n + 1) * (2 * n + 1) - 0.5 * F.col("tie_term")) / 24.0
    z = F.try_divide(w - n * (n + 1) / 4.0, F.sqrt(variance))
    approx = two_sided_normal_p(z)
    if method == "approx":
        p = approx
    else:
        small = F.col("n_nonzero") <= EXACT_MAX_N
        if method == "auto":
            small = small & (F.col("tie_term") == 0) & (F.col("n_zero") == 0)
        p = F.when(small, exact_p(F.when(small, w), F.col("n_nonzero"))).otherwise(approx)
    out = t.select(
        *pair,
        F.col("n_pairs"),
        F.when(testable, w).alias("W"),
        F.when(all_zero, F.lit(1.0)).when(testable, p).alias("p_raw"),
    )
    out = holm(out, family)
    if digits is not None:
        out = out.withColumns({"p_raw": F.round("p_raw", digits), "p_holm": F.round("p_holm", digits)})
    return out


def holm(tests: DataFrame, family: Sequence[str] = FAMILY, tie_break: Sequence[str] = ("system_a", "system_b")) -> DataFrame:
    """Step-down adjustment within the family: null p ranks as 1 and stays null.

    A family has one row per system pair, so the window is tiny.
    """
    p = F.coalesce("p_raw", F.lit(1.0))
    by_p = Window.partitionBy(*family).orderBy(p, *tie_break)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    scaled = (m - F.row_number().over(by_p) + 1) * p
    out = tests.withColumn("_scaled", scaled).withColumn(
        "_adj",
        F.least(F.lit(1.0), F.max("_scaled").over(by_p.rowsBetween(Window.unboundedPreceding, 0))),
    )
    adjusted = F.when(F.col("p_raw").isNotNull(), F.col("_adj"))
    return out.select(
        *tests.columns,
        adjusted.alias("p_holm"),
        F.coalesce(adjusted <= 0.05, F.lit(False)).alias("significant_at_05"),
    )


def symmetric_matrix(tests: DataFrame, systems: Sequence[str], value: str = "p_holm", family: Sequence[str] = FAMILY) -> DataFrame:
    """Square matrix of a pair value; the diagonal stays empty."""
    one = tests.select(*family, F.col("system_a").alias("system"), F.col("system_b").alias("other"), value)
    two = tests.select(*family, F.col("system_b").alias("system"), F.col("system_a").alias("other"), value)
    return one.unionByName(two).groupBy(*family, "system").pivot("other", list(systems)).agg(F.first(value))


def format_mean_ci(mean: Column, half: Column) -> Column:
    """``m ± h`` with two decimals; no half width shows the mean, no mean ``n/a``."""
    return (
        F.when(mean.isNull(), F.lit("n/a"))
        .when(half.isNull(), F.format_string("%.2f", mean))
        .otherwise(F.format_string("%.2f ± %.2f", mean, half))
    )


def system_table(means: DataFrame, cells: Sequence[tuple[str, str]], name: str = "system") -> DataFrame:
    """One row per run, one rendered cell per (channel, axis) asked for."""
    text = format_mean_ci(F.col("mean"), F.col("ci_half"))
    return means.groupBy(F.col("run").alias(name)).agg(
        *[
            F.coalesce(
                F.max(F.when((F.col("channel") == c) & (F.col("axis") == a), text)), F.lit("n/a")
            ).alias(f"{c}_{a}")
            for c, a in cells
        ]
    )
