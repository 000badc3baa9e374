"""Speech runs and the timing samples read off their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmetry.constants import KEYS, THRESHOLDS, TIMING_SUPPORT_MS, Thresholds
from talkmetry.operators.conversation import known_roles
from talkmetry.operators.intervals import merge_intervals
from talkmetry.operators.ordered import Scan, dealt, hot_keys, scan_given
from talkmetry.operators.ranks import quartiles_of_counts
from talkmetry.session import materialize


def speech_runs(
    intervals: DataFrame, gap_ms: int = THRESHOLDS.merge_gap_ms, limit: int | None = None
) -> DataFrame:
    """Per-role merged speech: run, conv_index, role, start_ms, end_ms, n_merged."""
    return merge_intervals(known_roles(intervals), gap_ms, [*KEYS, "role"], limit)


def hot_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Conversations with too many runs for one task, for the scans along time to share."""
    return hot_keys(runs, KEYS, "start_ms", limit)


def adjacent_runs(runs: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Each run with the next one of the conversation: by onset, tutor first on a tie.

    Runs of a role lie more than the merge gap apart, so a conversation has at most eleven a second however
    many rows they came from. Where that is still too much for one task, store the runs and pass ``hot_runs`` of them.
    Else they are dealt to as many tasks as the session names: the planner fills fewer up to a size before sorting, of which
    the sorts here and in ``turn_events`` hold many times as much.
    """
    if hot is None:
        runs = dealt(runs, KEYS)
    rows = runs.withColumn("_place", F.when(F.col("role") == "tutor", 0).otherwise(1))
    spec = Scan(next={"next_start_ms": "start_ms", "next_role": "role"})
    return scan_given(rows, KEYS, ["start_ms", "_place"], spec, hot).drop("_place")


def timing_samples(runs: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Long table (run, conv_index, metric, value_ms) of the five timing distributions.

    A floor transfer of exactly 0 is a gap. A same-role step of 0 or less is nothing.
    """
    delta = F.col("next_start_ms") - F.col("end_ms")
    same = F.col("role") == F.col("next_role")

    def sample(metric: str, value, when=None):
        item = F.struct(F.lit(metric).alias("metric"), value.cast("long").alias("value_ms"))
        return item if when is None else F.when(when, item)

    samples = F.array(
        sample("turn_dur_s", F.col("end_ms") - F.col("start_ms")),
        sample("fto_s", delta, ~same),
        sample("gap_s", delta, ~same & (delta >= 0)),
        sample("overlap_s", -delta, ~same & (delta < 0)),
        sample("within_pause_s", delta, same & (delta > 0)),
    )
    rows = adjacent_runs(runs, hot).select(*KEYS, F.explode(samples).alias("s")).filter(F.col("s").isNotNull())
    return rows.select(*KEYS, "s.metric", "s.value_ms")


def timing_summary(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Count, mean and quartiles per run and metric (whole milliseconds, exact).

    Samples are counted per distinct value first; nothing holds a group's values in one buffer.
    """
    by = ["run", "metric"]
    counts = samples.groupBy(*by, F.col("value_ms").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    found = quartiles_of_counts(materialize(counts, "timing-values"), by, limit)
    return found.select(
        *by,
        "n",
        F.round(F.col("total") / F.col("n") / 1000.0, 6).alias("mean_s"),
        *[F.round(F.col(q) / 1000.0, 6).alias(f"{q}_s") for q in ("q1", "median", "q3")],
    )


def in_support() -> Column:
    """Is the sample inside its metric's inclusive support?"""
    keep = F.lit(False)
    for metric, (lo, hi) in TIMING_SUPPORT_MS.items():
        keep = keep | ((F.col("metric") == metric) & F.col("value_ms").between(lo, hi))
    return keep


def clip_to_support(samples: DataFrame) -> DataFrame:
    """Keep samples inside the metric's support; nothing is clamped."""
    return samples.filter(in_support())


def thresholds_column(th: Thresholds = THRESHOLDS):
    """The active limits as a struct, to store with each row."""
    return F.struct(*[F.lit(v).alias(k) for k, v in th.as_dict().items()]).alias("thresholds")
