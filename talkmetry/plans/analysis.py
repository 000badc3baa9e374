"""End-to-end plans: score the turn-taking of conversations, compare systems.

Each returns named tables. Results that several of them read are written once to the
shared folder (``materialize``), so nothing expensive runs twice and a lost executor
costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmetry.constants import EVENT_LABELS, KEYS, THRESHOLDS, Thresholds
from talkmetry.operators import compare, distance, events, timing
from talkmetry.session import materialize


def score_turn_taking(intervals: DataFrame, frames: DataFrame, th: Thresholds = THRESHOLDS) -> dict[str, DataFrame]:
    """Events, cues, cells and timing samples of every conversation with frames.

    ``intervals``: run, conv_index, role, start_ms, end_ms (words, or segments without
    timed words). ``frames``: run, conv_index, frame, t_ms and the four probabilities, on any
    grid: an event whose frame is missing reads the nearest one.
    """
    runs = materialize(timing.speech_runs(intervals, th.merge_gap_ms), "speech-runs")
    spans = frames.groupBy(*KEYS).agg(F.min("t_ms").alias("t_lo"), F.max("t_ms").alias("t_hi"))
    spans = materialize(spans, "frame-spans")
    hot = timing.hot_runs(runs)
    found = materialize(events.turn_events(runs, spans, th, hot), "turn-events")
    start = spans.select(*KEYS, "t_lo")
    kept = events.kept_events(found).join(start, list(KEYS))
    scored = events.nearest_frames(kept, frames, smooth=th.read_smooth_frames).drop("t_lo", "frame_ms")
    classified = materialize(events.classify_events(scored, th), "classified-events")
    return {
        "events": classified.withColumn("thresholds", timing.thresholds_column(th)),
        "event_counts": events.event_counts(found, spans),
        "cue_counts": events.cue_counts(classified, spans),
        "cells": events.conversation_cells(classified, spans),
        "timing_samples": timing.timing_samples(runs, hot),
    }


def compare_systems(
    quality: DataFrame | None = None,
    label_frames: DataFrame | None = None,
    cells: DataFrame | None = None,
    samples: DataFrame | None = None,
    reference: str | None = None,
    scope: str = "tutor",
) -> dict[str, DataFrame]:
    """Statistics of whatever components are there; the others are left out.

    ``quality``: run, conv_index, channel, axis, score. ``label_frames``: run, conv_index,
    label. ``cells``: as ``score_turn_taking`` returns them. ``samples`` with
    ``reference``: timing samples and the run the others are measured against.
    """
    out: dict[str, DataFrame] = {}
    if quality is not None:
        out["quality_means"] = compare.means_ci(quality, ["run", "channel", "axis"])
        out["quality_pairs"] = compare.paired_wilcoxon(quality)
        out["axis_correlations"] = compare.axis_correlations(quality)
        out["role_gap"] = compare.role_gap(quality)
    if label_frames is not None:
        shares = materialize(compare.label_percentages(label_frames), "label-shares")
        out["label_shares"] = compare.means_ci(shares, ["run", "label"], "pct", "mean_pct")
        contrasted = shares.filter(F.col("label").isin(*EVENT_LABELS)).withColumnRenamed("pct", "score")
        out["label_pairs"] = compare.paired_wilcoxon(contrasted, ["label"])
    if cells is not None:
        stored = materialize(cells, "cells")
        out["fi_rates"] = compare.means_ci(stored, ["run", "scope"], "fi_rate", "mean_fi_rate")
        rates = stored.filter(F.col("scope") == scope).select(*KEYS, "scope", F.col("fi_rate").alias("score"))
        out["fi_pairs"] = compare.paired_wilcoxon(rates, ["scope"])
    if samples is not None and reference is not None:
        counts = materialize(distance.value_counts(samples), "timing-counts")
        out["reference_distances"] = distance.reference_distances(counts, reference)
        out["ecdf"] = distance.ecdf(counts)
    return out
