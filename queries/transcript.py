"""Transcript metrics, intervals, timing and turn-taking events."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as I
from queries.inputs import with_ctes
from talkmetry.constants import KEYS, THRESHOLDS
from talkmetry.functions.text import word_count
from talkmetry.operators import conversation as C
from talkmetry.operators import events as E
from talkmetry.operators import intervals, timing
from talkmetry.operators.intervals import merge_intervals

W = (
    r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _runs(spark, d):
    return timing.speech_runs(I.segments(spark, d))


def _events(spark, d):
    return E.turn_events(_runs(spark, d), E.frame_ranges(I.frames(spark, d)).drop("n_frames"))


def classified(spark, d):
    kept = E.kept_events(_events(spark, d))
    return E.classify_events(E.read_frames(kept, I.frames(spark, d), I.FRAME_STEP_MS))


def _event_frames(spark, d):
    kept = E.kept_events(_events(spark, d))
    return E.read_frames(kept, I.frames(spark, d), I.FRAME_STEP_MS, smooth=3).select(
        *KEYS, "t_ms", "holder", "event_type", F.round("p_now0", 6).alias("p_now"), F.round("p_future1", 6).alias("p_future")
    )


def _irregular(spark, d, smooth=1):
    """Two thirds of the frames, unevenly spaced."""
    frames = I.frames(spark, d).filter((F.col("frame") * 7 + F.col("conv_index")) % 3 != 0)
    return E.nearest_frames(E.kept_events(_events(spark, d)), frames, smooth=smooth).select(
        *KEYS, "t_ms", "holder", "event_type", "frame_ms", F.round("p_now0", 6).alias("p_now0")
    )


QUERIES = {
    "conversation_stats": lambda s, d: C.conversation_stats(I.segments(s, d)),
    "run_summary": lambda s, d: C.run_summary(C.conversation_stats(I.segments(s, d))),
    "role_switches": lambda s, d: C.role_switches(I.segments(s, d)),
    "turn_word_stats": lambda s, d: I.turns(s, d)
    .groupBy("conv_id", "role")
    .agg(F.count(F.lit(1)).alias("turns"), F.sum(word_count(F.col("text"))).alias("words")),
    "response_latency": lambda s, d: C.response_latency(I.segments(s, d)),
    "overlap_seconds": lambda s, d: C.speech_overlap(I.segments(s, d)),
    "backchannels": lambda s, d: C.backchannels(I.segments(s, d)),
    "turn_taking": lambda s, d: C.turn_taking(I.segments(s, d)),
    "silence_ratio": lambda s, d: C.turn_taking(I.segments(s, d)).select(*KEYS, "silence_s", "silence_ratio"),
    "merge_intervals": lambda s, d: merge_intervals(I.segments(s, d), 0),
    "covered_time": lambda s, d: intervals.covered_ms(I.segments(s, d)),
    "speech_runs": lambda s, d: _runs(s, d),
    "timing_samples": lambda s, d: timing.timing_samples(_runs(s, d)),
    "timing_summary": lambda s, d: timing.timing_summary(timing.timing_samples(_runs(s, d))),
    "support_filter": lambda s, d: timing.clip_to_support(timing.timing_samples(_runs(s, d))),
    "first_onset": lambda s, d: I.segments(s, d).groupBy(*KEYS).agg(F.min("start_ms").alias("onset_ms")),
    "turn_events": lambda s, d: _events(s, d),
    "guarded_events": lambda s, d: E.event_counts(_events(s, d), I.conversations_of(s, d)),
    "uptake_asof": lambda s, d: E.kept_events(_events(s, d)).select(
        *KEYS, "t_ms", "holder", "event_type", "took_floor", "latency_ms"
    ),
    "frame_asof": _event_frames,
    "frame_asof_irregular": _irregular,
    "frame_asof_irregular_mean": lambda s, d: _irregular(s, d, 3),
    "thresholds_embedded": lambda s, d: _events(s, d).select(*KEYS, "t_ms", "holder", "event_type", timing.thresholds_column()).select(
        *KEYS, "t_ms", "holder", "event_type", "thresholds.*"
    ),
    "event_cues_cells": lambda s, d: classified(s, d).select(
        *KEYS, "t_ms", "holder", "event_type", "cue_label", "cell", "vap_pred", "responder_action"
    ),
    "cue_counts": lambda s, d: E.cue_counts(classified(s, d), I.conversations_of(s, d)),
    "conversation_cells": lambda s, d: E.conversation_cells(classified(s, d), I.conversations_of(s, d)).withColumn(
        "fi_rate", F.round("fi_rate", 6)
    ),
    "cell_totals": lambda s, d: E.cell_totals(classified(s, d)),
    "cue_shares": lambda s, d: E.cue_shares(classified(s, d)),
    "uptake_latencies": lambda s, d: E.uptake_latencies(classified(s, d)),
}

STATS_SQL = """
, sw AS (SELECT run, conv_index, count(*) FILTER (WHERE role <> prev) AS role_switches FROM (
    SELECT *, lag(role) OVER (PARTITION BY run, conv_index ORDER BY seg_id) AS prev FROM seg) GROUP BY 1, 2),
agg AS (SELECT run, conv_index, max(end_ms) AS dur, count(*) AS num_segments,
    count(*) FILTER (WHERE role = 'tutor') AS tutor_segments,
    CAST(coalesce(sum(words) FILTER (WHERE role = 'tutor'), 0) AS BIGINT) AS tutor_words,
    CAST(coalesce(sum(end_ms - start_ms) FILTER (WHERE role = 'tutor'), 0) AS BIGINT) AS tutor_ms,
    count(*) FILTER (WHERE role = 'student') AS student_segments,
    CAST(coalesce(sum(words) FILTER (WHERE role = 'student'), 0) AS BIGINT) AS student_words,
    CAST(coalesce(sum(end_ms - start_ms) FILTER (WHERE role = 'student'), 0) AS BIGINT) AS student_ms
    FROM seg GROUP BY 1, 2),
stats AS (SELECT agg.run, agg.conv_index, pyround(dur / 1000.0::DOUBLE, 3) AS duration_s, num_segments, role_switches,
    tutor_segments, tutor_words, pyround(tutor_ms / 1000.0::DOUBLE, 3) AS tutor_speaking_time_s,
    CASE WHEN tutor_ms > 0 THEN pyround(tutor_words / (tutor_ms / 60000.0::DOUBLE), 1) ELSE 0.0::DOUBLE END AS tutor_words_per_min,
    CASE WHEN dur > 0 THEN pyround(tutor_ms / dur, 3) ELSE 0.0::DOUBLE END AS tutor_talk_ratio,
    student_segments, student_words, pyround(student_ms / 1000.0::DOUBLE, 3) AS student_speaking_time_s,
    CASE WHEN student_ms > 0 THEN pyround(student_words / (student_ms / 60000.0::DOUBLE), 1) ELSE 0.0::DOUBLE END AS student_words_per_min,
    CASE WHEN dur > 0 THEN pyround(student_ms / dur, 3) ELSE 0.0::DOUBLE END AS student_talk_ratio
    FROM agg JOIN sw ON agg.run = sw.run AND agg.conv_index = sw.conv_index)
"""


def _stats(body: str) -> str:
    return with_ctes("seg", "SELECT 1").rsplit("SELECT 1", 1)[0] + STATS_SQL + body


STAT_COLS = [
    "duration_s", "num_segments", "role_switches", "tutor_segments", "tutor_words", "tutor_speaking_time_s",
    "tutor_words_per_min", "tutor_talk_ratio", "student_segments", "student_words", "student_speaking_time_s",
    "student_words_per_min", "student_talk_ratio",
]

TT_SQL = """
, gaps AS (SELECT run, conv_index, start_ms - prev_end AS gap FROM (
    SELECT *, lag(end_ms) OVER w AS prev_end, lag(role) OVER w AS prev_role FROM seg
    WINDOW w AS (PARTITION BY run, conv_index ORDER BY start_ms, seg_id)) WHERE prev_role <> role AND start_ms >= prev_end),
lat AS (SELECT run, conv_index, pyround(CAST(sum(gap) AS BIGINT) / count(*) / 1000.0::DOUBLE, 3) AS latency_mean_s,
    pyround(median(gap) / 1000.0::DOUBLE, 3) AS latency_median_s,
    pyround(round(quantile_cont(gap, 0.9), 1) / 1000.0::DOUBLE, 3) AS latency_p90_s, count(*) AS latency_count FROM gaps GROUP BY 1, 2),
ov AS (SELECT a.run, a.conv_index, CAST(sum(greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))) AS BIGINT) AS overlap_ms
    FROM seg a JOIN seg b ON a.run = b.run AND a.conv_index = b.conv_index AND a.role = 'tutor' AND b.role = 'student'
    AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY 1, 2),
mrg AS (SELECT run, conv_index, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_merged FROM (
    SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY run, conv_index
        ORDER BY start_ms, end_ms, seg_id) AS island FROM (
    SELECT *, max(end_ms) OVER (PARTITION BY run, conv_index ORDER BY start_ms, end_ms, seg_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg)) GROUP BY run, conv_index, island),
cov AS (SELECT run, conv_index, CAST(sum(end_ms - start_ms) AS BIGINT) AS active_ms FROM mrg GROUP BY 1, 2),
bc AS (SELECT run, conv_index, seg_id, role FROM seg s WHERE end_ms - start_ms <= 1500 AND words <= 4 AND EXISTS (
    SELECT 1 FROM seg o WHERE o.run = s.run AND o.conv_index = s.conv_index AND o.role <> s.role
    AND o.start_ms < s.end_ms AND o.end_ms > s.start_ms)),
bcn AS (SELECT run, conv_index, count(*) AS n_back FROM bc GROUP BY 1, 2),
base AS (SELECT run, conv_index, count(*) AS n, max(end_ms) AS dur FROM seg GROUP BY 1, 2),
tt AS (SELECT b.run, b.conv_index, coalesce(latency_mean_s, 0) AS latency_mean_s, coalesce(latency_median_s, 0) AS latency_median_s,
    coalesce(latency_p90_s, 0) AS latency_p90_s, coalesce(latency_count, 0) AS latency_count,
    pyround(coalesce(overlap_ms, 0) / 1000.0::DOUBLE, 3) AS overlap_s,
    CASE WHEN dur > 0 THEN pyround(coalesce(overlap_ms, 0) / dur, 3) ELSE 0.0::DOUBLE END AS overlap_ratio,
    pyround(greatest(0, dur - active_ms) / 1000.0::DOUBLE, 3) AS silence_s,
    CASE WHEN dur > 0 THEN pyround(greatest(0, dur - active_ms) / dur, 3) ELSE 0.0::DOUBLE END AS silence_ratio,
    coalesce(n_back, 0) AS backchannel_count, pyround(coalesce(n_back, 0) / n, 3) AS backchannel_ratio
    FROM base b LEFT JOIN lat USING (run, conv_index) LEFT JOIN ov USING (run, conv_index)
    LEFT JOIN cov USING (run, conv_index) LEFT JOIN bcn USING (run, conv_index))
"""


def _tt(body: str) -> str:
    return with_ctes("seg", "SELECT 1").rsplit("SELECT 1", 1)[0] + TT_SQL + body


_CELLS = """CAST(count(*) FILTER (WHERE cell = 'appropriate_uptake') AS BIGINT) AS appropriate_uptake,
    count(*) FILTER (WHERE cell = 'missed_yield') AS missed_yield,
    count(*) FILTER (WHERE cell = 'false_interruption') AS false_interruption,
    count(*) FILTER (WHERE cell = 'appropriate_restraint') AS appropriate_restraint"""

ORACLES = {
    "conversation_stats": _stats("SELECT * FROM stats"),
    "run_summary": _stats(
        "SELECT run, " + ", ".join(f"pyround(CAST(sum(CAST({c} AS DECIMAL(38,9))) AS DOUBLE) / nullif(count({c}), 0), 3) AS {c}" for c in STAT_COLS) + " FROM stats GROUP BY run"
    ),
    "role_switches": _stats("SELECT * FROM sw"),
    "turn_word_stats": with_ctes(
        "turns",
        f"""SELECT conv_id, role, count(*) AS turns, CAST(sum(len(regexp_extract_all(text, '{W}'))) AS BIGINT) AS words
        FROM turns GROUP BY conv_id, role""",
    ),
    "response_latency": _tt("SELECT * FROM lat"),
    "overlap_seconds": _tt(
        "SELECT run, conv_index, coalesce(overlap_ms, 0) AS overlap_ms, active_ms FROM cov LEFT JOIN ov USING (run, conv_index)"
    ),
    "backchannels": _tt("SELECT * FROM bc"),
    "turn_taking": _tt("SELECT * FROM tt"),
    "silence_ratio": _tt("SELECT run, conv_index, silence_s, silence_ratio FROM tt"),
    "merge_intervals": _tt("SELECT * FROM mrg"),
    "covered_time": _tt("SELECT run, conv_index, active_ms AS covered_ms FROM cov"),
    "speech_runs": with_ctes("runs", "SELECT * FROM runs"),
    "timing_samples": with_ctes("samples", "SELECT * FROM samples"),
    "timing_summary": with_ctes(
        "samples",
        """SELECT run, metric, count(*) AS n, round(CAST(sum(value_ms) AS BIGINT) / count(*) / 1000.0::DOUBLE, 6) AS mean_s,
        round(quantile_cont(value_ms, 0.25) / 1000.0::DOUBLE, 6) AS q1_s,
        round(quantile_cont(value_ms, 0.5) / 1000.0::DOUBLE, 6) AS median_s,
        round(quantile_cont(value_ms, 0.75) / 1000.0::DOUBLE, 6) AS q3_s FROM samples GROUP BY run, metric""",
    ),
    "support_filter": with_ctes("clipped", "SELECT * FROM clipped"),
    "first_onset": with_ctes("seg", "SELECT run, conv_index, min(start_ms) AS onset_ms FROM seg GROUP BY 1, 2"),
    "turn_events": with_ctes(
        "tev",
        """SELECT run, conv_index, t_ms, holder, responder, event_type, gap_ms, dropped_guard,
        latency_ms IS NOT NULL AS took_floor, latency_ms FROM tev""",
    ),
    "guarded_events": with_ctes(
        "tev convs",
        """SELECT c.run, c.conv_index, count(*) FILTER (WHERE NOT dropped_guard AND event_type = 'turn_end') AS turn_end,
        count(*) FILTER (WHERE NOT dropped_guard AND event_type = 'intra_pause') AS intra_pause,
        count(*) FILTER (WHERE dropped_guard) AS dropped_guard FROM convs c LEFT JOIN tev t ON t.run = c.run AND t.conv_index = c.conv_index GROUP BY 1, 2""",
    ),
    "uptake_asof": with_ctes(
        "tev",
        """SELECT run, conv_index, t_ms, holder, event_type, latency_ms IS NOT NULL AS took_floor, latency_ms
        FROM tev WHERE NOT dropped_guard""",
    ),
    "frame_asof": with_ctes(
        "tev frames",
        """SELECT t.run, t.conv_index, t.t_ms, t.holder, t.event_type, round(sum(now_pm) / count(*) / 1000.0::DOUBLE, 6) AS p_now,
        round(sum(1000 - future_pm) / count(*) / 1000.0::DOUBLE, 6) AS p_future
        FROM (SELECT *, (SELECT min_by(frame, (abs(f.t_ms - e.t_ms), frame)) FROM frames f WHERE f.run = e.run
            AND f.conv_index = e.conv_index) AS idx FROM tev e WHERE NOT dropped_guard) t
        JOIN frames f ON f.run = t.run AND f.conv_index = t.conv_index AND f.frame BETWEEN t.idx - 2 AND t.idx
        GROUP BY ALL""",
    ),
    "frame_asof_irregular": with_ctes(
        "tev frames",
        """WITH fr AS (SELECT * FROM frames WHERE (frame * 7 + conv_index) % 3 <> 0)
        SELECT e.run, e.conv_index, e.t_ms, holder, event_type, min_by(f.t_ms, (abs(f.t_ms - e.t_ms), f.t_ms)) AS frame_ms,
        min_by(now_pm / 1000.0::DOUBLE, (abs(f.t_ms - e.t_ms), f.t_ms)) AS p_now0
        FROM tev e JOIN fr f ON f.run = e.run AND f.conv_index = e.conv_index WHERE NOT dropped_guard GROUP BY 1, 2, 3, 4, 5""",
    ),
    "thresholds_embedded": with_ctes(
        "tev",
        "SELECT run, conv_index, t_ms, holder, event_type, "
        + ", ".join(f"{v!r}{'::DOUBLE' if isinstance(v, float) else ''} AS {k}" for k, v in THRESHOLDS.as_dict().items())
        + " FROM tev",
    ),
    "frame_asof_irregular_mean": with_ctes(
        "tev frames",
        """WITH fr AS (SELECT *, row_number() OVER (PARTITION BY run, conv_index ORDER BY t_ms) AS no FROM frames WHERE (frame * 7 + conv_index) % 3 <> 0),
        n AS (SELECT e.run, e.conv_index, e.t_ms, holder, event_type, min_by(f.t_ms, (abs(f.t_ms - e.t_ms), f.t_ms)) AS frame_ms,
        min_by(no, (abs(f.t_ms - e.t_ms), f.t_ms)) AS at FROM tev e JOIN fr f ON f.run = e.run AND f.conv_index = e.conv_index WHERE NOT dropped_guard GROUP BY 1, 2, 3, 4, 5)
        SELECT n.run, n.conv_index, n.t_ms, holder, event_type, frame_ms, round(sum(now_pm) / count(*) / 1000.0::DOUBLE, 6) AS p_now0
        FROM n JOIN fr f ON f.run = n.run AND f.conv_index = n.conv_index AND f.no BETWEEN n.at - 2 AND n.at GROUP BY 1, 2, 3, 4, 5, 6""",
    ),
    "event_cues_cells": with_ctes(
        "cls",
        """SELECT run, conv_index, t_ms, holder, event_type, cue_label, cell,
        CASE WHEN future_r > 500 THEN 'YIELD' ELSE 'HOLD' END AS vap_pred,
        CASE WHEN latency_ms IS NOT NULL THEN 'took_floor' ELSE 'stayed_silent' END AS responder_action FROM cls""",
    ),
    "cue_counts": with_ctes(
        "cls",
        "SELECT c.run, c.conv_index, r.role, "
        + ", ".join(
            f"count(*) FILTER (WHERE cue_label = '{c}') AS {c.replace('-', '_').lower()}"
            for c in ("Early-Yield", "Late-Yield", "Yield-NotCued", "Strong-Hold", "Weak-Hold", "Hold-Misread")
        )
        + " FROM convs c CROSS JOIN (SELECT unnest(['tutor', 'student']) AS role) r"
        + " LEFT JOIN cls e ON e.run = c.run AND e.conv_index = c.conv_index AND e.holder = r.role GROUP BY 1, 2, 3",
    ),
    "conversation_cells": with_ctes(
        "cls",
        f"""WITH sc AS (SELECT *, responder AS scope FROM cls UNION ALL SELECT *, 'pooled' FROM cls),
        agg AS (SELECT run, conv_index, scope, {_CELLS},
            median(latency_ms) FILTER (WHERE cell = 'appropriate_uptake') AS med FROM sc GROUP BY 1, 2, 3)
        SELECT c.run, c.conv_index, s.scope, coalesce(appropriate_uptake, 0) AS appropriate_uptake,
            coalesce(missed_yield, 0) AS missed_yield, coalesce(false_interruption, 0) AS false_interruption,
            coalesce(appropriate_restraint, 0) AS appropriate_restraint,
            CASE WHEN false_interruption + appropriate_restraint > 0
                THEN round(false_interruption / (false_interruption + appropriate_restraint), 6) END AS fi_rate,
            med / 1000.0::DOUBLE AS uptake_lat_median_s
        FROM convs c CROSS JOIN (SELECT unnest(['tutor', 'student', 'pooled']) AS scope) s
        LEFT JOIN agg a ON a.run = c.run AND a.conv_index = c.conv_index AND a.scope = s.scope""",
    ),
    "cell_totals": with_ctes(
        "cls",
        f"""WITH sc AS (SELECT *, responder AS scope FROM cls UNION ALL SELECT *, 'pooled' FROM cls),
        agg AS (SELECT run, scope, {_CELLS} FROM sc GROUP BY 1, 2)
        SELECT *, CASE WHEN false_interruption + appropriate_restraint > 0
            THEN round(false_interruption / (false_interruption + appropriate_restraint), 6) END AS fi_rate,
            CASE WHEN appropriate_uptake + missed_yield > 0
            THEN round(appropriate_uptake / (appropriate_uptake + missed_yield), 6) END AS uptake_rate FROM agg""",
    ),
    "cue_shares": with_ctes(
        "cls",
        """SELECT g.run, g.role, g.label, count(c.cue_label) AS count,
        round(CAST(100.0 AS DOUBLE) * count(c.cue_label) / nullif(sum(count(c.cue_label)) OVER (PARTITION BY g.run, g.role), 0), 6) AS pct
        FROM (SELECT DISTINCT run, role, label FROM cls, (SELECT unnest(['tutor', 'student']) AS role) r,
            (SELECT unnest(['Early-Yield', 'Late-Yield', 'Yield-NotCued', 'Strong-Hold', 'Weak-Hold', 'Hold-Misread']) AS label) l) g
        LEFT JOIN cls c ON c.run = g.run AND c.holder = g.role AND c.cue_label = g.label GROUP BY 1, 2, 3""",
    ),
    "uptake_latencies": with_ctes(
        "cls",
        "SELECT run, conv_index, latency_ms / 1000.0::DOUBLE AS latency_s FROM cls WHERE cell = 'appropriate_uptake'",
    ),
}
