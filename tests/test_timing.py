"""Hand timelines and brute force for runs, samples and events."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from talkmetry.operators import conversation, events, timing
from talkmetry.operators.intervals import covered_ms, merge_intervals

SEG = "run string, conv_index long, seg_id long, role string, text string, start_ms long, end_ms long"


def seg(spark, items):
    return spark.createDataFrame([("r", 0, i, role, text, s, e) for i, (role, s, e, text) in enumerate(items)], SEG)


def timeline(spark):
    return seg(spark, [("tutor", 0, 1000, "a"), ("student", 1500, 2500, "b"), ("tutor", 2300, 3000, "c"), ("tutor", 3400, 4000, "d")])


def by_metric(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.metric, []).append(r.value_ms)
    return {k: sorted(v) for k, v in out.items()}


def test_golden_timeline(spark):
    got = by_metric(timing.timing_samples(timing.speech_runs(timeline(spark))))
    assert got == {
        "fto_s": [-200, 500],
        "gap_s": [500],
        "overlap_s": [200],
        "within_pause_s": [400],
        "turn_dur_s": [600, 700, 1000, 1000],
    }


def test_no_segments(spark):
    assert timing.timing_samples(timing.speech_runs(spark.createDataFrame([], SEG))).count() == 0


def test_zero_offset_is_a_gap_and_touching_words_merge(spark):
    s = seg(spark, [("tutor", 0, 1000, ""), ("student", 1000, 1500, ""), ("student", 1680, 1800, ""), ("other", 0, 9000, "")])
    got = by_metric(timing.timing_samples(timing.speech_runs(s)))
    assert got == {"fto_s": [0], "gap_s": [0], "turn_dur_s": [800, 1000]}


def test_tutor_comes_first_on_an_onset_tie(spark):
    s = seg(spark, [("student", 0, 500, ""), ("tutor", 0, 700, ""), ("student", 2000, 2100, "")])
    got = by_metric(timing.timing_samples(timing.speech_runs(s)))
    assert got["fto_s"] == [-700] and got["within_pause_s"] == [1500]


def brute_runs(items, gap):
    out = {}
    for role in ("tutor", "student"):
        merged = []
        for s, e in sorted((s, e) for r, s, e, _ in items if r == role):
            if merged and s - merged[-1][1] <= gap:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out[role] = merged
    return out


def brute_events(items, t_lo, t_hi):
    runs = brute_runs(items, 180)
    order = sorted([(s, e, r) for r in ("tutor", "student") for s, e in runs[r]], key=lambda x: x[0])
    out = []
    for (_, e, r), (s2, _, r2) in zip(order, order[1:]):
        gap = s2 - e
        if not (250 <= gap <= 4000 if r == r2 else 0 <= gap <= 4000) or not t_lo <= e <= t_hi:
            continue
        other = "student" if r == "tutor" else "tutor"
        guard = any(b > e - 300 and a < e for a, b in runs[other])
        on = [a for a, _ in runs[other] if e < a <= e + 1500]
        out.append((e, r, "intra_pause" if r == r2 else "turn_end", gap, guard, bool(on), min(on) - e if on else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_events_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    items = []
    for _ in range(150):
        s = rnd.randrange(0, 90_000, 50)
        items.append((rnd.choice(["tutor", "student"]), s, s + rnd.randrange(0, 1200, 50), "w " * rnd.randrange(7)))
    df = seg(spark, items)
    runs = timing.speech_runs(df)
    want = {(r, s, e) for r, v in brute_runs(items, 180).items() for s, e in v}
    assert {(x.role, x.start_ms, x.end_ms) for x in runs.collect()} == want
    span = spark.createDataFrame([("r", 0, 1000, 80_000)], "run string, conv_index long, t_lo long, t_hi long")
    got = rows(events.turn_events(runs, span), "t_ms", "holder", "event_type", "gap_ms", "dropped_guard", "took_floor", "latency_ms")
    assert got == brute_events(items, 1000, 80_000)
    # Overlap pair by pair, silence over the union, backchannels.
    tutor = [(s, e) for r, s, e, _ in items if r == "tutor"]
    student = [(s, e) for r, s, e, _ in items if r == "student"]
    overlap = sum(max(0, min(a1, b1) - max(a0, b0)) for a0, a1 in tutor for b0, b1 in student)
    back = 0
    for r, s, e, text in items:
        against = student if r == "tutor" else tutor
        back += e - s <= 1500 and len(text.split()) <= 4 and any(a < e and b > s for a, b in against)
    tt = conversation.turn_taking(df).first()
    assert tt.overlap_s == pytest.approx(overlap / 1000) and tt.backchannel_count == back
    union = sum(e - s for s, e in [(x.start_ms, x.end_ms) for x in merge_intervals(df, 0).collect()])
    assert covered_ms(df).first().covered_ms == union
    assert tt.silence_s == pytest.approx((max(e for _, _, e, _ in items) - union) / 1000)


def test_other_roles_in_transcript_metrics(spark):
    s = seg(spark, [("tutor", 0, 1000, "one two"), ("system", 1000, 2000, "x"), ("student", 2500, 2400, "hi"), ("tutor", 3000, 4000, "")])
    r = conversation.conversation_stats(s).first()
    assert (r.num_segments, r.role_switches, r.tutor_segments, r.tutor_words, r.student_words) == (4, 2, 2, 2, 1)
    assert r.student_speaking_time_s == 0.0 and r.student_words_per_min == 0.0
    # Any two different roles make a latency; negative gaps do not.
    lat = conversation.response_latency(s).first()
    assert (lat.latency_count, lat.latency_mean_s) == (3, pytest.approx((0 + 0.5 + 0.6) / 3, abs=1e-3))


def test_conversation_without_segments_gets_zeros(spark):
    convs = spark.createDataFrame([("r", 0, 5000), ("r", 1, 7000)], "run string, conv_index long, duration_ms long")
    s = timeline(spark)
    stats = {x.conv_index: x for x in conversation.conversation_stats(s, convs).collect()}
    assert stats[1].num_segments == 0 and stats[1].duration_s == 7.0 and stats[1].tutor_talk_ratio == 0.0
    tt = {x.conv_index: x for x in conversation.turn_taking(s, convs).collect()}
    assert tt[1].silence_s == 7.0 and tt[1].silence_ratio == 1.0 and tt[1].latency_count == 0


def test_cue_and_cell_boundaries(spark):
    cols = "holder string, responder string, event_type string, took_floor boolean, p_now0 double, p_now1 double, p_future0 double, p_future1 double"
    df = spark.createDataFrame(
        [
            ("tutor", "student", "turn_end", True, 0.4, 0.6, 0.49, 0.51),
            ("tutor", "student", "turn_end", False, 0.5, 0.5, 0.5, 0.5),
            ("student", "tutor", "intra_pause", True, 0.5, 0.5, 0.5, 0.5),
            ("student", "tutor", "intra_pause", False, 0.6, 0.4, 0.6, 0.4),
        ],
        cols,
    )
    got = [(r.cue_label, r.cell) for r in events.classify_events(df).collect()]
    assert got == [
        ("Early-Yield", "appropriate_uptake"),
        ("Yield-NotCued", "appropriate_restraint"),
        ("Strong-Hold", "false_interruption"),
        ("Hold-Misread", "missed_yield"),
    ]


def test_nearest_frame_prefers_the_earlier_one(spark):
    df = spark.range(0, 101).withColumn("i", events.nearest_grid_index(F.col("id"), 0, 20))
    for r in df.collect():
        want = min(range(6), key=lambda k: (abs(k * 20 - r.id), k))
        assert r.i == want
