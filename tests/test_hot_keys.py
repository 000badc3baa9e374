"""Cutting an enormous key into blocks must not change any result."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from queries import inputs as I
from talkmetry.constants import KEYS
from talkmetry.operators import compare, conversation, distance, events, timing, transcripts, words
from talkmetry.operators.intervals import cross_overlap, merge_intervals, reach_before
from talkmetry.operators.ordered import Scan, hot_keys, mirrored, scan, with_blocks

NEVER, ALWAYS = 10**9, 7


@pytest.fixture(scope="module")
def segments(spark, sf):
    """The segment view with a third of all rows moved to one conversation."""
    s = I.segments(spark, sf)
    hot = F.col("seg_id") % 3 == 0
    return s.withColumns(
        {
            "run": F.when(hot, F.lit("sys0")).otherwise(F.col("run")),
            "conv_index": F.when(hot, F.lit(0)).otherwise(F.col("conv_index")).cast("long"),
        }
    ).cache()


def both(fn):
    return rows(fn(NEVER)), rows(fn(ALWAYS))


def test_hot_table_is_small_and_finds_the_hot_key(segments):
    hot = hot_keys(segments, KEYS, "start_ms", 200).collect()
    assert [(r.run, r.conv_index) for r in hot] == [("sys0", 0)]
    assert hot_keys(segments, KEYS, "start_ms", NEVER).count() == 0


def test_plain_window_without_hot_keys(segments):
    """No join and no edge branch is left in the plan before anything runs."""
    df = segments.select(*KEYS, "seg_id", "start_ms", "end_ms")
    plan = scan(df, KEYS, ["start_ms", "seg_id"], Scan(max_before={"m": "end_ms"}), NEVER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and plan.count("Window") == 1


def test_scan_equals_window(segments):
    spec = Scan(prev={"p": "role"}, next={"n": "start_ms2"}, max_before={"m": "end_ms"}, sum_before={"s": "len"}, index="i")
    df = segments.select(*KEYS, "seg_id", "role", "start_ms", F.col("start_ms").alias("start_ms2"), "end_ms", F.length("text").alias("len"))
    a, b = both(lambda limit: scan(df, KEYS, ["start_ms", "seg_id"], spec, limit))
    assert a == b and len(a) == df.count()


def test_scan_rejects_one_column_in_two_roles(segments):
    with pytest.raises(ValueError):
        scan(segments, KEYS, ["start_ms", "seg_id"], Scan(prev={"p": "end_ms"}, max_before={"m": "end_ms"}))


@pytest.mark.parametrize("gap", [0, 180, 5000])
def test_merge_in_blocks(segments, gap):
    a, b = both(lambda limit: merge_intervals(segments, gap, [*KEYS, "role"], limit))
    assert a == b
    a, b = both(lambda limit: merge_intervals(segments, gap, KEYS, limit))
    assert a == b


@pytest.mark.parametrize("shape", ["never", "always", "long", "mixed"])
def test_merge_of_one_key_in_blocks(spark, shape):
    """Intervals that never merge, always merge, lie under one long one, or do all of it by turns."""
    r = random.Random(5)
    at = {
        "never": [(10 * i, 10 * i + 3) for i in range(2000)],
        "always": [(10 * i, 10 * i + 30) for i in range(2000)],
        "long": [(0, 100_000), *[(10 * i, 10 * i + 3) for i in range(2000)]],
        "mixed": [(s, s + r.choice([1, 5, 40, 900])) for s in (r.randrange(60_000) for _ in range(2000))],
    }[shape]
    df = spark.createDataFrame([("a", s, e) for s, e in at] + [("b", 1, 2), (None, 3, 4)], "k string, start_ms long, end_ms long").repartition(5)
    want = []
    for s, e in sorted(at):
        if want and s - want[-1][2] <= 4:
            want[-1] = ("a", want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append(("a", s, e, 1))
    for limit in (NEVER, ALWAYS, 500):
        got = merge_intervals(df, 4, ["k"], limit)
        assert rows(got, "k", "start_ms", "end_ms", "n_merged") == sorted([*want, ("b", 1, 2, 1), (None, 3, 4, 1)], key=repr)


def test_no_task_holds_the_block_results_of_a_hot_key(spark):
    """Of intervals that never merge, only two pieces a block share a partition of the last window."""
    from talkmetry.operators import intervals

    df = spark.range(20_000).selectExpr("'a' AS k", "id * 10 AS start_ms", "id * 10 + 3 AS end_ms")
    hot = hot_keys(df, ["k"], "start_ms", 100)
    blocks = with_blocks(df.withColumn("n_merged", F.lit(1).cast("long")), hot, "start_ms", "inner")
    seen = []
    run = intervals._run

    def spy(frame, by):
        if "_own_run" in list(by):
            seen.append(frame.groupBy("k", "_own_block", "_own_run").count().agg(F.max("count")).first()[0])
        return run(frame, by)

    intervals._run = spy
    try:
        assert intervals._merge_blocks(blocks, 0, ["k"]).count() == 20_000
    finally:
        intervals._run = run
    assert seen and seen[0] <= 2 * 256


def test_merge_with_shared_hot_table(segments):
    hot = hot_keys(segments, KEYS, "start_ms", ALWAYS)
    assert rows(merge_intervals(segments, 180, [*KEYS, "role"], hot=hot)) == rows(merge_intervals(segments, 180, [*KEYS, "role"], NEVER))


@pytest.mark.parametrize("name", ["conversation_stats", "response_latency", "backchannels", "turn_taking", "role_switches"])
def test_conversation_metrics(segments, name):
    a, b = both(lambda limit: getattr(conversation, name)(segments, limit=limit))
    assert a == b


def test_overlap_events_and_timing(segments, spark, sf):
    side = F.when(F.col("role") == "tutor", 0).otherwise(1)
    a, b = both(lambda limit: cross_overlap(segments, side, limit=limit))
    assert a == b
    runs = timing.speech_runs(segments).cache()
    hot = timing.hot_runs(runs, ALWAYS).cache()
    assert hot.count() > 0
    assert rows(timing.timing_samples(runs, hot)) == rows(timing.timing_samples(runs))
    samples = timing.timing_samples(runs).cache()
    a, b = both(lambda limit: timing.timing_summary(samples, limit))
    assert a == b
    asked = events.turn_events(runs).cache()
    assert rows(events.turn_events(runs, hot=hot)) == rows(asked) and asked.count() > 20
    frames = I.frames(spark, sf).cache()
    a, b = both(lambda limit: events.nearest_frames(asked, frames, limit, 3))
    assert a == b and len(a) > 20


def test_backward_scans_are_cut_too(segments):
    hot = hot_keys(segments, KEYS, "start_ms", ALWAYS)
    back = segments.withColumn("_back", -F.col("start_ms"))
    sizes = [r["count"] for r in with_blocks(back, mirrored(hot), "_back").groupBy(*KEYS, "_block").count().collect()]
    assert max(sizes) < 20


def test_reach_before_is_strict(spark):
    q = spark.createDataFrame([("r", 0, t) for t in (0, 5, 10, 11, 30)], "run string, conv_index long, at long")
    iv = spark.createDataFrame([("r", 0, 5, 9), ("r", 0, 10, 40), ("r", 0, 11, 12)], "run string, conv_index long, start_ms long, end_ms long")
    for limit in (NEVER, 1):
        assert rows(reach_before(q, iv, "at", limit=limit), "at", "reach_ms") == [(0, None), (10, 9), (11, 40), (30, 40), (5, None)]


def test_words_to_segments(segments):
    w = segments.select(*KEYS, "role", F.col("seg_id").alias("word_no"), F.lit("w").alias("word"), "start_ms", "end_ms")
    a, b = both(lambda limit: words.words_to_segments(w, limit=limit))
    assert a == b
    parts = words.words_to_segments(w, limit=ALWAYS, per_part=3)
    keys = [*KEYS, "role", "seg_no"]
    whole = words.words_to_segments(w, limit=NEVER)
    assert parts.agg(F.max(F.size("words"))).first()[0] == 3
    joined = parts.groupBy(*keys).agg(F.sum(F.size("words")).alias("n"), F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    assert rows(joined) == rows(whole.select(*keys, F.size("words").cast("long").alias("n"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))


def test_signed_ranks_and_quartiles(spark):
    rnd = random.Random(3)
    data = [(r, i, "c", "x", round(rnd.gauss(0, 1), 1)) for r in ("a", "b", "c") for i in range(120)]
    s = spark.createDataFrame(data, "run string, conv_index long, channel string, axis string, score double")
    diffs = compare.paired_differences(s)
    a, b = both(lambda limit: compare.signed_rank_sums(diffs, limit=limit))
    assert a == b
    a, b = both(lambda limit: distance.quartiles(s, ["run"], limit=limit))
    assert a == b


def test_transcripts_split_into_parts(segments):
    pieces = transcripts.join_in_order(segments, KEYS, ["start_ms", "seg_id"], "text", "|", per_part=10, limit=ALWAYS)
    whole = transcripts.join_in_order(segments, KEYS, ["start_ms", "seg_id"], "text", "|", limit=NEVER)
    assert pieces.agg(F.max("n_pieces")).first()[0] == 10
    parts = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.run, r.conv_index, r.part)):
        parts.setdefault((r.run, r.conv_index), []).append(r.text)
    assert {k: "|".join(v) for k, v in parts.items()} == {(r.run, r.conv_index): r.text for r in whole.collect()}


def test_results_do_not_depend_on_partitioning(spark, segments):
    want = rows(conversation.turn_taking(segments))
    assert rows(conversation.turn_taking(segments.repartition(11, "seg_id"))) == want


def test_a_stray_value_and_crowded_values_leave_even_blocks(spark):
    crowd = [("r", 0, i, i % 997) for i in range(20_000)] + [("r", 0, 20_000, 10**12)]
    df = spark.createDataFrame(crowd, "run string, conv_index long, seg_id long, start_ms long")
    sizes = [r["count"] for r in with_blocks(df, hot_keys(df, KEYS, "start_ms", 1000), "start_ms").groupBy("_block").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 600


def test_quartiles_of_few_values(spark):
    data = [("a", float(i % 3)) for i in range(3001)] + [("b", 1.5)]
    s = spark.createDataFrame(data, "run string, score double")
    for limit in (NEVER, 1):
        got = rows(distance.quartiles(s, ["run"], limit=limit), "run", "n", "q1", "median", "q3")
        assert got == [("a", 3001, 0.0, 1.0, 2.0), ("b", 1, 1.5, 1.5, 1.5)]


@pytest.mark.parametrize("smooth", [1, 3])
def test_nearest_frames_by_brute_force(spark, smooth):
    """Irregular frames with holes wider than a block, several events at one time, events far outside, and one conversation without frames."""
    r = random.Random(smooth)
    times = sorted(r.sample(range(0, 4000), 300) + r.sample(range(50_000, 54_000), 300))
    frames = [("r", c, t, *[r.random() for _ in range(4)]) for c in (1, 2) for t in (times if c == 1 else times[:5])]
    asked = [("r", c, r.choice([r.randrange(-100, 60_000), times[r.randrange(600)]]), i) for i, c in enumerate(r.choice([1, 1, 1, 2, 3]) for _ in range(500))]
    asked += [("r", 1, times[0], 1000), ("r", 1, times[0], 1001), ("r", 1, 27_000, 1002)]
    f = spark.createDataFrame(frames, "run string, conv_index long, t_ms long, " + ", ".join(f"{p} double" for p in events.PROBS)).repartition(4)
    e = spark.createDataFrame(asked, "run string, conv_index long, t_ms long, tag long").repartition(3)
    want = []
    for run, conv, t, tag in asked:
        mine = [x for x in frames if x[1] == conv]
        if mine:
            at = min(range(len(mine)), key=lambda i: (abs(mine[i][2] - t), mine[i][2]))
            used = mine[max(0, at - smooth + 1) : at + 1]
            want.append((tag, conv, t, mine[at][2], *[round(sum(x[k] for x in used) / len(used), 9) for k in range(3, 7)]))
    for limit in (NEVER, ALWAYS, 100):
        got = events.nearest_frames(e, f, limit, smooth).collect()
        assert sorted((x["tag"], x["conv_index"], x["t_ms"], x["frame_ms"], *[round(x[p], 9) for p in events.PROBS]) for x in got) == sorted(want)


def test_frame_activity_by_brute_force(spark):
    """Long, empty and corrupt intervals: two rows each, whatever their length."""
    from talkmetry.operators import frames as N

    r = random.Random(2)
    spans = [("r", 1, r.choice(["tutor", "student", "system"]), s, s + r.choice([-5, 0, 1, 39, 40, 41, 900])) for s in (r.randrange(-200, 20_000) for _ in range(150))]
    spans += [("r", 1, "tutor", 19_500, 9 * 10**15), ("r", 2, "student", -(10**15), 10**15), ("r", 1, "tutor", None, 10), ("r", 1, "student", 10, None)]
    table = spark.createDataFrame(spans, "run string, conv_index long, role string, start_ms long, end_ms long")
    given = spark.createDataFrame([("r", c, i, float(i)) for c in (1, 2, 3) for i in range(500)], "run string, conv_index long, frame long, energy double").repartition(3)
    assert N.activity_steps(table, 40).count() <= 2 * len(spans)
    want = []
    for c in (1, 2, 3):
        for i in range(500):
            on = [int(any(s[1] == c and s[2] == role and s[4] is not None and (s[3] or 0) <= 40 * i < s[4] for s in spans)) for role in ("tutor", "student")]
            want.append((c, i, *on))
    for limit in (NEVER, ALWAYS):
        got = N.frame_activity(given, table, 40, limit=limit)
        assert rows(got, "conv_index", "frame", "tutor_active", "student_active") == sorted(want, key=repr)
