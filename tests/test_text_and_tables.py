"""Parsing, prompts, caches, planning, sources, plug-ins."""

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from talkmetry.constants import NAIVE_RUBRIC, TAXONOMY_RUBRIC, THRESHOLDS
from talkmetry.functions import text as T
from talkmetry.operators import frames, leaves, rubrics, timing, transcripts, words, work
from talkmetry.operators.conversation import conversation_stats, turn_taking
from talkmetry.plans import evaluators
from talkmetry.schemas import ALIGNED, CONVERSATION, TUTORING_EXAMPLE
from talkmetry.sources import flatten, imports, lines, runs


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("value", ["", "  ", "a b", "　a b c ", "a\x1cb\n\nc", "é à"])
def test_words_as_python_splits(spark, value):
    assert one(spark, value, T.word_count) == len(value.split())
    assert one(spark, value, T.strip) == value.strip()


def test_tail_and_names(spark):
    assert one(spark, " " + "x" * 900 + "y ", T.keep_tail) == ("x" * 900 + "y")[-800:]
    assert one(spark, None, T.keep_tail) == ""
    assert one(spark, "a/b.c", T.slug) == "a-b.c" and one(spark, "a/b.c", T.file_slug) == "a_b-c"
    assert one(spark, "solo", lambda c: T.run_part(c, 0)) is None
    label = spark.sql("select 1").select(T.backend_label(F.lit("gpt-realtime"), F.lit(None).cast("string")).alias("l")).first().l
    assert label == "GPT↑ / ?↓"


def test_render_does_not_reread_values(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(T.render("<{a}|{b}|{{}}>", a=F.col("a"), b=F.col("b")).alias("o")).first().o == "<{b}|x|{}>"


def test_rounding_is_python_rounding(spark):
    df = spark.range(0, 20_000).select("id", F.format_string("%.2f", T.seconds(F.col("id"), 2)).alias("a"), T.seconds(F.col("id") / 2).alias("b"))
    for r in df.collect():
        assert r.a == f"{r.id / 1000.0:.2f}" and r.b == round(r.id / 2 / 1000.0, 3)
    rnd = random.Random(2)
    values = [rnd.uniform(-50, 50) for _ in range(3000)] + [k / 16 for k in range(-200, 200)] + [k / 2000 for k in range(-999, 999)]
    for digits in (1, 2, 3, 4):
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.round_exact(F.col("v"), digits).alias("o")).collect()
        assert [r.o for r in got] == [round(r.v, digits) for r in got]


RAW = {
    "plain": ('{"overall": {"score": 3, "rationale": "ok"}, "extra": {"score": 1}}', "ok", {"overall": 3}, 0.0),
    "fenced": ('```json\n{"overall": {"score": "4"}, "student_realism": {"score": 2.9}}\n```', "ok", {"overall": 4, "student_realism": 2}, 2.0),
    "not an entry": ('{"overall": 3, "student_realism": {"rationale": "x"}}', "ok", {}, 0.0),
    "empty": ("{}", "ok", {}, 0.0),
    "cut": ('{"overall": {"score": 3}', "parse_error", None, None),
    "trailing": ('{"overall": {"score": 3}} yes', "parse_error", None, None),
    "two": ('{"overall": {"score": 3}}, {}', "parse_error", None, None),
    "array": ("[1]", "parse_error", None, None),
    "fraction in text": ('{"overall": {"score": "4.5"}}', "parse_error", None, None),
    "null score": ('{"overall": {"score": null}}', "parse_error", None, None),
    "blank": ("", "parse_error", None, None),
}


def test_rubric_parsing(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in RAW.items()], "id string, raw string")
    got = {r.id: r for r in rubrics.parse_responses(df, NAIVE_RUBRIC).collect()}
    for name, (raw, status, scores, mean) in RAW.items():
        r = got[name]
        assert r.status == status, name
        assert (None if r.scores is None else {k: v.score for k, v in r.scores.items()}) == scores, name
        assert r.mean_component_score == mean, name
        assert r.raw == (raw if status == "parse_error" else None), name


def test_failed_calls_are_errors_and_raw_is_kept_short(spark):
    df = spark.createDataFrame([("a", None, "boom"), ("b", "x" * 1500, None)], "id string, raw string, error string")
    got = {r.id: r for r in rubrics.parse_responses(df, TAXONOMY_RUBRIC, error="error").collect()}
    assert got["a"].status == "error" and got["a"].raw is None
    assert got["b"].status == "parse_error" and len(got["b"].raw) == 1000


def test_leaderboard_order_and_n(spark):
    df = spark.createDataFrame(
        [("r1", 0, "B", "overall", 2), ("r1", 1, "A", "overall", 5), ("r2", 0, "C", "student_realism", 1), ("r1", 1, "A", "student_realism", 4)],
        "run string, conv_index long, label string, criterion string, score int",
    )
    got = [(r["rank"], r.label, r.n, r.engagement, r.naturalness) for r in rubrics.leaderboard(df, NAIVE_RUBRIC, "overall").orderBy("rank").collect()]
    assert got == [(1, "A", 0, 5.0, 4.0), (2, "B", 1, 2.0, None), (3, "C", 0, None, 1.0)]


def test_cache_merge(spark):
    cache = spark.createDataFrame([("r", 0, "ok", 1), ("r", 1, None, 2), ("r", 2, "error", 3), ("r", 3, "skipped", 4), ("r", 9, "error", 5)], "run string, conv_index long, status string, result long")
    todo = spark.createDataFrame([("r", i) for i in range(5)], "run string, conv_index long")
    keys = ("run", "conv_index")
    plan = work.merge_cache(cache, todo, keys)
    assert rows(plan, "conv_index", "action") == [(0, "reuse"), (1, "reuse"), (2, "compute"), (3, "reuse"), (4, "compute"), (9, "keep")]
    assert {r.action for r in work.merge_cache(cache, todo, keys, force=True).filter("conv_index < 5").collect()} == {"compute"}
    fresh = spark.createDataFrame([("r", 2, "ok", 30), ("r", 4, "ok", 40)], "run string, conv_index long, status string, result long")
    assert rows(work.merge_results(plan, fresh, keys), "conv_index", "result") == [(0, 1), (1, 2), (2, 30), (3, 4), (4, 40), (9, 5)]


def test_plan_selection_and_sample(spark):
    q = spark.createDataFrame([("a", 0), ("b", 1)], "pid string, ord long")
    done = spark.createDataFrame([("a", 1)], "pid string, attempt_index int")
    assert [(r.pid, r.attempt_index) for r in work.work_plan(q, 2, done).orderBy("ord", "attempt_index").collect()] == [("a", 0), ("b", 0), ("b", 1)]
    wanted = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "b"), (3, "a")], "ord long, pid string")
    found, missing = work.select_pids(q.select("pid"), wanted)
    assert [r.pid for r in found.orderBy("ord").collect()] == ["b", "a"] and [r.pid for r in missing.collect()] == ["zz"]
    big = spark.range(1000)
    a = [r.id for r in work.seeded_sample(big, "id", 50, seed=3).collect()]
    assert a == [r.id for r in work.seeded_sample(big.repartition(13), "id", 50, seed=3).collect()] == sorted(a) and len(a) == 50
    assert a != [r.id for r in work.seeded_sample(big, "id", 50, seed=4).collect()]


def test_sorting_puts_missing_last(spark):
    df = spark.createDataFrame([("r", 0, 1.0), ("r", 1, None), ("r", 2, 3.0)], "run string, conv_index long, v double")
    assert [r.conv_index for r in work.sort_rows(df, "v").collect()] == [0, 2, 1]
    assert [r.conv_index for r in work.sort_rows(df, "v", descending=True).collect()] == [2, 0, 1]


def test_manifest_drift(spark):
    cols = "run string, kind string, name string, value string"
    a = spark.createDataFrame([("r", "arg", "attempts", "1"), ("r", "arg", "port", "1"), ("r", "prompt", "tutor", "x")], cols)
    b = spark.createDataFrame([("r", "arg", "attempts", "2"), ("r", "arg", "port", "2"), ("r", "arg", "split", "t"), ("r", "prompt", "tutor", "x")], cols)
    assert rows(work.manifest_drift(a, b), "name", "saved", "current") == [("attempts", "1", "2"), ("split", None, "t")]


def test_leaves_of_any_depth(spark):
    doc = {"a": {"x": 1, "y": {"z": 2.5, "t": True, "s": "no"}}, "b": {"q": [1, 2]}, "c": 7}
    df = spark.createDataFrame([("k", json.dumps(doc)), ("bad", "{")], "k string, r string")
    assert rows(leaves.numeric_leaves_json(df, "r", ["k"]), "evaluator", "path", "value") == [("a", "x", 1.0), ("a", "y.z", 2.5), ("c", "", 7.0)]


def test_end_cut_and_chat_view(spark):
    turns = spark.createDataFrame([(0, 0, "student", "hi"), (0, 1, "tutor", "bye [END]"), (0, 2, "student", "late"), (1, 0, "student", "a"), (1, 1, "tutor", "b"), (1, 2, "student", "c")], "c long, turn long, role string, text string")
    assert rows(transcripts.cut_at_end(turns, ["c"], 2), "c", "turn") == [(0, 0), (0, 1), (1, 0), (1, 1)]
    prompts = spark.createDataFrame([(0, "tutor", "P")], "c long, agent string, content string")
    view = transcripts.chat_view(turns.filter("c = 0"), ["c"], prompts).filter("agent = 'tutor'").orderBy("position")
    assert [(r.chat_role, r.content) for r in view.collect()] == [("system", "P"), ("user", "hi"), ("assistant", "bye [END]"), ("user", "late")]


def test_choices(spark):
    assert one(spark, ["p", "q"], T.lettered_choices, "array<string>") == "Choices:\n  A. p\n  B. q"
    assert one(spark, [], T.lettered_choices, "array<string>") == ""


def test_decode_frames(spark):
    got = one(spark, "0.1,0.5,0.5,0,0 1,2 x,1,1,1,1  0,0,0,0,1", frames.decode_frames)
    assert [(f.label, f.probs) for f in got] == [("NA", [0.1, 0.5, 0.5, 0, 0]), ("T", [0, 0, 0, 0, 1])]
    assert one(spark, "", frames.decode_frames) == []


@pytest.mark.parametrize("duration", [24_000, 160_000, 160_020, 161_000, 270_500, 185_000])
def test_chunks_cover_everything_once(spark, duration):
    f = spark.range(0, -(-duration // 20)).select(F.lit("r").alias("run"), F.lit(0).cast("long").alias("conv_index"), F.col("id").alias("frame"), (F.col("id") * 20).alias("t_ms"))
    d = spark.createDataFrame([("r", 0, duration)], "run string, conv_index long, duration_ms long")
    got = frames.stitch_chunks(frames.chunk_frames(f, frames.chunk_plan(d)))
    assert rows(got, "frame") == rows(f, "frame")
    if duration > 160_000:
        assert got.filter("t_ms < 25000").select("chunk").distinct().count() == 1


def test_label_windows_tail(spark):
    f = spark.createDataFrame([("r", 0, t, "C") for t in (0, 29_960, 30_000, 60_000)], "run string, conv_index long, t_ms long, label string")
    for total, want in ((60_200, 2), (60_240, 3)):
        tot = spark.createDataFrame([("r", 0, total)], "run string, conv_index long, total_ms long")
        assert frames.label_windows(f, tot).count() == want
        assert frames.label_windows(f, tot, max_windows=1).count() == 1


def test_word_segments_compare_with_the_previous_word(spark):
    cols = "run string, conv_index long, role string, word_no long, word string, start_ms long, end_ms long"
    w = spark.createDataFrame([("r", 0, "t", 0, "a", 0, 5000), ("r", 0, "t", 1, "b", 100, 200), ("r", 0, "t", 2, "c", 1201, 1300), ("r", 0, "t", 3, "d", 2300, 2400)], cols)
    got = rows(words.words_to_segments(w), "seg_no", "start_ms", "end_ms", "text")
    assert got == [(0, 0, 5000, "a b"), (1, 1201, 2400, "c d")]
    assert rows(words.words_to_segments(w, joiner="", end="last"), "end_ms", "text") == [(200, "ab"), (2400, "cd")]


def test_aligned_words(spark):
    doc = {"run": "r", "conv_index": 0, "segments": [
        {"role": "tutor", "start_time": 1.0, "end_time": 2.0, "words": [{"word": "a", "start_time": 1.0, "end_time": 1.25, "confidence": -2.5}, {"word": "b", "start_time": None, "end_time": 2.0}]},
        {"role": "student", "start_time": 3.0, "end_time": 4.0, "words": None},
    ]}
    from pyspark.sql.types import StringType, StructField, StructType

    df = spark.read.schema(StructType([StructField("run", StringType()), *ALIGNED.fields])).json(spark.sparkContext.parallelize([json.dumps(doc)]))
    assert rows(words.flatten_words(df), "word", "start_ms", "low_confidence") == [("a", 1000, True)]
    assert rows(words.word_intervals(df), "role", "start_ms", "end_ms") == [("student", 3000, 4000), ("tutor", 1000, 1250)]


def test_lines(spark, tmp_path):
    p = tmp_path / "run1"
    p.mkdir()
    (p / "conversations.jsonl").write_text('{"pid": "a"}\n\n{"pid": "b", "conv_index": 7}\n{"pid": \n{"pid": "c", "segments": [{"role": "tutor", "start_time": 0.5, "end_time": 1.0}]}\n')
    good, bad = lines.split_bad(lines.read_tolerant(spark, str(p), CONVERSATION))
    assert rows(lines.with_dense_index(good), "pid", "conv_index") == [("a", 0), ("b", 7), ("c", 2)]
    assert [r._corrupt for r in bad.collect()] == ['{"pid": ']
    segs = flatten.segment_rows(lines.with_dense_index(good), "run1")
    assert rows(segs, "conv_index", "role", "start_ms", "text") == [(2, "tutor", 500, "")]
    with pytest.raises(Exception):
        lines.read_strict(spark, str(p), CONVERSATION).collect()
    (tmp_path / "_skip").mkdir()
    (tmp_path / "_skip" / "conversations.jsonl").write_text("{}\n")
    (tmp_path / "x__aligned").mkdir()
    (tmp_path / "x__aligned" / "conversations.jsonl").write_text("{}\n")
    found = runs.discover_runs(spark, str(tmp_path), "conversations.jsonl")
    assert rows(found, "run", "n_records") == [("run1", 4)]


def test_whole_file_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"problem": "p", "dialog_history": [{"user": "Teacher", "text": " x "}, {"user": null, "text": null}]}]')
    df = lines.read_json(spark, str(tmp_path), TUTORING_EXAMPLE, multi_line=True).withColumn("conv_index", F.lit(0).cast("long"))
    assert rows(imports.dialog_segments(df), "seg_id", "role", "text", "end_ms") == [(0, "tutor", "x", 1000), (1, "student", "", 2000)]


def test_question_defaults(spark):
    df = spark.createDataFrame([(1, "q", 2, 3.5)], "pid long, question string, answer long, skill double")
    r = imports.question_table(df).first()
    assert (r.pid, r.answer, r.query, r.choices, json.loads(r.metadata)) == ("1", "2", "q", [], {"skill": 3.5})


class RateLimitError(Exception):
    pass


def test_retry():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RateLimitError("slow down")
        return "ok"

    import talkmetry.plans.evaluators as ev

    sleep, ev.time.sleep = ev.time.sleep, waits.append
    try:
        assert evaluators.patiently(flaky) == "ok" and waits == [2.0, 4.0]
        with pytest.raises(ValueError):
            evaluators.patiently(lambda: (_ for _ in ()).throw(ValueError("no")))
        with pytest.raises(RateLimitError):
            evaluators.patiently(lambda: (_ for _ in ()).throw(RateLimitError()), evaluators.doubling(attempts=2))
    finally:
        ev.time.sleep = sleep


def test_unknown_evaluator():
    with pytest.raises(ValueError):
        evaluators.build(["stats", "nope"])


def test_thresholds_travel_with_rows(spark):
    r = spark.range(1).select(timing.thresholds_column()).first().thresholds
    assert r.asDict() == THRESHOLDS.as_dict()


def test_rubric_takes_the_last_of_repeated_keys(spark):
    from talkmetry.constants import NAIVE_RUBRIC
    from talkmetry.functions.rubric import add_outcome

    key, other = NAIVE_RUBRIC.keys[:2]
    texts = [
        f'{{"{key}": {{"score": 1}}, "{key}": {{"score": 2, "score": 4, "rationale": null}}}}',
        f'{{"{key}": {{"score": 1}}, "{other}": {{"score": 3, "rationale": "r"}}, "{key}": 7}}',
    ]
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys", None)
    got = [r["_scores"] for r in add_outcome(spark.createDataFrame([(t,) for t in texts], "raw string"), "raw", NAIVE_RUBRIC).collect()]
    assert {k: tuple(v) for k, v in got[0].items()} == {key: (4, "")}
    assert {k: tuple(v) for k, v in got[1].items()} == {other: (3, "r")}
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", None) == before


def test_json_leaves_of_any_depth(spark):
    from talkmetry.operators import leaves

    deep = lambda n: '{"a":' * n + "1" + "}" * n
    docs = [
        '{"e": {"x": 1, "y": {"z": 2.5, "t": true, "s": "7", "l": [1, 2], "n": null}}, "top": 3, "f": {"": 4}}',
        '{"e": {"x": 1, "x": 9}}', '{"big": ' + "1" * 400 + ', "wide": 12345678901234567890123, "huge": 1e30}',
        deep(20), deep(3000), "[1]", "5", "no json", None, "{}", '{"e": {}}',
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, r string").withColumns({"value": F.lit("x"), "path": F.lit("y")})
    got = {}
    for r in leaves.numeric_leaves_json(df, "r", ["id"]).collect():
        got.setdefault(r["id"], []).append((r["evaluator"], r["path"], r["value"]))
    assert sorted(got.pop(0)) == [("e", "x", 1.0), ("e", "y.z", 2.5), ("f", "", 4.0), ("top", "", 3.0)]
    assert got.pop(1) == [("e", "x", 9.0)]
    assert sorted(got.pop(2)) == [("big", "", float("inf")), ("huge", "", 1e30), ("wide", "", 12345678901234567890123.0)]
    assert got.pop(3) == [("a", ".".join("a" * 19), 1.0)]
    assert not got


def test_means_of_odd_numbers(spark):
    from talkmetry.functions.text import exact_mean, round_exact
    from talkmetry.operators import leaves

    inf, nan = float("inf"), float("nan")
    values = {"plain": [0.1, 0.2, 0.3], "nan": [nan, 1.0], "huge": [1e30, 1e30], "inf": [inf, 2.0], "none": [None], "mixed": [2.0**40, 0.5], "neg": [-0.0015, -0.0025, None], "long": [5e9] * 4}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(exact_mean(F.col("v"), 3).alias("m")).collect()}
    assert got.pop("nan") != got.get("nan") and got.pop("none") is None
    assert got == {"plain": 0.2, "huge": 1e30, "inf": inf, "mixed": round((2.0**40 + 0.5) / 2, 3), "neg": -0.002, "long": 5e9}
    rolled = leaves.leaf_rollup(df.filter("k IN ('nan', 'huge')").selectExpr("'e' AS evaluator", "k AS path", "v AS value")).collect()
    rolled = {r["path"]: (str(r["mean"]), str(r["min"]), str(r["max"]), r["n"]) for r in rolled}
    assert rolled == {"nan": ("nan", "nan", "nan", 2), "huge": ("1e+30", "1e+30", "1e+30", 2)}
    numbers = [2.0115, 1e18, -1e300, 0.0005, 0.0015, 2.5, 4503599627370.4955, inf]
    back = spark.createDataFrame([(x,) for x in numbers], "v double").select("v", round_exact(F.col("v"), 3).alias("r")).collect()
    assert all(r["r"] == round(r["v"], 3) for r in back)


def test_groups_are_written_to_few_files(spark, tmp_path):
    import os

    from talkmetry.sinks import write

    df = spark.range(0, 20_000, 1, 200).selectExpr("id % 10 AS k", "id AS v", "uuid() AS text")
    write.write_per_group(df, str(tmp_path / "small"), ["k"], "parquet")
    files = {d: len([f for f in os.listdir(tmp_path / "small" / d) if f.startswith("part")]) for d in os.listdir(tmp_path / "small") if d.startswith("k=")}
    assert len(files) == 10 and max(files.values()) <= 2 and spark.read.parquet(str(tmp_path / "small")).count() == 20_000
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:  # a group of half the rows is split
        write.write_per_group(df.withColumn("k", F.when(F.col("v") % 2 == 0, -1).otherwise(F.col("k"))), str(tmp_path / "large"), ["k"], "parquet")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    parts = {d: len([f for f in os.listdir(tmp_path / "large" / d) if f.startswith("part")]) for d in os.listdir(tmp_path / "large") if d.startswith("k=")}
    assert 3 <= parts["k=-1"] <= 20 and max(parts.values()) == parts["k=-1"]


def test_conversations_without_parts_and_with_defaults(spark):
    convs = spark.createDataFrame([("p", 1234, {"k": "v"}), ("q", 0, None)], "pid string, duration_ms long, metadata map<string,string>")
    none = spark.createDataFrame([], "pid string, seg_id long, role string, text string, start_ms long, end_ms long, audio_path string")
    got = {r["pid"]: json.loads(r["json"]) for r in transcripts.call_json(convs, none, ["pid"]).collect()}
    assert got["p"]["segments"] == [] and got["p"]["duration"] == 1.234 and got["p"]["metadata"] == {"k": "v"} and got["q"]["metadata"] == {}
    assert got["p"]["attempt_index"] == 0 and got["p"]["question"] == "" and "image_path" not in got["p"]
    said = spark.createDataFrame([("p", "tutor", 'two "x"\n', 2, ""), ("p", "student", "one", 1, "a.wav")], "pid string, role string, content string, turn int, audio_path string")
    got = {r["pid"]: json.loads(r["json"]) for r in transcripts.conversation_json(convs, said).collect()}
    assert got["q"]["utterances"] == [] and got["p"]["num_turns"] == 2
    assert got["p"]["utterances"] == [{"role": "student", "content": "one", "turn": 1, "audio_path": "a.wav"}, {"role": "tutor", "content": 'two "x"\n', "turn": 2}]


def test_a_status_of_the_class_is_seen():
    class Busy(Exception):
        code = 503

    class Asked(Exception):
        @property
        def status_code(self):
            return 429

    class Wrong(Exception):
        code = 400

    for error, tries in ((Busy(), 3), (Asked(), 3), (Wrong(), 1)):
        seen = []

        def call(error=error, seen=seen):
            seen.append(1)
            raise error

        with pytest.raises(type(error)):
            evaluators.patiently(call, (0, 0))
        assert len(seen) == tries


def test_report_sections(spark):
    """One report a conversation: several models of one rubric, a failed call, a second rubric and metrics where there are any."""
    scores = {"overall": (4, " fine "), "scaffolding_quality": (2, None)}
    kind = "run string, conv_index long, status string, judge_model string, error string, scores map<string,struct<score:int,rationale:string>>, mean_component_score double"
    naive = spark.createDataFrame([("r", 0, "ok", "b", None, scores, 2.0), ("r", 0, "error", "a", "no answer", None, None)], kind)
    taxonomy = spark.createDataFrame([("r", 1, "ok", "t", None, {"tutor_tone": (5, "kind")}, 5.0)], kind)
    convs = spark.createDataFrame(
        [("r", i, f"p{i}", 0, q, "42", None, None, "v", None, 1500) for i, q in enumerate(["one\ntwo", None])],
        "run string, conv_index long, pid string, attempt_index int, question string, answer string, tutor_backend string, student_backend string, "
        "tutor_voice string, student_voice string, duration_ms long")
    lines = spark.createDataFrame([("r", 0, 0, "  [   0.00s] TUTOR: hi")], "run string, conv_index long, part int, text string")
    segments = spark.createDataFrame(
        [("r", 0, 0, "tutor", 0, 1000, "a b"), ("r", 0, 1, "student", 1250, 2000, "c")],
        "run string, conv_index long, seg_id long, role string, start_ms long, end_ms long, text string")
    got = transcripts.conversation_reports(
        convs, lines, naive, more_judged=[(taxonomy, TAXONOMY_RUBRIC)], stats=conversation_stats(segments), timing=turn_taking(segments)).collect()
    text = {r["conv_index"]: r["report"] for r in got}
    assert len(got) == 2
    rule = "-" * 72
    assert f"QUESTION\n{rule}\n  one\n  two\n\nGround" in text[0] and f"QUESTION\n{rule}\n\nGround" in text[1]
    assert f"\n\nLLM JUDGE (naive)\n{rule}\n  Status: error\n  Error: no answer\n\nLLM JUDGE (naive)\n{rule}\n  Model: b   Mean component score: 2.0/5\n\n  Naturalness\n" in text[0]
    assert "    Overall                    4/5\n      fine\n" in text[0] and "BEA" not in text[0]
    assert f"\n\nSTATS\n{rule}\n  duration_s: 2.0\n  num_segments: 2\n  role_switches: 1\n  tutor_segments: 1\n" in text[0]
    assert f"\n\nTURN-TAKING\n{rule}\n  response_latency_s: {{'mean': 0.25, 'median': 0.25, 'p90': 0.25, 'count': 1}}\n  overlap_s: 0.000\n" in text[0]
    assert text[0].endswith("backchannel_ratio: 0.000\n")
    assert "  Model: ?   Mean component score: --/5\n" in text[1] and "STATS" not in text[1] and "TURN-TAKING" not in text[1]
    assert "NAACL 2025)" in text[1] and "    Tutor tone                 5/5\n      kind\n" in text[1]
