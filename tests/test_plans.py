"""The end-to-end plans over the derived views, written and read back."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queries import inputs as I
from queries import systems, transcript
from talkmetry.operators import events as E
from talkmetry.plans import analysis
from talkmetry.plans import evaluators as P
from talkmetry.session import shared_dir
from talkmetry.sinks import write


def test_score_and_compare(spark, sf):
    scored = analysis.score_turn_taking(I.segments(spark, sf), I.frames(spark, sf))
    want = transcript.classified(spark, sf)
    assert rows(scored["events"], "run", "conv_index", "t_ms", "cell", "cue_label") == rows(want, "run", "conv_index", "t_ms", "cell", "cue_label")
    out = analysis.compare_systems(
        I.scores(spark, sf), I.frames(spark, sf), scored["cells"], scored["timing_samples"], systems.REFERENCE
    )
    assert rows(out["fi_rates"]) == rows(systems.QUERIES["fi_summary"](spark, sf))
    assert rows(out["quality_means"]) == rows(systems.QUERIES["system_means_ci"](spark, sf))
    assert out["reference_distances"].count() == 20
    assert out["fi_pairs"].filter(F.col("scope") == "tutor").count() == 10
    path = shared_dir(spark, "cells")
    write.rewrite_sorted(scored["cells"], path)
    assert spark.read.parquet(path).count() == scored["cells"].count()


def test_no_event_is_lost_where_frames_are_missing(spark, sf):
    frames = I.frames(spark, sf).filter("frame % 10 <> 3")
    scored = analysis.score_turn_taking(I.segments(spark, sf), frames)
    spans = E.frame_ranges(frames).drop("n_frames")
    kept = E.kept_events(E.turn_events(transcript._runs(spark, sf), spans))
    by_grid = E.read_frames(kept.join(spans.drop("t_hi"), ["run", "conv_index"]), frames, I.FRAME_STEP_MS)
    n = scored["events"].count()
    assert n == kept.count() > by_grid.count()
    assert rows(scored["events"], "run", "conv_index", "t_ms", "holder", "p_now0") == rows(E.nearest_frames(kept, frames), "run", "conv_index", "t_ms", "holder", "p_now0")


def test_missing_components_are_left_out(spark, sf):
    assert set(analysis.compare_systems(samples=systems.samples(spark, sf))) == set()


def test_nearest_frame_on_a_regular_grid_agrees(spark, sf):
    kept = E.kept_events(E.turn_events(transcript._runs(spark, sf), E.frame_ranges(I.frames(spark, sf)).drop("n_frames")))
    frames = I.frames(spark, sf)
    by_index = E.read_frames(kept, frames, I.FRAME_STEP_MS)
    for limit in (10**9, 50):
        by_time = E.nearest_frames(kept, frames, limit)
        cols = ("run", "conv_index", "t_ms", "holder", "p_now0", "p_future1")
        assert rows(by_time, *cols) == rows(by_index, *cols)


def test_bucketed_table_joins_without_a_shuffle(spark, sf):
    stats = I.segments(spark, sf).groupBy("run", "conv_index").agg(F.count("*").alias("n"))
    write.bucketed_table(stats, "bucketed_stats", 4)
    a, b = spark.table("bucketed_stats"), spark.table("bucketed_stats").withColumnRenamed("n", "m")
    joined = a.hint("merge").join(b, ["run", "conv_index"])
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == stats.count()


def test_a_key_over_several_batches_is_scored_as_a_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from talkmetry.streaming import incremental

    for n, ids in enumerate((range(0, 40), range(40, 70), range(70, 75))):
        part = spark.createDataFrame([(i % 7, i) for i in ids], "k long, v long").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def score(batch):
        return batch.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).withColumn("status", F.lit("ok"))

    incremental.score_stream(stream, score, str(tmp_path / "out"), str(tmp_path / "state"), ["k"])
    got = {r["k"]: (r["n"], r["s"]) for r in incremental.latest_results(spark, str(tmp_path / "out"), ["k"]).collect()}
    assert got == {k: (len(range(k, 75, 7)), sum(range(k, 75, 7))) for k in range(7)}


def test_streams_over_several_files_end_like_the_batch(spark, tmp_path):
    """One file per batch; the last segment and conversation are closed by the end marker only."""
    from talkmetry.streaming import incremental, live

    base = 1_704_067_200_000
    said = [("r", 1, t, i) for i, t in enumerate((0, 400, 1400, 2500, 3000, 30_000, 30_500))] + [("r", 2, 29_000 + 900 * i, 10 + i) for i in range(4)]
    for lo, hi in ((0, 1000), (1000, 29_500), (29_500, 40_000)):
        part = spark.createDataFrame([(r, c, t, s) for r, c, t, s in said if lo <= t < hi], "run string, conv_index long, t long, seq long").coalesce(1)
        part.selectExpr("run", "conv_index", "'tutor' AS role", "concat('w', seq) AS text", "seq", f"timestamp_millis({base} + t) AS ts").write.mode("append").parquet(str(tmp_path / "in"))

    def run(build, name):
        schema = "run string, conv_index long, role string, text string, seq long, ts timestamp"
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = build(live.with_end_marker(source, str(tmp_path / f"{name}-end")))
        incremental.run_to_end(out, str(tmp_path / name), str(tmp_path / f"{name}-state"), str(tmp_path / f"{name}-end"))
        return spark.read.schema(out.schema).parquet(str(tmp_path / name))

    segments = run(live.token_segments, "segments")
    assert rows(segments, "conv_index", "text") == [(1, "w0w1w2"), (1, "w3w4"), (1, "w5w6"), (2, "w10w11w12w13")]
    ends = run(live.conversation_ends, "ends")
    assert rows(ends, "conv_index", "reason", "n_tokens") == [(1, "silence", 5), (2, "silence", 4)]


def _parts(spark, folder, batches):
    """One parquet file per batch, oldest first."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.parquet(f"{folder}/{i:03d}")
        for f in os.listdir(f"{folder}/{i:03d}"):
            os.utime(f"{folder}/{i:03d}/{f}", (time.time() + i, time.time() + i))
    return spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_incremental_batches_read_the_buckets_of_their_keys(spark, tmp_path, monkeypatch):
    """Twenty batches: one key in all of them, one null key, others in one or two. Rows read follow the keys touched."""
    from talkmetry.streaming import incremental

    n = 20
    batches = [[("all", i), (None, i), *[(f"b{i}-{j}", j) for j in range(60)], *[(f"b{i - 1}-{j}", 100) for j in range(3) if i]] for i in range(n)]
    read = []
    of_keys = incremental.Arrivals.of_keys

    def counted(self, touched, batch_id):
        wanted = [r[0] for r in touched.select(self.bucket()).distinct().collect()]
        rows = self._read(self.folders(batch_id)).where(incremental.F.col("_bucket").isin(wanted)).count()
        read.append((batch_id, rows, len(self.folders(batch_id)), touched.count()))
        return of_keys(self, touched, batch_id)

    monkeypatch.setattr(incremental.Arrivals, "of_keys", counted)
    stream = _parts(spark, str(tmp_path / "in"), batches)

    def score(rows):
        return rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))

    incremental.score_stream(stream, score, str(tmp_path / "out"), str(tmp_path / "state"), ["k"], buckets=1024, merge=3)
    got = {r["k"]: (r["n"], r["s"]) for r in incremental.latest_results(spark, str(tmp_path / "out"), ["k"]).collect()}
    want = {}
    for rows in batches:
        for k, v in rows:
            c, s = want.get(k, (0, 0))
            want[k] = c + 1, s + v
    assert got == want
    assert [b for b, *_ in read] == list(range(n))
    history = 0
    for (b, rows, folders, keys), arrived in zip(read, batches):
        history += len(arrived)
        # The two long keys' rows, the touched keys' own, and what shares a bucket with them: a key's share of 1024 buckets.
        assert rows <= 2 * (b + 1) + keys + 3 + 3 * (1 + keys * history / 1024)
        assert folders <= 3 * 3
    assert read[-1][1] < history / 3


def test_incremental_failures_are_due_again(spark, tmp_path):
    """A failed key is scored again with the next batch, and by retry_failed without one; others are not."""
    from talkmetry.streaming import incremental

    out, state, source = str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "in")
    tries = []

    def score(rows):
        tries.append(sorted(r["k"] for r in rows.select("k").distinct().collect()))
        bad = F.lit(len(tries) < 4) & (F.col("k") == "bad")
        return rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("status", F.when(bad, "error").otherwise("ok"))

    failed = F.col("status") == "error"
    stream = _parts(spark, source, [[("bad", 1), ("good", 1)], [("new", 1)]])
    incremental.score_stream(stream, score, out, state, ["k"], failed)
    assert incremental.retry_failed(spark, score, out, ["k"], failed) and incremental.retry_failed(spark, score, out, ["k"], failed)
    assert not incremental.retry_failed(spark, score, out, ["k"], failed)
    assert tries == [["bad", "good"], ["bad", "new"], ["bad"], ["bad"]]
    got = {r["k"]: (r["n"], r["status"]) for r in incremental.latest_results(spark, out, ["k"]).collect()}
    assert got == {"bad": (1, "ok"), "good": (1, "ok"), "new": (1, "ok")}
    incremental.score_stream(stream, score, out, state, ["k"], failed)
    assert len(tries) == 4


def test_arrivals_survive_a_replayed_batch_and_merge(spark, tmp_path):
    from talkmetry.streaming.incremental import Arrivals

    rows = Arrivals(spark, str(tmp_path / "rows"), ["k"], buckets=4, merge=2)
    for i in range(9):
        for _ in range(2):  # every batch is written, and merged, twice
            rows.add(spark.createDataFrame([(f"k{i % 3}", i)], "k string, v long"), i)
        keys = spark.createDataFrame([("k0",), ("k1",), ("k2",)], "k string")
        assert sorted(r["v"] for r in rows.of_keys(keys, i).collect()) == list(range(i + 1))
    assert [f.rsplit("/", 2)[-2:] for f in rows.folders(8)] == [["g=3", "n=0"], ["g=0", "n=8"]]


def _tokens_in_files(spark, folder, said, columns, *edges):
    """One file per stretch of time, oldest first."""
    import os
    import time

    schema = "run string, conv_index long, t_ms long, seq long"
    for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = spark.createDataFrame([x for x in said if lo <= x[2] < hi], schema).coalesce(1)
        part.selectExpr(*columns, "timestamp_millis(1704067200000 + t_ms) AS ts").write.parquet(f"{folder}/{n}")
        for f in os.listdir(f"{folder}/{n}"):
            os.utime(f"{folder}/{n}/{f}", (time.time() + n, time.time() + n))


@pytest.mark.parametrize("max_windows", [None, 3])
def test_stream_windows_follow_the_batch_rule(spark, tmp_path, max_windows):
    """Windows over several batches, a tail that is too short, one that is long enough, a window that fills late."""
    from talkmetry.operators import frames as N
    from talkmetry.streaming import incremental, live

    said = [("r", 1, 40 * i, i) for i in range(2255)]  # 90.2 s: the last window has 200 ms
    said += [("r", 2, 40 * i, i) for i in range(2000)] + [("r", 3, 10, 1), ("r", 4, 65_000, 1), ("r", 4, 65_500, 2)]
    said += [("r", 5, 29_000, 3), ("r", 5, 30_050, 4)]
    columns = ["run", "conv_index", "t_ms", "element_at(array('C', 'NA', 'I', 'BC', 'T', null), int(seq % 6) + 1) AS label"]
    _tokens_in_files(spark, str(tmp_path / "in"), said, columns, 0, 20_000, 45_000, 75_000, 100_000)
    source = spark.readStream.schema("run string, conv_index long, t_ms long, label string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = live.conversation_windows(live.with_end_marker(source, str(tmp_path / "end")), max_windows=max_windows)
    path = str(tmp_path / "out")
    incremental.run_available(out, path, str(tmp_path / "state"))
    early = spark.read.schema(out.schema).parquet(path)
    assert {(x["conv_index"], x["window_index"]) for x in early.collect()} >= {(1, 0), (1, 1), (2, 0), (2, 1)}
    incremental.run_to_end(out, path, str(tmp_path / "state"), str(tmp_path / "end"))
    frames = spark.read.parquet(*[f"{tmp_path}/in/{n}" for n in range(4)])
    totals = frames.groupBy("run", "conv_index").agg((F.max("t_ms") + 40).alias("total_ms"))
    assert rows(spark.read.schema(out.schema).parquet(path)) == rows(N.label_windows(frames, totals, max_windows=max_windows))


def test_segments_that_never_pause_go_out_in_pieces(spark, tmp_path):
    """Pieces of bounded size leave while the segment is open; joined, they are the segments of the plain form."""
    from talkmetry.streaming import incremental, live

    said = [("r", 1, 300 * i, i) for i in range(200)] + [("r", 2, t, i) for i, t in enumerate((0, 400, 1400, 2401, 2500, 30_000, 41_000, 41_100))]
    columns = ["run", "conv_index", "'tutor' AS role", "seq", "CASE WHEN seq % 7 = 0 THEN '  ' WHEN seq % 5 = 0 THEN 'w ' ELSE concat('v', seq) END AS text"]
    _tokens_in_files(spark, str(tmp_path / "in"), said, columns, 0, 20_000, 40_000, 70_000)
    schema = "run string, conv_index long, role string, seq long, text string, ts timestamp"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def run(build, name):
        out = build(live.with_end_marker(source, str(tmp_path / f"{name}-end")))
        incremental.run_available(out, str(tmp_path / name), str(tmp_path / f"{name}-state"))
        early = spark.read.schema(out.schema).parquet(str(tmp_path / name)).collect()
        incremental.run_to_end(out, str(tmp_path / name), str(tmp_path / f"{name}-state"), str(tmp_path / f"{name}-end"))
        return early, spark.read.schema(out.schema).parquet(str(tmp_path / name))

    early, pieces = run(lambda t: live.segment_pieces(t, max_tokens=8), "pieces")
    assert sum(x["conv_index"] == 1 for x in early) >= 15 and not any(x["closed"] for x in early if x["conv_index"] == 1)
    assert max(len(x["text"]) for x in pieces.collect()) <= 8 * 4 + 2
    assert pieces.filter("closed").count() == pieces.select("conv_index", "start_ts").distinct().count()
    whole = run(live.token_segments, "segments")[1]
    assert rows(live.join_pieces(pieces)) == rows(whole)


def test_plugin_groups_in_common_batches(spark):
    """A group's rows, order and types are its own however batches are cut, and groups are dealt to as many tasks as named."""

    def seen(pdf):
        if pdf["extra"].dtype == "float64":
            raise ValueError(f"{int(pdf['extra'].isna().sum())} of {len(pdf)}")
        return {"first": int(pdf["seg_id"].iloc[0]), "top": int(pdf["extra"].max()), "size": len(pdf)}

    def seen_of_all(parts):
        return {"firsts": ",".join(str(x) for x in parts["first"]), "top": int(parts["top"].max()), "rows": int(parts["size"].sum())}

    big, n = 2**60 + 1, 30
    segs = spark.createDataFrame(
        [("r", c, s, big + c) for c in range(n) for s in range(c + 1)] + [("r", None, s, big) for s in range(3)],
        "run string, conv_index long, seg_id long, extra long",
    )
    fields = T.StructType.fromDDL
    ev = P.conversation_plugin("seen", seen, fields("first long, top long, size long"), fields("firsts string, top long, rows long"), seen_of_all, chunk_rows=4)
    asked = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(asked)
    want = {c: (",".join(str(f) for f in range(0, c + 1, 4)), big + c, c + 1, "ok", None) for c in range(n)}
    want |= {None: ("0", big, 3, "ok", None)}
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set(asked, size)
            out = ev.run(P.Tables(segs))
            assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
            assert {r["conv_index"]: tuple(r)[2:] for r in out.collect()} == want
        broken = segs.filter("conv_index IN (3, 5)").withColumn("extra", F.when(~((F.col("conv_index") == 3) & (F.col("seg_id") == 2)), F.col("extra")))
        got = {r["conv_index"]: tuple(r)[2:] for r in ev.run(P.Tables(broken)).collect()}
        assert got == {3: (None, None, None, "error", "1 of 4"), 5: want[5]}
    finally:
        spark.conf.set(asked, before)
