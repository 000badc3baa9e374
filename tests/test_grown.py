"""Queries on copies of the given tables with shifted keys, against their SQL, and the plans they run by."""

import os

import check
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from queries import inputs
from talkmetry.operators import events, frames, timing

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture
def conf(spark):
    """Sets session settings for one test."""
    before = {}

    def put(**values):
        for key, value in values.items():
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield lambda values: put(**values)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def grown(spark, sf, folder, table, shifts, times):
    """A folder with the tables of ``sf``, ``table`` repeated ``times`` times with ``shifts`` (column to distance) added."""
    for name in os.listdir(sf):
        if name != f"{table}.parquet":
            os.symlink(f"{sf}/{name}", f"{folder}/{name}")
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    copies = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    copies.select(*[(F.col(c) + F.col("_k") * shifts[c]).alias(c) if c in shifts else F.col(c) for c in rows.columns]).coalesce(1).write.parquet(f"{folder}/_all")
    part = next(f for f in os.listdir(f"{folder}/_all") if f.endswith(".parquet"))
    os.symlink(f"{folder}/_all/{part}", f"{folder}/{table}.parquet")
    return str(folder)


def test_arrays_in_one_file_each(spark, sf, conf, tmp_path):
    """Rows and brackets of a file stay together however the planner coalesces."""
    d = grown(spark, sf, tmp_path, "conversations", {"conv_id": 1000}, 8)
    conf({"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.shuffle.partitions": "16"})
    ok, note = check.compare(spark, check.connect(d), d, "json_auto_scan", QUERIES["json_auto_scan"], SQL["json_auto_scan"])
    assert ok, note


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_frames_are_not_broadcast(spark):
    """However small frames and chunk slots look to the planner, they are dealt by key."""
    seen = spark.sql("SELECT string(id) AS run, id AS conv_index, id AS frame, 0.1D AS p_now0, 0.9D AS p_now1, 0.2D AS p_future0, 0.8D AS p_future1 FROM range(9)")
    asked = spark.sql("SELECT string(id) AS run, id AS conv_index, id * 40 AS t_ms FROM range(9)")
    for smooth in (1, 3):
        assert "Broadcast" not in planned(events.read_frames(asked, seen, 500, smooth))
    onsets = spark.sql("SELECT string(id) AS run, id AS conv_index, 900L AS onset_ms FROM range(9)")
    assert "Broadcast" not in planned(frames.frame_clock(seen, onsets))


def test_slots_are_not_broadcast(spark):
    lengths = spark.sql("SELECT string(id) AS run, id AS conv_index, 90000L AS duration_ms FROM range(9)")
    times = spark.sql("SELECT string(id) AS run, id AS conv_index, id * 40 AS t_ms FROM range(9)")
    assert "Broadcast" not in planned(frames.chunk_frames(times, frames.chunk_plan(lengths)))


def test_cue_shares_read_their_input_once(spark):
    seen = spark.createDataFrame([("r", "tutor", "Early-Yield"), ("r", "tutor", "Weak-Hold")], "run string, holder string, cue_label string")
    got = events.cue_shares(seen)
    assert planned(got).count("Scan") == 1
    assert {(r["role"], r["label"]): (r["count"], r["pct"]) for r in got.collect() if r["count"]} == {("tutor", "Early-Yield"): (1, 50.0), ("tutor", "Weak-Hold"): (1, 50.0)}
    assert [r["pct"] for r in got.filter("role = 'student'").collect()] == [None] * 6


def test_frames_are_dealt_before_they_are_made(spark, sf):
    """As many tasks as the session names make the frames, not the few that their conversations fit into."""
    made = inputs.frames(spark, sf)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_runs_are_dealt_before_they_are_sorted(spark):
    """The planner does not fill the sorts of the runs, and of the events between them, into a few tasks by bytes."""
    named = int(spark.conf.get("spark.sql.shuffle.partitions"))
    said = spark.sql("SELECT string(id % 3) AS run, id % 9 AS conv_index, IF(id % 2 = 0, 'tutor', 'student') AS role, id * 700 AS start_ms, id * 700 + 400 AS end_ms FROM range(99)")
    runs = timing.speech_runs(said)
    assert runs.rdd.getNumPartitions() == named
    for made in (timing.timing_samples(runs), events.turn_events(runs)):
        assert made.rdd.getNumPartitions() == named


def test_frames_of_odd_events(spark, tmp_path):
    """Events without a time, or before the clock starts, move no frame."""
    rows = "SELECT * FROM VALUES (0, CAST(NULL AS TIMESTAMP), 7, 2.0D), (1, TIMESTAMP '2023-12-31 23:59:57', 7, 1.0D), (2, TIMESTAMP '2024-01-01 00:00:01', 7, 0.5D) t(event_id, ts, user_id, value)"
    spark.sql(rows).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["frame"]: r["p_now0"] for r in inputs.frames(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(541))
    assert got[2] == (2 * 37 + 101 + 7 * 13 + 50) % 1000 / 1000 and got[3] == (3 * 37 + 101 + 7 * 13) % 1000 / 1000
