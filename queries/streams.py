"""Structured Streaming jobs over the events table, run to completion (available now)
into the shared folder and read back.

The streams take events in file order. In append mode a window or session is emitted once
the watermark (latest time seen minus the delay) passes its end; an end marker then closes
what is open, so the results are those of the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import inputs as I
from queries.inputs import with_ctes
from talkmetry.constants import KEYS
from talkmetry.operators.conversation import spoken_ms
from talkmetry.session import ROCKSDB_PROVIDER, STATE_STORE_KEY, shared_dir
from talkmetry.streaming import incremental, live

DELAY = "10 seconds"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """The segment view as a stream of tokens stamped 2024-01-01 plus their start."""
    schema = I.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    start = F.expr("us div 10000000")
    end_mark = F.when(F.col("event_id") % 97 == 0, F.lit("[END]")).otherwise(F.lit(""))
    return stream.select("event_id", "user_id", I.micros().alias("us")).select(
        I._run().alias("run"),
        I._conv().alias("conv_index"),
        F.when(F.col("event_id") % 2 == 0, F.lit("tutor")).otherwise(F.lit("student")).alias("role"),
        F.concat(F.lit("w"), (F.col("event_id") % 10).cast("string"), end_mark).alias("text"),
        F.col("event_id").alias("seq"),
        F.timestamp_millis(F.lit(1704067200000).cast("long") + start).alias("ts"),
    )


def _finish(spark: SparkSession, build, source: DataFrame, name: str) -> DataFrame:
    """Run ``build`` over the source to the end of its input and read the result back. The source has no
    rate limit, so its input is one batch."""
    path, marker = shared_dir(spark, name), shared_dir(spark, f"{name}-end")
    out = build(live.with_end_marker(source, marker))
    incremental.run_to_end(out, path, shared_dir(spark, f"{name}-state"), marker, one_batch=True)
    return spark.read.schema(out.schema).parquet(path)


def _millis(column: str):
    return (F.unix_millis(column) - 1704067200000).alias(column)


def _segments(spark, d):
    return _finish(spark, lambda t: live.token_segments(t, DELAY), tokens(spark, d), "stream-segments").select(*KEYS, "role", _millis("start_ts"), _millis("end_ts"), "text")


def _windows(spark, d):
    labels = F.array(*[F.lit(x) for x in I.LABEL_NAMES])
    stream = tokens(spark, d).withColumn("label", labels[(F.col("seq") % 5).cast("int")])
    return _finish(spark, lambda t: live.label_windows(t, DELAY), stream, "stream-windows").select(*KEYS, _millis("window_start"), "n_frames", *I.LABEL_NAMES)


MAX_WINDOWS = 4


def _label_windows(spark, d):
    """Windows on each conversation's clock, at most four, without a short tail."""
    spark.conf.set(STATE_STORE_KEY, ROCKSDB_PROVIDER)
    labels = F.array(*[F.lit(x) for x in I.LABEL_NAMES])
    stream = tokens(spark, d).withColumns({"label": labels[(F.col("seq") % 5).cast("int")], "t_ms": F.unix_millis("ts") - 1704067200000})
    return _finish(spark, lambda t: live.conversation_windows(t, DELAY, max_windows=MAX_WINDOWS), stream, "stream-label-windows")


PIECE_TOKENS = 2


def _pieces(spark, d):
    """Segments in pieces of two tokens."""
    spark.conf.set(STATE_STORE_KEY, ROCKSDB_PROVIDER)
    out = _finish(spark, lambda t: live.segment_pieces(t, DELAY, max_tokens=PIECE_TOKENS), tokens(spark, d), "stream-pieces")
    return out.select(*KEYS, "role", _millis("start_ts"), "part", _millis("end_ts"), "text", "closed")


def _sliding(spark, d):
    return _finish(spark, lambda t: live.sliding_means(t, "seq", DELAY), tokens(spark, d), "stream-sliding").select(*KEYS, _millis("chunk_start"), "n_frames", "n_fresh", "fresh_sum", "chunk_sum")


def _dedup(spark, d):
    """Repeats of (conversation, minute) as repeated (pid, attempt)."""
    stream = tokens(spark, d).select(
        F.concat_ws("-", "run", F.col("conv_index").cast("string")).alias("pid"),
        F.floor((F.unix_millis("ts") - 1704067200000) / 60000).cast("int").alias("attempt_index"),
        "ts",
    )
    out, path = live.first_attempts(stream, "1 hour"), shared_dir(spark, "stream-dedup")
    incremental.run_available(out, path, shared_dir(spark, "stream-dedup-state"))
    return spark.read.schema(out.schema).parquet(path).select("pid", "attempt_index")


def _ends(spark, d):
    spark.conf.set(STATE_STORE_KEY, ROCKSDB_PROVIDER)
    return _finish(spark, lambda t: live.conversation_ends(t, DELAY), tokens(spark, d), "stream-ends").select(*KEYS, "reason", _millis("started"), _millis("ended"), "n_tokens")


def _incremental(spark, d):
    """Score the events file by file as it arrives; failed rows are due again."""
    schema = I.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)

    def score(batch: DataFrame) -> DataFrame:
        status = F.when(F.col("user_id") % 9 == 0, F.lit("error")).otherwise(F.lit("ok"))
        return batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event")).withColumn("status", status)

    path = shared_dir(spark, "incremental")
    for _ in range(2):  # a second run finds nothing new
        incremental.score_stream(stream, score, path, path + "-state", ["user_id"])
    return incremental.latest_results(spark, path, ["user_id"]).select("user_id", "n", "last_event", "status")


BATCHES = 6


def _incremental_batches(spark, d):
    """The events in files of their own, one a batch: users come back in later batches, and some scores fail until the last one."""
    events = I.table(spark, d, "events")
    source = shared_dir(spark, "incremental-batches-in")
    events.repartitionByRange(BATCHES, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    path, keys, failed = shared_dir(spark, "incremental-batches"), ["user_id"], F.col("status") == "error"

    def score(rows: DataFrame) -> DataFrame:
        out = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"), F.sum("value").cast("decimal(18,2)").alias("total"))
        return out.withColumn("status", F.when((F.col("user_id") % 9 == 0) & (F.col("n") < 3), "error").otherwise("ok"))

    incremental.score_stream(stream, score, path, path + "-state", keys, failed, buckets=16, merge=3)
    incremental.retry_failed(spark, score, path, keys, failed, buckets=16, merge=3)
    return incremental.latest_results(spark, path, keys).select("user_id", "n", "last_event", "status")


QUERIES = {
    "stream_label_windows": _label_windows,
    "stream_pieces": _pieces,
    "stream_incremental_batches": _incremental_batches,
    "stream_segments": _segments,
    "stream_windows": _windows,
    "stream_sliding": _sliding,
    "stream_dedup": _dedup,
    "stream_ends": _ends,
    "stream_incremental": _incremental,
}

_TOK = """tok AS (SELECT run, conv_index, role, seg_id AS seq, start_ms AS ms, concat('w', CAST(seg_id % 10 AS VARCHAR), CASE WHEN seg_id % 97 = 0 THEN '[END]' ELSE '' END) AS text FROM seg)"""

ORACLES = {
    "stream_segments": with_ctes(
        "seg",
        f"""WITH {_TOK}, f AS (SELECT *, CAST(coalesce(ms - lag(ms) OVER w > 1000, FALSE) AS INT) AS o FROM tok WINDOW w AS (PARTITION BY run, conv_index, role ORDER BY ms, seq)),
        g AS (SELECT *, sum(o) OVER (PARTITION BY run, conv_index, role ORDER BY ms, seq) AS no FROM f)
        SELECT run, conv_index, role, min(ms) AS start_ts, max(ms) AS end_ts, string_agg(text, '' ORDER BY ms, seq) AS text FROM g
        GROUP BY run, conv_index, role, no""",
    ),
    "stream_windows": with_ctes(
        "seg",
        f"""WITH {_TOK} SELECT run, conv_index, ms // 30000 * 30000 AS window_start, count(*) AS n_frames,
        {", ".join(f"count(*) FILTER (WHERE seq % 5 = {i}) AS {x}" for i, x in enumerate(I.LABEL_NAMES))} FROM tok
        GROUP BY 1, 2, 3""",
    ),
    "stream_sliding": with_ctes(
        "seg",
        f"""WITH {_TOK}, c AS (SELECT run, conv_index, (ms // 5000 - k) * 5000 AS chunk_start, ms, seq FROM tok, range(5) r(k))
        SELECT run, conv_index, chunk_start, count(*) AS n_frames, count(*) FILTER (WHERE ms >= chunk_start + 20000) AS n_fresh,
        CAST(sum(seq) FILTER (WHERE ms >= chunk_start + 20000) AS BIGINT) AS fresh_sum, CAST(sum(seq) AS BIGINT) AS chunk_sum FROM c
        GROUP BY 1, 2, 3""",
    ),
    # A conversation ends with its last frame (40 ms); a last window below 240 ms is left out.
    "stream_label_windows": with_ctes(
        "seg",
        f"""WITH {_TOK}, t AS (SELECT run, conv_index, max(ms) + 40 AS total FROM tok GROUP BY 1, 2),
        w AS (SELECT run, conv_index, ms // 30000 AS window_index, count(*) AS n_frames,
        {", ".join(f"count(*) FILTER (WHERE seq % 5 = {i}) AS {x}" for i, x in enumerate(I.LABEL_NAMES))} FROM tok GROUP BY 1, 2, 3)
        SELECT run, conv_index, window_index, window_index * 30000 / 1000.0::DOUBLE AS window_start_s, least((window_index + 1) * 30000, total) / 1000.0::DOUBLE AS window_end_s,
        n_frames, {", ".join(I.LABEL_NAMES)} FROM w JOIN t USING (run, conv_index)
        WHERE window_index < {MAX_WINDOWS} AND least((window_index + 1) * 30000, total) - window_index * 30000 >= 240""",
    ),
    "stream_pieces": with_ctes(
        "seg",
        f"""WITH {_TOK}, f AS (SELECT *, CAST(coalesce(ms - lag(ms) OVER w > 1000, FALSE) AS INT) AS o FROM tok WINDOW w AS (PARTITION BY run, conv_index, role ORDER BY ms, seq)),
        g AS (SELECT *, sum(o) OVER (PARTITION BY run, conv_index, role ORDER BY ms, seq) AS no FROM f),
        p AS (SELECT *, (row_number() OVER (PARTITION BY run, conv_index, role, no ORDER BY ms, seq) - 1) // {PIECE_TOKENS} AS part, min(ms) OVER (PARTITION BY run, conv_index, role, no) AS start_ts FROM g),
        q AS (SELECT run, conv_index, role, no, start_ts, part, max(ms) AS end_ts, string_agg(text, '' ORDER BY ms, seq) AS text FROM p GROUP BY ALL)
        SELECT run, conv_index, role, start_ts, part, end_ts, text, part = max(part) OVER (PARTITION BY run, conv_index, role, no) AS closed FROM q""",
    ),
    "stream_incremental_batches": "SELECT user_id, count(*) AS n, max(event_id) AS last_event, CASE WHEN user_id % 9 = 0 AND count(*) < 3 THEN 'error' ELSE 'ok' END AS status FROM events GROUP BY user_id",
    "stream_dedup": with_ctes("seg", "SELECT DISTINCT concat(run, '-', CAST(conv_index AS VARCHAR)) AS pid, CAST(start_ms // 60000 AS INT) AS attempt_index FROM seg"),
    # The end is the first of: end token, a silence of 10 s, 300 s of length; a
    # conversation still open when the input ends falls silent.
    "stream_ends": with_ctes(
        "seg",
        f"""WITH {_TOK}, n AS (SELECT *, lead(ms) OVER (PARTITION BY run, conv_index ORDER BY ms, seq) AS nxt, row_number() OVER (PARTITION BY run, conv_index ORDER BY ms, seq) AS pos,
        min(ms) OVER (PARTITION BY run, conv_index) AS started FROM tok),
        e AS (SELECT *, CASE WHEN text LIKE '%[END]%' THEN 'end_token' WHEN nxt IS NULL OR nxt - ms >= 10000 THEN 'silence' END AS reason FROM n)
        SELECT run, conv_index, reason, started, CASE reason WHEN 'silence' THEN ms + 10000 ELSE ms END AS ended, pos AS n_tokens FROM e WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run, conv_index ORDER BY pos) = 1""",
    ),
    "stream_incremental": "SELECT user_id, count(*) AS n, max(event_id) AS last_event, CASE WHEN user_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status FROM events GROUP BY user_id",
}
