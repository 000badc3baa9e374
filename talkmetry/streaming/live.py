"""Live conversations as Structured Streaming jobs.

The batch rules apply unchanged; a watermark (which the batch form does not need)
bounds the state and decides when a result is final. What is still open when the input
ends is closed by an end marker: one row far in the future that moves the watermark past
everything and takes no part in any result (``with_end_marker``, ``mark_end``).

State that Spark's aggregates do not have comes to Python with a key's rows and goes back with its results: a call
to the state store for each key and value costs more than the work on an ordinary conversation.
"""

from __future__ import annotations

import bisect
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from talkmetry.constants import (
    CHUNK_CONTEXT_MS,
    CHUNK_STEP_MS,
    END_TOKEN,
    FRAME_LABELS,
    LABEL_FRAME_MS,
    LABEL_MIN_TAIL_MS,
    LABEL_WINDOW_MS,
    MAX_DURATION_MS,
    SEGMENT_SILENCE_MS,
    SILENCE_TIMEOUT_MS,
)
from talkmetry.functions.text import WHITESPACE, strip

CONV = ("run", "conv_index")
END_OF_INPUT = "2200-01-01 00:00:00"
FORGET_MS = 86_400_000


def with_end_marker(stream: DataFrame, folder: str) -> DataFrame:
    """``stream`` (with its time in ``ts``) followed by whatever ``mark_end`` puts into ``folder``."""
    spark = stream.sparkSession
    spark.createDataFrame([], "ts timestamp").write.mode("append").parquet(folder)
    marker = spark.readStream.schema("ts timestamp").parquet(folder)
    return stream.unionByName(marker, allowMissingColumns=True)


def mark_end(spark: SparkSession, folder: str) -> None:
    """The input is complete: the next run of the query emits what is still open."""
    spark.range(1).select(F.lit(END_OF_INPUT).cast("timestamp").alias("ts")).write.mode("append").parquet(folder)


def _watched(stream: DataFrame, delay: str) -> DataFrame:
    """Watermark over all rows; the end marker goes no further. The condition names the time
    column, so it is applied behind the watermark."""
    return stream.withWatermark("ts", delay).filter(_before_end())


def _before_end() -> Column:
    return F.col("ts") < F.lit(END_OF_INPUT).cast("timestamp")


def _wake_at(state: GroupState, ms: int) -> None:
    """The key's timer; one that is due goes off with the next watermark."""
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))


def token_segments(tokens: DataFrame, delay: str = "10 seconds", gap_ms: int = SEGMENT_SILENCE_MS) -> DataFrame:
    """Close a role's segment after more than one second of silence.

    ``tokens``: run, conv_index, role, text, ts, seq. The session window merges an event at
    exactly the gap and splits beyond it. Text is joined in arrival order; blank
    segments are dropped.
    """
    session = F.session_window("ts", f"{gap_ms} milliseconds")
    return (
        _watched(tokens, delay)
        .groupBy(*CONV, "role", session.alias("w"))
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.array_sort(F.collect_list(F.struct("ts", "seq", "text"))).alias("_t"),
        )
        .withColumn("text", strip(F.array_join(F.transform("_t", lambda t: t["text"]), "")))
        .filter(F.col("text") != "")
        .select(*CONV, "role", "start_ts", "end_ts", "text")
    )


def label_windows(labels: DataFrame, delay: str = "10 seconds", window_ms: int = LABEL_WINDOW_MS) -> DataFrame:
    """Counts per label in non-overlapping event-time windows."""
    w = F.window("ts", f"{window_ms} milliseconds")
    return (
        _watched(labels, delay)
        .groupBy(*CONV, w.alias("w"))
        .agg(F.count(F.lit(1)).alias("n_frames"), *[F.count_if(F.col("label") == x).alias(x) for x in FRAME_LABELS])
        .select(*CONV, F.col("w.start").alias("window_start"), "n_frames", *FRAME_LABELS)
    )


LABELLED = StructType(
    [
        StructField("run", StringType()),
        StructField("conv_index", LongType()),
        StructField("window_index", LongType()),
        StructField("window_start_s", DoubleType()),
        StructField("window_end_s", DoubleType()),
        StructField("n_frames", LongType()),
        *[StructField(label, LongType()) for label in FRAME_LABELS],
    ]
)
#: Latest frame on the conversation's clock, its time stamp, and the open windows as JSON: {index: [frames, one count per label]}.
_WINDOWS = StructType([StructField("last_ms", LongType()), StructField("last_us", LongType()), StructField("open", StringType())])


def conversation_windows(
    labels: DataFrame,
    delay: str = "10 seconds",
    window_ms: int = LABEL_WINDOW_MS,
    max_windows: int | None = None,
    min_tail_ms: int = LABEL_MIN_TAIL_MS,
    frame_ms: int = LABEL_FRAME_MS,
    close_ms: int = FORGET_MS,
) -> DataFrame:
    """Label counts per non-overlapping window of a conversation, by the rules of ``frames.label_windows``.

    ``labels``: run, conv_index, t_ms (on the conversation's clock), label, ts. A conversation is as long as its last frame's
    end. A last window shorter than ``min_tail_ms`` is left out, and so are windows from number ``max_windows`` on. A
    window goes out when a frame behind it has come and the watermark has passed its end; the last one, whose length is not known
    before, when the conversation has been quiet for ``close_ms`` or the end marker comes. State: one number per label and
    open window, of which there are as many as fit into the delay, and the last. A batch is counted piece by piece, so a
    conversation's share of it is never held as a whole.
    """
    names = [f.name for f in LABELLED.fields]
    width = len(FRAME_LABELS) + 1

    def windows(key, counts: dict[str, list[int]], total_ms: int) -> Iterator[pd.DataFrame]:
        out = []
        for index in sorted(map(int, counts)):
            start, end = index * window_ms, min((index + 1) * window_ms, total_ms)
            if end - start >= min_tail_ms:
                out.append([key[0], key[1], index, start / 1000.0, end / 1000.0, *counts[str(index)]])
        if out:
            yield pd.DataFrame(out, columns=names)

    def step(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ms, last_us, text = state.get if state.exists else (-1, 0, "{}")
        counts = json.loads(text)
        if state.hasTimedOut:
            state.remove()
            yield from windows(key, counts, last_ms + frame_ms)
            return
        for part in rows:
            # Not a filter on the stream: that would go below the watermark and take the end marker with it.
            part = part.dropna(subset=["t_ms"])
            if part.empty:
                continue
            t, us = part["t_ms"].astype("int64"), part["ts"].astype("datetime64[us]").astype("int64")
            last_ms, last_us = max(last_ms, int(t.max())), max(last_us, int(us.max()))
            index = t // window_ms
            if max_windows is not None:
                part, index = part[index < max_windows], index[index < max_windows]
            for (i, label), n in Counter(zip(index.tolist(), part["label"].tolist())).items():
                own = counts.setdefault(str(i), [0] * width)
                own[0] += n
                if label in FRAME_LABELS:
                    own[1 + FRAME_LABELS.index(label)] += n
        if last_ms < 0:
            return
        # The stamp of a window's end on the clock of the time stamps; frames before it are late once the watermark is there.
        passed_ms = last_ms + (state.getCurrentWatermarkMs() - last_us // 1000)
        done = {i: c for i, c in counts.items() if (int(i) + 1) * window_ms <= min(passed_ms, last_ms)}
        state.update((last_ms, last_us, json.dumps({i: c for i, c in counts.items() if i not in done})))
        _wake_at(state, -(-last_us // 1000) + close_ms)
        yield from windows(key, done, last_ms + frame_ms)

    return (
        _watched(labels, delay)
        .select(*CONV, "t_ms", "label", "ts")
        .groupBy(*CONV)
        .applyInPandasWithState(step, LABELLED, _WINDOWS, "append", GroupStateTimeout.EventTimeTimeout)
    )


PIECES = StructType(
    [
        StructField("run", StringType()),
        StructField("conv_index", LongType()),
        StructField("role", StringType()),
        StructField("start_ts", TimestampType()),
        StructField("part", LongType()),
        StructField("end_ts", TimestampType()),
        StructField("text", StringType()),
        StructField("closed", BooleanType()),
    ]
)
#: As JSON: the open segment [start, last time, tokens of the piece, part, its text, anything said] and the waiting tokens [time, seq, text].
_SEGMENT = StructType([StructField("open", StringType()), StructField("waiting", StringType())])


def segment_pieces(
    tokens: DataFrame, delay: str = "10 seconds", gap_ms: int = SEGMENT_SILENCE_MS, max_tokens: int = 4096
) -> DataFrame:
    """The segments of ``token_segments`` in pieces of at most ``max_tokens`` tokens, for roles that may never pause.

    A piece goes out as soon as it is full; the last one of a segment has ``closed`` set and the segment's end. Joined in the order
    of ``part`` (``join_pieces``), they are the segment. Tokens wait in the state until the watermark has passed them, so that late
    ones take their place; of the open segment only the current piece is kept. White space at a segment's edges is dropped: at the
    start as it comes, behind the last word by handing it on to the next piece. Blank segments give nothing.
    """
    names = [f.name for f in PIECES.fields]

    def step(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Take the waiting tokens before the watermark in order, close what has been silent, set the next timer."""
        open_, held = map(json.loads, state.get) if state.exists else (None, [])
        until_us = state.getCurrentWatermarkMs() * 1000
        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64")
            held += map(list, zip(us.tolist(), part["seq"].tolist(), part["text"].tolist()))
        held.sort()
        ready = bisect.bisect_left(held, [until_us])
        out: list[list] = []

        def send(closed: bool) -> None:
            nonlocal open_
            start, last, n, part, text, said = open_
            rest = text[len(text.rstrip(WHITESPACE)) :]
            if said:
                stamp = [pd.Timestamp(us, unit="us") for us in (start, last)]
                out.append([*key, stamp[0], part, stamp[1], text.rstrip(WHITESPACE), closed])
            open_ = None if closed else (start, last, 0, part + said, rest, said)

        for us, _, text in held[:ready]:
            if open_ and us - open_[1] > gap_ms * 1000:
                send(True)
            if open_ and open_[2] == max_tokens:
                send(False)
            start, _, n, part, before, said = open_ or (us, us, 0, 0, "", False)
            text = before + (text or "")
            if not said:
                text = text.lstrip(WHITESPACE)
            open_ = (start, us, n + 1, part, text, said or bool(text))
        if open_ and until_us - open_[1] > gap_ms * 1000:
            send(True)
        due = [t[0] for t in held[ready : ready + 1]] + ([open_[1] + gap_ms * 1000] if open_ else [])
        if due:
            state.update((json.dumps(open_), json.dumps(held[ready:])))
            _wake_at(state, min(due) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    return (
        _watched(tokens, delay)
        .select(*CONV, "role", "ts", "seq", "text")
        .groupBy(*CONV, "role")
        .applyInPandasWithState(step, PIECES, _SEGMENT, "append", GroupStateTimeout.EventTimeTimeout)
    )


def join_pieces(pieces: DataFrame) -> DataFrame:
    """Segments of stored pieces, for those that fit into one row: run, conv_index, role, start_ts, end_ts, text."""
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return pieces.groupBy(*CONV, "role", "start_ts").agg(F.max("end_ts").alias("end_ts"), text.alias("text"))


def sliding_means(frames: DataFrame, value: str, delay: str = "30 seconds") -> DataFrame:
    """Per 25 s chunk (sliding by 5 s): mean over its last 5 s and over the whole chunk."""
    size = CHUNK_CONTEXT_MS + CHUNK_STEP_MS
    w = F.window("ts", f"{size} milliseconds", f"{CHUNK_STEP_MS} milliseconds")
    fresh = F.col("ts") >= F.col("w.end") - F.expr(f"INTERVAL {CHUNK_STEP_MS / 1000} SECONDS")
    return (
        _watched(frames, delay)
        .withColumn("w", w)
        .groupBy(*CONV, "w")
        .agg(
            F.count(F.lit(1)).alias("n_frames"),
            F.count_if(fresh).alias("n_fresh"),
            F.sum(F.when(fresh, F.col(value))).alias("fresh_sum"),
            F.sum(value).alias("chunk_sum"),
        )
        .select(*CONV, F.col("w.start").alias("chunk_start"), "n_frames", "n_fresh", "fresh_sum", "chunk_sum")
    )


def first_attempts(convs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (pid, attempt_index) once, as long as repeats arrive within the delay."""
    return convs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["pid", "attempt_index"])


ENDED = StructType(
    [
        StructField("run", StringType()),
        StructField("conv_index", LongType()),
        StructField("reason", StringType()),
        StructField("started", TimestampType()),
        StructField("ended", TimestampType()),
        StructField("n_tokens", LongType()),
    ]
)
_STATE = StructType(
    [
        StructField("first_us", LongType()),
        StructField("last_us", LongType()),
        StructField("n", LongType()),
        StructField("done", BooleanType()),
    ]
)


def conversation_ends(
    tokens: DataFrame,
    delay: str = "10 seconds",
    max_duration_ms: int = MAX_DURATION_MS,
    silence_ms: int = SILENCE_TIMEOUT_MS,
    forget_ms: int = FORGET_MS,
) -> DataFrame:
    """One row when a conversation ends: end token, maximum length, or silence.

    State is four numbers per conversation. Tokens are taken in time order within a
    micro-batch; those after the end are ignored until the conversation is forgotten, ``forget_ms`` after it ended,
    which keeps the state from growing for ever. An event-time timer at ``last +
    silence`` fires when the watermark passes it. One conversation's share of a batch is
    held in memory, so bound the batch at the source (``maxBytesPerTrigger``).
    """
    names = [f.name for f in ENDED.fields]

    def finish(key, state: GroupState, reason: str, first: int, end: int, n: int) -> pd.DataFrame:
        forget = -(-end // 1000) + forget_ms
        if forget > state.getCurrentWatermarkMs():
            state.update((first, end, n, True))
            _wake_at(state, forget)
        elif state.exists:
            state.remove()
        return pd.DataFrame([[key[0], key[1], reason, pd.Timestamp(first, unit="us"), pd.Timestamp(end, unit="us"), n]], columns=names)

    def step(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, done = state.get if state.exists else (None, None, 0, False)
        if state.hasTimedOut:
            quiet, longest = (None, None) if done else (last + silence_ms * 1000, first + max_duration_ms * 1000)
            if done:
                state.remove()
            elif quiet <= longest:
                yield finish(key, state, "silence", first, quiet, n)
            else:
                yield finish(key, state, "max_duration", first, longest, n)
            return
        if done:
            _wake_at(state, -(-last // 1000) + forget_ms)  # input takes the timer away
            return
        batch = pd.concat(rows)
        stamps = batch["ts"].astype("datetime64[us]").astype("int64")
        for us, _, text in sorted(zip(stamps.tolist(), batch["seq"].tolist(), batch["text"].tolist()), key=lambda t: t[:2]):
            if first is None:
                first = us
            elif us - last >= silence_ms * 1000:
                yield finish(key, state, "silence", first, last + silence_ms * 1000, n)
                return
            if us - first >= max_duration_ms * 1000:
                yield finish(key, state, "max_duration", first, first + max_duration_ms * 1000, n)
                return
            last, n = us, n + 1
            if END_TOKEN in text:
                yield finish(key, state, "end_token", first, us, n)
                return
        state.update((first, last, n, False))
        _wake_at(state, -(-min(last + silence_ms * 1000, first + max_duration_ms * 1000) // 1000))

    return (
        _watched(tokens, delay)
        .groupBy(*CONV)
        .applyInPandasWithState(step, ENDED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
