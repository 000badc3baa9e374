"""Word timings: flattening, segmentation on silence, cleaning of aligned intervals.

``words``: run, conv_index, role, word_no (list position), word, start_ms, end_ms, confidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmetry.constants import (
    ALIGN_MIN_MS,
    KEYS,
    LOW_CONFIDENCE,
    SEGMENT_SILENCE_MS,
    SILENCE_LABELS,
)
from talkmetry.functions.text import strip
from talkmetry.operators.ordered import Scan, hot_keys, scan


def to_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds."""
    return F.round(seconds * 1000).cast("long")


def flatten_words(aligned: DataFrame) -> DataFrame:
    """Role-tagged word rows of nested aligned conversations; words without both times
    are dropped, low confidence is flagged.

    ``aligned``: run, conv_index, segments array<struct<role, ..., words array<struct<word,
    start_time, end_time, confidence>>>>.
    """
    return (
        aligned.select(*KEYS, F.posexplode("segments").alias("seg_id", "seg"))
        .select(*KEYS, "seg_id", F.col("seg.role").alias("role"), F.posexplode("seg.words").alias("word_no", "w"))
        .filter(F.col("w.start_time").isNotNull() & F.col("w.end_time").isNotNull())
        .select(
            *KEYS,
            "seg_id",
            "role",
            "word_no",
            F.coalesce(F.col("w.word"), F.lit("")).alias("word"),
            to_ms(F.col("w.start_time")).alias("start_ms"),
            to_ms(F.col("w.end_time")).alias("end_ms"),
            (F.col("w.confidence") < LOW_CONFIDENCE).alias("low_confidence"),
        )
    )


def word_intervals(aligned: DataFrame) -> DataFrame:
    """Interval rows of a nested conversation: timed words, or the segment itself where a
    segment has none."""
    timed = F.filter(
        F.coalesce(F.col("seg.words"), F.array()),
        lambda w: w["start_time"].isNotNull() & w["end_time"].isNotNull(),
    )
    spans = F.transform(
        timed, lambda w: F.struct(w["start_time"].alias("s"), w["end_time"].alias("e"))
    )
    whole = F.array(F.struct(F.col("seg.start_time").alias("s"), F.col("seg.end_time").alias("e")))
    return (
        aligned.select(*KEYS, F.posexplode("segments").alias("seg_id", "seg"))
        .select(*KEYS, "seg_id", F.col("seg.role").alias("role"), F.explode(F.when(F.size(spans) > 0, spans).otherwise(whole)).alias("i"))
        .select(*KEYS, "seg_id", "role", to_ms(F.col("i.s")).alias("start_ms"), to_ms(F.col("i.e")).alias("end_ms"))
    )


def segment_numbers(
    words: DataFrame,
    gap_ms: int = SEGMENT_SILENCE_MS,
    keys: Sequence[str] = (*KEYS, "role"),
    limit: int | None = None,
) -> DataFrame:
    """Add ``seg_no`` and ``seg_pos`` (place inside the segment): a segment starts after a
    silence longer than ``gap_ms`` since the *previous word's* end (not the latest end so
    far)."""
    hot = hot_keys(words, keys, "word_no", limit)
    placed = scan(words, keys, ["word_no"], Scan(prev={"_prev_end": "end_ms"}, index="_at"), hot=hot)
    after_silence = F.coalesce(F.col("start_ms") - F.col("_prev_end") > gap_ms, F.lit(False))
    flagged = placed.withColumns(
        {
            "_opened": after_silence.cast("long"),
            "_open_at": F.when(after_silence | (F.col("_at") == 0), F.col("_at")),
        }
    )
    spec = Scan(sum_before={"_segs": "_opened"}, max_before={"_last_open": "_open_at"})
    numbered = scan(flagged, keys, ["word_no"], spec, hot=hot)
    return numbered.select(
        *words.columns,
        (F.col("_segs") + F.col("_opened")).alias("seg_no"),
        (F.col("_at") - F.coalesce("_open_at", "_last_open")).alias("seg_pos"),
    )


def words_to_segments(
    words: DataFrame,
    gap_ms: int = SEGMENT_SILENCE_MS,
    keys: Sequence[str] = (*KEYS, "role"),
    joiner: str = " ",
    end: str = "max",
    limit: int | None = None,
    per_part: int | None = None,
) -> DataFrame:
    """Segments with text, times and their words in order.

    ``end="max"`` takes the latest word end, ``end="last"`` the last word's. Blank
    segments are dropped. A segment is one row (``part`` 0) whatever its length. Where the caller gives
    ``per_part``, speech without a silence continues in further rows after so many words.
    """
    numbered = segment_numbers(words, gap_ms, keys, limit)
    item = F.struct("word_no", "word", "start_ms", "end_ms", *(["confidence"] if "confidence" in words.columns else []))
    part = F.floor(F.col("seg_pos") / per_part).cast("int") if per_part else F.lit(0)
    last_end = F.max("end_ms") if end == "max" else F.max_by("end_ms", "word_no")
    return (
        numbered.groupBy(*keys, "seg_no", part.alias("part"))
        .agg(
            F.min_by("start_ms", "word_no").alias("start_ms"),
            last_end.alias("end_ms"),
            F.array_sort(F.collect_list(item)).alias("words"),
        )
        .withColumn("text", strip(F.array_join(F.transform("words", lambda w: w["word"]), joiner)))
        .filter(F.col("text") != "")
    )


def extend_segments(segments: DataFrame, audio: DataFrame, limit: int | None = None) -> DataFrame:
    """Stretch each segment to the next one of its role, the last to the audio's end.

    ``audio``: run, conv_index, audio_ms. Starts are floored at 0 and an end never lies
    before its start.
    """
    keys = [*KEYS, "role"]
    rows = segments.select(*keys, "seg_id", F.greatest(F.lit(0), F.col("start_ms")).alias("start_ms"))
    nexts = scan(rows, keys, ["seg_id"], Scan(next={"next_start": "start_ms"}), limit)
    return nexts.join(audio, list(KEYS)).select(
        *keys,
        "seg_id",
        "start_ms",
        F.greatest(F.col("start_ms"), F.coalesce("next_start", "audio_ms")).alias("end_ms"),
    )


def drop_silence(labels: DataFrame, offset: str = "offset_ms") -> DataFrame:
    """Drop silence labels and move the rest by their segment's offset."""
    word = strip(F.col("word"))
    return labels.filter(~F.lower(word).isin(*SILENCE_LABELS)).withColumns(
        {
            "word": word,
            "start_ms": F.col("start_ms") + F.col(offset),
            "end_ms": F.col("end_ms") + F.col(offset),
        }
    )


def clamp_to_audio(segments: DataFrame, audio: DataFrame, min_ms: int = ALIGN_MIN_MS) -> DataFrame:
    """Clamp to [0, audio length]; drop what is blank or shorter than ``min_ms``."""
    start = F.greatest(F.lit(0), F.col("start_ms"))
    end = F.least(F.col("audio_ms"), F.col("end_ms"))
    return (
        segments.filter(strip(F.col("text")) != "")
        .join(audio, list(KEYS))
        .withColumns({"start_ms": start, "end_ms": end})
        .filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
        .drop("audio_ms")
    )
