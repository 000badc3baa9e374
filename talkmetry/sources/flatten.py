"""Nested conversation records to the normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmetry.operators.words import to_ms


def conversation_rows(records: DataFrame, run: str | None = None) -> DataFrame:
    """Conversation columns without the segments; duration in milliseconds."""
    named = records if run is None else records.withColumn("run", F.lit(run))
    keep = [c for c in named.columns if c not in ("segments", "duration") and not c.startswith("_")]
    return named.select(*keep, F.coalesce(to_ms(F.col("duration")), F.lit(0).cast("long")).alias("duration_ms"))


def segment_rows(records: DataFrame, run: str | None = None) -> DataFrame:
    """run, conv_index, seg_id, role, text, start_ms, end_ms, audio_path."""
    named = records if run is None else records.withColumn("run", F.lit(run))
    return named.select("run", "conv_index", F.posexplode("segments").alias("seg_id", "s")).select(
        "run",
        "conv_index",
        F.col("seg_id").cast("long").alias("seg_id"),
        F.coalesce("s.role", F.lit("")).alias("role"),
        F.coalesce("s.text", F.lit("")).alias("text"),
        F.coalesce(to_ms(F.col("s.start_time")), F.lit(0).cast("long")).alias("start_ms"),
        F.coalesce(to_ms(F.col("s.end_time")), F.lit(0).cast("long")).alias("end_ms"),
        F.col("s.audio_path").alias("audio_path"),
    )


def turn_rows(records: DataFrame) -> DataFrame:
    """Turn-based conversations to (pid, turn, role, text)."""
    return records.select("pid", F.explode("utterances").alias("u")).select(
        "pid", F.col("u.turn").alias("turn"), F.col("u.role").alias("role"), F.col("u.content").alias("text")
    )
