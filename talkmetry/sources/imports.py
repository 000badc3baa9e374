"""Imports of other layouts into conversations and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from talkmetry.functions.text import strip
from talkmetry.operators.transcripts import dataset_role
from talkmetry.operators.words import to_ms

QUESTION_COLUMNS = ("pid", "question", "answer", "question_type", "answer_type", "choices", "query")
IMAGE_COLUMNS = ("image", "decoded_image")


def question_table(raw: DataFrame) -> DataFrame:
    """Typed question columns; every other column goes into ``metadata`` as JSON.

    Missing optional columns get their defaults: empty text, no choices, and the question
    as the query.
    """
    have = set(raw.columns)

    def text(name: str):
        return F.col(name).cast("string") if name in have else F.lit("")

    rest = [c for c in raw.columns if c not in (*QUESTION_COLUMNS, *IMAGE_COLUMNS)]
    images = [F.col(c) for c in reversed(IMAGE_COLUMNS) if c in have]
    return raw.select(
        F.col("pid").cast("string").alias("pid"),
        "question",
        F.col("answer").cast("string").alias("answer"),
        text("question_type").alias("question_type"),
        text("answer_type").alias("answer_type"),
        (F.coalesce("choices", F.array()) if "choices" in have else F.array().cast("array<string>")).alias("choices"),
        (F.coalesce(*images) if images else F.lit(None)).alias("image"),
        (F.coalesce("query", "question") if "query" in have else F.col("question")).alias("query"),
        (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata"),
    )


def dialog_segments(examples: DataFrame, key: str = "conv_index") -> DataFrame:
    """Dialogue turns on a synthetic one-second timeline: turn i speaks in [i, i+1) s."""
    return examples.select(key, F.posexplode("dialog_history").alias("seg_id", "turn")).select(
        key,
        F.col("seg_id").cast("long").alias("seg_id"),
        dataset_role(F.col("turn.user")).alias("role"),
        strip(F.coalesce("turn.text", F.lit(""))).alias("text"),
        (F.col("seg_id") * 1000).cast("long").alias("start_ms"),
        ((F.col("seg_id") + 1) * 1000).cast("long").alias("end_ms"),
    )


def dialog_conversations(examples: DataFrame, source: str, key: str = "conv_index") -> DataFrame:
    """Conversation rows of tutoring examples."""
    return examples.select(
        key,
        F.col(key).cast("string").alias("pid"),
        F.coalesce("problem", F.lit("")).alias("question"),
        F.coalesce("reference_solution", F.lit("")).alias("answer"),
        F.lit(source).alias("tutor_backend"),
        F.lit(source).alias("student_backend"),
        (F.size(F.coalesce("dialog_history", F.array())) * 1000).cast("long").alias("duration_ms"),
        F.coalesce("topic", F.lit("")).alias("topic"),
    )


def preference_segments(rows: DataFrame, key: str = "row_idx") -> DataFrame:
    """Two conversations per pair: the history, then that side's reply by the tutor.

    The reply is appended to the history array before it is exploded, so both sides come
    out of one pass and no union re-reads the table.
    """
    reply = lambda c: F.struct(F.lit("Teacher").alias("user"), F.coalesce(c, F.lit("")).alias("text"))
    history = F.coalesce("dialog_history", F.array())
    sides = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.array_append(history, reply(F.col(c))).alias("dialog_history"))
            for s, c in (("pos", "teacher_response_positive"), ("neg", "teacher_response_negative"))
        ]
    )
    both = rows.select(key, F.explode(sides).alias("s")).select(F.struct(key, "s.side").alias("k"), "s.dialog_history")
    return dialog_segments(both, "k").select(f"k.{key}", "k.side", "seg_id", "role", "text", "start_ms", "end_ms")


TIMED_UNIT = StructType(
    [
        StructField("_VALUE", StringType()),
        StructField("_start", StringType()),
        StructField("_end", StringType()),
        StructField("_utt", StringType()),
    ]
)


def timed_units(spark: SparkSession, glob: str, name: Column | None = None) -> DataFrame:
    """Words of timed-unit XML files ``<dialogue>.<g|f>.timed-units.xml``.

    ``name`` gives that name where the files are called otherwise.

    Units without text or without a valid ``end > start`` are left out. The giver (g) is
    the tutor. Times are rounded from the file's four decimals to milliseconds.
    """
    raw = spark.read.format("xml").option("rowTag", "tu").schema(TIMED_UNIT).load(glob)
    name = F.col("_metadata.file_name") if name is None else name
    start, end = F.col("_start").try_cast("double"), F.col("_end").try_cast("double")
    word = strip(F.coalesce("_VALUE", F.lit("")))
    return (
        raw.select(
            F.regexp_extract(name, r"^([^.]+)\.", 1).alias("dialogue"),
            F.when(F.regexp_extract(name, r"^[^.]+\.([^.]+)\.", 1) == "g", F.lit("tutor")).otherwise(F.lit("student")).alias("role"),
            word.alias("word"),
            start.alias("start"),
            end.alias("end"),
            F.col("_utt").alias("utt"),
        )
        .filter((F.col("word") != "") & (F.col("end") > F.col("start")))
        .select("dialogue", "role", "word", to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"), "utt")
    )


def dialogues(units: DataFrame) -> DataFrame:
    return units.select("dialogue").distinct()


def frame_rows(arrays: DataFrame, keys: tuple[str, ...] = ("run", "conv_index"), columns: tuple[str, ...] = ()) -> DataFrame:
    """Per-conversation frame arrays to one row per frame."""
    columns = columns or tuple(c for c in arrays.columns if c not in keys)
    return arrays.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("frame", "v")).select(
        *keys, F.col("frame").cast("long").alias("frame"), *[F.col(f"v.{c}").alias(c) for c in columns]
    )
