"""Schemas of the stored records."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


WORD = _struct(
    ("word", StringType()), ("start_time", DoubleType()), ("end_time", DoubleType()), ("confidence", DoubleType())
)
SEGMENT = _struct(
    ("role", StringType()),
    ("text", StringType()),
    ("start_time", DoubleType()),
    ("end_time", DoubleType()),
    ("audio_path", StringType()),
    ("words", ArrayType(WORD)),
)
CONVERSATION = _struct(
    ("pid", StringType()),
    ("conv_index", LongType()),
    ("attempt_index", IntegerType()),
    ("question", StringType()),
    ("answer", StringType()),
    ("tutor_voice", StringType()),
    ("student_voice", StringType()),
    ("tutor_backend", StringType()),
    ("student_backend", StringType()),
    ("tutor_uses_image", BooleanType()),
    ("student_uses_image", BooleanType()),
    ("duration", DoubleType()),
    ("segments", ArrayType(SEGMENT)),
    ("metadata", MapType(StringType(), StringType())),
)
ALIGNMENT = _struct(
    ("mode", StringType()),
    ("asr_model", StringType()),
    ("aligner", StringType()),
    ("prompt_bias", BooleanType()),
    ("timestamp", StringType()),
    ("source_segments_count", MapType(StringType(), IntegerType())),
    ("aligned_segments_count", MapType(StringType(), IntegerType())),
)
ALIGNED = StructType(CONVERSATION.fields + [StructField("alignment", ALIGNMENT)])
UTTERANCE = _struct(
    ("role", StringType()), ("content", StringType()), ("turn", IntegerType()), ("audio_path", StringType())
)
TURN_CONVERSATION = _struct(
    ("pid", StringType()),
    ("question", StringType()),
    ("answer", StringType()),
    ("image_path", StringType()),
    ("utterances", ArrayType(UTTERANCE)),
    ("num_turns", IntegerType()),
)
SCORE_RECORD = _struct(
    ("pid", StringType()),
    ("conv_index", LongType()),
    ("timestamp", StringType()),
    # Each evaluator owns its shape, so results stay text until a query asks for a path.
    ("evaluator_results", StringType()),
)
DIALOG_TURN = _struct(("user", StringType()), ("text", StringType()))
TUTORING_EXAMPLE = _struct(
    ("problem", StringType()),
    ("reference_solution", StringType()),
    ("topic", StringType()),
    ("dialog_history", ArrayType(DIALOG_TURN)),
)
PREFERENCE_ROW = StructType(
    TUTORING_EXAMPLE.fields
    + [
        StructField("teacher_response_positive", StringType()),
        StructField("teacher_response_negative", StringType()),
    ]
)
FRAME_ARRAYS = _struct(
    ("run", StringType()),
    ("conv_index", LongType()),
    ("frame_times", ArrayType(DoubleType())),
    ("p_now0", ArrayType(DoubleType())),
    ("p_now1", ArrayType(DoubleType())),
    ("p_future0", ArrayType(DoubleType())),
    ("p_future1", ArrayType(DoubleType())),
)
