"""Parsing of rubric responses (a JSON object of criterion -> score and rationale)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmetry.constants import RAW_KEEP_CHARS, Rubric
from talkmetry.functions.text import WHITESPACE, round_exact, strip
from talkmetry.session import last_key_wins


def strip_fences(raw: Column) -> Column:
    """The response without surrounding code fences."""
    text = strip(raw)
    opened = F.ltrim(F.regexp_replace(text, "^```(?:json)?", ""), F.lit(WHITESPACE))
    body = F.when(F.startswith(text, F.lit("```")), opened).otherwise(text)
    closed = F.rtrim(F.left(body, F.length(body) - 3), F.lit(WHITESPACE))
    return F.when(F.endswith(body, F.lit("```")), closed).otherwise(body)


def whole_score(score: Column) -> Column:
    """A score as an integer: numbers are cut, text must spell a whole number."""
    text = score.try_cast("string")
    spelled = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))
    return F.when(F.schema_of_variant(score) == "STRING", spelled).otherwise(
        score.try_cast("double").try_cast("int")
    )


def add_outcome(df: DataFrame, raw: str, rubric: Rubric) -> DataFrame:
    """Add ``_scores`` (criterion -> score, rationale; null on a parse error) and
    ``_mean``.

    Known criteria whose value is an object with a score are kept; of a repeated key the last value counts. A missing
    or null rationale is an empty text. Text that is no JSON object, or a score that is no whole number in text form, is
    a parse error. The steps are separate columns so that each is computed once.
    """
    # Wrapped in an array, text after the object is an error too, or a second element.
    doc = F.try_parse_json(F.concat(F.lit("["), strip_fences(F.col(raw)), F.lit("]")))
    alone = F.try_variant_get("_doc", "$[1]", "variant").isNull()
    fields = F.when(alone, F.try_variant_get("_doc", "$[0]", "map<string,variant>"))

    def entry(e: Column) -> Column:
        score = F.try_variant_get(e["value"], "$.score", "variant")
        rationale = F.coalesce(F.try_variant_get(e["value"], "$.rationale", "string"), F.lit(""))
        return F.struct(
            e["key"].alias("key"),
            F.struct(whole_score(score).alias("score"), rationale.alias("rationale")).alias("value"),
        )

    def wanted(e: Column) -> Column:
        return e["key"].isin(*rubric.keys) & F.try_variant_get(e["value"], "$.score", "variant").isNotNull()

    found = F.transform(F.filter(F.map_entries("_fields"), wanted), entry)
    parts = F.filter("_found", lambda e: ~e["key"].isin(*rubric.mean_excludes)) if rubric.mean_excludes else F.col("_found")
    total = F.aggregate("_parts", F.lit(0), lambda acc, e: acc + e["value"]["score"])
    mean = F.when(F.size("_parts") > 0, round_exact(total / F.size("_parts"), 3)).otherwise(F.lit(0.0))
    with last_key_wins(df.sparkSession):
        parsed = df.withColumn("_doc", doc)
    return (
        parsed.withColumn("_fields", fields)
        .withColumn("_found", found)
        .withColumn("_found", F.when(~F.exists("_found", lambda e: e["value"]["score"].isNull()), F.col("_found")))
        .withColumn("_parts", parts)
        .withColumns(
            {"_scores": F.map_from_entries("_found"), "_mean": F.when(F.col("_found").isNotNull(), mean)}
        )
        .drop("_doc", "_fields", "_found", "_parts")
    )


def kept_raw(raw: Column) -> Column:
    """What is stored of an unreadable response."""
    return F.left(raw, F.lit(RAW_KEEP_CHARS))
