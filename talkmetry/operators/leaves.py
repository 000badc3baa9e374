"""Nested results: numeric leaves, rollups and flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

from talkmetry.constants import AXES, CELLS, CHANNELS, NAIVE_RUBRIC, SCOPES
from talkmetry.functions.text import exact_mean, round_exact
from talkmetry.session import last_key_wins, materialize


def struct_leaves(schema: StructType, prefix: str, strings: bool = False) -> list[tuple[str, str]]:
    """(dotted path, column path) of the numeric leaves of a struct type; with
    ``strings`` also of its text leaves. Booleans are no numbers."""
    found = []
    for field in schema.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        if isinstance(field.dataType, StructType):
            found += struct_leaves(field.dataType, path, strings)
        elif isinstance(field.dataType, NumericType) or (strings and isinstance(field.dataType, StringType)):
            found.append((path, path))
    return found


def numeric_leaves(results: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Typed nested results to (keys, evaluator, path, value): the schema is walked once
    when the plan is built, the data stays in one projection and one explode."""
    schema = results.schema[column].dataType
    items = []
    for path, source in struct_leaves(schema, ""):
        evaluator, _, leaf = path.partition(".")
        items.append(
            F.struct(
                F.lit(evaluator).alias("evaluator"),
                F.lit(leaf).alias("path"),
                F.col(f"{column}.{source}").cast("double").alias("value"),
            )
        )
    return (
        results.select(*keys, F.explode(F.array(*items)).alias("l"))
        .select(*keys, "l.*")
        .filter(F.col("value").isNotNull())
    )


def text_leaves(results: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """All leaves with their text: (keys, path, text), numbers in Spark's own spelling. Null leaves are left out."""
    leaves = struct_leaves(results.schema[column].dataType, "", strings=True)
    items = [F.struct(F.lit(path).alias("path"), F.col(f"{column}.{source}").cast("string").alias("text")) for path, source in leaves]
    rows = results.select(*keys, F.explode(F.array(*items)).alias("l")).select(*keys, "l.*")
    return rows.filter(F.col("text").isNotNull())


#: Levels of nesting opened in one pass over the rows.
PASS_LEVELS = 6


def numeric_leaves_json(results: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """As ``numeric_leaves`` for JSON text of unknown shape and any depth the parser reads; use the typed form where the
    shape is known.

    The text becomes a variant, whose objects are opened level by level: ``PASS_LEVELS`` levels in one projection, and what
    is still an object then, stored with its path, in the next pass. So the passes follow the deepest document and each
    reads only what is left. A repeated key counts with its last value. Lists, text, booleans and nulls are no leaves. An
    integer beyond the range of doubles is infinite. Text that is no JSON object has no leaves, nor has one nested deeper
    than Spark's parser reads (1000 levels) or with a number of more than 1000 digits.
    """
    keep = [F.col(k) for k in keys]
    with last_key_wins(results.sparkSession):
        rows = results.select(*keep, F.array().cast("array<string>").alias("_path"), F.try_parse_json(F.col(column)).alias("_value"))
    out = None
    while True:
        rows = rows.select(*keep, F.explode(_opened(F.col("_path"), F.col("_value"))).alias("_e")).select(*keep, "_e.*")
        kind = F.schema_of_variant("_value")
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("_value", "$", "double"))
        still = F.when(F.startswith(kind, F.lit("OBJECT")), F.col("_value"))
        rows = rows.select(*keep, "_path", number.alias("value"), still.alias("_value"))
        rows = materialize(rows.filter((F.col("value").isNotNull() & (F.size("_path") > 0)) | F.col("_value").isNotNull()), "leaves")
        found = rows.filter(F.col("value").isNotNull()).select(
            *keep,
            F.element_at("_path", 1).alias("evaluator"),
            F.array_join(F.slice("_path", 2, F.greatest(F.size("_path"), F.lit(1))), ".").alias("path"),
            "value",
        )
        out = found if out is None else out.unionByName(found)
        rows = rows.filter(F.col("_value").isNotNull())
        if rows.isEmpty():
            return out


def _opened(path: Column, value: Column) -> Column:
    """array<struct<_path, _value>> of a variant's members, ``PASS_LEVELS`` levels down or to where they are no objects."""
    items = F.array(F.struct(path.alias("_path"), value.alias("_value")))
    for _ in range(PASS_LEVELS):
        items = F.flatten(F.transform(items, _members))
    return items


def _members(item: Column) -> Column:
    fields = F.try_variant_get(item["_value"], "$", "map<string,variant>")
    inner = F.transform(
        F.map_entries(fields),
        lambda e: F.struct(F.concat(item["_path"], F.array(e["key"])).alias("_path"), e["value"].alias("_value")),
    )
    return F.when(fields.isNull(), F.array(item)).otherwise(inner)


def leaf_rollup(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mean, min, max and n of every leaf. A leaf with a value that is no number (NaN) has NaN for all three; infinite
    values count as they are."""
    unknown = F.max(F.isnan("value"))

    def bound(x: Column) -> Column:
        return F.when(unknown, F.lit(float("nan"))).otherwise(round_exact(x, 3))

    return leaves.groupBy(*by, "evaluator", "path").agg(
        exact_mean(F.col("value"), 3).alias("mean"),
        bound(F.min("value")).alias("min"),
        bound(F.max("value")).alias("max"),
        F.count(F.lit(1)).alias("n"),
    )


def variant_number(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "double")


# Flat columns of a stored score record and where they sit in it.
DETAIL_PATHS = {
    "duration_s": "stats.duration_s",
    "num_segments": "stats.num_segments",
    "role_switches": "stats.role_switches",
    "tutor_words": "stats.tutor_words",
    "tutor_speaking_time_s": "stats.tutor_speaking_time_s",
    "tutor_talk_ratio": "stats.tutor_talk_ratio",
    "student_words": "stats.student_words",
    "student_speaking_time_s": "stats.student_speaking_time_s",
    "student_talk_ratio": "stats.student_talk_ratio",
    "latency_mean_s": "turn_taking.response_latency_s.mean",
    "latency_median_s": "turn_taking.response_latency_s.median",
    "latency_p90_s": "turn_taking.response_latency_s.p90",
    "overlap_s": "turn_taking.overlap_s",
    "overlap_ratio": "turn_taking.overlap_ratio",
    "silence_s": "turn_taking.silence_s",
    "silence_ratio": "turn_taking.silence_ratio",
    "backchannel_count": "turn_taking.backchannel_count",
    "backchannel_ratio": "turn_taking.backchannel_ratio",
    **{k: f"llm_judge.scores.{k}.score" for k in NAIVE_RUBRIC.keys},
    "mean_component_score": "llm_judge.mean_component_score",
}


def detail_rows(records: DataFrame, column: str = "evaluator_results") -> DataFrame:
    """Score records (run, conv_index, pid, JSON text) to one flat row each."""
    doc = records.withColumn("_doc", F.try_parse_json(F.col(column)))
    return doc.select(
        F.col("run").alias("run_name"),
        "conv_index",
        "pid",
        *[variant_number(F.col("_doc"), path).alias(name) for name, path in DETAIL_PATHS.items()],
    )


def wide_quality(quality: DataFrame) -> DataFrame:
    """Long quality scores to one ``ab_<channel>_<axis>`` column each."""
    cells = [
        F.max(F.when((F.col("channel") == c) & (F.col("axis") == a), F.col("score"))).alias(f"ab_{c}_{a}")
        for c in CHANNELS
        for a in AXES
    ]
    return quality.groupBy("run", "conv_index").agg(*cells)


def long_quality(wide: DataFrame) -> DataFrame:
    """The other way round; missing scores are left out."""
    items = F.array(
        *[
            F.struct(F.lit(c).alias("channel"), F.lit(a).alias("axis"), F.col(f"ab_{c}_{a}").alias("score"))
            for c in CHANNELS
            for a in AXES
        ]
    )
    return wide.select("run", "conv_index", F.explode(items).alias("i")).select("run", "conv_index", "i.*").filter(
        F.col("score").isNotNull()
    )


def wide_cells(cells: DataFrame) -> DataFrame:
    """Per-conversation cells to ``vap_<scope>_<cell>`` columns and rates."""
    columns = [
        F.max(F.when(F.col("scope") == s, F.col(c))).alias(f"vap_{s}_{name}")
        for s in SCOPES
        for c, name in [*[(c, c) for c in CELLS], ("fi_rate", "FI_rate")]
    ]
    return cells.groupBy("run", "conv_index").agg(*columns)
