"""JSON and JSON-lines scans with an explicit record position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from talkmetry.operators.work import last_wins

CORRUPT = "_corrupt"
ORDER = ("_file", "_offset", "_row")


def _place(df: DataFrame) -> DataFrame:
    """Where a record came from: file, split offset, and its order within the split."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_row"),
    )


def read_tolerant(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """JSON lines; unreadable ones keep their text in ``_corrupt``. Blank lines vanish.

    Lines are read as text and parsed in the projection, so counting or keeping only the
    unreadable ones is an ordinary query.
    """
    full = StructType(schema.fields + [StructField(CORRUPT, StringType())])
    text = _place(spark.read.text(path)).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return text.withColumn("_r", F.from_json("value", full, options)).select("_r.*", *ORDER)


def split_bad(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable records, quarantine of unreadable lines)."""
    good = lines.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, lines.filter(F.col(CORRUPT).isNotNull()).select("_file", "_offset", CORRUPT)


def read_strict(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """JSON lines; the first unreadable one fails the job."""
    return _place(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def read_json(spark: SparkSession, path, schema: StructType, multi_line: bool) -> DataFrame:
    """Whole-file JSON (an object or an array) or JSON lines."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def with_dense_index(records: DataFrame, column: str = "conv_index") -> DataFrame:
    """Fill a missing index with the record's position among its file's readable records.

    Splits of a file are counted in parallel and their counts summed in file order; rows
    are then numbered inside their split, so no file has to fit one task.
    """
    splits = records.groupBy("_file", "_offset").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_offset").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_file", "_offset").orderBy("_row")
    position = F.col("_start") + F.row_number().over(inside) - 1
    out = records.join(starts, ["_file", "_offset"]).withColumn("_position", position)
    return out.withColumn(column, F.coalesce(column, "_position")).drop("_start")


def aligned_by_index(records: DataFrame) -> DataFrame:
    """Aligned records per file and conversation; the last written one wins."""
    indexed = records.filter(F.col("conv_index").isNotNull()).withColumn("_order", F.struct("_offset", "_row"))
    return last_wins(indexed, ["_file", "conv_index"], "_order").drop("_order", "_offset", "_row")
