"""Discovery of runs, judge runs and alignment variants from file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmetry.constants import JUDGE_DIR_MARKER, VARIANT_PRIORITY


def _parent(path: Column) -> Column:
    """Name of the directory a file is in."""
    return F.url_decode(F.element_at(F.split(path, "/"), -2))


def listing(spark: SparkSession, glob: str) -> DataFrame:
    """path, modificationTime, length of files; their content is never read."""
    return spark.read.format("binaryFile").load(glob).select("path", "modificationTime", "length")


def discover_runs(spark: SparkSession, root: str, required: str) -> DataFrame:
    """Sub-directories that hold ``required``: run, mtime, n_records, newest first.

    Directories starting with ``_`` or ``.`` or ending in ``__aligned`` do not count, nor
    do files of length 0.
    """
    glob = f"{root.rstrip('/')}/*/{required}"
    files = listing(spark, glob).select(_parent(F.col("path")).alias("run"), F.col("modificationTime").alias("mtime"))
    lines = (
        spark.read.text(glob)
        .filter(F.trim("value") != "")
        .groupBy(_parent(F.col("_metadata.file_path")).alias("run"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
    named = files.filter(~F.col("run").rlike(r"^[_.]") & ~F.endswith("run", F.lit("__aligned")))
    return named.join(lines, "run", "left").fillna(0, ["n_records"]).orderBy(F.desc("mtime"), "run")


def judge_runs(runs: DataFrame) -> DataFrame:
    """Split ``<run>__judge-<model>`` directories once into run and judge model."""
    at = F.instr("run", JUDGE_DIR_MARKER)
    cut = len(JUDGE_DIR_MARKER)
    return runs.filter(at > 0).select(
        F.col("run").alias("directory"),
        F.substring(F.col("run"), F.lit(1), at - 1).alias("run"),
        F.substring(F.col("run"), at + cut, F.length("run")).alias("judge_model"),
    )


def variant_listing(aligned: DataFrame) -> DataFrame:
    """Per variant: mode and prompt bias of the first record, and the record count.

    ``aligned``: run, variant, pos, mode, prompt_bias.
    """
    return aligned.groupBy("run", "variant").agg(
        F.min_by("mode", F.when(F.col("mode").isNotNull(), F.col("pos"))).alias("mode"),
        F.min_by("prompt_bias", F.when(F.col("mode").isNotNull(), F.col("pos"))).alias("prompt_bias"),
        F.count(F.lit(1)).alias("n_records"),
    )


def default_variant(variants: DataFrame) -> DataFrame:
    """The variant to show first: by fixed priority, else the first by name."""
    rank = F.lit(len(VARIANT_PRIORITY))
    for i, name in enumerate(VARIANT_PRIORITY):
        rank = F.when(F.col("variant") == name, F.lit(i)).otherwise(rank)
    return variants.groupBy("run").agg(F.min_by("variant", F.struct(rank, "variant")).alias("default_variant"))
