"""Sinks. None of them reads the path it writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmetry.constants import KEYS


def rewrite_sorted(df: DataFrame, path: str, partition: str = "run", order: Sequence[str] = KEYS, fmt: str = "parquet") -> None:
    """Replace the partitions present in ``df``, sorted; others stay.

    Range partitioning on the full order splits a run that holds most rows over many
    files. The output committer makes the switch all or nothing.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).format(fmt).save(path)


def append_rows(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a header and a fixed column order; missing numbers are empty."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_per_group(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "json") -> None:
    """One directory per group, with one file, or more where the group is large.

    Rows of a group are brought together before they are written, and the adaptive planner splits a group above its
    advisory partition size over several tasks; a small group that shares a partition with it has at most as many files. Without
    that, every task writes a file for each group it meets.
    """
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).format(fmt).save(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Report texts, one directory per run."""
    write_per_group(reports.select("run", F.col("report").alias("value")), path, ["run"], "text")


def bucketed_table(df: DataFrame, name: str, buckets: int, keys: Sequence[str] = KEYS, sort: Sequence[str] = ()) -> None:
    """Store a table hashed on the conversation, so joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*(sort or keys)).saveAsTable(name)
