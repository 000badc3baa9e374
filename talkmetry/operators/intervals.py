"""Interval algebra on ``[start_ms, end_ms]`` rows, without joins that pair rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from talkmetry.constants import KEYS
from talkmetry.operators.ordered import BLOCK, Scan, dealt, hot_keys, scan, with_blocks, without_keys


def merge_intervals(
    df: DataFrame,
    gap_ms: int = 0,
    keys: Sequence[str] = KEYS,
    limit: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Merge intervals that touch: a new run starts when ``start - max_end > gap``.

    A key with too many rows is merged as a segmented prefix scan (``_merge_blocks``): each of its time blocks is
    one task, and no task sees the results of all blocks. Other keys are one window, dealt to as many tasks as the session
    names, as the sort holds many times the bytes that the planner would fill fewer tasks by.
    """
    rows = df.select(*keys, "start_ms", "end_ms", F.lit(1).cast("long").alias("n_merged"))
    if hot is None:
        hot = hot_keys(rows, keys, "start_ms", limit)
    blocks = with_blocks(rows, hot, "start_ms", "inner")
    cold = without_keys(rows, hot)
    return _merge_once(dealt(cold, keys), gap_ms, keys).unionByName(_merge_blocks(blocks, gap_ms, keys))


def _opened(rows: DataFrame, gap_ms: int, part: Sequence[str], order: Sequence[str]) -> tuple[Column, WindowSpec]:
    """1 where a row opens a run, and the window that tells it."""
    w = Window.partitionBy(*part).orderBy(*order)
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(reach.isNull() | (F.col("start_ms") - reach > gap_ms), 1).otherwise(0), w


def _run(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_merged").alias("n_merged")
    )


def _merge_once(rows: DataFrame, gap_ms: int, part: Sequence[str]) -> DataFrame:
    opened, w = _opened(rows, gap_ms, part, ["start_ms", "end_ms"])
    run_no = F.sum("_opened").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _run(rows.withColumn("_opened", opened).withColumn("_run_no", run_no), [*part, "_run_no"]).drop("_run_no")


def _merge_blocks(rows: DataFrame, gap_ms: int, keys: Sequence[str]) -> DataFrame:
    """Runs of the blocks of hot keys, joined where they go on across blocks.

    The latest end of all earlier blocks, a running maximum over one summary row per block, enters each
    block as its first row. So a row knows in its block's only sort whether it opens a run, and counting those
    numbers the runs; number 0 goes on from an earlier block. Only that piece and the block's last run can belong to a
    run of several blocks: these two rows per block are numbered once more, along the key's blocks. All other runs are
    complete and are spread over the tasks by their own number.
    """
    part = [*keys, BLOCK]
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    ends = rows.groupBy(*part).agg(F.max("end_ms").alias("_end"))
    carry = F.max("_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    edges = ends.select(*part, F.lit(None).cast("long").alias("start_ms"), carry.alias("end_ms"), F.lit(0).cast("long").alias("n_merged"))
    stream = rows.withColumn("_row", F.lit(1)).unionByName(edges.filter(F.col("end_ms").isNotNull()).withColumn("_row", F.lit(0)))
    opened, w = _opened(stream, gap_ms, part, ["_row", "start_ms", "end_ms"])
    numbered = stream.withColumn("_opened", F.col("_row") * opened).withColumns(
        {
            "_run_no": F.sum("_opened").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_last": F.sum("_opened").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    pieces = _run(numbered.filter(F.col("_row") == 1), [*part, "_run_no", "_last"])
    inner = (F.col("_run_no") > 0) & (F.col("_run_no") < F.col("_last"))
    own = {"_own_block": F.when(inner, F.col(BLOCK)), "_own_run": F.when(inner, F.col("_run_no"))}
    chain = Window.partitionBy(*keys, *own).orderBy(BLOCK, "_run_no")
    joined = F.sum(F.when(F.col("_run_no") > 0, 1).otherwise(0)).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    return _run(pieces.withColumns(own).withColumn("_no", joined), [*keys, *own, "_no"]).drop(*own, "_no")


def covered_ms(df: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = None) -> DataFrame:
    """Length of the union of the intervals per key."""
    return (
        merge_intervals(df, 0, keys, limit)
        .groupBy(*keys)
        .agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))
    )


def cross_overlap(
    df: DataFrame,
    side: Column,
    keys: Sequence[str] = KEYS,
    limit: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Overlap of every interval of side 0 with every interval of side 1, summed,
    and the time in which either side is active.

    Instead of pairing rows: the sum over pairs of overlap lengths equals the integral
    of (active on side 0) x (active on side 1). Starts and ends are first added up per
    distinct millisecond (a map-side aggregate), so the scan sees at most one row per
    millisecond of a conversation however many rows that conversation has.
    """
    spans = df.withColumn("_side", side).filter(
        F.col("_side").isNotNull() & (F.col("end_ms") > F.col("start_ms"))
    )
    edges = spans.select(
        *keys,
        "_side",
        F.explode(
            F.array(
                F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")),
                F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")),
            )
        ).alias("e"),
    )
    instants = edges.groupBy(*keys, F.col("e.t").alias("t")).agg(
        F.sum(F.when(F.col("_side") == 0, F.col("e.d")).otherwise(0)).alias("d0"),
        F.sum(F.when(F.col("_side") == 1, F.col("e.d")).otherwise(0)).alias("d1"),
    )
    ordered = scan(instants, keys, ["t"], Scan(sum_before={"_b0": "d0", "_b1": "d1"}, next={"_next": "t"}), limit, hot)
    levels = ordered.select(
        *keys,
        (F.col("_b0") + F.col("d0")).alias("n0"),
        (F.col("_b1") + F.col("d1")).alias("n1"),
        (F.col("_next") - F.col("t")).alias("dt"),
    )
    return levels.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("n0") * F.col("n1") * F.col("dt")), F.lit(0)).alias("overlap_ms"),
        F.coalesce(F.sum(F.when(F.col("n0") + F.col("n1") > 0, F.col("dt"))), F.lit(0)).alias("active_ms"),
    )


def reach_before(
    queries: DataFrame,
    intervals: DataFrame,
    at: str,
    keys: Sequence[str] = KEYS,
    out: str = "reach_ms",
    limit: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """For each query row: the latest end among intervals that start strictly before ``at``.

    "Does any interval overlap (a, b)?" is ``reach > a`` with ``at = b``: an as-of lookup
    over one sorted stream, so nothing is paired. Queries sort before intervals that
    start at the same millisecond, which makes "before" strict.
    """
    starts = intervals.groupBy(*keys, F.col("start_ms").alias("_t")).agg(F.max("end_ms").alias("_end"))
    asked = queries.withColumn("_t", F.col(at)).withColumn("_kind", F.lit(0))
    both = asked.unionByName(starts.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    seen = scan(both, keys, ["_t", "_kind"], Scan(max_before={out: "_end"}), limit, hot)
    return seen.filter(F.col("_kind") == 0).drop("_t", "_kind", "_end")
