"""Ordered scans inside a key that survive one key holding most of the rows.

A plain window puts a whole key in one task. Here keys above ``hot_rows`` rows are
cut into blocks along the order (time, position or value), and each block is its own
window partition. What a block needs from its neighbours (last row before it, first
row after it, how many rows precede it, running maximum or sum so far) comes from a
summary with one row per block and enters the window as an edge row.

Ordinary keys have a null block, so they stay one partition. Whether any key is hot is
counted when the scan is built; where none is, the hot table is an empty relation and the
optimizer drops the block join and the edge branch, which leaves the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmetry.session import hot_rows as session_hot_rows
from talkmetry.session import materialize

BLOCK = "_block"
BLOCKS = 256
_CUTS = "_cuts"
_AXIS = "_axis"
_SIDE = "_side"
_COUNT = "_rows"


@dataclass
class Scan:
    """What to add to each row: neighbours, 0-based position, earlier maximum or sum.

    ``prev``/``next``/``max_before``/``sum_before`` map an output column to an input
    column. The last two cover the rows strictly before the current one.
    """

    prev: dict[str, str] = field(default_factory=dict)
    next: dict[str, str] = field(default_factory=dict)
    max_before: dict[str, str] = field(default_factory=dict)
    sum_before: dict[str, str] = field(default_factory=dict)
    index: str | None = None

    def apply(self, df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        cols = {out: F.lag(src).over(w) for out, src in self.prev.items()}
        cols |= {out: F.lead(src).over(w) for out, src in self.next.items()}
        cols |= {out: F.max(src).over(before) for out, src in self.max_before.items()}
        sums = dict(self.sum_before)
        if self.index:
            sums[self.index] = _COUNT
        cols |= {out: F.coalesce(F.sum(src).over(before), F.lit(0)) for out, src in sums.items()}
        return df.withColumns(cols)


def hot_keys(df: DataFrame, keys: Sequence[str], axis: str, limit: int | None = None) -> DataFrame:
    """Keys above ``limit`` rows with the cuts between their blocks.

    Cuts are quantiles of the key's own rows along ``axis``, so blocks hold about equally many rows however
    unevenly they lie, and a stray value moves nothing; only rows at one and the same value stay together. All hot keys
    are listed, at most rows / ``limit``. The count runs here; the list is stored where it is not empty, so that Spark knows
    its size and broadcasts it or joins it otherwise. Several scans over one table can share the list (``hot=``).
    """
    limit = limit or session_hot_rows(df.sparkSession)
    rows = df.select(*keys, F.col(axis).alias(_AXIS))
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
    fractions = F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)])
    if large.isEmpty():
        fields = rows.withColumn(_CUTS, F.array(_AXIS)).drop(_AXIS).schema
        # Empty by a filter the optimizer sees; an empty list of Python rows is only found empty by running it.
        return df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).filter(F.lit(False))
    cuts = _of_keys(rows, materialize(large, "hot-keys"), "left_semi").groupBy(*keys).agg(F.percentile_approx(_AXIS, fractions, 20 * BLOCKS).alias(_CUTS))
    return materialize(cuts, "hot-cuts")


def _of_keys(df: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """``df`` joined with ``hot`` on the latter's keys; null is a key like others."""
    on = key_columns(hot)
    named = hot.withColumnsRenamed({k: f"_hot_{k}" for k in on})
    return df.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in on]), how)


def key_columns(hot: DataFrame) -> list[str]:
    return [c for c in hot.columns if c != _CUTS]


def mirrored(hot: DataFrame) -> DataFrame:
    """The same cuts for a scan that runs backwards, along the negated axis."""
    return hot.withColumn(_CUTS, F.reverse(F.transform(_CUTS, lambda cut: -cut)))


def with_blocks(df: DataFrame, hot: DataFrame, axis: str, how: str = "left") -> DataFrame:
    """Add the block of each row: null outside hot keys. ``inner`` keeps hot rows only."""
    block = F.when(F.col(_CUTS).isNotNull(), cuts_below(F.col(axis))).cast("long")
    return _of_keys(df, hot, how).withColumn(BLOCK, block).select(*df.columns, BLOCK)


def cuts_below(value: Column) -> Column:
    """How many of the rising cuts lie below ``value``, by bisection."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((BLOCKS - 1).bit_length()))])

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get(F.col(_CUTS), at + step - 1) < value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def without_keys(df: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of ordinary keys."""
    return _of_keys(df, hot, "left_anti")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    spec: Scan,
    limit: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add the columns of ``spec`` to ``df``, ordered by ``order`` within ``keys``.

    ``order[0]`` must be a number (time, position or value). ``order`` must leave no
    ties among rows whose neighbours or positions are asked for, so the result does
    not depend on partitioning.
    """
    if hot is None:
        hot = hot_keys(df, keys, order[0], limit)
    part = [*keys, BLOCK]
    body = with_blocks(df, hot, order[0]).withColumn(_SIDE, F.lit(0)).withColumn(_COUNT, F.lit(1).cast("long"))
    edges = _edge_rows(with_blocks(df, hot, order[0], "inner"), keys, order, spec)
    ordering = [F.col(_SIDE), *[F.col(c) for c in order]]
    out = spec.apply(body.unionByName(edges), part, ordering)
    return out.filter(F.col(_SIDE) == 0).drop(_SIDE, _COUNT, BLOCK)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A key's rows together, in as many tasks as the session names. Such a number is not coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scan_given(df: DataFrame, keys: Sequence[str], order: Sequence[str], spec: Scan, hot: DataFrame | None) -> DataFrame:
    """``scan`` cut at the hot keys the caller found, or plain windows where it names none.

    For input that is costly to make and bounded per key: finding hot keys reads it twice more, so the caller
    who has stored it decides.
    """
    if hot is None:
        return spec.apply(df, keys, [F.col(c) for c in order])
    return scan(df, keys, order, spec, hot=hot)


def _edge_rows(hot_rows: DataFrame, keys: Sequence[str], order: Sequence[str], spec: Scan) -> DataFrame:
    """One row before (and after) each block that stands for the blocks around it."""
    part = [*keys, BLOCK]
    position = F.struct(*order)
    neighbours = sorted({*spec.prev.values(), *spec.next.values()})
    edge = F.struct(*neighbours) if neighbours else F.struct(F.lit(1).alias("_"))
    maxima, sums = sorted(set(spec.max_before.values())), sorted(set(spec.sum_before.values()))
    carried = {*maxima, *sums}
    if len(carried) < len(maxima) + len(sums) or carried & set(neighbours):
        raise ValueError("a column may serve one of neighbour, maximum and sum")
    blocks = hot_rows.groupBy(*part).agg(
        F.max_by(edge, position).alias("_last"),
        F.min_by(edge, position).alias("_first"),
        F.count(F.lit(1)).alias(_COUNT),
        *[F.max(c).alias(f"_carry_{c}") for c in maxima],
        *[F.sum(c).alias(f"_carry_{c}") for c in sums],
    )
    # One row per block: this window is as long as the number of blocks of a key.
    w = Window.partitionBy(*keys).orderBy(BLOCK)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *part,
        F.lag("_last").over(w).alias("_last"),
        F.lead("_first").over(w).alias("_first"),
        F.sum(_COUNT).over(before).alias(_COUNT),
        *[F.max(f"_carry_{c}").over(before).alias(f"_carry_{c}") for c in maxima],
        *[F.sum(f"_carry_{c}").over(before).alias(f"_carry_{c}") for c in sums],
    )
    types = dict(hot_rows.dtypes)

    def as_row(source: str, side: int) -> Column:
        values = []
        for c in hot_rows.columns:
            if c in part:
                continue
            value = F.col(f"{source}.{c}") if c in neighbours else F.lit(None)
            if side < 0 and c in carried:
                value = F.col(f"_carry_{c}")
            values.append(value.cast(types[c]).alias(c))
        rows = F.col(_COUNT) if side < 0 else F.lit(0)
        row = F.struct(*values, F.lit(side).alias(_SIDE), rows.cast("long").alias(_COUNT))
        return F.when(F.col(source).isNotNull(), row)

    rows = F.array(as_row("_last", -1), as_row("_first", 1))
    return blocks.select(*part, F.explode(rows).alias("_e")).filter(F.col("_e").isNotNull()).select(*part, "_e.*")
