"""Distance of each system's timing distributions from a reference population.

Samples are whole milliseconds inside a fixed support, so a (system, metric) has at
most 20 001 distinct values. Everything below works on counts per distinct value: the
big table is aggregated once, map-side, and the windows see only the counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmetry.constants import BOOTSTRAP_REPLICATES, JS_BINS, TIMING_SUPPORT_MS
from talkmetry.functions.text import run_part
from talkmetry.operators.ordered import Scan, scan
from talkmetry.operators.ranks import quartiles_of_counts
from talkmetry.operators.timing import in_support

GROUP = ("system", "metric")


def value_counts(samples: DataFrame) -> DataFrame:
    """(run, metric, value_ms, n) inside the support; samples outside it count under a
    null value, so that their run is still known."""
    value = F.when(in_support(), F.col("value_ms"))
    return samples.groupBy("run", "metric", value.alias("value_ms")).agg(F.count(F.lit(1)).alias("n"))


def ecdf(counts: DataFrame) -> DataFrame:
    """Share of samples at or below each distinct value, per run and metric."""
    w = Window.partitionBy("run", "metric")
    upto = w.orderBy("value_ms").rowsBetween(Window.unboundedPreceding, 0)
    return counts.filter(F.col("value_ms").isNotNull()).select(
        "run", "metric", "value_ms", "n", F.round(F.sum("n").over(upto) / F.sum("n").over(w), 9).alias("ecdf")
    )


def against_reference(all_counts: DataFrame, reference: str) -> DataFrame:
    """(system, metric, value_ms, ns, nr): counts of a system and of the reference on the
    values either has. Empty when the reference has no samples at all."""
    counts = all_counts.filter(F.col("value_ms").isNotNull())
    ref = counts.filter(F.col("run") == reference).select("metric", "value_ms", F.col("n").alias("nr"))
    mine = counts.filter(F.col("run") != reference).select(
        F.col("run").alias("system"), "metric", "value_ms", F.col("n").alias("ns"), F.lit(0).cast("long").alias("nr")
    )
    # The reference counts, once per system: bounded by systems x support.
    grid = _systems(all_counts, reference)
    theirs = grid.join(ref, "metric").select("system", "metric", "value_ms", F.lit(0).cast("long").alias("ns"), "nr")
    return mine.unionByName(theirs).groupBy(*GROUP, "value_ms").agg(F.sum("ns").alias("ns"), F.sum("nr").alias("nr"))


def _systems(counts: DataFrame, reference: str) -> DataFrame:
    """Every other system with every metric, if the reference is there (tiny)."""
    everyone = Window.partitionBy(F.lit(1))
    runs = counts.select("run").distinct().withColumn(
        "_ref", F.max(F.col("run") == reference).over(everyone)
    )
    metrics = F.array(*[F.lit(m) for m in TIMING_SUPPORT_MS])
    return runs.filter(F.col("_ref") & (F.col("run") != reference)).select(
        F.col("run").alias("system"), F.explode(metrics).alias("metric")
    )


def _bounds(which: int) -> Column:
    out = F.lit(None).cast("long")
    for metric, support in TIMING_SUPPORT_MS.items():
        out = F.when(F.col("metric") == metric, F.lit(support[which])).otherwise(out)
    return out


def bin_of(value: Column) -> Column:
    """One of 40 equal bins of the metric's support; the last one is closed."""
    width = (_bounds(1) - _bounds(0)) / JS_BINS
    return F.least(F.floor((value - _bounds(0)) / width), F.lit(JS_BINS - 1))


def distances(value_counts: DataFrame, reference: str, digits: int = 6) -> DataFrame:
    """KS, EMD (seconds) and Jensen-Shannon distance (base 2) of each system and metric.

    Every (system, metric) has a row; below two samples on either side it holds nulls.
    """
    counts = against_reference(value_counts, reference)
    w = Window.partitionBy(*GROUP)
    by_value = w.orderBy("value_ms")
    upto = by_value.rowsBetween(Window.unboundedPreceding, 0)
    cdf = counts.select(
        *GROUP,
        (F.lead("value_ms").over(by_value) - F.col("value_ms")).alias("step"),
        F.abs(
            F.try_divide(F.sum("ns").over(upto), F.sum("ns").over(w))
            - F.try_divide(F.sum("nr").over(upto), F.sum("nr").over(w))
        ).alias("gap"),
    )
    ks_emd = cdf.groupBy(*GROUP).agg(
        F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * F.col("step")), F.lit(0.0)).alias("emd_ms")
    )
    binned = counts.groupBy(*GROUP, bin_of(F.col("value_ms")).alias("bin")).agg(
        F.sum("ns").alias("ns"), F.sum("nr").alias("nr")
    )
    p = F.try_divide(F.col("ns"), F.sum("ns").over(w))
    q = F.try_divide(F.col("nr"), F.sum("nr").over(w))
    mixed = binned.select(*GROUP, "ns", "nr", p.alias("p"), q.alias("q"))
    m = (F.col("p") + F.col("q")) / 2

    def part(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)

    js = mixed.groupBy(*GROUP).agg(
        F.sum("ns").alias("n_system"),
        F.sum("nr").alias("n_reference"),
        F.sum(part("p") + part("q")).alias("div"),
    )
    out = (
        _systems(value_counts, reference)
        .join(js, list(GROUP), "left")
        .join(ks_emd, list(GROUP), "left")
        .fillna(0, ["n_system", "n_reference"])
    )
    enough = (F.col("n_system") >= 2) & (F.col("n_reference") >= 2)
    js_value = F.sqrt(F.greatest(F.lit(0.0), F.col("div")) / (2.0 * F.ln(F.lit(2.0))))
    return out.select(
        *GROUP,
        "n_system",
        "n_reference",
        F.when(enough, F.round("ks", digits)).alias("ks"),
        F.when(enough, F.round(F.col("emd_ms") / 1000.0, digits)).alias("emd"),
        F.when(enough, F.round(js_value, digits)).alias("js"),
    )


def bootstrap_ci(
    value_counts: DataFrame,
    reference: str,
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = 0,
    chunk: int = 50,
) -> DataFrame:
    """2.5 and 97.5 % points of the three distances over resamples of the system.

    Drawing n values with replacement is a multinomial draw over the distinct values, so
    a replicate costs as much as the support is wide, not as many samples as there are.
    Tasks take (system, metric, chunk of replicates); each replicate has its own stream
    seeded by its group and number, so neither the result nor its reproducibility
    depends on partitioning.
    """
    counts = against_reference(value_counts, reference)
    item = F.struct("value_ms", "ns", "nr")
    # At most 20 001 triples per group: the support bounds the array.
    packed = counts.groupBy(*GROUP).agg(
        F.array_sort(F.collect_list(item)).alias("c"), F.sum("ns").alias("_s"), F.sum("nr").alias("_r")
    ).filter((F.col("_s") >= 2) & (F.col("_r") >= 2))
    jobs = packed.select(
        *GROUP,
        F.col("c.value_ms").alias("v"),
        F.col("c.ns").alias("ns"),
        F.col("c.nr").alias("nr"),
        _bounds(0).alias("lo"),
        _bounds(1).alias("hi"),
        F.xxhash64(F.lit(seed), *GROUP).alias("stream"),
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(chunk))).alias("first"),
    ).repartition(*GROUP, "first")
    draws = jobs.mapInPandas(
        _replicates(replicates, chunk), "system string, metric string, ks double, emd double, js double"
    )
    bounds = []
    for name in ("ks", "emd", "js"):
        for tag, q in (("lo", 0.025), ("hi", 0.975)):
            bounds.append(F.percentile(name, F.lit(q)).alias(f"{name}_{tag}"))
    return draws.groupBy(*GROUP).agg(*bounds)


def _replicates(replicates: int, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                v = np.asarray(row.v, dtype=np.float64)
                ns, nr = np.asarray(row.ns, dtype=np.int64), np.asarray(row.nr, dtype=np.int64)
                n = int(ns.sum())
                draws = np.stack(
                    [
                        np.random.default_rng([row.stream % 2**63, row.first + i]).multinomial(n, ns / n)
                        for i in range(min(chunk, replicates - row.first))
                    ]
                )
                gap = np.abs(np.cumsum(draws, axis=1) / n - np.cumsum(nr) / nr.sum())
                width = (row.hi - row.lo) / JS_BINS
                bins = np.minimum(((v - row.lo) // width).astype(int), JS_BINS - 1)
                at = np.eye(JS_BINS)[bins]
                p, q = draws @ at / n, nr @ at / nr.sum()
                m = (p + q) / 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    div = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
                yield pd.DataFrame(
                    {
                        "system": row.system,
                        "metric": row.metric,
                        "ks": gap.max(axis=1),
                        "emd": (gap[:, :-1] * np.diff(v)).sum(axis=1) / 1000.0,
                        "js": np.sqrt(np.maximum(div.sum(axis=1), 0) / 2),
                    }
                )

    return run


def reference_distances(value_counts: DataFrame, reference: str, replicates: int = BOOTSTRAP_REPLICATES, seed: int = 0) -> DataFrame:
    """The distances with their bootstrap intervals, one row per system and metric.

    ``value_counts`` is read several times; it is small, so store it (``materialize``)
    when computing it is not.
    """
    columns = ["system", "metric", "n_system", "n_reference"]
    columns += [f"{d}{e}" for d in ("ks", "emd", "js") for e in ("", "_lo", "_hi")]
    point = distances(value_counts, reference)
    return point.join(bootstrap_ci(value_counts, reference, replicates, seed), list(GROUP), "left").select(columns)


def pair_matrix(distance: DataFrame, tutors: Sequence[str], metric: str = "fto_s", value: str = "emd") -> DataFrame:
    """Student x tutor matrix from run names of the form <student>_<tutor>_<suffix>."""
    rows = distance.filter(F.col("metric") == metric).select(
        run_part(F.col("system"), 0).alias("student"), run_part(F.col("system"), 1).alias("tutor"), value
    )
    return rows.filter(F.col("student").isNotNull()).groupBy("student").pivot("tutor", list(tutors)).agg(F.last(value))


def quartiles(scores: DataFrame, by: Sequence[str], value: str = "score", limit: int | None = None) -> DataFrame:
    """min, quartiles and max per group, exact for any number of distinct values.

    Equal values are counted before anything moves, so a score that half of the rows share is one row.
    """
    rows = scores.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    return quartiles_of_counts(rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c")), by, limit).drop("total")
