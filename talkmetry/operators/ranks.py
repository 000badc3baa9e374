"""Order statistics from counts per distinct value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmetry.operators.ordered import Scan, scan


def quartiles_of_counts(counts: DataFrame, by: Sequence[str], limit: int | None = None) -> DataFrame:
    """The same from the number of rows (``c``) of each distinct value (``v``), plus the sum of the values.

    A running count over the distinct values tells which of them stands at a wanted position.
    """
    sizes = counts.groupBy(*by).agg(
        F.sum("c").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum(F.col("v") * F.col("c")).alias("total")
    )
    placed = scan(counts, by, ["v"], Scan(sum_before={"_before": "c"}), limit)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_before") <= position) & (position < F.col("_before") + F.col("c")), F.col("v")))

    picks = []
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        low = F.floor((F.col("n") - 1) * F.lit(q)).cast("long")
        picks += [at(low).alias(f"_{name}_lo"), at(F.least(low + 1, F.col("n") - 1)).alias(f"_{name}_hi")]
    found = placed.join(sizes.select(*by, "n"), list(by)).groupBy(*by).agg(*picks)

    def value_at(name: str, q: float) -> Column:
        at = (F.col("n") - 1) * F.lit(q)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return F.round(low + (high - low) * (at - F.floor(at)), 6).alias(name)

    return sizes.join(found, list(by)).select(
        *by, "n", "min", value_at("q1", 0.25), value_at("median", 0.5), value_at("q3", 0.75), "max", "total"
    )
