"""Helpers shared by the operators: columns of any input, intermediate tables, words, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MASK64 = (1 << 64) - 1
#: Odd 64-bit multipliers of the rolling hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_llm"
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove tables written by ``store`` once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def under_plain_names(docs: DataFrame, used: Sequence[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs``, which gets the columns it does not use under names that clash with none of its own.

    ``stage`` returns the columns it was given; they come back under their names and in their order.
    """
    plain = [c if c in used else f"_given_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*plain)).select(*plain).toDF(*docs.columns)


def rows_and_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return int(got["n"]), int(got["b"] or 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split`` separates at."""
    return text.split() if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a fixed number of distinct words."""

    def __init__(self, limit: int = 200_000):
        self._known: dict[bytes, int] = {}
        self._limit = limit

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > self._limit:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        out = []
        for t in tokens:
            h = known.get(t)
            if h is None:
                h = known[t] = digest(t)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingle_set(tokens: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle, none is empty."""
    n = len(tokens)
    if not n:
        return tokens
    span = min(width, n)
    h = tokens[: n - span + 1].copy()
    for k in range(1, span):
        h *= STEP
        h += tokens[k : n - span + 1 + k]
    return np.unique(mix64(h + np.uint64(span)))


def arrow_map(df: DataFrame, row_maker: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch that returns columns by name."""
    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = row_maker(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], (pa.Array, pa.ChunkedArray)) else cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``links``, by alternating star steps.

    Each round connects every node's larger neighbours, then all its neighbours, to the smallest
    one. A round is two grouped minima and two joins on the node, with skew left to the adaptive join; the rounds
    are logarithmic in the longest path. Links never reach the driver, only their count and a checksum.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = store(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    sign = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        after = store(small, "edges")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if now == sign:
            break
        sign = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def site(url: str | Column) -> Column:
    """Lower-case host of a URL; an empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))
