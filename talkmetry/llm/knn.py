"""Exact top-k by inner product: a Voronoi join of queries and vectors.

Components become ``floor(64 * x)``, so scores are integers and ties are real. Pivots, a sample of distinct
vectors, cut queries and data into Voronoi cells.

* *Summary.* Per data cell: its rows, its radius, and the distances of its k + 1 nearest members to the pivot. A repeated id is a member
  once in all cells, with its nearest row, so that of any k + 1 members at most one is the query's own.
* *Bound.* For a query at pivot q0 and distance d of it, any vector x of cell p scores at least ``<q, p> - |q| r`` for its distance
  r to p, and at most ``<q, p> + |q| R`` for the radius R. The (k + 1) best of the lower bounds are certain, so a cell whose upper
  bound lies below the last of them holds nothing for the query (one more than k, as a query does not count itself).
* *Replication.* Queries go to the cells that can matter to them; data go to their own cell only.
* *Local solve.* A cell is cut into blocks of about ``BLOCK`` vectors by a hash of the id, however many lie on one spot, and its
  queries into blocks of about as many; each pair of blocks gives every query its k best, and a window over those picks the final ones.

The summary has one row per pivot and the pivots are at most ``MAX_PIVOTS``, so both may be broadcast. Vectors that are null, or hold null
or non-finite components, take no part. Vectors of different lengths are never paired: the join runs once per length. Rows that repeat an id are separate candidates
but never their own query's answer. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from talkmetry.llm.common import store

K = 20
SCALE = 64
MAX_PIVOTS = 1024
BLOCK = 4096
_SLACK = 1e-6


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, v, the packed integer components, and their number dim, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    return rows.select("vec_id", whole.alias("v"), F.size("embedding").alias("dim"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles: exact for sums below 2 ** 53."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pick_pivots(data: DataFrame, rows: int) -> np.ndarray:
    """About sqrt(rows) distinct vectors, those smallest by a hash of their components."""
    want = int(min(MAX_PIVOTS, max(1, round(rows**0.5))))
    got = data.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(want).toArrow()
    return matrix(got.column("v").combine_chunks()) if got.num_rows else np.zeros((0, 0))


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and distance of every row; ties go to the first pivot."""
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)
    cell = square.argmin(axis=1)
    return cell, np.sqrt(np.maximum(((x - pivots[cell]) ** 2).sum(axis=1), 0.0))


def top_k(vectors: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of every query (ids divisible by ``every``)."""
    data = store(scaled(vectors), "vectors")
    lengths = sorted((r["dim"], r["count"]) for r in data.groupBy("dim").count().collect())  # one row per length
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    local = reduce(DataFrame.union, [best_of_blocks(data.where(F.col("dim") == dim).select("vec_id", "v"), rows, k, every) for dim, rows in lengths])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best_of_blocks(data: DataFrame, rows: int, k: int, every: int) -> DataFrame:
    """query_id, vec_id and score: the k best of every query in every block that can matter, of ``rows`` vectors of one length."""
    spark = data.sparkSession
    pivots = spark.sparkContext.broadcast(pick_pivots(data, rows))
    with_vectors = StructType.fromDDL("vec_id long, cell int, far double, v array<bigint>")
    arrow = to_arrow_schema(with_vectors)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = nearest(matrix(batch.column("v")), pivots.value)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cell, type=pa.int32()), pa.array(far), batch.column("v").cast(arrow.field("v").type)], schema=arrow)

    placed = store(data.mapInArrow(to_cells, with_vectors), "cells")
    # One row of every id; then the nearest k + 1 members of every cell: the window's limit is applied before the shuffle as well.
    by_cell = Window.partitionBy("cell").orderBy("far", "vec_id")
    members = placed.groupBy("vec_id").agg(F.min(F.struct("far", "cell")).alias("at")).select("at.cell", "at.far", "vec_id")
    close = members.withColumn("n", F.row_number().over(by_cell)).where(F.col("n") <= k + 1)
    summary = (
        placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("rows"))
        .join(close.groupBy("cell").agg(F.array_sort(F.collect_list("far")).alias("near")), "cell", "left").orderBy("cell").toArrow()
    )  # at most MAX_PIVOTS rows of k + 3 numbers
    cells = summary.column("cell").to_numpy()
    radius = summary.column("radius").to_numpy()
    near = np.full((len(cells), k + 1), np.inf)
    for i, d in enumerate(summary.column("near").to_pylist()):
        near[i, : len(d or ())] = d or ()
    shared = spark.sparkContext.broadcast((cells, radius, near))

    sent_schema = StructType.fromDDL("cell int, query_id long, q array<bigint>")
    sent_arrow = to_arrow_schema(sent_schema)

    def to_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_, radius_, near_ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column("v"))
            norm = np.sqrt((q * q).sum(axis=1))
            at = q @ pivots.value[cells_].T
            for i in range(len(q)):
                sure = (at[i][:, None] - norm[i] * near_).ravel()
                sure = sure[np.isfinite(sure)]
                floor = np.partition(sure, -(k + 1))[-(k + 1)] if len(sure) > k else -np.inf
                slack = _SLACK * (1.0 + np.abs(at[i]) + norm[i] * radius_)
                hit = np.flatnonzero(at[i] + norm[i] * radius_ + slack >= floor)
                one = batch.slice(i, 1)
                times = pa.array(np.zeros(len(hit), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cells_[hit], type=pa.int32()), one.column("vec_id").take(times), one.column("v").take(times).cast(sent_arrow.field("q").type)], schema=sent_arrow)

    queries = store(data.where(F.col("vec_id") % every == 0).mapInArrow(to_queries, sent_schema), "queries")
    sizes = spark.createDataFrame([(int(c), max(1, -(-int(n) // BLOCK))) for c, n in zip(cells, summary.column("rows").to_pylist())], "cell int, blocks int")
    turns = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns"))
    sizes = sizes.join(turns, "cell")  # one row per cell that is asked

    def every_one(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    def dealt(column: str, of: str):
        return F.pmod(F.xxhash64(column), F.col(of)).cast("int")

    blocks = placed.join(F.broadcast(sizes), "cell").select("cell", dealt("vec_id", "blocks").alias("block"), every_one("turns").alias("turn"), "vec_id", "v")
    asked = queries.join(F.broadcast(sizes), "cell").select("cell", every_one("blocks").alias("block"), dealt("query_id", "turns").alias("turn"), "query_id", "q")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        none = {"query_id": np.zeros(0, dtype=np.int64), "vec_id": np.zeros(0, dtype=np.int64), "score": np.zeros(0, dtype=np.int64)}
        if not left.num_rows or not right.num_rows:
            return pa.table(none)
        ids, x = left.column("vec_id").to_numpy(), matrix(left.column("v").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        asked_ids, q_all = right.column("query_id").to_numpy(), matrix(right.column("q").combine_chunks())
        found = []
        for at in range(0, len(asked_ids), 256):
            mine, q = asked_ids[at : at + 256], q_all[at : at + 256]
            score = np.rint(q @ x.T)
            score[mine[:, None] == ids[None, :]] = -np.inf
            take = min(k, len(ids))
            last = np.partition(score, len(ids) - take, axis=1)[:, len(ids) - take]
            for i in range(len(mine)):
                hit = np.flatnonzero((score[i] >= last[i]) & np.isfinite(score[i]))
                best = hit[np.argsort(-score[i, hit], kind="stable")][:k]  # ids rise, so ties go to the smaller
                found.append((np.full(len(best), mine[i]), ids[best], score[i, best].astype(np.int64)))
        return pa.table({n: np.concatenate([f[j] for f in found]) for j, n in enumerate(none)})

    return blocks.groupBy("cell", "block", "turn").cogroup(asked.groupBy("cell", "block", "turn")).applyInArrow(solve, "query_id long, vec_id long, score long")


def oracle(table: str = "embeddings", k: int = K, every: int = 20) -> str:
    """DuckDB SQL for ``top_k``: every query against every vector."""
    return f"""
WITH s AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM {table}
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM s q JOIN s c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) x WHERE rank <= {k}
"""
