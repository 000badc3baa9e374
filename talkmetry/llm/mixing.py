"""Mixing sources to target weights by the cube method (balanced sampling).

Sources in code point order, null last, weigh 5, 2, 1, repeating, and share ``SHARE`` times all words. A source's
target is at most ``LIMIT`` times its size; what it cannot take is shared again by weight, which is the water level at
which the capped targets add up. A document of a source is taken ``floor(target / size)`` times for certain and once
more with the fractional part as its inclusion probability. Those probabilities are moved to 0 or 1 by the cube
method: every step follows the null space of the two constraints *documents* and *words* on three documents, so both
totals of a source stay where they are, until one of the three is decided.

A source is dealt into chunks of about ``CHUNK`` documents by a hash of the id; a chunk leaves two documents undecided, which
meet again in the next, far smaller round. The last round of a source stops at ``LANDING`` documents, takes the subset whose
words come closest, and mends what a last huge document leaves by changing a few others. Documents are taken whole. Order and random moves derive from ids, so reruns agree.

A null text has size 0 and is never taken; an empty table gives an empty result; each row of a repeated id is
decided by itself; only id, source and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmetry.llm.common import store, under_plain_names

SHARE = 1.5
LIMIT = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
CHUNK = 4096
LANDING = 12
WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, share: float = SHARE, limit: float = LIMIT, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs (with words) and target, one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    # Windows over one row per source.
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * limit)
    order = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("total", F.sum("source_size").over(everything) * share).withColumn("level", (F.col("total") - before) / open_weight)
    # Filling sources by rising cap per weight, the first level that a source's cap holds is everyone's level.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), "n_docs", F.greatest(target, F.lit(0.0)).alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, stop_at: int, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1 with their sum and their size-weighted sum unchanged, until ``stop_at`` are left
    or no move is possible."""
    chance = chance.astype(float).copy()
    left = int(((chance > _NEAR) & (chance < 1 - _NEAR)).sum())
    draws = iter(rng.random(len(chance) + 8))
    waiting = iter(np.flatnonzero((chance > _NEAR) & (chance < 1 - _NEAR)).tolist())
    held: list[int] = []
    while left > stop_at:
        while len(held) < 3 and (more := next(waiting, None)) is not None:
            held.append(more)
        w = [float(size[i]) for i in held]
        if len(held) == 3:
            move = [w[2] - w[1], w[0] - w[2], w[1] - w[0]]
            if not any(move):
                move = [1.0, -1.0, 0.0]
        elif len(held) == 2 and w[0] == w[1]:
            move = [1.0, -1.0]
        else:
            break
        p = [float(chance[i]) for i in held]
        up = min((1 - x) / m if m > 0 else x / -m for x, m in zip(p, move) if m)
        down = min(x / m if m > 0 else (1 - x) / -m for x, m in zip(p, move) if m)
        go = up if next(draws) * (up + down) < down else -down
        after = []
        for i, x, m in zip(held, p, move):
            x += go * m
            x = 0.0 if x <= _NEAR else 1.0 if x >= 1 - _NEAR else x
            chance[i] = x
            if 0.0 < x < 1.0:
                after.append(i)
            else:
                left -= 1
        held = after
    return chance


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last few: the subset closest in words, then in documents."""
    open_ = np.flatnonzero((chance > _NEAR) & (chance < 1 - _NEAR))
    if not len(open_):
        return np.round(chance)
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = choices - chance[open_]
    words, documents = np.abs(off @ size[open_].astype(float)), np.abs(off.sum(axis=1))
    out = chance.copy()
    out[open_] = choices[np.lexsort((documents, np.round(words, 6)))[0]]
    return mend(np.round(out), size, float(np.dot(np.round(out) - chance, size)))


def mend(taken: np.ndarray, size: np.ndarray, excess: float, changes: int = 50) -> np.ndarray:
    """Drop (or add) the document whose size is nearest to the words in excess (or missing) while that helps."""
    for _ in range(changes):
        can = np.flatnonzero((taken == (1.0 if excess > 0 else 0.0)) & (size > 0))
        if not len(can):
            break
        best = can[np.argmin(np.abs(size[can] - abs(excess)))]
        after = excess - np.sign(excess) * size[best]
        if abs(after) >= abs(excess):
            break
        taken[best] = 1.0 - taken[best]
        excess = after
    return taken


def _decide(table: pa.Table) -> pa.Table:
    last = table.column("chunks")[0].as_py() == 1
    size, tie = table.column("size").to_numpy(), table.column("tie").to_numpy()
    order = np.lexsort((tie, -size))  # large documents first: what is left over is small
    chance = table.column("chance").to_numpy()[order]
    rng = np.random.default_rng([len(order), int(np.bitwise_xor.reduce(tie)) & 0xFFFFFFFF, int(size.sum()) & 0xFFFFFFFF])
    got = flight(chance, size[order], LANDING if last else 0, rng)
    if last:
        got = land(got, size[order])
    back = np.empty_like(got)
    back[order] = got
    return table.set_column(table.column_names.index("chance"), "chance", pa.array(back))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    sized = store(sizes(docs), "sizes")
    per = store(targets(sized), "targets")
    most = per.agg(F.max("n_docs")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"])).drop(per["source"])
    rows = rows.withColumn("whole", F.floor(ratio + _NEAR).cast("long")).withColumn("chance", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "size")).withColumn("chunks", F.lit(0)).withColumn("chunk", F.lit(0))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "whole", "chance", "tie", "n_docs", "chunks", "chunk")
    undecided = (F.col("size") > 0) & (F.col("chance") > _NEAR)
    done, open_ = [rows.where(~undecided).withColumn("chance", F.lit(0.0))], rows.where(undecided)
    step = 0
    while True:
        chunks = F.ceil(F.col("n_docs") / CHUNK).cast("int")
        dealt = open_.withColumn("chunks", F.greatest(chunks, F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("tie", F.lit(step)), F.col("chunks")).cast("int"))
        got = dealt.groupBy("source", "chunk").applyInArrow(_decide, dealt.schema)
        got = store(got, "flight")
        fixed = (F.col("chance") <= _NEAR) | (F.col("chance") >= 1 - _NEAR)
        done.append(got.where(fixed))
        if most <= CHUNK:
            break
        # A chunk leaves two documents at most: so many per source are left, or fewer.
        most = 2 * -(-most // CHUNK)
        open_ = got.where(~fixed).withColumn("n_docs", 2 * F.col("chunks"))
        step += 1
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.round("chance").cast("long"))).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, a document as often as the mix takes it. Rows of a repeated id
    share one decision."""
    return under_plain_names(docs, ("doc_id", "source", "text"), _mixture)


def _mixture(docs: DataFrame) -> DataFrame:
    taken = mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.expr("taken div size")).cast("int").alias("_copies"))
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
