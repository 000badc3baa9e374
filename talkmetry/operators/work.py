"""Work planning, caches, sampling, ordering and set operations on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmetry.constants import KEYS, OUTPUT_AFFECTING_ARGS

DONE = ("ok", "skipped")


def work_plan(questions: DataFrame, attempts: int, done: DataFrame) -> DataFrame:
    """Question x attempt pairs still to do. ``questions``: pid, ord. ``done``: pid,
    attempt_index. Read in (ord, attempt_index) order."""
    todo = questions.select("ord", "pid", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt_index"))
    return todo.join(done.select("pid", "attempt_index"), ["pid", "attempt_index"], "left_anti")


def done_pairs(convs: DataFrame) -> DataFrame:
    """(pid, attempt_index) already stored; a missing attempt is 0."""
    return (
        convs.filter(F.col("pid").isNotNull())
        .select(F.col("pid").cast("string").alias("pid"), F.coalesce("attempt_index", F.lit(0)).cast("int").alias("attempt_index"))
        .distinct()
    )


def next_attempt(convs: DataFrame) -> DataFrame:
    return convs.groupBy("pid").agg((F.max(F.coalesce("attempt_index", F.lit(0))) + 1).alias("next_attempt_index"))


def select_pids(questions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions in the requested order without repeats, and the ids not found.

    ``wanted``: ord, pid.
    """
    order = first_seen(wanted, "pid", "ord")
    found = questions.join(order, "pid").select("ord", *questions.columns)
    return found, order.join(questions, "pid", "left_anti")


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place of their first appearance."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the highest ``order`` per key. ``max_by`` combines before the shuffle,
    so a key with very many versions sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*")


def merge_cache(cache: DataFrame, todo: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """What to do with every cell: ``reuse`` finished ones, ``compute`` missing or failed
    ones, ``keep`` cached cells nobody asked for.

    ``cache``: keys, status, result. A null status counts as finished.
    """
    known = cache.select(*keys, "status", "result", F.lit(True).alias("_cached"))
    asked = todo.select(*keys).distinct().withColumn("_asked", F.lit(True))
    finished = F.col("_cached").isNotNull() & (F.col("status").isNull() | F.col("status").isin(*DONE))
    action = (
        F.when(F.col("_asked").isNull(), F.lit("keep"))
        .when(finished & F.lit(not force), F.lit("reuse"))
        .otherwise(F.lit("compute"))
    )
    return asked.join(known, list(keys), "full_outer").select(*keys, action.alias("action"), "status", "result")


def merge_results(plan: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cached rows with recomputed cells replaced. ``fresh``: keys, status, result."""
    new = fresh.select(*keys, F.col("status").alias("_s"), F.col("result").alias("_r"), F.lit(True).alias("_new"))
    redo = F.col("_new").isNotNull()
    return plan.join(new, list(keys), "left").select(
        *keys,
        F.when(redo, F.col("_s")).otherwise(F.col("status")).alias("status"),
        F.when(redo, F.col("_r")).otherwise(F.col("result")).alias("result"),
    )


def scorability(todo: DataFrame, aligned: DataFrame, audio: DataFrame) -> DataFrame:
    """Can a conversation be scored, and if not why? ``aligned``: keys, onset_ms (null
    when it has no timed word); ``audio``: keys of those with a stereo file."""
    a = aligned.select(*KEYS, "onset_ms", F.lit(True).alias("_aligned"))
    f = audio.select(*KEYS).distinct().withColumn("_audio", F.lit(True))
    reason = (
        F.when(F.col("_aligned").isNull(), F.lit("not aligned"))
        .when(F.col("onset_ms").isNull(), F.lit("no aligned words"))
        .when(F.col("_audio").isNull(), F.lit("missing audio"))
    )
    return (
        todo.select(*KEYS)
        .join(a, list(KEYS), "left")
        .join(f, list(KEYS), "left")
        .select(*KEYS, F.when(reason.isNull(), F.col("onset_ms")).alias("first_onset_ms"), reason.alias("skip_reason"))
    )


def judging_matrix(rows: DataFrame, judges: Sequence[tuple[str, str]], sides: Sequence[str] = ("pos", "neg")) -> DataFrame:
    """Every row x side x judge to score; the judges and sides are a short literal list."""
    grid = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.lit(m).alias("judge_model"), F.lit(r).alias("rubric"))
            for s in sides
            for m, r in judges
        ]
    )
    return rows.select("*", F.explode(grid).alias("_g")).select(*rows.columns, "_g.*")


def manifest_drift(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Settings that differ. Both: run, kind (arg/prompt/pids), name, value (text).

    Only arguments that affect the output are compared, prompts and id lists always.
    """

    def relevant(df: DataFrame, out: str) -> DataFrame:
        wanted = (F.col("kind") != "arg") | F.col("name").isin(*OUTPUT_AFFECTING_ARGS)
        return df.filter(wanted).select("run", "kind", "name", F.col("value").alias(out))

    return (
        relevant(saved, "saved")
        .join(relevant(current, "current"), ["run", "kind", "name"], "full_outer")
        .filter(~F.col("saved").eqNullSafe(F.col("current")))
    )


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows chosen by a hash of seed and key: the same rows however the
    table is partitioned. Only the best ``n`` rows of each task leave it."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(draw, key).limit(n).orderBy(key)


def indexed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The sample with a stable ``row_idx`` in key order; the window sees ``n`` rows."""
    place = F.row_number().over(Window.orderBy(key)) - 1
    return seeded_sample(df, key, n, seed).withColumn("row_idx", place)


def sort_rows(df: DataFrame, column: str, descending: bool = False, tie_break: Sequence[str] = KEYS) -> DataFrame:
    """Sort by a chosen column; missing values come last either way."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *tie_break)


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack runs; columns a run lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def runs_with_rows(requested: DataFrame, rows: DataFrame) -> DataFrame:
    """Requested runs (ord, run) that have rows, order kept."""
    return requested.join(rows.select("run"), "run", "left_semi")


def other_systems(runs: DataFrame, reference: str) -> DataFrame:
    return runs.filter(F.col("run") != reference)


def conversations_per_run(rows: DataFrame, approximate: bool = False) -> DataFrame:
    count: Column = F.approx_count_distinct("conv_index") if approximate else F.count_distinct("conv_index")
    return rows.groupBy("run").agg(count.alias("n_conversations"))
