"""Frame tables: decoding, clocks, thinning, activity, label windows, chunk stitching.

Where frames meet one row a conversation, the latter is hashed in every task: frames made in the plan look small to
Spark, which would broadcast them otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmetry.constants import (
    CHUNK_CONTEXT_MS,
    CHUNK_DIRECT_MAX_MS,
    CHUNK_STEP_MS,
    FRAME_LABELS,
    FRAME_STEP_MS,
    KEYS,
    LABEL_MIN_TAIL_MS,
    LABEL_WINDOW_MS,
    PLOT_MAX_POINTS,
    PREROLL_MS,
    ROLES,
)
from talkmetry.operators.ordered import Scan, hot_keys, scan


def decode_frames(text: Column) -> Column:
    """array<struct<probs, label>> of space-separated frames of comma-separated
    probabilities. Frames with a bad number or the wrong length are dropped; the label is
    the first of the largest."""
    names = F.array(*[F.lit(x) for x in FRAME_LABELS])
    frames = F.filter(F.split(text, " "), lambda f: F.trim(f) != "")
    probs = F.transform(frames, lambda f: F.transform(F.split(f, ","), lambda x: F.trim(x).try_cast("double")))
    good = F.filter(
        probs, lambda p: (F.size(p) == len(FRAME_LABELS)) & ~F.exists(p, lambda x: x.isNull())
    )
    return F.transform(
        good,
        lambda p: F.struct(
            p.alias("probs"), F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).alias("label")
        ),
    )


def decoded_rows(windows: DataFrame, text: str = "frames") -> DataFrame:
    """One row per kept frame with its number inside the window."""
    keep = [c for c in windows.columns if c != text]
    # The outer form keeps Catalyst from decoding twice (once to test for emptiness).
    rows = windows.select(*keep, F.posexplode_outer(decode_frames(F.col(text))).alias("frame", "f"))
    return rows.filter(F.col("f").isNotNull()).select(*keep, "frame", "f.label", "f.probs")


def frame_clock(frames: DataFrame, onsets: DataFrame, step_ms: int = FRAME_STEP_MS) -> DataFrame:
    """Frame times on the conversation's clock: the audio starts 0.8 s before the first
    onset (or at 0). ``onsets``: run, conv_index, onset_ms."""
    trim = F.greatest(F.lit(0), F.col("onset_ms") - PREROLL_MS)
    return frames.join(onsets.hint("shuffle_hash"), list(KEYS)).withColumn("t_ms", trim + F.col("frame") * step_ms).drop("onset_ms")


def downsample(frames: DataFrame, max_points: int = PLOT_MAX_POINTS) -> DataFrame:
    """Every k-th frame, k = ceil(n / max_points) of the conversation.

    Frames are numbered already, so the count is an aggregate joined back and no
    conversation is sorted.
    """
    n = frames.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_points))
    return frames.join(n.hint("shuffle_hash"), list(KEYS)).filter(F.col("frame") % stride == 0).drop("_n")


def activity_steps(intervals: DataFrame, step_ms: int, t0_ms: int = 0) -> DataFrame:
    """run, conv_index, frame and one column per role: by how many its covering intervals (``start <= t < end``) change there.

    An interval gives two rows however long it is, so a corrupt end costs one row.
    """

    def first_at_or_after(t: Column) -> Column:
        return F.ceil((t - t0_ms) / step_ms).cast("long")

    first = F.greatest(F.lit(0).cast("long"), first_at_or_after(F.col("start_ms")))
    behind = first_at_or_after(F.col("end_ms"))
    ends = F.array(F.struct(F.col("_a").alias("frame"), F.lit(1).alias("d")), F.struct(F.col("_b").alias("frame"), F.lit(-1).alias("d")))
    steps = intervals.withColumns({"_a": first, "_b": behind}).filter(F.col("_b") > F.col("_a")).select(*KEYS, "role", F.explode(ends).alias("_e"))
    change = {r: F.sum(F.when(F.col("role") == r, F.col("_e.d")).otherwise(0)) for r in ROLES}
    return steps.groupBy(*KEYS, F.col("_e.frame").alias("frame")).agg(*[c.alias(f"_d_{r}") for r, c in change.items()])


def frame_activity(
    frames: DataFrame,
    intervals: DataFrame,
    step_ms: int,
    t0_ms: int = 0,
    limit: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Frames with one 0/1 column per role: is the running sum of the steps up to the frame above zero?

    ``hot`` as in ``ordered.scan``, found along ``frame``.
    """
    steps = activity_steps(intervals, step_ms, t0_ms).withColumn("_kind", F.lit(0))
    both = frames.withColumn("_kind", F.lit(1)).unionByName(steps, allowMissingColumns=True)
    if hot is None:
        hot = hot_keys(frames, KEYS, "frame", limit)
    summed = scan(both, KEYS, ["frame", "_kind"], Scan(sum_before={f"_on_{r}": f"_d_{r}" for r in ROLES}), hot=hot)
    active = [(F.col(f"_on_{r}") > 0).cast("int").alias(f"{r}_active") for r in ROLES]
    return summed.filter(F.col("_kind") == 1).select(*frames.columns, *active)


def detect_channels(activity: DataFrame, energy: tuple[str, str] = ("energy0", "energy1")) -> DataFrame:
    """Which channel carries the tutor: the one whose energy follows the tutor's activity
    better than the student's, with the opposite test on the other channel added."""
    pairs = {f"r{c}_{role}": F.corr(energy[c], f"{role}_active") for c in (0, 1) for role in ROLES}
    corr = activity.groupBy(*KEYS).agg(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in pairs.items()])
    score = (F.col("r0_tutor") - F.col("r0_student")) + (F.col("r1_student") - F.col("r1_tutor"))
    return corr.select(*KEYS, score.alias("score"), F.when(score >= 0, 0).otherwise(1).alias("tutor_channel"))


def label_windows(
    frames: DataFrame,
    totals: DataFrame,
    window_ms: int = LABEL_WINDOW_MS,
    max_windows: int | None = None,
    min_tail_ms: int = LABEL_MIN_TAIL_MS,
) -> DataFrame:
    """Label counts per non-overlapping window. A last window shorter than the minimum is
    left out. ``frames``: keys, t_ms, label; ``totals``: keys, total_ms."""
    index = F.floor(F.col("t_ms") / window_ms).cast("long")
    counted = frames.groupBy(*KEYS, index.alias("window_index")).agg(
        F.count(F.lit(1)).alias("n_frames"), *[F.count_if(F.col("label") == x).alias(x) for x in FRAME_LABELS]
    )
    start = F.col("window_index") * window_ms
    end = F.least(start + window_ms, F.col("total_ms"))
    out = counted.join(totals.hint("shuffle_hash"), list(KEYS)).filter(end - start >= min_tail_ms)
    if max_windows is not None:
        out = out.filter(F.col("window_index") < max_windows)
    return out.select(
        *KEYS,
        "window_index",
        (start / 1000.0).alias("window_start_s"),
        (end / 1000.0).alias("window_end_s"),
        "n_frames",
        *FRAME_LABELS,
    )


def chunk_plan(
    durations: DataFrame,
    step_ms: int = CHUNK_STEP_MS,
    context_ms: int = CHUNK_CONTEXT_MS,
    direct_max_ms: int = CHUNK_DIRECT_MAX_MS,
) -> DataFrame:
    """Overlapping chunks of long conversations and the stretch each one contributes.

    ``durations``: keys, duration_ms. A conversation up to ``direct_max_ms`` is one chunk.
    Else chunks of context + step slide by step: the first is kept whole, later ones keep
    their last step, and a tail chunk at the very end fills what is left.
    """
    size = step_ms + context_ms
    dur = F.col("duration_ms")
    n = F.floor((dur - size) / step_ms) + 1
    direct = F.array(
        F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("from_ms"), dur.alias("to_ms"), F.lit(0).cast("long").alias("keep_from_ms"))
    )
    sliding = F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1),
        lambda i: F.struct(
            i.alias("chunk"),
            (i * step_ms).alias("from_ms"),
            (i * step_ms + size).alias("to_ms"),
            F.when(i == 0, F.lit(0).cast("long")).otherwise(i * step_ms + context_ms).alias("keep_from_ms"),
        ),
    )
    covered = (n - 1) * step_ms + size
    tail = F.when(
        covered < dur,
        F.array(F.struct(n.alias("chunk"), (dur - size).alias("from_ms"), dur.alias("to_ms"), covered.alias("keep_from_ms"))),
    ).otherwise(F.array().cast("array<struct<chunk:bigint,from_ms:bigint,to_ms:bigint,keep_from_ms:bigint>>"))
    plan = F.when(dur > direct_max_ms, F.concat(sliding, tail)).otherwise(direct)
    return durations.select(*KEYS, F.explode(plan).alias("c")).select(*KEYS, "c.*")


def chunk_frames(frames: DataFrame, plan: DataFrame, step_ms: int = CHUNK_STEP_MS, context_ms: int = CHUNK_CONTEXT_MS) -> DataFrame:
    """The frames each chunk sees (every frame about five times).

    A frame's candidate chunks follow from its time, so the join is on (conversation,
    chunk start slot) rather than on a range. Spark sizes the slots by the conversations they are made from, so
    the join is told not to broadcast them.
    """
    size = step_ms + context_ms
    slots = plan.select(*KEYS, "chunk", "from_ms", "to_ms", "keep_from_ms", F.explode(
        F.sequence(F.floor(F.col("from_ms") / size), F.floor((F.col("to_ms") - 1) / size))
    ).alias("_slot"))
    return (
        frames.withColumn("_slot", F.floor(F.col("t_ms") / size))
        .join(slots.hint("merge"), [*KEYS, "_slot"])
        .filter((F.col("t_ms") >= F.col("from_ms")) & (F.col("t_ms") < F.col("to_ms")))
        .drop("_slot")
    )


def stitch_chunks(chunked: DataFrame) -> DataFrame:
    """Keep each chunk's own stretch: every frame once, from the chunk that owns it."""
    return chunked.filter(F.col("t_ms") >= F.col("keep_from_ms")).drop("from_ms", "to_ms", "keep_from_ms")
