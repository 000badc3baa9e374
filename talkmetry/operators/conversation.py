"""Per-conversation transcript metrics over ``segments``.

``segments``: run, conv_index, seg_id (list position), role, text, start_ms, end_ms.
``convs`` (optional): run, conv_index, duration_ms. Without it the duration is the
latest segment end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmetry.constants import BACKCHANNEL_MAX_MS, BACKCHANNEL_MAX_WORDS, KEYS, ROLES
from talkmetry.functions.text import exact_mean, ratio, round_exact, seconds, word_count
from talkmetry.operators.intervals import cross_overlap, reach_before
from talkmetry.operators.ordered import Scan, hot_keys, scan


def durations(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*KEYS).agg(F.max("end_ms").alias("duration_ms"))


def known_roles(segments: DataFrame) -> DataFrame:
    return segments.filter(F.col("role").isin(*ROLES))


def spoken_ms():
    """Segment length, never negative."""
    return F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))


def role_switches(segments: DataFrame, limit: int | None = None) -> DataFrame:
    """Changes of role in list order, other roles left out."""
    ordered = scan(
        known_roles(segments).select(*KEYS, "seg_id", "role"),
        KEYS,
        ["seg_id"],
        Scan(prev={"prev_role": "role"}),
        limit,
    )
    return ordered.groupBy(*KEYS).agg(
        F.count_if(F.col("role") != F.col("prev_role")).alias("role_switches")
    )


def conversation_stats(
    segments: DataFrame, convs: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Segments, words, speaking time, pace and share of each role, and role switches.

    Every segment counts in ``num_segments``; only known roles count elsewhere. The
    neighbour scan hands its rows straight to one aggregate on the same key.
    """
    known = F.col("role").isin(*ROLES)
    base = segments.select(
        *KEYS,
        "seg_id",
        F.when(known, F.col("role")).alias("role"),
        word_count(F.col("text")).alias("words"),
        spoken_ms().alias("spoken"),
        "end_ms",
    )
    spoken_rows = scan(
        base.filter(F.col("role").isNotNull()), KEYS, ["seg_id"], Scan(prev={"prev_role": "role"}), limit
    )
    others = base.filter(F.col("role").isNull()).withColumn("prev_role", F.lit(None).cast("string"))
    per_role = []
    for role in ROLES:
        mine = F.col("role") == role
        per_role += [
            F.count_if(mine).alias(f"{role}_segments"),
            F.coalesce(F.sum(F.when(mine, F.col("words"))), F.lit(0)).alias(f"{role}_words"),
            F.coalesce(F.sum(F.when(mine, F.col("spoken"))), F.lit(0)).alias(f"{role}_ms"),
        ]
    totals = spoken_rows.unionByName(others).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("num_segments"),
        F.count_if(F.col("role") != F.col("prev_role")).alias("role_switches"),
        F.max("end_ms").alias("last_end_ms"),
        *per_role,
    )
    if convs is None:
        totals = totals.withColumn("duration_ms", F.col("last_end_ms"))
    else:
        # A conversation without segments still gets a row of zeros.
        totals = convs.select(*KEYS, "duration_ms").join(totals, list(KEYS), "left")
        counts = ["num_segments", "role_switches"] + [
            f"{r}_{c}" for r in ROLES for c in ("segments", "words", "ms")
        ]
        totals = totals.fillna(0, counts)
    columns = [
        seconds(F.col("duration_ms")).alias("duration_s"),
        F.col("num_segments"),
        F.col("role_switches"),
    ]
    for role in ROLES:
        ms = F.col(f"{role}_ms")
        columns += [
            F.col(f"{role}_segments"),
            F.col(f"{role}_words"),
            seconds(ms).alias(f"{role}_speaking_time_s"),
            F.when(ms > 0, round_exact(F.col(f"{role}_words") / (ms / 60000.0), 1))
            .otherwise(F.lit(0.0))
            .alias(f"{role}_words_per_min"),
            ratio(ms, F.col("duration_ms")).alias(f"{role}_talk_ratio"),
        ]
    return totals.select(*KEYS, *columns)


def hot_conversations(segments: DataFrame, limit: int | None = None) -> DataFrame:
    """Conversations too large for one task, for every scan along time to share."""
    return hot_keys(segments, KEYS, "start_ms", limit)


def response_gaps(segments: DataFrame, limit: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Gap (ms) from the previous segment to the next one of another role, sorted by start."""
    ordered = scan(
        segments.select(*KEYS, "start_ms", "seg_id", "role", "end_ms"),
        KEYS,
        ["start_ms", "seg_id"],
        Scan(prev={"prev_role": "role", "prev_end_ms": "end_ms"}),
        limit,
        hot,
    )
    return ordered.filter(~F.col("role").eqNullSafe(F.col("prev_role")) & F.col("prev_end_ms").isNotNull()).select(
        *KEYS, "seg_id", (F.col("start_ms") - F.col("prev_end_ms")).alias("gap_ms")
    )


def response_latency(segments: DataFrame, limit: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Mean, median, p90 and count of the gaps that are not overlaps.

    Gaps are whole milliseconds, so the exact percentile keeps one counter per distinct
    gap and merges map-side.
    """
    return (
        response_gaps(segments, limit, hot)
        .filter(F.col("gap_ms") >= 0)
        .groupBy(*KEYS)
        .agg(
            seconds(F.sum("gap_ms") / F.count(F.lit(1))).alias("latency_mean_s"),
            seconds(F.median("gap_ms")).alias("latency_median_s"),
            # Interpolation lands on tenths of a millisecond; drop the float noise first.
            seconds(F.round(F.percentile("gap_ms", F.lit(0.9)), 1)).alias("latency_p90_s"),
            F.count(F.lit(1)).alias("latency_count"),
        )
    )


def speech_overlap(segments: DataFrame, limit: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Milliseconds in which tutor and student intervals overlap, pair by pair, and
    milliseconds in which anyone speaks."""
    side = F.when(F.col("role") == "tutor", 0).when(F.col("role") == "student", 1)
    return cross_overlap(segments.select(*KEYS, "role", "start_ms", "end_ms"), side, KEYS, limit, hot)


def backchannels(segments: DataFrame, limit: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Short segments said while the other role's segment is in progress.

    A role other than the two known ones is compared with the tutor.
    """
    rows = segments.select(
        *KEYS, "seg_id", "role", "start_ms", "end_ms", word_count(F.col("text")).alias("words")
    )
    short = rows.filter(
        (F.col("end_ms") - F.col("start_ms") <= BACKCHANNEL_MAX_MS)
        & (F.col("words") <= BACKCHANNEL_MAX_WORDS)
    ).withColumn("heard", F.when(F.col("role") == "tutor", F.lit("student")).otherwise(F.lit("tutor")))
    floor = known_roles(rows).select(*KEYS, F.col("role").alias("heard"), "start_ms", "end_ms")
    asked = short.select(*KEYS, "heard", "seg_id", "role", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"))
    reached = reach_before(asked, floor, "seg_end", [*KEYS, "heard"], limit=limit, hot=hot)
    return reached.filter(F.col("reach_ms") > F.col("seg_start")).select(*KEYS, "seg_id", "role")


def turn_taking(
    segments: DataFrame, convs: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Latency, overlap, silence and backchannel metrics, one row per conversation.

    All parts are aggregates keyed by the conversation, so the joins below meet data
    that is already small and hashed on the join key.
    """
    base = segments.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_segments"), F.max("end_ms").alias("last_end_ms")
    )
    if convs is not None:
        base = convs.select(*KEYS, "duration_ms").join(base, list(KEYS), "left")
    else:
        base = base.withColumn("duration_ms", F.col("last_end_ms"))
    hot = hot_conversations(segments, limit)
    joined = (
        base.join(response_latency(segments, hot=hot), list(KEYS), "left")
        .join(speech_overlap(segments, hot=hot), list(KEYS), "left")
        .join(
            backchannels(segments, hot=hot).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_back")),
            list(KEYS),
            "left",
        )
    )
    zero = F.lit(0)
    overlap = F.coalesce(F.col("overlap_ms"), zero)
    silence = F.greatest(zero, F.col("duration_ms") - F.coalesce(F.col("active_ms"), zero))
    back = F.coalesce(F.col("n_back"), zero)
    n = F.greatest(F.coalesce(F.col("n_segments"), zero), F.lit(1))
    return joined.select(
        *KEYS,
        *[F.coalesce(F.col(f"latency_{c}_s"), F.lit(0.0)).alias(f"latency_{c}_s") for c in ("mean", "median", "p90")],
        F.coalesce(F.col("latency_count"), zero).alias("latency_count"),
        seconds(overlap).alias("overlap_s"),
        ratio(overlap, F.col("duration_ms")).alias("overlap_ratio"),
        seconds(silence).alias("silence_s"),
        ratio(silence, F.col("duration_ms")).alias("silence_ratio"),
        back.alias("backchannel_count"),
        round_exact(back / n, 3).alias("backchannel_ratio"),
    )


def run_summary(detail: DataFrame, metrics: list[str] | None = None, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Mean of each numeric column per run; missing values do not count."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    if metrics is None:
        metrics = [c for c, t in detail.dtypes if t in numeric and c not in KEYS and c not in by]
    return detail.groupBy(*by).agg(
        *[exact_mean(F.col(c), 3).alias(c) for c in metrics]
    )
