"""Turn-taking events: detection, silence guard, uptake, frame reads, cues and cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmetry.constants import CELLS, CUE_LABELS, KEYS, ROLES, SCOPES, THRESHOLDS, Thresholds
from talkmetry.operators.ordered import BLOCK, BLOCKS, Scan, hot_keys, mirrored, scan_given, with_blocks
from talkmetry.operators.timing import adjacent_runs

# Frame probabilities by channel: 0 = tutor, 1 = student.
PROBS = ("p_now0", "p_now1", "p_future0", "p_future1")


def turn_events(
    runs: DataFrame,
    frame_range: DataFrame | None = None,
    th: Thresholds = THRESHOLDS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Candidate events with their guard and uptake facts.

    ``runs`` are speech runs. ``frame_range`` (run, conv_index, t_lo, t_hi) drops events
    outside the frames. Each event also carries, for the responder (the role that does
    not hold the floor): ``reach_ms`` = latest end among its runs that began before the
    event, and ``onset_ms`` = its first onset strictly after the event. A scan forwards and
    one backwards over runs and events replace two range joins. ``hot`` as in ``adjacent_runs``.
    """
    steps = adjacent_runs(runs.select(*KEYS, "role", "start_ms", "end_ms"), hot=hot)
    gap = F.col("next_start_ms") - F.col("end_ms")
    same = F.col("role") == F.col("next_role")
    kind = F.when(same & gap.between(th.pause_min_ms, th.pause_max_ms), F.lit("intra_pause")).when(
        ~same & gap.between(0, th.max_gap_ms), F.lit("turn_end")
    )
    # A run row speaks for its own role at its onset; an event row asks about the other
    # role at the run's end. Both come out of the same rows, so nothing is read twice.
    ask = F.struct(
        F.lit(1).alias("is_event"),
        F.col("end_ms").alias("t"),
        F.when(F.col("role") == "tutor", F.lit("student")).otherwise(F.lit("tutor")).alias("who"),
        F.lit(None).cast("long").alias("run_end"),
        kind.alias("event_type"),
        F.col("role").alias("holder"),
        gap.alias("gap_ms"),
    )
    tell = F.struct(
        F.lit(0).alias("is_event"),
        F.col("start_ms").alias("t"),
        F.col("role").alias("who"),
        F.col("end_ms").alias("run_end"),
        F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("string").alias("holder"),
        F.lit(None).cast("long").alias("gap_ms"),
    )
    both = F.array(tell, F.when(kind.isNotNull(), ask))
    stream = steps.select(*KEYS, F.explode(both).alias("r")).filter(F.col("r").isNotNull()).select(*KEYS, "r.*")
    # An event sorts before a run that starts at the same instant, in both directions, so
    # "earlier rows" means strictly before and, backwards, strictly after.
    starts = F.when(F.col("is_event") == 0, -F.col("t"))
    stream = stream.withColumns({"_kind": 1 - F.col("is_event"), "_back": -F.col("t"), "_onset": starts})
    by = [*KEYS, "who"]
    back = None if hot is None else mirrored(hot)
    stream = scan_given(stream, by, ["t", "_kind"], Scan(max_before={"reach_ms": "run_end"}), hot)
    stream = scan_given(stream, by, ["_back", "_kind"], Scan(max_before={"_next": "_onset"}), back)
    events = stream.filter(F.col("is_event") == 1).select(
        *KEYS,
        F.col("t").alias("t_ms"),
        "holder",
        F.col("who").alias("responder"),
        "event_type",
        "gap_ms",
        "reach_ms",
        (-F.col("_next")).alias("onset_ms"),
    )
    if frame_range is not None:
        events = events.join(frame_range, list(KEYS)).filter(
            F.col("t_ms").between(F.col("t_lo"), F.col("t_hi"))
        ).drop("t_lo", "t_hi")
    guarded = F.coalesce(F.col("reach_ms") > F.col("t_ms") - th.guard_pre_ms, F.lit(False))
    took = F.coalesce(F.col("onset_ms") <= F.col("t_ms") + th.w_decision_ms, F.lit(False))
    return events.select(
        *KEYS,
        "t_ms",
        "holder",
        "responder",
        "event_type",
        "gap_ms",
        guarded.alias("dropped_guard"),
        took.alias("took_floor"),
        F.when(took, F.col("onset_ms") - F.col("t_ms")).alias("latency_ms"),
    )


def kept_events(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("dropped_guard"))


def frame_ranges(frames: DataFrame) -> DataFrame:
    """First and last frame time per conversation, with the frame count."""
    return frames.groupBy(*KEYS).agg(
        F.min("t_ms").alias("t_lo"), F.max("t_ms").alias("t_hi"), F.count(F.lit(1)).alias("n_frames")
    )


def nearest_grid_index(t: Column, t0: Column | int, step_ms: int) -> Column:
    """Index of the nearest frame of a regular grid; the earlier one on a tie."""
    return F.floor((2 * (t - t0) + (step_ms - 1)) / (2 * step_ms)).cast("long")


def read_frames(
    events: DataFrame,
    frames: DataFrame,
    step_ms: int,
    smooth: int = THRESHOLDS.read_smooth_frames,
) -> DataFrame:
    """Causal mean of ``smooth`` frames ending at the frame nearest to each event.

    ``frames``: run, conv_index, frame (0-based) and ``PROBS`` (0 = tutor, 1 = student), on
    a regular grid that starts at the conversation's ``t_lo`` (or at 0). The frame number
    is arithmetic, so the big table meets the events in an equi-join on
    (conversation, frame): no range predicate, and one long conversation spreads over
    all tasks. Frames made in the plan look small to Spark, so the join is told not to broadcast them.
    """
    frames = frames.select(*KEYS, "frame", *PROBS).hint("merge")
    t0 = F.col("t_lo") if "t_lo" in events.columns else F.lit(0)
    index = nearest_grid_index(F.col("t_ms"), t0, step_ms)
    first = F.greatest(F.lit(0).cast("long"), index - (smooth - 1))
    if smooth == 1:
        return (
            events.withColumn("frame", index)
            .join(frames, [*KEYS, "frame"])
            .drop("frame")
        )
    names = events.columns
    wanted = events.withColumn("frame", F.explode(F.sequence(first, index)))
    return (
        wanted.join(frames, [*KEYS, "frame"])
        .groupBy(*names)
        .agg(*[F.avg(p).alias(p) for p in PROBS])
    )


def nearest_frames(
    events: DataFrame,
    frames: DataFrame,
    limit: int | None = None,
    smooth: int = 1,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The frame nearest to each event on any grid, with or without holes; the earlier one on a tie.

    ``frames``: run, conv_index, t_ms and ``PROBS``. With ``smooth`` above 1 the values are the causal mean of so many frames
    ending at the nearest one (of fewer at the start). Adds ``frame_ms`` and the values; events of conversations without frames go.

    Events and frames are merged into one stream by time and sorted once. An event looks back at the last ``smooth`` frames
    and ahead at the next one, skipping other events; nothing is joined back. A hot conversation is cut into blocks, which take the
    frames an event may need from beyond their edges with them. ``hot`` as in ``ordered.scan``, found along ``t_ms``.
    """
    given = [c for c in events.columns if c not in KEYS]
    frame = F.struct(F.col("t_ms").alias("ms"), *PROBS)
    seen = frames.select(*KEYS, F.col("t_ms").alias("_t"), F.lit(0).alias("_kind"), frame.alias("_f"))
    asked = events.select(*KEYS, F.col("t_ms").alias("_t"), F.lit(1).alias("_kind"), F.struct(*given).alias("_event"))
    if hot is None:
        hot = hot_keys(seen, KEYS, "_t", limit)
    stream = with_blocks(seen.unionByName(asked, allowMissingColumns=True), hot, "_t")
    stream = stream.unionByName(_edge_frames(with_blocks(seen, hot, "_t", "inner"), hot, smooth), allowMissingColumns=True)
    order = f"OVER (PARTITION BY {', '.join(KEYS)}, {BLOCK} ORDER BY _t, _kind)"
    looks = {f"_b{i}": F.expr(f"lag(_f, {i}) IGNORE NULLS {order}") for i in range(1, smooth + 1)}
    looks["_next"] = F.expr(f"lead(_f, 1) IGNORE NULLS {order}")
    found = stream.withColumns(looks).filter(F.col("_kind") == 1)
    before, after, t = F.col("_b1.ms"), F.col("_next.ms"), F.col("_t")
    ahead = before.isNull() | F.coalesce(after - t < t - before, F.lit(False))
    behind = [F.col(f"_b{i}") for i in range(smooth, 0, -1)]
    used = F.when(ahead, F.array(*behind[1:], F.col("_next"))).otherwise(F.array(*behind))
    used = F.filter(used, lambda f: f.isNotNull())
    found = found.select(*KEYS, "_event", used.alias("_used")).filter(F.size("_used") > 0)

    def mean(p: str) -> Column:
        values = F.filter(F.transform("_used", lambda f: f[p]), lambda x: x.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))
        return F.try_divide(total, F.size(values)).alias(p)

    values = [F.element_at("_used", 1)[p].alias(p) if smooth == 1 else mean(p) for p in PROBS]
    return found.select(*KEYS, "_event.*", F.element_at("_used", -1)["ms"].alias("frame_ms"), *values)


def _edge_frames(blocks: DataFrame, hot: DataFrame, smooth: int) -> DataFrame:
    """For every block of a hot conversation: the last ``smooth`` frames before it and the first one behind it.

    ``blocks``: the frames of hot conversations with their block. A block gives its own last and first frames; one row per block,
    whether it has frames or not, then looks over the others.
    """
    at = Window.partitionBy(*KEYS, BLOCK).orderBy(F.desc("_t"))
    last = blocks.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= smooth)
    last = last.groupBy(*KEYS, BLOCK).agg(F.array_sort(F.collect_list("_f")).alias("_lasts"))
    first = blocks.groupBy(*KEYS, BLOCK).agg(F.min_by("_f", "_t").alias("_first"))
    all_blocks = hot.select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))).alias(BLOCK))
    summary = all_blocks
    for own in (last, first):
        own = own.withColumnsRenamed({k: f"_own_{k}" for k in (*KEYS, BLOCK)})
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in (*KEYS, BLOCK)])
        summary = summary.join(own, same, "left").drop(*[f"_own_{k}" for k in (*KEYS, BLOCK)])
    along = Window.partitionBy(*KEYS).orderBy(BLOCK)
    before = F.flatten(F.collect_list("_lasts").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    after = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    near = F.slice("_before", F.greatest(F.lit(1), F.size("_before") - (smooth - 1)), F.lit(smooth))
    edges = F.filter(F.concat(near, F.array("_after")), lambda f: f.isNotNull())
    out = summary.select(*KEYS, BLOCK, before.alias("_before"), after.alias("_after")).select(*KEYS, BLOCK, F.explode(edges).alias("_f"))
    return out.select(*KEYS, F.col("_f.ms").alias("_t"), F.lit(0).alias("_kind"), "_f", BLOCK)


def classify_events(scored: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Cue label from the holder's channel and cell from the responder's.

    The cell test is strict (>), the cue tests are not.
    """

    def of(role: str, column: str) -> Column:
        return F.when(F.col(role) == "tutor", F.col(f"{column}0")).otherwise(F.col(f"{column}1"))

    now_h, future_h, future_r = of("holder", "p_now"), of("holder", "p_future"), of("responder", "p_future")
    turn_end = F.when(future_h >= th.yield_thresh, F.lit("Yield-NotCued")).otherwise(
        F.when(now_h < th.p_now_shift_thresh, F.lit("Early-Yield")).otherwise(F.lit("Late-Yield"))
    )
    pause = F.when(future_h < th.hold_thresh, F.lit("Hold-Misread")).otherwise(
        F.when(now_h >= th.hold_thresh, F.lit("Strong-Hold")).otherwise(F.lit("Weak-Hold"))
    )
    says_yield = future_r > th.yield_thresh
    took = F.col("took_floor")
    cell = (
        F.when(says_yield & took, F.lit("appropriate_uptake"))
        .when(says_yield, F.lit("missed_yield"))
        .when(took, F.lit("false_interruption"))
        .otherwise(F.lit("appropriate_restraint"))
    )
    return scored.withColumns(
        {
            "vap_pred": F.when(says_yield, F.lit("YIELD")).otherwise(F.lit("HOLD")),
            "responder_action": F.when(took, F.lit("took_floor")).otherwise(F.lit("stayed_silent")),
            "cue_label": F.when(F.col("event_type") == "turn_end", turn_end).otherwise(pause),
            "cell": cell,
        }
    )


def event_counts(events: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """turn_end, intra_pause and dropped_guard per conversation.

    ``convs`` (run, conv_index) adds the scored conversations that have no event, with zeros.
    """
    kept = ~F.col("dropped_guard")
    counts = events.groupBy(*KEYS).agg(
        F.count_if(kept & (F.col("event_type") == "turn_end")).alias("turn_end"),
        F.count_if(kept & (F.col("event_type") == "intra_pause")).alias("intra_pause"),
        F.count_if(F.col("dropped_guard")).alias("dropped_guard"),
    )
    return counts if convs is None else convs.select(*KEYS).join(counts, list(KEYS), "left").fillna(0)


def cue_counts(classified: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """Cue labels per conversation and holder, one column per label.

    ``convs`` (run, conv_index) adds zeros for the roles that hold no event's floor.
    """
    counts = classified.groupBy(*KEYS, F.col("holder").alias("role")).agg(
        *[F.count_if(F.col("cue_label") == c).alias(c.replace("-", "_").lower()) for c in CUE_LABELS]
    )
    if convs is None:
        return counts
    grid = convs.select(*KEYS, F.explode(F.array(*map(F.lit, ROLES))).alias("role"))
    return grid.join(counts, [*KEYS, "role"], "left").fillna(0)


def _scoped(classified: DataFrame) -> DataFrame:
    """Each event once for its responder and once pooled."""
    return classified.withColumn("scope", F.explode(F.array(F.col("responder"), F.lit("pooled"))))


def conversation_cells(classified: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """The four cells and the false-interruption rate per conversation and scope.

    ``convs`` (run, conv_index) adds the scored conversations that have no event.
    """
    cells = (
        _scoped(classified)
        .groupBy(*KEYS, "scope")
        .agg(
            *[F.count_if(F.col("cell") == c).alias(c) for c in CELLS],
            F.median(F.when(F.col("cell") == "appropriate_uptake", F.col("latency_ms"))).alias("lat_median_ms"),
        )
    )
    if convs is not None:
        grid = convs.select(*KEYS, F.explode(F.array(*map(F.lit, SCOPES))).alias("scope"))
        cells = grid.join(cells, [*KEYS, "scope"], "left").fillna(0, list(CELLS))
    fi, ar = F.col("false_interruption"), F.col("appropriate_restraint")
    return cells.select(
        *KEYS,
        "scope",
        *CELLS,
        F.try_divide(fi, fi + ar).alias("fi_rate"),
        (F.col("lat_median_ms") / 1000.0).alias("uptake_lat_median_s"),
    )


def cell_totals(classified: DataFrame) -> DataFrame:
    """Cells per run and scope, with pooled rates."""
    out = _scoped(classified).groupBy("run", "scope").agg(
        *[F.count_if(F.col("cell") == c).alias(c) for c in CELLS]
    )
    fi, ar = F.col("false_interruption"), F.col("appropriate_restraint")
    up, mi = F.col("appropriate_uptake"), F.col("missed_yield")
    return out.withColumns(
        {
            "fi_rate": F.round(F.try_divide(fi, fi + ar), 6),
            "uptake_rate": F.round(F.try_divide(up, up + mi), 6),
        }
    )


def cue_shares(classified: DataFrame) -> DataFrame:
    """Share (%) of each cue label per run and holder role; labels never seen count 0."""
    # One count for every role and label, so that roles never holding the floor appear, with no share.
    pairs = [(r, c) for r in ROLES for c in CUE_LABELS]
    held = [F.count_if((F.col("holder") == r) & (F.col("cue_label") == c)).alias(f"c{i}") for i, (r, c) in enumerate(pairs)]
    counts = classified.groupBy("run").agg(*held)

    def total(role: str) -> Column:
        return sum((F.col(f"c{i}") for i, (r, _) in enumerate(pairs) if r == role), F.lit(0))

    items = F.array(
        *[F.struct(F.lit(r).alias("role"), F.lit(c).alias("label"), F.col(f"c{i}").alias("count"), total(r).alias("total")) for i, (r, c) in enumerate(pairs)]
    )
    share = F.round(F.try_divide(100.0 * F.col("i.count"), F.col("i.total")), 6).alias("pct")
    return counts.select("run", F.explode(items).alias("i")).select("run", "i.role", "i.label", "i.count", share)


def uptake_latencies(classified: DataFrame, scope: str = "pooled") -> DataFrame:
    """Latency of every appropriate uptake."""
    rows = classified.filter(F.col("cell") == "appropriate_uptake")
    if scope != "pooled":
        rows = rows.filter(F.col("responder") == scope)
    return rows.select("run", "conv_index", (F.col("latency_ms") / 1000.0).alias("latency_s"))
