"""Views over the given tables in the library's data model, in Spark and in SQL.

The SQL twins are CTE texts for the checks: ``with_ctes("seg", body)`` puts the named
ones in front of ``body``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmetry.constants import CHAT_ROLE_MAP
from talkmetry.functions.text import lookup

FRAME_STEP_MS = 500
FRAMES = 541
LABEL_NAMES = ("C", "NA", "I", "BC", "T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str = "ts") -> Column:
    """Microseconds since 2024-01-01 (the tables hold January 2024 without a zone)."""
    since = F.unix_micros(F.col(ts).cast("timestamp")) if isinstance(ts, str) else F.unix_micros(ts.cast("timestamp"))
    return since - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))


def _cents() -> Column:
    return F.round(F.col("value") * 100).cast("long")


def _run() -> Column:
    return F.concat(F.lit("sys"), (F.col("user_id") % 5).cast("string"))


def run_of_user() -> Column:
    return _run().alias("run")


def _conv() -> Column:
    return F.expr("user_id div 5")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("us div 10000000")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", micros().alias("us"), _cents().alias("c"))
        .select(
            _run().alias("run"),
            _conv().alias("conv_index"),
            F.col("event_id").alias("seg_id"),
            F.when(F.col("event_id") % 2 == 0, F.lit("tutor")).otherwise(F.lit("student")).alias("role"),
            start.alias("start_ms"),
            (start + F.expr("c div 2")).alias("end_ms"),
            F.expr("trim(repeat('w ', cast(c % 12 as int)))").alias("text"),
        )
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long quality scores: run, conv_index, channel, axis, score."""
    wide = paired(spark, sf_dir)
    axes = F.explode(
        F.array(*[F.struct(F.lit(a.upper()).alias("axis"), F.col(a).cast("double").alias("score")) for a in ("pq", "ce", "cu", "pc")])
    )
    return wide.select("run", "conv_index", F.lit("mixed").alias("channel"), axes.alias("s")).select(
        "run", "conv_index", "channel", "s.axis", "s.score"
    )


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("conv_index"))
        .agg(
            F.round(F.sum(_cents()) / F.count(F.lit(1)) / 100.0, 6).alias("pq"),
            F.max("value").alias("ce"),
            F.min("value").alias("cu"),
            F.count(F.lit(1)).alias("pc"),
        )
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two channels per (run, conv_index): even event ids speak for the tutor."""
    channel = F.when(F.col("event_id") % 2 == 0, F.lit("tutor")).otherwise(F.lit("student"))
    wide = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("conv_index"), channel.alias("channel"))
        .agg(F.max("value").alias("PQ"), F.min("value").alias("CE"))
    )
    return wide.select(
        "run",
        "conv_index",
        "channel",
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("score")) for a in ("PQ", "CE")])
        ).alias("s"),
    ).select("run", "conv_index", "channel", "s.axis", "s.score")


def rubric_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One judge response per event, fenced JSON: every event stands for a conversation that one model judged."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", _cents().alias("c"))
    raw = F.concat(
        F.lit('```json\n{"guidance_quality": {"score": '),
        (F.col("c") % 6).cast("string"),
        F.lit(', "rationale": "r"}, "actionability": {"score": '),
        F.expr("c div 6 % 6").cast("string"),
        F.lit(', "rationale": "r"}, "coherence": {"score": '),
        F.expr("c div 36 % 6").cast("string"),
        F.lit(', "rationale": "r"}'),
        F.when(F.col("event_id") % 17 == 0, F.lit("")).otherwise(F.lit("}")),
        F.lit("\n```"),
    )
    return rows.select(
        _run().alias("run"), F.col("event_id").alias("conv_index"), F.col("event_type").alias("judge_model"), "event_id", raw.alias("raw")
    )


def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the two sides of a preference pair: two neighbouring events."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 2").alias("row_idx"),
        F.when(F.col("event_id") % 2 == 0, F.lit("pos")).otherwise(F.lit("neg")).alias("side"),
        F.lit("even").alias("split"),
        F.lit("llm_judge_bea").alias("rubric"),
        F.concat(F.lit("m"), F.expr("event_id div 2 % 3").cast("string")).alias("judge_model"),
        F.explode(
            F.array(
                F.struct(F.lit("guidance_quality").alias("comparison_key"), (_cents() % 6).cast("double").alias("score")),
                F.struct(F.lit("actionability").alias("comparison_key"), F.expr("cast(round(value*100) as bigint) div 6 % 6").cast("double").alias("score")),
            )
        ).alias("s"),
    ).select("split", "row_idx", "side", "rubric", "judge_model", "s.comparison_key", "s.score")


def conversations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (run, conv_index) of the segment view, with the user."""
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.col("user_id").alias("u"), _run().alias("run"), _conv().alias("conv_index")
    )


def cents_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, conv_index, the user and the sum of the cents of all its events."""
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(_cents()).alias("c"))
    return sums.select(F.col("user_id").alias("u"), _run().alias("run"), _conv().alias("conv_index"), "c")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """541 frames per conversation at 2 Hz; probabilities from integers per mille. Each event moves the frame of its half second."""
    i = F.col("frame")
    timed = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), micros().alias("us"), _cents().alias("c"))
    moved = timed.groupBy("u", F.expr(f"us div 500000 % {FRAMES}").alias("frame")).agg(F.sum("c").alias("c"))
    # A conversation's frames come out of one row. The number of partitions is given, as the planner would coalesce by the size before that.
    dealt = moved.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "u")
    on_grid = F.col("frame").between(0, FRAMES - 1)
    own = dealt.groupBy("u").agg(F.collect_list(F.when(on_grid, F.struct("frame", "c"))).alias("own")).select("u", F.col("own.frame").alias("at"), F.col("own.c").alias("c"))
    still = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(FRAMES - 1).cast("long")), "at")
    # The outer form keeps Catalyst from making the array twice (once to test for emptiness).
    each = own.select("u", "c", F.posexplode_outer(F.concat("at", still)).alias("pos", "frame"))
    sums = each.select("u", "frame", F.coalesce(F.get("c", F.col("pos")), F.lit(0)).alias("c"))
    keyed = sums.select("u", "frame", "c", F.concat(F.lit("sys"), (F.col("u") % 5).cast("string")).alias("run"), F.expr("u div 5").alias("conv_index"))
    now = (i * 37 + F.col("conv_index") * 101 + F.col("u") * 13 + F.col("c")) % 1000
    future = (i * 53 + F.col("conv_index") * 29 + F.col("u") * 7 + F.col("c")) % 1000
    labels = F.array(*[F.lit(x) for x in LABEL_NAMES])
    return keyed.select(
        "run",
        "conv_index",
        "frame",
        (i * FRAME_STEP_MS).alias("t_ms"),
        (now / 1000.0).alias("p_now0"),
        ((1000 - now) / 1000.0).alias("p_now1"),
        (future / 1000.0).alias("p_future0"),
        ((1000 - future) / 1000.0).alias("p_future1"),
        labels[((i * 7 + F.col("conv_index") + F.col("c")) % 5).cast("int")].alias("label"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat table with tutor/student roles; other roles keep their name."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", lookup(F.col("role"), CHAT_ROLE_MAP).alias("role"), "text"
    )


# --- the same views as SQL -----------------------------------------------------
CTES = {
    "ev": """ev AS (SELECT event_id, user_id, event_type, value, props,
        epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us,
        CAST(round(value * 100) AS BIGINT) AS c FROM events)""",
    "seg": """seg AS (SELECT concat('sys', CAST(user_id % 5 AS VARCHAR)) AS run, user_id // 5 AS conv_index,
        event_id AS seg_id, CASE WHEN event_id % 2 = 0 THEN 'tutor' ELSE 'student' END AS role,
        us // 10000000 AS start_ms, us // 10000000 + c // 2 AS end_ms,
        trim(repeat('w ', CAST(c % 12 AS INT))) AS text, c % 12 AS words FROM ev)""",
    "paired": """paired AS (SELECT event_type AS run, user_id AS conv_index,
        round(CAST(sum(c) AS BIGINT) / count(*) / 100.0::DOUBLE, 6) AS pq, max(value) AS ce, min(value) AS cu,
        CAST(count(*) AS DOUBLE) AS pc FROM ev GROUP BY event_type, user_id)""",
    "scores": """scores AS (SELECT run, conv_index, 'mixed' AS channel, 'PQ' AS axis, pq AS score FROM paired
        UNION ALL SELECT run, conv_index, 'mixed', 'CE', ce FROM paired
        UNION ALL SELECT run, conv_index, 'mixed', 'CU', cu FROM paired
        UNION ALL SELECT run, conv_index, 'mixed', 'PC', pc FROM paired)""",
    "quality": """quality AS (WITH q AS (SELECT event_type AS run, user_id AS conv_index,
        CASE WHEN event_id % 2 = 0 THEN 'tutor' ELSE 'student' END AS channel, max(value) AS hi, min(value) AS lo
        FROM ev GROUP BY 1, 2, 3)
        SELECT run, conv_index, channel, 'PQ' AS axis, hi AS score FROM q
        UNION ALL SELECT run, conv_index, channel, 'CE', lo FROM q)""",
    "raw": """raw AS (SELECT concat('sys', CAST(user_id % 5 AS VARCHAR)) AS run, event_id AS conv_index,
        event_type AS judge_model, event_id, c,
        concat('```json', chr(10), '{"guidance_quality": {"score": ', CAST(c % 6 AS VARCHAR),
        ', "rationale": "r"}, "actionability": {"score": ', CAST((c // 6) % 6 AS VARCHAR),
        ', "rationale": "r"}, "coherence": {"score": ', CAST((c // 36) % 6 AS VARCHAR), ', "rationale": "r"}',
        CASE WHEN event_id % 17 = 0 THEN '' ELSE '}' END, chr(10), '```') AS raw FROM ev)""",
    "crit": """crit AS (SELECT run, conv_index, judge_model, unnest(['guidance_quality', 'actionability', 'coherence']) AS criterion,
        CAST(unnest([c % 6, (c // 6) % 6, (c // 36) % 6]) AS INT) AS score FROM raw WHERE event_id % 17 <> 0)""",
    "pref": """pref AS (SELECT event_id // 2 AS row_idx, event_id % 2 AS neg, 'even' AS split, 'llm_judge_bea' AS rubric,
        concat('m', CAST((event_id // 2) % 3 AS VARCHAR)) AS judge_model,
        unnest(['guidance_quality', 'actionability']) AS comparison_key,
        CAST(unnest([c % 6, (c // 6) % 6]) AS DOUBLE) AS score FROM ev)""",
    "convs": """convs AS (SELECT DISTINCT user_id AS u, concat('sys', CAST(user_id % 5 AS VARCHAR)) AS run,
        user_id // 5 AS conv_index FROM events)""",
    "frames": """frames AS (SELECT c.run, c.conv_index, f.i AS frame, f.i * 500 AS t_ms,
        (f.i * 37 + c.conv_index * 101 + c.u * 13 + coalesce(m.c, 0)) % 1000 AS now_pm,
        (f.i * 53 + c.conv_index * 29 + c.u * 7 + coalesce(m.c, 0)) % 1000 AS future_pm,
        (['C', 'NA', 'I', 'BC', 'T'])[1 + (f.i * 7 + c.conv_index + coalesce(m.c, 0)) % 5] AS label
        FROM convs c CROSS JOIN (SELECT i FROM range(541) t(i)) f
        LEFT JOIN (SELECT user_id, us // 500000 % 541 AS i, CAST(sum(c) AS BIGINT) AS c FROM ev GROUP BY 1, 2) m ON m.user_id = c.u AND m.i = f.i)""",
    "turns": """turns AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'tutor'
        ELSE role END AS role, text FROM conversations)""",
    # Speech runs: a run starts where no earlier interval of the role reaches within the gap.
    "runs": """runs AS (WITH s AS (SELECT *, max(end_ms) OVER (PARTITION BY run, conv_index, role ORDER BY start_ms, end_ms, seg_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
        f AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR start_ms - reach > 180 THEN 1 ELSE 0 END) OVER (
        PARTITION BY run, conv_index, role ORDER BY start_ms, end_ms, seg_id) AS BIGINT) AS island FROM s)
        SELECT run, conv_index, role, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_merged
        FROM f GROUP BY run, conv_index, role, island)""",
    "steps": """steps AS (SELECT *, lead(start_ms) OVER w AS next_start, lead(role) OVER w AS next_role FROM runs
        WINDOW w AS (PARTITION BY run, conv_index ORDER BY start_ms, role DESC))""",
    "samples": """samples AS (SELECT run, conv_index, 'turn_dur_s' AS metric, end_ms - start_ms AS value_ms FROM runs
        UNION ALL SELECT run, conv_index, 'fto_s', next_start - end_ms FROM steps WHERE next_role <> role
        UNION ALL SELECT run, conv_index, 'gap_s', next_start - end_ms FROM steps WHERE next_role <> role AND next_start >= end_ms
        UNION ALL SELECT run, conv_index, 'overlap_s', end_ms - next_start FROM steps WHERE next_role <> role AND next_start < end_ms
        UNION ALL SELECT run, conv_index, 'within_pause_s', next_start - end_ms FROM steps WHERE next_role = role AND next_start > end_ms)""",
    "clipped": """clipped AS (SELECT * FROM samples WHERE CASE metric WHEN 'fto_s' THEN value_ms BETWEEN -2000 AND 2000
        WHEN 'turn_dur_s' THEN value_ms BETWEEN 0 AND 20000 ELSE value_ms BETWEEN 0 AND 2000 END)""",
    # Events with guard and uptake as correlated look-ups (the library uses one window).
    "events0": """events0 AS (SELECT run, conv_index, end_ms AS t_ms, role AS holder,
        CASE role WHEN 'tutor' THEN 'student' ELSE 'tutor' END AS responder,
        CASE WHEN next_role = role THEN 'intra_pause' ELSE 'turn_end' END AS event_type, next_start - end_ms AS gap_ms
        FROM steps WHERE end_ms BETWEEN 0 AND 270000 AND ((next_role = role AND next_start - end_ms BETWEEN 250 AND 4000)
        OR (next_role <> role AND next_start - end_ms BETWEEN 0 AND 4000)))""",
    "tev": """tev AS (SELECT e.run, e.conv_index, e.t_ms, e.holder, e.responder, e.event_type, e.gap_ms,
        coalesce(bool_or(r.end_ms > e.t_ms - 300 AND r.start_ms < e.t_ms), FALSE) AS dropped_guard,
        min(CASE WHEN r.start_ms > e.t_ms AND r.start_ms <= e.t_ms + 1500 THEN r.start_ms - e.t_ms END) AS latency_ms
        FROM events0 e LEFT JOIN runs r ON r.run = e.run AND r.conv_index = e.conv_index AND r.role = e.responder
        GROUP BY ALL)""",
    "cls": """cls AS (WITH k AS (SELECT t.*, f.now_pm, f.future_pm,
        CASE holder WHEN 'tutor' THEN now_pm ELSE 1000 - now_pm END AS now_h,
        CASE holder WHEN 'tutor' THEN future_pm ELSE 1000 - future_pm END AS future_h,
        CASE responder WHEN 'tutor' THEN future_pm ELSE 1000 - future_pm END AS future_r
        FROM tev t JOIN frames f ON f.run = t.run AND f.conv_index = t.conv_index AND f.frame = (2 * t.t_ms + 499) // 1000
        WHERE NOT dropped_guard)
        SELECT *, CASE WHEN event_type = 'turn_end' THEN CASE WHEN future_h >= 500 THEN 'Yield-NotCued'
        WHEN now_h < 500 THEN 'Early-Yield' ELSE 'Late-Yield' END
        ELSE CASE WHEN future_h < 500 THEN 'Hold-Misread' WHEN now_h >= 500 THEN 'Strong-Hold' ELSE 'Weak-Hold' END END AS cue_label,
        CASE WHEN future_r > 500 THEN CASE WHEN latency_ms IS NOT NULL THEN 'appropriate_uptake' ELSE 'missed_yield' END
        ELSE CASE WHEN latency_ms IS NOT NULL THEN 'false_interruption' ELSE 'appropriate_restraint' END END AS cell FROM k)""",
}
_NEEDS = {
    "seg": ("ev",),
    "paired": ("ev",),
    "scores": ("paired",),
    "quality": ("ev",),
    "raw": ("ev",),
    "crit": ("raw",),
    "pref": ("ev",),
    "frames": ("ev", "convs"),
    "runs": ("seg",),
    "steps": ("runs",),
    "samples": ("steps",),
    "clipped": ("samples",),
    "events0": ("steps",),
    "tev": ("events0",),
    "cls": ("tev", "frames"),
}


def with_ctes(names: str, body: str) -> str:
    """``body`` preceded by the named views and everything they need, in order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    lead = ",\n".join(CTES[n] for n in wanted)
    if body.upper().startswith("WITH "):
        return f"WITH {lead},\n{body[5:]}"
    return f"WITH {lead}\n{body}"


def expand(sql: str) -> str:
    """``pyround(x, n)`` is round-half-even on the stored double, which DuckDB has as text
    formatting."""
    at = sql.find("pyround(")
    while at >= 0:
        depth, end, comma = 1, at + len("pyround("), -1
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = end
            end += 1
        value, digits = sql[at + len("pyround(") : comma], sql[comma + 1 : end - 1].strip()
        sql = f"{sql[:at]}CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE){sql[end:]}"
        at = sql.find("pyround(")
    return sql
