"""Rubric scores: parsing, leaderboards, summaries, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import inputs as I
from queries.inputs import with_ctes
from talkmetry.constants import KEYS, TAXONOMY_RUBRIC
from talkmetry.operators import rubrics as R

MODELS = ("click", "error", "purchase", "signup", "view")
BACKENDS = ("gpt-realtime", "gemini-live", "personaplex", "moshivis", "other-backend")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_responses(I.rubric_raw(spark, d), TAXONOMY_RUBRIC)


def backends_of(convs: DataFrame) -> DataFrame:
    """Backends by system; those of every seventh conversation are not known."""
    names = F.array(*[F.lit(b) for b in BACKENDS])
    known = F.col("conv_index") % 7 != 0
    return convs.select(
        *KEYS,
        F.when(known, names[(F.col("u") % 5).cast("int")]).alias("tutor_backend"),
        F.when(known, F.lit("gemini-live")).alias("student_backend"),
    )


def labelled(spark, d):
    scored = R.criterion_scores(parsed(spark, d))
    return R.label_scores(scored, backends_of(I.table(spark, d, "events").select(F.col("user_id").alias("u"), I.run_of_user(), F.col("event_id").alias("conv_index"))))


def _parse_rows(spark, d):
    return parsed(spark, d).select(
        *KEYS,
        "judge_model",
        "status",
        *[F.try_element_at("scores", F.lit(k))["score"].alias(k) for k in ("guidance_quality", "actionability", "coherence")],
        "mean_component_score",
        "raw",
    )


def _comparison(spark, d):
    return R.comparison_scores(parsed(spark, d), TAXONOMY_RUBRIC).select(*KEYS, "judge_model", "comparison_key", "score")


QUERIES = {
    "rubric_parse": _parse_rows,
    "comparison_scores": _comparison,
    "leaderboard": lambda s, d: R.leaderboard(labelled(s, d), TAXONOMY_RUBRIC, "guidance_quality"),
    "score_distribution": lambda s, d: R.score_distribution(labelled(s, d)),
    "axis_summary": lambda s, d: R.axis_summary(R.criterion_scores(parsed(s, d)), TAXONOMY_RUBRIC, ["run"]),
    "judge_run_summary": lambda s, d: R.judge_run_summary(parsed(s, d), TAXONOMY_RUBRIC).select(
        "run", "judge_model", "n_ok", "guidance_quality", "actionability", "coherence", "tutor_tone", "mean_component_score"
    ),
    "judge_matrix": lambda s, d: R.judge_matrix(parsed(s, d), TAXONOMY_RUBRIC, MODELS),
    "pair_verdicts": lambda s, d: R.pair_verdicts(I.preference_rows(s, d)),
    "judge_agreement_wilson": lambda s, d: R.agreement(R.pair_verdicts(I.preference_rows(s, d))),
}

_OK = """SELECT run, conv_index, judge_model, CAST(c % 6 AS INT) AS g, CAST((c // 6) % 6 AS INT) AS a, CAST((c // 36) % 6 AS INT) AS h,
    pyround((c % 6 + (c // 6) % 6 + (c // 36) % 6) / 3, 3) AS mean_component_score, event_id % 17 <> 0 AS ok, raw FROM raw"""
_LAB = """lab AS (SELECT r.run, r.conv_index, criterion, score,
    CASE WHEN r.conv_index % 7 = 0 THEN '?↑ / ?↓' ELSE concat(CASE r.run WHEN 'sys0' THEN 'GPT' WHEN 'sys1' THEN 'Gemini'
    WHEN 'sys2' THEN 'PersonaPlex' WHEN 'sys3' THEN 'MoshiVis' ELSE 'other-backend' END, '↑ / Gemini↓') END AS label FROM crit r)"""
_AXIS = """CASE criterion WHEN 'coherence' THEN 'Dialogue quality' ELSE 'Pedagogical quality' END"""
_MEAN = "pyround(avg(score) FILTER (WHERE criterion = '{k}'), 2) AS {k}"

ORACLES = {
    "rubric_parse": with_ctes(
        "raw",
        f"""SELECT run, conv_index, judge_model, CASE WHEN ok THEN 'ok' ELSE 'parse_error' END AS status,
        CASE WHEN ok THEN g END AS guidance_quality, CASE WHEN ok THEN a END AS actionability, CASE WHEN ok THEN h END AS coherence,
        CASE WHEN ok THEN mean_component_score END AS mean_component_score, CASE WHEN NOT ok THEN left(raw, 1000) END AS raw
        FROM ({_OK})""",
    ),
    "comparison_scores": with_ctes(
        "raw",
        f"""SELECT run, conv_index, judge_model, unnest(['guidance_quality', 'actionability', 'mean_component_score']) AS comparison_key,
        unnest([g::DOUBLE, a::DOUBLE, mean_component_score]) AS score FROM ({_OK}) WHERE ok""",
    ),
    "leaderboard": with_ctes(
        "crit",
        f"""WITH {_LAB}, b AS (SELECT label, min((run, conv_index)) AS seen, avg(score) FILTER (WHERE criterion = 'guidance_quality') AS k,
        pyround(avg(score) FILTER (WHERE criterion <> 'coherence'), 2) AS pedagogical_quality,
        pyround(avg(score) FILTER (WHERE criterion = 'coherence'), 2) AS dialogue_quality,
        {", ".join(_MEAN.format(k=k) for k in TAXONOMY_RUBRIC.keys)} FROM lab GROUP BY label)
        SELECT CAST(row_number() OVER (ORDER BY k DESC NULLS LAST, seen) AS INT) AS rank, label, seen[1] AS first_run, CAST(0 AS BIGINT) AS n,
        CAST(NULL AS DOUBLE) AS error_diagnosis, pedagogical_quality, dialogue_quality, {", ".join(TAXONOMY_RUBRIC.keys)} FROM b""",
    ),
    "score_distribution": with_ctes(
        "crit",
        f"""WITH {_LAB} SELECT label, criterion, {", ".join(f"count(*) FILTER (WHERE score = {i}) AS n{i}" for i in range(6))},
        pyround(avg(score), 2) AS mean FROM lab GROUP BY label, criterion""",
    ),
    "axis_summary": with_ctes(
        "crit",
        f"""SELECT run, axis, criterion, count(*) AS n, round(avg(score), 6) AS mean, median(score) AS median,
        round(coalesce(stddev_samp(score), 0), 6) AS sd FROM (SELECT *, {_AXIS} AS axis FROM crit)
        GROUP BY GROUPING SETS ((run, axis), (run, axis, criterion))""",
    ),
    "judge_run_summary": with_ctes(
        "raw",
        f"""SELECT run, judge_model, count(*) FILTER (WHERE ok) AS n_ok, pyround(CAST(sum(CAST(g AS DECIMAL(38,9))) FILTER (WHERE ok) AS DOUBLE) / nullif(count(g) FILTER (WHERE ok), 0), 3) AS guidance_quality,
        pyround(CAST(sum(CAST(a AS DECIMAL(38,9))) FILTER (WHERE ok) AS DOUBLE) / nullif(count(a) FILTER (WHERE ok), 0), 3) AS actionability, pyround(CAST(sum(CAST(h AS DECIMAL(38,9))) FILTER (WHERE ok) AS DOUBLE) / nullif(count(h) FILTER (WHERE ok), 0), 3) AS coherence,
        CAST(NULL AS DOUBLE) AS tutor_tone, pyround(CAST(sum(CAST(mean_component_score AS DECIMAL(38,9))) FILTER (WHERE ok) AS DOUBLE) / nullif(count(mean_component_score) FILTER (WHERE ok), 0), 3) AS mean_component_score
        FROM ({_OK}) GROUP BY run, judge_model""",
    ),
    "judge_matrix": with_ctes(
        "raw",
        f"""WITH v AS (SELECT run, judge_model, unnest(['guidance_quality', 'actionability', 'coherence', 'MEAN COMPONENT', 'n (ok convs)']) AS criterion,
        unnest([pyround(CAST(sum(CAST(g AS DECIMAL(38,9))) AS DOUBLE) / nullif(count(g), 0), 2), pyround(CAST(sum(CAST(a AS DECIMAL(38,9))) AS DOUBLE) / nullif(count(a), 0), 2), pyround(CAST(sum(CAST(h AS DECIMAL(38,9))) AS DOUBLE) / nullif(count(h), 0), 2), pyround(CAST(sum(CAST(mean_component_score AS DECIMAL(38,9))) AS DOUBLE) / nullif(count(mean_component_score), 0), 2), CAST(count(*) AS DOUBLE)]) AS value
        FROM ({_OK}) WHERE ok GROUP BY run, judge_model)
        SELECT run, criterion, {", ".join(f"max(value) FILTER (WHERE judge_model = '{m}') AS {m}" for m in MODELS)} FROM v GROUP BY run, criterion""",
    ),
    "pair_verdicts": with_ctes(
        "pref",
        """SELECT p.split, p.row_idx, p.rubric, p.judge_model, p.comparison_key, p.score AS score_pos, n.score AS score_neg,
        p.score - n.score AS margin, CASE WHEN p.score > n.score THEN 'correct' WHEN p.score = n.score THEN 'tie' ELSE 'wrong' END AS verdict
        FROM pref p JOIN pref n ON p.row_idx = n.row_idx AND p.comparison_key = n.comparison_key AND p.neg = 0 AND n.neg = 1""",
    ),
    "judge_agreement_wilson": with_ctes(
        "pref",
        """WITH v AS (SELECT p.split, p.rubric, p.judge_model, p.comparison_key, p.score - n.score AS m
        FROM pref p JOIN pref n ON p.row_idx = n.row_idx AND p.comparison_key = n.comparison_key AND p.neg = 0 AND n.neg = 1),
        g AS (SELECT split, rubric, judge_model, comparison_key, count(*) AS n,
        (count(*) FILTER (WHERE m > 0) + 0.5::DOUBLE * count(*) FILTER (WHERE m = 0)) / count(*) AS p,
        count(*) FILTER (WHERE m = 0) AS t, sum(m) AS sm FROM v GROUP BY 1, 2, 3, 4),
        z AS (SELECT *, 1.96::DOUBLE AS z FROM g)
        SELECT split, n, judge_model, rubric, comparison_key, pyround(p, 4) AS accuracy,
        pyround(greatest(0, ((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 4) AS ci_low,
        pyround(least(1, ((p + z*z/(2*n)) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 4) AS ci_high,
        pyround(t / n, 4) AS tie_rate, pyround(sm / n, 4) AS mean_margin FROM z""",
    ),
}
