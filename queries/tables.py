"""Work planning, caches, dedup, sampling, nested results, evaluator plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from queries import inputs as I
from queries import texts, transcript
from queries.inputs import with_ctes
from talkmetry.constants import KEYS, NAIVE_RUBRIC
from talkmetry.functions.text import backend_label, file_slug, round_exact, run_part, slug, variant_key
from talkmetry.operators import events as E
from talkmetry.operators import leaves as L
from talkmetry.operators import rubrics as R
from talkmetry.operators import transcripts as X
from talkmetry.operators import work as W
from talkmetry.operators.conversation import run_summary
from talkmetry.plans import evaluators as P
from talkmetry.sources.runs import default_variant, variant_listing

CELL = ("run", "conv_index")


def _attempts(spark, d):
    return I.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("pid"), (F.col("l_linenumber") - 1).alias("attempt_index")
    )


def _work_plan(spark, d):
    questions = I.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("pid"), F.col("o_orderkey").alias("ord"))
    return W.work_plan(questions, 3, W.done_pairs(_attempts(spark, d)))


def _select_pids(spark, d, missing: bool):
    wanted = I.table(spark, d, "events").select(F.col("event_id").alias("ord"), (F.col("user_id") * 13).alias("pid"))
    questions = I.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), "c_name")
    return W.select_pids(questions, wanted)[missing]


def _cache(spark, d):
    status = F.when(F.col("pc") % 4 == 0, F.lit("ok")).when(F.col("pc") % 4 == 1, F.lit("error")).when(F.col("pc") % 4 == 2, F.lit("skipped"))
    return I.paired(spark, d).select("run", "conv_index", status.alias("status"), F.col("ce").alias("result"))


def _cache_plan(spark, d):
    todo = I.paired(spark, d).filter(F.col("conv_index") % 3 != 0).select(
        "run", F.when(F.col("conv_index") % 2 == 0, F.col("conv_index")).otherwise(F.col("conv_index") + 100000).alias("conv_index")
    )
    return W.merge_cache(_cache(spark, d), todo, CELL)


def _incremental_merge(spark, d):
    plan = _cache_plan(spark, d)
    fresh = plan.filter(F.col("action") == "compute").select(*CELL, F.lit("ok").alias("status"), (F.col("conv_index") * 2.0).alias("result"))
    return W.merge_results(plan, fresh, CELL)


def _scorability(spark, d):
    convs = I.conversations_of(spark, d)
    aligned = convs.filter(F.col("conv_index") % 5 != 0).select(
        *KEYS, F.when(F.col("conv_index") % 7 != 0, F.col("u") * 10).alias("onset_ms")
    )
    return W.scorability(convs, aligned, convs.filter(F.col("u") % 3 != 0))


def _manifest(spark, d, current: bool):
    c = I.table(spark, d, "customer")
    changed = (F.col("c_custkey") % 10 == 0) if current else F.lit(False)
    items = F.array(
        F.struct(F.lit("arg").alias("kind"), F.lit("attempts").alias("name"), (F.col("c_nationkey") + changed.cast("int")).cast("string").alias("value")),
        F.struct(F.lit("arg").alias("kind"), F.lit("port").alias("name"), changed.cast("string").alias("value")),
        F.struct(F.lit("prompt").alias("kind"), F.lit("tutor").alias("name"), F.when(changed & (F.col("c_custkey") % 20 == 0), F.lit(None)).otherwise(F.col("c_mktsegment")).alias("value")),
    )
    return c.select(F.col("c_custkey").alias("run"), F.explode(items).alias("i")).select("run", "i.*")


def _nested(spark, d):
    """A nested result per event: numbers on two levels, a flag and a text."""
    return I.table(spark, d, "events").select(
        F.col("event_id"),
        F.struct(
            F.struct(F.col("value").alias("value"), (F.col("user_id") % 2 == 0).alias("flag"), F.col("event_type").alias("kind")).alias("stats"),
            F.struct(F.from_json("props", "struct<k:bigint>").alias("props"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user")).alias("meta"),
        ).alias("r"),
    )


def records(spark, d):
    """Score records of the segment view as stored: results as JSON text."""
    t = P.evaluate(P.Tables(I.segments(spark, d)), ["stats", "turn_taking"])
    nested = F.struct(
        "stats",
        F.struct(
            "turn_taking.*",
            F.struct(*[F.col(f"turn_taking.latency_{c}_s").alias(c) for c in ("mean", "median", "p90")]).alias("response_latency_s"),
        ).alias("turn_taking"),
        F.struct(
            F.lit("ok").alias("status"),
            F.struct(F.struct((F.col("conv_index") % 6).alias("score")).alias("overall")).alias("scores"),
        ).alias("llm_judge"),
    )
    return t.select(*KEYS, F.col("conv_index").cast("string").alias("pid"), F.to_json(nested).alias("evaluator_results"))


_DETAIL = ["run_name", "conv_index", "pid", "duration_s", "num_segments", "tutor_talk_ratio", "latency_p90_s", "silence_ratio", "overall", "answer_correctness", "mean_component_score"]


def _evaluate(spark, d):
    t = P.evaluate(P.Tables(I.segments(spark, d)), ["stats", "turn_taking"])
    return t.select(*KEYS, "stats.num_segments", "stats.tutor_words", "turn_taking.overlap_s", "turn_taking.silence_ratio")


def _longest(pdf):
    if pdf["conv_index"].iloc[0] % 10 == 3:
        raise ValueError("no score")
    return {"longest_ms": int((pdf["end_ms"] - pdf["start_ms"]).max()), "starts": int(pdf["start_ms"].sum()), "n": len(pdf)}


def _longest_of_all(parts):
    return {"longest_ms": int(parts["longest_ms"].max()), "mean_start": float(parts["starts"].sum() / parts["n"].sum())}


def _plugin(spark, d):
    """Chunks of 25 segments, so that most conversations take several."""
    partial = StructType([StructField(c, LongType()) for c in ("longest_ms", "starts", "n")])
    schema = StructType([StructField("longest_ms", LongType()), StructField("mean_start", DoubleType())])
    ev = P.conversation_plugin("longest", _longest, partial, schema, _longest_of_all, chunk_rows=25)
    return ev.run(P.Tables(I.segments(spark, d))).withColumn("mean_start", round_exact(F.col("mean_start"), 3))


def _client(shift: int):
    def make():
        def ask(prompt: str) -> str:
            n = len(prompt) + shift
            if n % 7 == 0:
                raise ValueError("refused")
            return f'{{"overall": {{"score": {n % 6}, "rationale": "r"}}, "student_realism": {{"score": {n % 5}}}}}' + ("" if n % 11 else "}")

        return ask

    return make


def _judge_calls(spark, d):
    answered = P.judge(texts._judge_prompts(spark, d), _client(0))
    return R.parse_responses(answered, NAIVE_RUBRIC, error="error").select("conv_index", "status", F.try_element_at("scores", F.lit("overall"))["score"].alias("overall"), "mean_component_score", "raw", "error")


def _judge_sweep(spark, d):
    answered = P.judge_sweep(texts._judge_prompts(spark, d), {"a": _client(0), "b/1": _client(1)})
    out = R.parse_responses(answered, NAIVE_RUBRIC, error="error")
    return out.groupBy(slug(F.col("judge_model")).alias("judge_model")).agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"), F.count_if(F.col("status") == "parse_error").alias("n_bad")
    )


def _names(spark, d):
    backend = F.when(F.col("c_nationkey") % 4 == 0, F.lit("gpt-realtime")).when(F.col("c_nationkey") % 4 == 1, F.lit("human")).when(F.col("c_nationkey") % 4 == 2, F.lit("new/model.1"))
    run = F.concat_ws("_", F.col("c_mktsegment"), backend, F.when(F.col("c_custkey") % 2 == 0, F.lit("v1")))
    mode = F.when(F.col("c_custkey") % 3 == 0, F.lit("text_mms")).otherwise(F.lit("whisper_mms"))
    return I.table(spark, d, "customer").select(
        "c_custkey",
        backend_label(backend, F.lit("gemini-live")).alias("label"),
        slug(backend).alias("slug"),
        file_slug(backend).alias("file_slug"),
        run_part(run, 0).alias("student"),
        run_part(run, 1).alias("tutor"),
        variant_key(mode, F.col("c_custkey") % 2 == 0).alias("variant"),
        X.uses_image(F.col("c_custkey") % 5 == 0, backend).alias("uses_image"),
    )


def _variants(spark, d):
    return I.table(spark, d, "events").select(
        I._run().alias("run"),
        F.when(F.col("event_type") == "view", F.lit("text_mms")).when((F.col("event_type") == "click") & (F.col("user_id") % 5 != 2), F.lit("whisper_mfa")).otherwise(F.lit("zz_other")).alias("variant"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("mode"), (F.col("event_id") % 3).cast("string"))).alias("mode"),
        (F.col("event_id") % 2 == 0).alias("prompt_bias"),
    )


QUERIES = {
    "work_plan": _work_plan,
    "next_attempt": lambda s, d: W.next_attempt(_attempts(s, d)),
    "select_pids": lambda s, d: _select_pids(s, d, False),
    "missing_pids": lambda s, d: _select_pids(s, d, True),
    "last_wins": lambda s, d: W.last_wins(I.table(s, d, "events").select("user_id", "event_type", "event_id", "value", "props"), ["user_id", "event_type"], "event_id"),
    "cache_plan": _cache_plan,
    "incremental_merge": _incremental_merge,
    "scorability": _scorability,
    "judging_matrix": lambda s, d: W.judging_matrix(I.table(s, d, "customer").select(F.col("c_custkey").alias("row_idx")), [("m1", "llm_judge"), ("m2", "llm_judge"), ("m1", "llm_judge_bea")]),
    "manifest_drift": lambda s, d: W.manifest_drift(_manifest(s, d, False), _manifest(s, d, True)),
    "first_n": lambda s, d: W.first_n(I.table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"], 25),
    "seeded_sample": lambda s, d: W.seeded_sample(I.table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, seed=7),
    "indexed_sample": lambda s, d: W.indexed_sample(I.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 100, seed=7),
    "sorted_scores": lambda s, d: W.sort_rows(I.paired(s, d).withColumn("ce", F.when(F.col("cu") < 5, F.col("ce"))).select("run", "conv_index", "ce"), "ce", descending=True),
    "first_seen": lambda s, d: W.first_seen(I.table(s, d, "events"), "user_id", "event_id"),
    "union_runs": lambda s, d: W.union_runs([I.paired(s, d).filter(F.col("run") == "view").select("run", "conv_index", "pq"), I.paired(s, d).filter(F.col("run") != "view").select("run", "conv_index", "ce")]),
    "runs_with_rows": lambda s, d: W.runs_with_rows(I.table(s, d, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("sys"), F.col("n_nationkey").cast("string")).alias("run")), I.segments(s, d)),
    "other_systems": lambda s, d: W.other_systems(W.conversations_per_run(I.segments(s, d)), "sys0"),
    "conversations_per_run": lambda s, d: W.conversations_per_run(I.segments(s, d)),
    "numeric_leaf_rollup": lambda s, d: L.leaf_rollup(L.numeric_leaves(_nested(s, d), "r", ["event_id"])),
    "numeric_leaf_json": lambda s, d: L.leaf_rollup(L.numeric_leaves_json(_nested(s, d).withColumn("r", F.to_json("r")), "r", ["event_id"])),
    "text_leaf_rows": lambda s, d: L.text_leaves(_nested(s, d).withColumn("r", F.struct(F.struct("r.stats.kind", F.format_string("%.2f", "r.stats.value").alias("value")).alias("stats"), "r.meta")), "r", ["event_id"]),
    "detail_rows": lambda s, d: L.detail_rows(records(s, d)).select(*_DETAIL),
    "detail_summary": lambda s, d: run_summary(L.detail_rows(records(s, d)), ["num_segments", "tutor_talk_ratio", "silence_ratio", "overall", "answer_correctness"], by=("run_name",)),
    "wide_quality": lambda s, d: L.wide_quality(I.quality(s, d)).select("run", "conv_index", "ab_tutor_PQ", "ab_student_PQ", "ab_tutor_CE", "ab_mixed_PQ"),
    "long_quality": lambda s, d: L.long_quality(L.wide_quality(I.quality(s, d))),
    "wide_cells": lambda s, d: L.wide_cells(E.conversation_cells(transcript.classified(s, d))).select("run", "conv_index", "vap_tutor_appropriate_uptake", "vap_student_missed_yield", "vap_pooled_false_interruption", F.round("vap_pooled_FI_rate", 6).alias("vap_pooled_FI_rate")),
    "evaluate": _evaluate,
    "evaluator_plugin": _plugin,
    "judge_calls": _judge_calls,
    "judge_sweep": _judge_sweep,
    "names": _names,
    "variant_listing": lambda s, d: variant_listing(_variants(s, d)),
    "default_variant": lambda s, d: default_variant(variant_listing(_variants(s, d))),
}

_TODO = """todo AS (SELECT DISTINCT run, CASE WHEN conv_index % 2 = 0 THEN conv_index ELSE conv_index + 100000 END AS conv_index FROM paired WHERE conv_index % 3 <> 0),
    cache AS (SELECT run, conv_index, CASE CAST(pc AS BIGINT) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' END AS status, ce AS result, TRUE AS cached FROM paired),
    plan AS (SELECT coalesce(t.run, c.run) AS run, coalesce(t.conv_index, c.conv_index) AS conv_index,
        CASE WHEN t.run IS NULL THEN 'keep' WHEN cached AND coalesce(status, 'ok') <> 'error' THEN 'reuse' ELSE 'compute' END AS action, status, result
        FROM todo t FULL JOIN cache c ON t.run = c.run AND t.conv_index = c.conv_index)"""
_LEAF = """SELECT 'stats' AS evaluator, 'value' AS path, value AS v FROM events
    UNION ALL SELECT 'meta', 'props.k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events
    UNION ALL SELECT 'meta', 'user', CAST(user_id AS DOUBLE) FROM events WHERE event_id % 3 = 0"""
_ROLL = f"SELECT evaluator, path, pyround(CAST(sum(CAST(v AS DECIMAL(38,9))) AS DOUBLE) / count(v), 3) AS mean, pyround(min(v), 3) AS min, pyround(max(v), 3) AS max, count(*) AS n FROM ({_LEAF}) GROUP BY 1, 2"
_ST, _TT = transcript.STATS_SQL, transcript.TT_SQL
_BOTH = with_ctes("seg", "SELECT 1").rsplit("SELECT 1", 1)[0] + _ST + _TT.replace("base AS", "base0 AS").replace("FROM base b", "FROM base0 b")
_BACK = "CASE c_nationkey % 4 WHEN 0 THEN 'gpt-realtime' WHEN 1 THEN 'human' WHEN 2 THEN 'new/model.1' END"
_NLEN = texts.ORACLES["judge_prompts"]


def _judged(shift: int) -> str:
    return f"""SELECT conv_index, length(prompt) + {shift} AS n FROM ({_NLEN})"""


_ANSWER = """concat('{"overall": {"score": ', CAST(n % 6 AS VARCHAR), ', "rationale": "r"}, "student_realism": {"score": ', CAST(n % 5 AS VARCHAR), '}}}')"""

ORACLES = {
    "work_plan": """SELECT CAST(o_orderkey AS VARCHAR) AS pid, o_orderkey AS ord, CAST(a AS INT) AS attempt_index FROM orders CROSS JOIN range(3) t(a)
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber - 1 = a)""",
    "next_attempt": "SELECT CAST(l_orderkey AS VARCHAR) AS pid, max(l_linenumber) AS next_attempt_index FROM lineitem GROUP BY l_orderkey",
    "select_pids": """SELECT ord, c_custkey AS pid, c_name FROM customer JOIN (SELECT user_id * 13 AS pid, min(event_id) AS ord FROM events GROUP BY 1) w ON c_custkey = w.pid""",
    "missing_pids": """SELECT user_id * 13 AS pid, min(event_id) AS ord FROM events WHERE user_id * 13 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
    "last_wins": "SELECT user_id, event_type, event_id, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "cache_plan": with_ctes("paired", f"WITH {_TODO} SELECT * FROM plan"),
    "incremental_merge": with_ctes(
        "paired",
        f"""WITH {_TODO} SELECT run, conv_index, CASE action WHEN 'compute' THEN 'ok' ELSE status END AS status,
        CASE action WHEN 'compute' THEN conv_index * 2.0::DOUBLE ELSE result END AS result FROM plan""",
    ),
    "scorability": with_ctes(
        "convs",
        """WITH r AS (SELECT run, conv_index, u, CASE WHEN conv_index % 5 = 0 THEN 'not aligned' WHEN conv_index % 7 = 0 THEN 'no aligned words'
        WHEN u % 3 = 0 THEN 'missing audio' END AS skip_reason FROM convs)
        SELECT run, conv_index, CASE WHEN skip_reason IS NULL THEN u * 10 END AS first_onset_ms, skip_reason FROM r""",
    ),
    "judging_matrix": """SELECT c_custkey AS row_idx, side, m[1] AS judge_model, m[2] AS rubric FROM customer, (SELECT unnest(['pos', 'neg']) AS side),
        (SELECT unnest([['m1', 'llm_judge'], ['m2', 'llm_judge'], ['m1', 'llm_judge_bea']]) AS m)""",
    "manifest_drift": """SELECT c_custkey AS run, 'arg' AS kind, 'attempts' AS name, CAST(c_nationkey AS VARCHAR) AS saved, CAST(c_nationkey + 1 AS VARCHAR) AS current
        FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'prompt', 'tutor', c_mktsegment, NULL FROM customer WHERE c_custkey % 20 = 0""",
    "first_n": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "seeded_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat('7:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 100",
    "indexed_sample": """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS row_idx FROM
        (SELECT o_orderkey FROM orders ORDER BY md5(concat('7:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 100)""",
    "sorted_scores": with_ctes("paired", "SELECT run, conv_index, CASE WHEN cu < 5 THEN ce END AS ce FROM paired"),
    "first_seen": "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id",
    "union_runs": with_ctes("paired", "SELECT run, conv_index, CASE WHEN run = 'view' THEN pq END AS pq, CASE WHEN run <> 'view' THEN ce END AS ce FROM paired"),
    "runs_with_rows": with_ctes("seg", "SELECT n_nationkey AS ord, concat('sys', CAST(n_nationkey AS VARCHAR)) AS run FROM nation WHERE concat('sys', CAST(n_nationkey AS VARCHAR)) IN (SELECT run FROM seg)"),
    "other_systems": with_ctes("seg", "SELECT run, count(DISTINCT conv_index) AS n_conversations FROM seg WHERE run <> 'sys0' GROUP BY run"),
    "conversations_per_run": with_ctes("seg", "SELECT run, count(DISTINCT conv_index) AS n_conversations FROM seg GROUP BY run"),
    "numeric_leaf_rollup": _ROLL,
    "numeric_leaf_json": _ROLL,
    "text_leaf_rows": """SELECT * FROM (SELECT event_id, 'stats.kind' AS path, event_type AS text FROM events
        UNION ALL SELECT event_id, 'stats.value', printf('%.2f', value) FROM events
        UNION ALL SELECT event_id, 'meta.props.k', json_extract_string(props, '$.k') FROM events
        UNION ALL SELECT event_id, 'meta.user', CAST(user_id AS VARCHAR) FROM events WHERE event_id % 3 = 0) WHERE text IS NOT NULL""",
    "detail_rows": _BOTH
    + """SELECT s.run AS run_name, s.conv_index, CAST(s.conv_index AS VARCHAR) AS pid, duration_s, CAST(num_segments AS DOUBLE) AS num_segments, tutor_talk_ratio,
        latency_p90_s, silence_ratio, CAST(s.conv_index % 6 AS DOUBLE) AS overall, CAST(NULL AS DOUBLE) AS answer_correctness, CAST(NULL AS DOUBLE) AS mean_component_score
        FROM stats s JOIN tt USING (run, conv_index)""",
    "detail_summary": _BOTH
    + """SELECT s.run AS run_name, pyround(CAST(sum(CAST(num_segments AS DECIMAL(38,9))) AS DOUBLE) / nullif(count(num_segments), 0), 3) AS num_segments, pyround(CAST(sum(CAST(tutor_talk_ratio AS DECIMAL(38,9))) AS DOUBLE) / nullif(count(tutor_talk_ratio), 0), 3) AS tutor_talk_ratio,
        pyround(CAST(sum(CAST(silence_ratio AS DECIMAL(38,9))) AS DOUBLE) / nullif(count(silence_ratio), 0), 3) AS silence_ratio, pyround(CAST(sum(CAST(s.conv_index % 6 AS DECIMAL(38,9))) AS DOUBLE) / nullif(count(s.conv_index % 6), 0), 3) AS overall, CAST(NULL AS DOUBLE) AS answer_correctness
        FROM stats s JOIN tt USING (run, conv_index) GROUP BY 1""",
    "wide_quality": with_ctes(
        "quality",
        """SELECT run, conv_index, max(score) FILTER (WHERE channel = 'tutor' AND axis = 'PQ') AS ab_tutor_PQ, max(score) FILTER (WHERE channel = 'student' AND axis = 'PQ') AS ab_student_PQ,
        max(score) FILTER (WHERE channel = 'tutor' AND axis = 'CE') AS ab_tutor_CE, CAST(NULL AS DOUBLE) AS ab_mixed_PQ FROM quality GROUP BY 1, 2""",
    ),
    "long_quality": with_ctes("quality", "SELECT run, conv_index, channel, axis, score FROM quality"),
    "wide_cells": with_ctes(
        "cls",
        """SELECT run, conv_index, CASE WHEN bool_or(responder = 'tutor') THEN count(*) FILTER (WHERE responder = 'tutor' AND cell = 'appropriate_uptake') END AS vap_tutor_appropriate_uptake,
        CASE WHEN bool_or(responder = 'student') THEN count(*) FILTER (WHERE responder = 'student' AND cell = 'missed_yield') END AS vap_student_missed_yield,
        count(*) FILTER (WHERE cell = 'false_interruption') AS vap_pooled_false_interruption,
        round(count(*) FILTER (WHERE cell = 'false_interruption') / nullif(count(*) FILTER (WHERE cell IN ('false_interruption', 'appropriate_restraint')), 0), 6) AS "vap_pooled_FI_rate"
        FROM cls GROUP BY 1, 2""",
    ),
    "evaluate": _BOTH + "SELECT s.run, s.conv_index, num_segments, tutor_words, overlap_s, silence_ratio FROM stats s JOIN tt USING (run, conv_index)",
    "evaluator_plugin": with_ctes(
        "seg",
        """SELECT run, conv_index, CASE WHEN conv_index % 10 <> 3 THEN max(end_ms - start_ms) END AS longest_ms, CASE WHEN conv_index % 10 <> 3 THEN pyround(avg(start_ms), 3) END AS mean_start,
        CASE WHEN conv_index % 10 = 3 THEN 'error' ELSE 'ok' END AS status, CASE WHEN conv_index % 10 = 3 THEN 'no score' END AS error FROM seg GROUP BY 1, 2""",
    ),
    "judge_calls": f"""SELECT conv_index, CASE WHEN n % 7 = 0 THEN 'error' WHEN n % 11 = 0 THEN 'parse_error' ELSE 'ok' END AS status,
        CASE WHEN n % 7 <> 0 AND n % 11 <> 0 THEN CAST(n % 6 AS INT) END AS overall, CASE WHEN n % 7 <> 0 AND n % 11 <> 0 THEN CAST(n % 5 AS DOUBLE) END AS mean_component_score,
        CASE WHEN n % 7 <> 0 AND n % 11 = 0 THEN {_ANSWER} END AS raw, CASE WHEN n % 7 = 0 THEN 'refused' END AS error FROM ({_judged(0)})""",
    "judge_sweep": f"""SELECT judge_model, count(*) FILTER (WHERE n % 7 <> 0 AND n % 11 <> 0) AS n_ok, count(*) FILTER (WHERE n % 7 = 0) AS n_error,
        count(*) FILTER (WHERE n % 7 <> 0 AND n % 11 = 0) AS n_bad FROM (SELECT 'a' AS judge_model, n FROM ({_judged(0)}) UNION ALL SELECT 'b-1', n FROM ({_judged(1)})) GROUP BY 1""",
    "names": f"""SELECT c_custkey, concat(CASE c_nationkey % 4 WHEN 0 THEN 'GPT' WHEN 1 THEN 'Human' WHEN 2 THEN 'new/model.1' ELSE '?' END, '↑ / Gemini↓') AS label,
        replace(b, '/', '-') AS slug, translate(b, '/.', '_-') AS file_slug,
        CASE WHEN b IS NOT NULL OR c_custkey % 2 = 0 THEN c_mktsegment END AS student,
        CASE WHEN b IS NOT NULL THEN b WHEN c_custkey % 2 = 0 THEN 'v1' END AS tutor,
        CASE WHEN c_custkey % 3 = 0 THEN 'text_mms' WHEN c_custkey % 2 = 0 THEN 'whisper_mms_no_bias' ELSE 'whisper_mms' END AS variant,
        c_custkey % 5 = 0 AND coalesce(b = 'gpt-realtime', FALSE) AS uses_image FROM (SELECT *, {_BACK} AS b FROM customer)""",
    "variant_listing": with_ctes(
        "ev",
        """SELECT run, variant, concat('mode', CAST(min(pos) FILTER (WHERE pos % 4 <> 0) % 3 AS VARCHAR)) AS mode, min(pos) FILTER (WHERE pos % 4 <> 0) % 2 = 0 AS prompt_bias, count(*) AS n_records
        FROM (SELECT concat('sys', CAST(user_id % 5 AS VARCHAR)) AS run, event_id AS pos, CASE WHEN event_type = 'view' THEN 'text_mms'
        WHEN event_type = 'click' AND user_id % 5 <> 2 THEN 'whisper_mfa' ELSE 'zz_other' END AS variant FROM ev) GROUP BY 1, 2""",
    ),
    "default_variant": "SELECT DISTINCT concat('sys', CAST(user_id % 5 AS VARCHAR)) AS run, CASE WHEN user_id % 5 = 2 THEN 'text_mms' ELSE 'whisper_mfa' END AS default_variant FROM events",
}
