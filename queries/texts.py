"""Queries over the chat table, documents and parts: transcripts, prompts, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as I
from queries.inputs import with_ctes
from queries.judging import backends_of
from queries.transcript import STATS_SQL, STAT_COLS, TT_SQL
from talkmetry.constants import KEYS, NAIVE_RUBRIC, TAXONOMY_RUBRIC
from talkmetry.functions.text import keep_tail, strip
from talkmetry.operators import transcripts as X
from talkmetry.operators.conversation import conversation_stats, turn_taking
from talkmetry.operators.rubrics import parse_responses
from talkmetry.sources.imports import dialog_conversations, dialog_segments, preference_segments, question_table

CHAT = ("conv_id",)
TEMPLATE = "Q: {question}\nA: {answer}\n{transcript}\nScore it."
TUTOR_PROMPT = "Tutor for: {question} ({answer})\n{choices_block}"


def chat_segments(spark, d):
    """The chat table on a one-second timeline, in the segment layout."""
    timed = X.synthetic_timeline(I.turns(spark, d), CHAT, "turn")
    return timed.select(
        F.lit("chat").alias("run"), F.col("conv_id").alias("conv_index"), F.col("turn").alias("seg_id"), "role", "text", "start_ms", "end_ms"
    )


def _questions(spark, d):
    return I.table(spark, d, "part").select(
        F.col("p_partkey").alias("pid"),
        F.col("p_name").alias("question"),
        F.col("p_brand").alias("answer"),
        F.split("p_type", " ").alias("choices"),
        "p_size",
        "p_type",
    )


def _prompt_render(spark, d):
    q = _questions(spark, d)
    return q.select(
        "pid", X.system_prompt(TUTOR_PROMPT, F.col("question"), F.col("answer"), F.col("choices")).alias("prompt")
    )


def _judge_prompts(spark, d):
    segments = chat_segments(spark, d)
    convs = segments.groupBy(*KEYS).agg(F.min_by("text", "seg_id").alias("question"), F.count(F.lit(1)).alias("answer"))
    return X.judge_prompts(convs, segments, TEMPLATE)


def _end_cut(spark, d):
    marked = I.turns(spark, d).withColumn(
        "text", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat("text", F.lit(" [END]"))).otherwise(F.col("text"))
    )
    return X.cut_at_end(marked, CHAT, 6).select("conv_id", "turn", "role")


def _chat_view(spark, d):
    turns = I.turns(spark, d)
    agents = turns.select("conv_id").distinct().select(
        "conv_id", F.explode(F.array(F.lit("tutor"), F.lit("student"))).alias("agent")
    )
    prompts = agents.withColumn("content", F.concat(F.lit("You are the "), F.col("agent")))
    return X.chat_view(turns, CHAT, prompts)


def _message_parts(spark, d):
    part = "struct<type:string,text:string,image_url:struct<url:string>>"
    words = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("struct<url:string>").alias("image_url")).cast(part)
    image = F.struct(
        F.lit("image_url").alias("type"),
        F.lit(None).cast("string").alias("text"),
        F.struct(F.concat(F.lit("img/"), F.col("conv_id").cast("string")).alias("url")).alias("image_url"),
    ).cast(part)
    parts = F.when(F.col("turn") == 0, F.array(image, words)).otherwise(F.array(words))
    return (
        I.turns(spark, d)
        .select("conv_id", "turn", F.posexplode(X.convert_image_parts(parts)).alias("part", "p"))
        .select("conv_id", "turn", "part", "p.type", "p.image", "p.text")
    )


def _modality(spark, d):
    convs = I.table(spark, d, "conversations").select(
        (F.col("conv_id") % 7).alias("dataset"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("x.png")).otherwise(F.lit("")).alias("image_path"),
        (F.col("conv_id") % 2 == 0).alias("has_audio"),
    )
    return X.dataset_modality(convs)


FILES = {"view": "tutor_full.wav", "click": "student_full.opus", "signup": "combined.wav"}


def _inventory(spark, d):
    """A file per event: audio where its value is small, else notes."""
    names = F.when(F.col("value") < 1, F.col("event_type"))
    return I.table(spark, d, "events").select(
        F.concat(F.lit("sys"), (F.col("user_id") % 5).cast("string")).alias("run"),
        F.expr("user_id div 5").alias("conv_index"),
        F.when(names == "view", F.lit(FILES["view"])).when(names == "click", F.lit(FILES["click"])).when(names == "signup", F.lit(FILES["signup"])).otherwise(F.lit("notes.txt")).alias("file_name"),
    )


def _convs(spark, d):
    return I.conversations_of(spark, d).select(*KEYS, F.col("u").cast("string").alias("pid"), F.repeat(F.concat(F.lit("question "), F.col("u").cast("string"), F.lit(" ")), F.lit(12)).alias("question"))


def _history(spark, d):
    return X.history(_convs(spark, d), I.segments(spark, d), _inventory(spark, d))


def _reject_empty(spark, d):
    """Conversations whose segments are only the long ones; audio from the inventory."""
    listed = X.history(_convs(spark, d), I.segments(spark, d), _inventory(spark, d)).select(*KEYS, "has_tutor_audio", "has_student_audio")
    spoken = I.segments(spark, d).filter(F.col("end_ms") - F.col("start_ms") > 14000)
    return X.reject_empty(listed, spoken).select(*KEYS)


def _question_table(spark, d):
    q = question_table(_questions(spark, d))
    return q.select(
        "pid", "question", "answer", "query", F.size("choices").alias("n_choices"),
        F.get_json_object("metadata", "$.p_size").cast("long").alias("p_size"),
        F.get_json_object("metadata", "$.p_type").alias("p_type"),
        F.json_object_keys("metadata")[0].alias("first_key"),
    )


def examples(spark, d):
    """Chat conversations in the nested layout of tutoring examples."""
    turn = F.struct(
        "turn",
        F.when(F.col("role") == "assistant", F.lit("Teacher")).when(F.col("role") == "user", F.lit("Student")).otherwise(F.col("role")).alias("user"),
        "text",
    )
    return (
        I.table(spark, d, "conversations")
        .groupBy(F.col("conv_id").alias("conv_index"))
        .agg(F.array_sort(F.collect_list(turn)).alias("t"))
        .select(
            "conv_index",
            F.transform("t", lambda x: F.struct(x["user"].alias("user"), x["text"].alias("text"))).alias("dialog_history"),
            F.col("t")[0]["text"].alias("problem"),
            F.lit(None).cast("string").alias("reference_solution"),
            F.lit("algebra").alias("topic"),
        )
    )


def _preference_import(spark, d):
    rows = examples(spark, d).withColumnRenamed("conv_index", "row_idx").withColumns(
        {"teacher_response_positive": F.concat(F.lit(" good "), F.col("problem")), "teacher_response_negative": F.lit("bad")}
    )
    return preference_segments(rows)


def _judged(spark, d, rubric):
    """A response per conversation, its scores from all its events; the calls of every thirteenth user to the plain rubric failed."""
    sums = I.cents_of_conversations(spark, d)
    keys = ("scaffolding_quality", "overall") if rubric is NAIVE_RUBRIC else ("guidance_quality", "actionability", "coherence")
    why = "" if rubric is NAIVE_RUBRIC else "r"
    entry = [F.concat(F.lit(f'"{k}": {{"score": '), F.expr(f"c div {6 ** i} % 6").cast("string"), F.lit(f', "rationale": "{why}"}}')) for i, k in enumerate(keys)]
    end = F.lit("}") if rubric is NAIVE_RUBRIC else F.when(F.col("c") % 17 == 0, F.lit("")).otherwise(F.lit("}"))
    error = F.when(F.col("u") % 13 == 0, F.lit("timed out")) if rubric is NAIVE_RUBRIC else F.lit(None).cast("string")
    raw = sums.select(*KEYS, F.lit("judge-1").alias("judge_model"), error.alias("error"), F.concat(F.lit("{"), F.concat_ws(", ", *entry), end).alias("raw"))
    return parse_responses(raw, rubric, error="error")


def _reports(spark, d):
    segments = I.segments(spark, d)
    convs = (
        _convs(spark, d)
        .join(backends_of(I.conversations_of(spark, d)), list(KEYS), "left")
        .withColumns(
            {
                "attempt_index": (F.col("conv_index") % 3).cast("int"),
                "answer": F.lit(" 42 "),
                "tutor_voice": F.lit("v1"),
                "student_voice": F.lit(None).cast("string"),
                "duration_ms": (F.col("conv_index") * 500).cast("long"),
            }
        )
    )
    lines = X.transcripts(segments, "report").drop("n_pieces")
    return X.conversation_reports(
        convs, lines, _judged(spark, d, NAIVE_RUBRIC), more_judged=[(_judged(spark, d, TAXONOMY_RUBRIC), TAXONOMY_RUBRIC)],
        stats=conversation_stats(segments), timing=turn_taking(segments))


def _call_json(spark, d):
    segments = I.segments(spark, d).withColumn("audio_path", F.when(F.col("seg_id") % 3 == 0, F.concat(F.lit("a/"), F.col("seg_id").cast("string"))))
    convs = segments.groupBy(*KEYS).agg(F.max("end_ms").alias("duration_ms")).withColumns(
        {"pid": F.concat_ws("-", *[F.col(k).cast("string") for k in KEYS]), "question": F.lit('Say "why"?'), "tutor_uses_image": F.col("conv_index") % 2 == 0,
         "image_path": F.when(F.col("conv_index") % 3 == 0, F.lit("i.png")).otherwise(F.lit(""))})
    return X.call_json(convs, segments)


def _conversation_json(spark, d):
    turns = I.table(spark, d, "conversations").select(F.col("conv_id").alias("pid"), "role", F.col("text").alias("content"), "turn")
    turns = turns.withColumn("audio_path", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))))
    convs = turns.groupBy("pid").agg(F.min_by("content", "turn").alias("question")).withColumn("tutor_model", F.lit("bench"))
    return X.conversation_json(convs, turns)


QUERIES = {
    "call_json": _call_json,
    "conversation_json": _conversation_json,
    "synthetic_timeline": lambda s, d: chat_segments(s, d).select("conv_index", "seg_id", "role", "start_ms", "end_ms"),
    "transcript_lines": lambda s, d: X.transcript_lines(chat_segments(s, d)),
    "transcripts": lambda s, d: X.transcripts(chat_segments(s, d)),
    "judge_prompts": _judge_prompts,
    "prompt_render": _prompt_render,
    "prompt_tail": lambda s, d: I.table(s, d, "documents").select("doc_id", keep_tail(F.col("text")).alias("tail")),
    "speaker_text": lambda s, d: X.speaker_text(I.turns(s, d), "tutor", CHAT, "turn"),
    "end_token_cut": _end_cut,
    "chat_view": _chat_view,
    "message_parts": _message_parts,
    "dataset_modality": _modality,
    "history_listing": _history,
    "reject_empty": _reject_empty,
    "question_table": _question_table,
    "dialog_import": lambda s, d: dialog_segments(examples(s, d)),
    "dialog_conversations": lambda s, d: dialog_conversations(examples(s, d), "bench"),
    "preference_import": _preference_import,
    "segment_json": lambda s, d: I.segments(s, d)
    .withColumn("audio_path", F.when(F.col("seg_id") % 3 == 0, F.concat(F.lit("a/"), F.col("seg_id").cast("string"))).otherwise(F.lit("")))
    .select("seg_id", X.segment_json().alias("json")),
    "conversation_reports": _reports,
}

_WS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_LINE = f"printf('[t=%6.2fs] %s: %s', CAST(turn_no AS DOUBLE), role, {_strip('text')})"
_TIMED = "timed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM turns)"
_FILES = """inv AS (SELECT concat('sys', CAST(user_id % 5 AS VARCHAR)) AS run, user_id // 5 AS conv_index,
    bool_or(event_type = 'view' AND value < 1) AS has_tutor_audio, bool_or(event_type = 'click' AND value < 1) AS has_student_audio,
    bool_or(event_type = 'signup' AND value < 1) AS has_combined_audio FROM events GROUP BY 1, 2)"""
_RULE = "repeat('-', 72)"
_USER = "CASE role WHEN 'assistant' THEN 'tutor' ELSE 'student' END"

ORACLES = {
    "synthetic_timeline": with_ctes(
        "turns",
        f"WITH {_TIMED} SELECT conv_id AS conv_index, turn AS seg_id, role, turn_no * 1000 AS start_ms, (turn_no + 1) * 1000 AS end_ms FROM timed",
    ),
    "transcript_lines": with_ctes(
        "turns", f"WITH {_TIMED} SELECT 'chat' AS run, conv_id AS conv_index, turn_no AS line_no, {_LINE} AS line FROM timed"
    ),
    "transcripts": with_ctes(
        "turns",
        f"""WITH {_TIMED} SELECT 'chat' AS run, conv_id AS conv_index, CAST(0 AS INT) AS part, count(*) AS n_pieces,
        string_agg({_LINE}, chr(10) ORDER BY turn_no) AS text FROM timed GROUP BY conv_id""",
    ),
    "judge_prompts": with_ctes(
        "turns",
        f"""WITH {_TIMED} SELECT 'chat' AS run, conv_id AS conv_index, CAST(0 AS INT) AS part, concat('Q: ', arg_min(text, turn), chr(10), 'A: ',
        CAST(count(*) AS VARCHAR), chr(10), string_agg({_LINE}, chr(10) ORDER BY turn_no), chr(10), 'Score it.') AS prompt FROM timed GROUP BY conv_id""",
    ),
    "prompt_render": """SELECT p_partkey AS pid, concat('Tutor for: ', p_name, ' (', p_brand, ')', chr(10), 'Choices:', chr(10),
        array_to_string(list_transform(range(len(string_split(p_type, ' '))), lambda i: concat('  ', chr(CAST(65 + i AS INT)), '. ',
        string_split(p_type, ' ')[i + 1])), chr(10))) AS prompt FROM part""",
    "prompt_tail": f"SELECT doc_id, right({_strip('text')}, 800) AS tail FROM documents",
    "speaker_text": with_ctes(
        "turns",
        f"""SELECT conv_id, CAST(0 AS INT) AS part, count(*) AS n_pieces, string_agg({_strip('text')}, ' ' ORDER BY turn) AS text
        FROM turns WHERE role = 'tutor' AND {_strip('text')} <> '' GROUP BY conv_id""",
    ),
    "end_token_cut": with_ctes(
        "turns",
        """SELECT conv_id, turn, role FROM turns t WHERE turn < 6 AND NOT EXISTS (SELECT 1 FROM turns e WHERE e.conv_id = t.conv_id
        AND e.turn < t.turn AND (e.conv_id + e.turn) % 5 = 0)""",
    ),
    "chat_view": with_ctes(
        "turns",
        """WITH agents AS (SELECT unnest(['tutor', 'student']) AS agent)
        SELECT DISTINCT conv_id, agent, CAST(0 AS BIGINT) AS position, 'system' AS chat_role, concat('You are the ', agent) AS content FROM turns, agents
        UNION ALL SELECT conv_id, agent, turn + 1, CASE WHEN role = agent THEN 'assistant' ELSE 'user' END, text
        FROM turns, agents WHERE role IN ('tutor', 'student')""",
    ),
    "message_parts": with_ctes(
        "turns",
        """SELECT conv_id, turn, CAST(0 AS INT) AS part, 'image' AS type, concat('img/', CAST(conv_id AS VARCHAR)) AS image, NULL AS text FROM turns WHERE turn = 0
        UNION ALL SELECT conv_id, turn, CASE WHEN turn = 0 THEN 1 ELSE 0 END, 'text', NULL, text FROM turns""",
    ),
    "dataset_modality": """SELECT conv_id % 7 AS dataset, CASE WHEN min(conv_id) % 3 = 0 AND min(conv_id) % 2 = 0 THEN 'text + image + audio'
        WHEN min(conv_id) % 3 = 0 THEN 'text + image' WHEN min(conv_id) % 2 = 0 THEN 'text + audio' ELSE 'text only' END AS modality
        FROM conversations GROUP BY 1""",
    "history_listing": with_ctes(
        "convs",
        f"""WITH {_FILES}, n AS (SELECT user_id AS u, count(*) AS num_segments FROM events GROUP BY 1)
        SELECT c.run, c.conv_index, CAST(c.u AS VARCHAR) AS pid, left(repeat(concat('question ', CAST(c.u AS VARCHAR), ' '), 12), 100) AS question,
        num_segments, coalesce(has_tutor_audio, FALSE) AS has_tutor_audio, coalesce(has_student_audio, FALSE) AS has_student_audio,
        coalesce(has_combined_audio, FALSE) AS has_combined_audio FROM convs c JOIN n USING (u) LEFT JOIN inv USING (run, conv_index)""",
    ),
    "reject_empty": with_ctes(
        "convs seg",
        f"""WITH {_FILES} SELECT run, conv_index FROM convs c LEFT JOIN inv USING (run, conv_index) WHERE coalesce(has_tutor_audio, FALSE)
        OR coalesce(has_student_audio, FALSE) OR EXISTS (SELECT 1 FROM seg WHERE seg.run = c.run AND seg.conv_index = c.conv_index AND end_ms - start_ms > 14000)""",
    ),
    "question_table": """SELECT CAST(p_partkey AS VARCHAR) AS pid, p_name AS question, p_brand AS answer, p_name AS query,
        CAST(len(string_split(p_type, ' ')) AS INT) AS n_choices, CAST(p_size AS BIGINT) AS p_size, p_type, 'p_size' AS first_key FROM part""",
    "dialog_import": f"""SELECT conv_id AS conv_index, row_number() OVER w - 1 AS seg_id, {_USER} AS role, {_strip('text')} AS text,
        (row_number() OVER w - 1) * 1000 AS start_ms, row_number() OVER w * 1000 AS end_ms FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "dialog_conversations": """SELECT conv_id AS conv_index, CAST(conv_id AS VARCHAR) AS pid, arg_min(text, turn) AS question, '' AS answer,
        'bench' AS tutor_backend, 'bench' AS student_backend, count(*) * 1000 AS duration_ms, 'algebra' AS topic FROM conversations GROUP BY conv_id""",
    "preference_import": f"""WITH n AS (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS problem FROM conversations GROUP BY 1),
        s AS (SELECT unnest(['pos', 'neg']) AS side)
        SELECT conv_id AS row_idx, side, row_number() OVER w - 1 AS seg_id, {_USER} AS role, {_strip('text')} AS text,
        (row_number() OVER w - 1) * 1000 AS start_ms, row_number() OVER w * 1000 AS end_ms FROM conversations, s
        WINDOW w AS (PARTITION BY conv_id, side ORDER BY turn)
        UNION ALL SELECT conv_id, side, n, 'tutor', CASE side WHEN 'pos' THEN {_strip("concat('good ', problem)")} ELSE 'bad' END, n * 1000, (n + 1) * 1000 FROM n, s""",
    "segment_json": with_ctes(
        "seg",
        """SELECT seg_id, concat('{"role":"', role, '","text":"', text, '","start_time":', CAST(pyround(start_ms / 1000.0::DOUBLE, 3) AS VARCHAR),
        ',"end_time":', CAST(pyround(end_ms / 1000.0::DOUBLE, 3) AS VARCHAR), CASE WHEN seg_id % 3 = 0 THEN concat(',"audio_path":"a/', CAST(seg_id AS VARCHAR), '"') ELSE '' END, '}') AS json FROM seg""",
    ),
    "call_json": with_ctes(
        "seg",
        """SELECT run, conv_index, concat('{"pid":"', run, '-', CAST(conv_index AS VARCHAR), '","attempt_index":0,"question":"Say \\"why\\"?","answer":"","tutor_voice":"","student_voice":"","tutor_backend":"","student_backend":"",',
        '"tutor_uses_image":', CASE WHEN conv_index % 2 = 0 THEN 'true' ELSE 'false' END, ',"student_uses_image":false,"duration":', CAST(pyround(max(end_ms) / 1000.0::DOUBLE, 3) AS VARCHAR), ',"segments":[',
        string_agg(concat('{"role":"', role, '","text":"', text, '","start_time":', CAST(pyround(start_ms / 1000.0::DOUBLE, 3) AS VARCHAR),
        ',"end_time":', CAST(pyround(end_ms / 1000.0::DOUBLE, 3) AS VARCHAR), CASE WHEN seg_id % 3 = 0 THEN concat(',"audio_path":"a/', CAST(seg_id AS VARCHAR), '"') ELSE '' END, '}'), ',' ORDER BY start_ms, seg_id),
        '],"metadata":{}', CASE WHEN conv_index % 3 = 0 THEN ',"image_path":"i.png"' ELSE '' END, '}') AS json FROM seg GROUP BY run, conv_index""",
    ),
    "conversation_json": """WITH u AS (SELECT conv_id, turn, text, concat('{"role":', CAST(to_json(role) AS VARCHAR), ',"content":', CAST(to_json(text) AS VARCHAR), ',"turn":', CAST(turn AS VARCHAR),
        CASE WHEN turn % 4 = 0 THEN concat(',"audio_path":"t', CAST(turn AS VARCHAR), '"') ELSE '' END, '}') AS j FROM conversations)
        SELECT conv_id AS pid, concat('{"pid":"', CAST(conv_id AS VARCHAR), '","question":', CAST(to_json(coalesce(arg_min(text, turn), '')) AS VARCHAR), ',"answer":"","tutor_model":"bench","student_model":"","utterances":[',
        string_agg(j, ',' ORDER BY turn), '],"num_turns":', CAST(count(*) AS VARCHAR), ',"metadata":{}}') AS json FROM u GROUP BY conv_id""",
    "conversation_reports": with_ctes("seg convs", "SELECT 1").rsplit("SELECT 1", 1)[0] + STATS_SQL + TT_SQL + f"""
        , t AS (SELECT run, conv_index, string_agg(printf('  [%7.2fs] %s: %s', start_ms / 1000.0::DOUBLE, upper(role), text), chr(10)
        ORDER BY start_ms, seg_id) AS text FROM seg GROUP BY 1, 2),
        j AS (SELECT user_id AS u, CAST(sum(c) AS BIGINT) AS c FROM ev GROUP BY 1),
        k AS (SELECT *, c % 6 AS s0, c // 6 % 6 AS s1, c // 36 % 6 AS s2 FROM j),
        b AS (SELECT * FROM convs)
        SELECT b.run, b.conv_index, CAST(0 AS INT) AS part, array_to_string([repeat('=', 72),
        printf('Conversation %03d   pid=%d   attempt=%d', b.conv_index, b.u, b.conv_index % 3), repeat('=', 72),
        printf('Backends  tutor=%s (v1)   student=%s (?)', CASE WHEN b.conv_index % 7 = 0 THEN '?' ELSE (['gpt-realtime', 'gemini-live', 'personaplex',
            'moshivis', 'other-backend'])[1 + b.u % 5] END, CASE WHEN b.conv_index % 7 = 0 THEN '?' ELSE 'gemini-live' END),
        printf('Duration  %.1fs', b.conv_index * 500 / 1000.0::DOUBLE), '', 'QUESTION', {_RULE},
        concat('  ', rtrim(repeat(concat('question ', CAST(b.u AS VARCHAR), ' '), 12))), '', 'Ground-truth answer: 42', '', 'TRANSCRIPT', {_RULE}, t.text, '',
        'LLM JUDGE (naive)', {_RULE},
        CASE WHEN b.u % 13 = 0 THEN concat('  Status: error', chr(10), '  Error: timed out') ELSE array_to_string([
        printf('  Model: judge-1   Mean component score: %s/5', CAST(s0::DOUBLE AS VARCHAR)), '', '  Naturalness',
        printf('    %-26s --  (missing)', 'Phrasing naturalness'), printf('    %-26s --  (missing)', 'Student realism'), '  Tutoring effectiveness',
        printf('    %-26s --  (missing)', 'Answer correctness'), printf('    %-26s %d/5', 'Scaffolding quality', s0), '  Engagement / holistic',
        printf('    %-26s %d/5', 'Overall', s1)], chr(10)) END, '',
        'LLM JUDGE (BEA 2025 — Maurya et al., NAACL 2025)', {_RULE},
        CASE WHEN c % 17 = 0 THEN '  Status: parse_error' ELSE array_to_string([
        printf('  Model: judge-1   Mean component score: %s/5', CAST(pyround((s0 + s1 + s2) / 3, 3) AS VARCHAR)), '', '  Error diagnosis',
        printf('    %-26s --  (missing)', 'Confusion ID'), printf('    %-26s --  (missing)', 'Confusion location'), '  Pedagogical quality',
        printf('    %-26s --  (missing)', 'Answer withheld'), printf('    %-26s %d/5', 'Guidance quality', s0), '      r', printf('    %-26s %d/5', 'Actionability', s1), '      r',
        '  Dialogue quality', printf('    %-26s %d/5', 'Coherence', s2), '      r', printf('    %-26s --  (missing)', 'Tutor tone'),
        printf('    %-26s --  (missing)', 'Human-likeness')], chr(10)) END, '',
        'STATS', {_RULE}, {", ".join(f"concat('  {c}: ', CAST({c} AS VARCHAR))" for c in STAT_COLS)}, '',
        'TURN-TAKING', {_RULE}, concat('  response_latency_s: {{''mean'': ', CAST(latency_mean_s::DOUBLE AS VARCHAR), ', ''median'': ', CAST(latency_median_s::DOUBLE AS VARCHAR),
        ', ''p90'': ', CAST(latency_p90_s::DOUBLE AS VARCHAR), ', ''count'': ', CAST(latency_count AS VARCHAR), '}}'),
        {", ".join(f"printf('  {c}: %.3f', {c}::DOUBLE)" for c in ("overlap_s", "overlap_ratio", "silence_s", "silence_ratio"))},
        concat('  backchannel_count: ', CAST(backchannel_count AS VARCHAR)), printf('  backchannel_ratio: %.3f', backchannel_ratio::DOUBLE), ''], chr(10)) AS report
        FROM b JOIN t USING (run, conv_index) JOIN k USING (u) JOIN stats USING (run, conv_index) JOIN tt USING (run, conv_index)""",
}
