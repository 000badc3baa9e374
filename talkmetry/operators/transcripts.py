"""Transcripts as text, prompts, chat views and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmetry.constants import (
    DATASET_ROLE_MAP,
    END_TOKEN,
    IMAGE_CAPABLE_BACKENDS,
    KEYS,
    NAIVE_RUBRIC,
    ROLES,
    Rubric,
)
from talkmetry.functions.text import lettered_choices, lookup, render, seconds, strip
from talkmetry.operators.ordered import Scan, scan

def dataset_role(user: Column) -> Column:
    """Teacher -> tutor, Student -> student, anything else (or nothing) -> student."""
    return lookup(user, DATASET_ROLE_MAP, F.lit("student"))


def join_in_order(
    pieces: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    piece: str,
    sep: str,
    per_part: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Concatenate ``piece`` in order: keys, part, n_pieces, text.

    A key is one row (part 0) whatever its length. Where the caller gives ``per_part``, a part takes the next so many
    pieces; ``transcript_lines`` is the form for texts that no cell should hold.
    """
    numbered = scan(pieces.select(*keys, *order, F.col(piece).alias("_piece")), keys, order, Scan(index="_i"), limit)
    part = F.floor(F.col("_i") / per_part).cast("int") if per_part else F.lit(0)
    return (
        numbered.groupBy(*keys, part.alias("part"))
        .agg(
            F.count(F.lit(1)).alias("n_pieces"),
            F.array_sort(F.collect_list(F.struct("_i", "_piece"))).alias("_p"),
        )
        .withColumn("text", F.array_join(F.transform("_p", lambda p: p["_piece"]), sep))
        .drop("_p")
    )


def transcript_line(style: str = "prompt") -> Column:
    """``[t=  1.23s] role: text`` for prompts, ``  [   1.23s] ROLE: text`` for reports."""
    t = seconds(F.col("start_ms"), 2)
    role = F.coalesce(F.col("role"), F.lit("?"))
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    if style == "prompt":
        return F.format_string("[t=%6.2fs] %s: %s", t, role, text)
    return F.format_string("  [%7.2fs] %s: %s", t, F.upper(role), text)


def transcript_lines(segments: DataFrame, style: str = "prompt", limit: int | None = None) -> DataFrame:
    """One row per segment: its line and its place by start time."""
    rows = segments.select(*KEYS, "start_ms", "seg_id", "role", "text")
    numbered = scan(rows, KEYS, ["start_ms", "seg_id"], Scan(index="line_no"), limit)
    return numbered.select(*KEYS, "line_no", transcript_line(style).alias("line"))


def transcripts(segments: DataFrame, style: str = "prompt", limit: int | None = None) -> DataFrame:
    """The transcript of each conversation, sorted by start, list order on ties."""
    rows = segments.select(*KEYS, "start_ms", "seg_id", transcript_line(style).alias("line"))
    return join_in_order(rows, KEYS, ["start_ms", "seg_id"], "line", "\n", limit=limit)


def speaker_text(turns: DataFrame, role: str, keys: Sequence[str], order: str, limit: int | None = None) -> DataFrame:
    """All of one role's text in list order, blanks left out."""
    text = strip(F.col("text"))
    rows = turns.filter((F.col("role") == role) & (text != "")).select(*keys, order, text.alias("text"))
    return join_in_order(rows, keys, [order], "text", " ", limit=limit)


def judge_prompts(convs: DataFrame, segments: DataFrame, template: str, limit: int | None = None) -> DataFrame:
    """Fill ``{question}``, ``{answer}`` and ``{transcript}`` per conversation (and part)."""
    lines = transcripts(segments, limit=limit)
    joined = convs.select(*KEYS, "question", "answer").join(lines, list(KEYS), "left")
    prompt = render(template, question=F.col("question"), answer=F.col("answer"), transcript=F.col("text"))
    return joined.select(*KEYS, F.coalesce("part", F.lit(0)).alias("part"), prompt.alias("prompt"))


def system_prompt(template: str, question: Column, answer: Column, choices: Column) -> Column:
    return render(template, question=question, answer=answer, choices_block=lettered_choices(choices))


def synthetic_timeline(turns: DataFrame, keys: Sequence[str], order: str, limit: int | None = None) -> DataFrame:
    """Give turns without a clock one second each, in order."""
    numbered = scan(turns, keys, [order], Scan(index="_i"), limit)
    return numbered.withColumns(
        {"start_ms": F.col("_i") * 1000, "end_ms": (F.col("_i") + 1) * 1000}
    ).drop("_i")


def cut_at_end(turns: DataFrame, keys: Sequence[str], max_turns: int, token: str = END_TOKEN) -> DataFrame:
    """Keep turns up to the first one with the end token, and at most ``max_turns``.

    The first end turn is an aggregate over the few turns that hold the token, joined
    back: no conversation has to be sorted.
    """
    ends = turns.filter(F.contains("text", F.lit(token))).groupBy(*keys).agg(F.min("turn").alias("_end"))
    last = F.least(F.coalesce("_end", F.lit(max_turns - 1)), F.lit(max_turns - 1))
    return turns.filter(F.col("turn") < max_turns).join(ends, list(keys), "left").filter(
        F.col("turn") <= last
    ).drop("_end")


def chat_view(turns: DataFrame, keys: Sequence[str], prompts: DataFrame) -> DataFrame:
    """Messages as each agent sees them: own turns ``assistant``, the other's ``user``,
    the system prompt first (position 0).

    ``prompts``: keys, agent, content.
    """
    heard = turns.filter(F.col("role").isin(*ROLES)).select(
        *keys, "turn", "role", "text", F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("agent")
    )
    said = heard.select(
        *keys,
        "agent",
        (F.col("turn") + 1).cast("long").alias("position"),
        F.when(F.col("role") == F.col("agent"), F.lit("assistant")).otherwise(F.lit("user")).alias("chat_role"),
        F.col("text").alias("content"),
    )
    first = prompts.select(
        *keys, "agent", F.lit(0).cast("long").alias("position"), F.lit("system").alias("chat_role"), "content"
    )
    return first.unionByName(said)


def convert_image_parts(parts: Column) -> Column:
    """``image_url`` content parts become ``image`` parts; others stay as they are."""

    def convert(p: Column) -> Column:
        is_image = (p["type"] == "image_url") & p["image_url"].isNotNull()
        return F.struct(
            F.when(is_image, F.lit("image")).otherwise(p["type"]).alias("type"),
            F.when(is_image, p["image_url"]["url"]).alias("image"),
            p["text"].alias("text"),
        )

    return F.transform(parts, convert)


def dataset_modality(convs: DataFrame, dataset: str = "dataset", order: str = "pos") -> DataFrame:
    """Text / +image / +audio of each dataset, judged by its first conversation.

    ``convs``: dataset, pos, image_path, has_audio.
    """
    has_image = F.coalesce(F.col("image_path") != "", F.lit(False))
    first = convs.groupBy(dataset).agg(
        F.min_by(F.struct(has_image.alias("i"), F.coalesce("has_audio", F.lit(False)).alias("a")), order).alias("f")
    )
    kind = (
        F.when(F.col("f.i") & F.col("f.a"), F.lit("text + image + audio"))
        .when(F.col("f.i"), F.lit("text + image"))
        .when(F.col("f.a"), F.lit("text + audio"))
        .otherwise(F.lit("text only"))
    )
    return first.select(dataset, kind.alias("modality"))


def uses_image(has_image: Column, backend: Column) -> Column:
    return has_image & F.coalesce(backend.isin(*IMAGE_CAPABLE_BACKENDS), F.lit(False))


def history(convs: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """Listing: first 100 characters of the question, segment count, which audio exists.

    ``files`` (run, conv_index, file_name) is an inventory; it is reduced to one row per
    conversation before the join.
    """

    def present(*names: str) -> Column:
        return F.max(F.col("file_name").isin(*names))

    audio = files.groupBy(*KEYS).agg(
        present("tutor_full.wav", "tutor_full.opus").alias("has_tutor_audio"),
        present("student_full.wav", "student_full.opus").alias("has_student_audio"),
        present("combined.wav").alias("has_combined_audio"),
    )
    counts = segments.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("num_segments"))
    flags = ["has_tutor_audio", "has_student_audio", "has_combined_audio"]
    return (
        convs.withColumn("question", F.left("question", F.lit(100)))
        .join(counts, list(KEYS), "left")
        .join(audio, list(KEYS), "left")
        .fillna(0, ["num_segments"])
        .fillna(False, flags)
    )


def reject_empty(convs: DataFrame, segments: DataFrame) -> DataFrame:
    """Drop conversations with neither a segment nor audio of either role."""
    spoken = segments.select(*KEYS).distinct().withColumn("_spoken", F.lit(True))
    return (
        convs.join(spoken, list(KEYS), "left")
        .filter(F.col("_spoken").isNotNull() | F.coalesce("has_tutor_audio", F.lit(False)) | F.coalesce("has_student_audio", F.lit(False)))
        .drop("_spoken")
    )


def segment_record() -> Column:
    """A segment for interchange: seconds with three decimals, empty optional fields left out."""
    return F.struct(
        "role",
        "text",
        seconds(F.col("start_ms")).alias("start_time"),
        seconds(F.col("end_ms")).alias("end_time"),
        F.nullif(F.col("audio_path"), F.lit("")).alias("audio_path"),
    )


def segment_json() -> Column:
    return F.to_json(segment_record())


def utterance_record() -> Column:
    """A turn of a text conversation for interchange; ``audio_path`` left out where empty."""
    return F.struct("role", "content", "turn", F.nullif(F.col("audio_path"), F.lit("")).alias("audio_path"))


def utterance_json() -> Column:
    return F.to_json(utterance_record())


def _with_list(convs: DataFrame, parts: DataFrame, keys: Sequence[str], order: Sequence[str], record: Column, name: str) -> DataFrame:
    """``convs`` with their parts as one ordered list, empty where they have none."""
    rows = F.array_sort(F.collect_list(F.struct(*order, record.alias("_record"))))
    listed = parts.groupBy(*keys).agg(F.transform(rows, lambda r: r["_record"]).alias(name))
    joined = convs.join(listed, list(keys), "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))


def _field(df: DataFrame, name: str, default) -> Column:
    """A column, or the default where it is null or not there."""
    value = F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    return value.alias(name)


def _metadata(df: DataFrame) -> Column:
    none = F.create_map().cast("map<string,string>")
    return (F.coalesce("metadata", none) if "metadata" in df.columns else none).alias("metadata")


def _image(df: DataFrame) -> Column:
    return F.nullif(_field(df, "image_path", ""), F.lit("")).alias("image_path")


def call_json(convs: DataFrame, segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys and ``json``: a spoken conversation with its segments in time order.

    ``convs``: keys, pid, duration_ms and whatever it has of the other fields; ``segments``: keys, seg_id and the columns of
    ``segment_record``. One row a conversation, whatever its length.
    """
    df = _with_list(convs, segments, keys, ["start_ms", "seg_id"], segment_record(), "segments")
    texts = ("question", "answer", "tutor_voice", "student_voice", "tutor_backend", "student_backend")
    record = F.struct(
        F.col("pid").cast("string").alias("pid"),
        _field(df, "attempt_index", 0),
        *[_field(df, c, "") for c in texts],
        *[_field(df, c, False) for c in ("tutor_uses_image", "student_uses_image")],
        seconds(F.col("duration_ms")).alias("duration"),
        "segments",
        _metadata(df),
        _image(df),
    )
    return df.select(*keys, F.to_json(record).alias("json"))


def conversation_json(convs: DataFrame, utterances: DataFrame, keys: Sequence[str] = ("pid",)) -> DataFrame:
    """keys and ``json``: a text conversation with its utterances by turn. ``convs``: keys, pid and whatever it has of the
    other fields; ``utterances``: keys and the columns of ``utterance_record``."""
    df = _with_list(convs, utterances, keys, ["turn"], utterance_record(), "utterances")
    record = F.struct(
        F.col("pid").cast("string").alias("pid"),
        *[_field(df, c, "") for c in ("question", "answer", "tutor_model", "student_model")],
        "utterances",
        F.size("utterances").alias("num_turns"),
        _metadata(df),
        _image(df),
    )
    return df.select(*keys, F.to_json(record).alias("json"))


def rubric_lines(scores: Column, rubric: Rubric) -> Column:
    """A rubric by axis: axis title, then each criterion with score and rationale."""
    lines = []
    for axis, keys in (rubric.report_axes or rubric.axes).items():
        lines.append(F.lit(f"  {axis}"))
        for key in keys:
            entry = F.try_element_at(scores, F.lit(key))
            label = f"    {rubric.report_labels.get(key, key):<26} "
            why = strip(F.coalesce(entry["rationale"], F.lit("")))
            lines.append(
                F.when(entry.isNull(), F.lit(f"{label}--  (missing)")).otherwise(
                    F.concat(F.lit(label), entry["score"].cast("string"), F.lit("/5"))
                )
            )
            lines.append(F.when(why != "", F.concat(F.lit("      "), why)))
    return F.concat_ws("\n", *lines)


RULE, BAR = "-" * 72, "=" * 72
LATENCIES = {"mean": "latency_mean_s", "median": "latency_median_s", "p90": "latency_p90_s", "count": "latency_count"}


def _plain(value: Column) -> Column:
    """A number of at most three decimals without exponent or trailing zeros, but with one decimal."""
    return F.regexp_replace(value.cast("decimal(38,3)").cast("string"), r"(\.\d+?)0+$", "$1")


def judge_section(status: Column, model: Column, mean: Column, scores: Column, error: Column, rubric: Rubric) -> Column:
    """Heading and outcome of one judge: its scores, or the status and error of a call that gave none."""
    failed = F.concat_ws("\n", F.concat(F.lit("  Status: "), status), F.concat(F.lit("  Error: "), error))
    scored = F.concat_ws(
        "\n",
        F.format_string("  Model: %s   Mean component score: %s/5", F.coalesce(model, F.lit("?")), F.coalesce(mean.cast("string"), F.lit("--"))),
        F.lit(""),
        rubric_lines(scores, rubric),
    )
    return F.concat_ws("\n", F.lit(f"\n{rubric.heading}\n{RULE}"), F.when(~status.isin("ok", "missing"), failed).otherwise(scored))


def judge_sections(judged: DataFrame, rubric: Rubric) -> DataFrame:
    """keys and ``section``: the sections of all of a conversation's judges, by model."""
    error = F.col("error") if "error" in judged.columns else F.lit(None).cast("string")
    section = judge_section(F.col("status"), F.col("judge_model"), F.col("mean_component_score"), F.col("scores"), error, rubric)
    rows = judged.select(*KEYS, F.struct("judge_model", section.alias("section")).alias("s"))
    return rows.groupBy(*KEYS).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("s")), lambda x: x["section"])).alias("section"))


def stats_section(stats: DataFrame) -> DataFrame:
    """keys and ``section``: each column of ``conversation_stats`` in a line."""
    lines = [
        F.concat(F.lit(f"  {c}: "), _plain(F.col(c)) if t == "double" else F.col(c).cast("string"))
        for c, t in stats.dtypes
        if c not in KEYS
    ]
    return stats.select(*KEYS, F.concat_ws("\n", F.lit(f"\nSTATS\n{RULE}"), *lines).alias("section"))


def timing_section(timing: DataFrame) -> DataFrame:
    """keys and ``section``: each column of ``turn_taking`` in a line, the four of latency in one."""
    latency = [F.concat(F.lit(f"'{n}': "), F.col(c).cast("string") if n == "count" else _plain(F.col(c))) for n, c in LATENCIES.items()]
    lines = [F.concat(F.lit("  response_latency_s: {"), F.concat_ws(", ", *latency), F.lit("}"))]
    for c, t in timing.dtypes:
        if c not in KEYS and c not in LATENCIES.values():
            lines.append(F.format_string(f"  {c}: " + ("%.3f" if t == "double" else "%d"), F.col(c)))
    return timing.select(*KEYS, F.concat_ws("\n", F.lit(f"\nTURN-TAKING\n{RULE}"), *lines).alias("section"))


def conversation_reports(
    convs: DataFrame,
    lines: DataFrame,
    judged: DataFrame,
    rubric: Rubric = NAIVE_RUBRIC,
    more_judged: Sequence[tuple[DataFrame, Rubric]] = (),
    stats: DataFrame | None = None,
    timing: DataFrame | None = None,
) -> DataFrame:
    """One report text per conversation (and transcript part), however many models judged it.

    ``convs``: keys, pid, attempt_index, question, answer, backends, voices, duration_ms.
    ``lines``: ``transcripts(style="report")``. ``judged``: keys, status, judge_model,
    scores, mean_component_score and, if calls can fail, error. A conversation that ``judged`` lacks gets a section
    without scores; the further rubrics of ``more_judged``, ``stats`` (``conversation_stats``) and ``timing``
    (``turn_taking``) have a section only where they have a row.
    """
    name = {c: F.coalesce(F.col(c), F.lit("?")) for c in ("tutor_backend", "student_backend", "tutor_voice", "student_voice")}
    joined = convs.join(lines, list(KEYS), "left")
    parts = [judge_sections(judged, rubric)] + [judge_sections(d, r) for d, r in more_judged]
    parts += [section(df) for section, df in ((stats_section, stats), (timing_section, timing)) if df is not None]
    for i, part in enumerate(parts):
        joined = joined.join(part.withColumnRenamed("section", f"_section_{i}"), list(KEYS), "left")
    none = F.lit(None)
    unjudged = judge_section(F.lit("missing"), none, none, F.create_map().cast("map<string,struct<score:int,rationale:string>>"), none.cast("string"), rubric)
    question = strip(F.coalesce("question", F.lit("")))
    report = F.concat_ws(
        "\n",
        F.lit(BAR),
        F.format_string(
            "Conversation %03d   pid=%s   attempt=%d",
            "conv_index",
            F.coalesce("pid", F.lit("?")),
            F.coalesce("attempt_index", F.lit(0)),
        ),
        F.lit(BAR),
        F.format_string(
            "Backends  tutor=%s (%s)   student=%s (%s)",
            name["tutor_backend"],
            name["tutor_voice"],
            name["student_backend"],
            name["student_voice"],
        ),
        F.when(F.col("duration_ms").isNotNull(), F.format_string("Duration  %.1fs", seconds(F.col("duration_ms"), 1))),
        F.lit("\nQUESTION"),
        F.lit(RULE),
        F.when(question != "", F.regexp_replace(question, "(?m)^", "  ")),
        F.concat(F.lit("\nGround-truth answer: "), strip(F.coalesce("answer", F.lit("")))),
        F.lit("\nTRANSCRIPT"),
        F.lit(RULE),
        F.coalesce("text", F.lit("  (no segments)")),
        F.coalesce(F.col("_section_0"), unjudged),
        *[F.col(f"_section_{i}") for i in range(1, len(parts))],
        F.lit(""),
    )
    return joined.select(*KEYS, F.coalesce("part", F.lit(0)).alias("part"), report.alias("report"))
