"""Frames, label windows, words: time-series side of the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as I
from queries.inputs import with_ctes
from talkmetry.constants import ASR_SPLIT_GAP_MS, CORPUS_SPLIT_GAP_MS, KEYS
from talkmetry.operators import frames as N
from talkmetry.operators import words as W
from talkmetry.sources.imports import frame_rows

STEP = I.FRAME_STEP_MS
SPAN_MS = I.FRAMES * STEP


def _encoded(spark, d):
    """Label windows as text: 60 frames of five numbers; some frames are damaged."""
    f = F.col("frame")
    numbers = [F.round(F.col("p_now0") * 1000).cast("long"), F.round(F.col("p_future0") * 1000).cast("long"), f * 7 % 1000, f * 11 % 1000, f * 13 % 1000]
    good = F.concat_ws(",", *[n.cast("string") for n in numbers])
    text = F.when(f % 17 == 0, F.concat_ws(",", *[n.cast("string") for n in numbers[:4]])).when(f % 19 == 0, F.lit("1,2,x,4,5")).otherwise(good)
    return (
        I.frames(spark, d)
        .select(*KEYS, F.floor(F.col("t_ms") / 30000).alias("window_index"), "frame", text.alias("txt"))
        .groupBy(*KEYS, "window_index")
        .agg(F.array_sort(F.collect_list(F.struct("frame", "txt"))).alias("p"))
        .select(*KEYS, "window_index", F.array_join(F.transform("p", lambda x: x["txt"]), " ").alias("frames"))
    )


def _totals(spark, d):
    """Audio length: between one frame into and past the end of the last window."""
    return I.conversations_of(spark, d).select(*KEYS, (F.lit(270000) + F.col("u") % 7 * 100).cast("long").alias("total_ms"))


def _sliding(spark, d):
    durations = I.conversations_of(spark, d).select(*KEYS, F.lit(SPAN_MS).cast("long").alias("duration_ms"))
    plan = N.chunk_plan(durations)
    return N.stitch_chunks(N.chunk_frames(I.frames(spark, d).select(*KEYS, "frame", "t_ms"), plan))


def _activity(spark, d):
    return N.frame_activity(I.frames(spark, d).select(*KEYS, "frame", "p_now0", "p_future0"), I.segments(spark, d), STEP)


def _channels(spark, d):
    energy = _activity(spark, d).withColumnsRenamed({"p_now0": "energy0", "p_future0": "energy1"})
    return N.detect_channels(energy).withColumn("score", F.round("score", 6))


def words(spark, d):
    """Each segment of the view as one timed word; event ids follow time."""
    return I.segments(spark, d).select(
        *KEYS, "role", F.col("seg_id").alias("word_no"), F.concat(F.lit("w"), (F.col("seg_id") % 7).cast("string")).alias("word"), "start_ms", "end_ms"
    )


def _flat(segs):
    return segs.select(*KEYS, "role", "seg_no", "part", "start_ms", "end_ms", "text", F.size("words").alias("n_words"))


def _audio(spark, d):
    return I.conversations_of(spark, d).select(*KEYS, (F.col("u") * 97 % 3000 + 258000).alias("audio_ms"))


def aligned(spark, d):
    """One-segment aligned records: even events have two words (one may lack a time)."""
    sec = lambda c: F.col(c) / 1000.0
    null = F.lit(None).cast("double")
    word = lambda w, a, b, c: F.struct(F.lit(w).alias("word"), a.alias("start_time"), b.alias("end_time"), c.alias("confidence"))
    first = word("a", sec("start_ms"), sec("start_ms"), -(F.col("seg_id") % 5).cast("double"))
    second = word("b", F.when(F.col("seg_id") % 4 == 0, null).otherwise(sec("start_ms")), sec("end_ms"), null)
    items = F.when(F.col("seg_id") % 2 == 0, F.array(first, second)).when(F.col("seg_id") % 3 == 0, F.array(word("c", null, sec("end_ms"), null)))
    seg = F.struct("role", sec("start_ms").alias("start_time"), sec("end_ms").alias("end_time"), items.alias("words"))
    return I.segments(spark, d).select(*KEYS, F.col("seg_id").alias("rec"), F.array(seg).alias("segments"))


def _drop_silence(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ("sil", " SP ", "hello", "", "spn ", "ok")]), (F.col("seg_id") % 6 + 1).cast("int"))
    rows = I.segments(spark, d).select(*KEYS, "seg_id", label.alias("word"), F.lit(0).cast("long").alias("start_ms"), (F.col("end_ms") - F.col("start_ms")).alias("end_ms"), F.col("start_ms").alias("offset_ms"))
    return W.drop_silence(rows).drop("offset_ms")


QUERIES = {
    "frame_decode": lambda s, d: N.decoded_rows(_encoded(s, d)).select(*KEYS, "window_index", "frame", "label"),
    "frame_downsample": lambda s, d: N.downsample(I.frames(s, d).select(*KEYS, "frame", "p_now0"), 100),
    "frame_clock": lambda s, d: N.frame_clock(I.frames(s, d).select(*KEYS, "frame"), I.segments(s, d).groupBy(*KEYS).agg(F.min("start_ms").alias("onset_ms"))),
    "frame_activity": _activity,
    "channel_detection": _channels,
    "tumbling_label_counts": lambda s, d: N.label_windows(I.frames(s, d), _totals(s, d)),
    "first_label_window": lambda s, d: N.label_windows(I.frames(s, d), _totals(s, d), max_windows=1),
    "sliding_stitch": _sliding,
    "frame_arrays": lambda s, d: frame_rows(I.table(s, d, "embeddings").select("vec_id", "embedding"), ("vec_id",)).withColumn("embedding", F.round(F.col("embedding").cast("double"), 6)),
    "words_to_segments": lambda s, d: _flat(W.words_to_segments(words(s, d))),
    "words_split_last": lambda s, d: _flat(W.words_to_segments(words(s, d), gap_ms=ASR_SPLIT_GAP_MS, joiner="", end="last")),
    "words_corpus_split": lambda s, d: _flat(W.words_to_segments(words(s, d), gap_ms=CORPUS_SPLIT_GAP_MS, end="last")),
    "extend_segments": lambda s, d: W.extend_segments(I.segments(s, d), _audio(s, d)),
    "clamp_to_audio": lambda s, d: W.clamp_to_audio(I.segments(s, d), _audio(s, d)).select(*KEYS, "seg_id", "start_ms", "end_ms"),
    "drop_silence": _drop_silence,
    "flatten_words": lambda s, d: W.flatten_words(aligned(s, d)).drop("seg_id"),
    "word_intervals": lambda s, d: W.word_intervals(aligned(s, d)).drop("seg_id"),
}

_SPLIT = """f AS (SELECT run, conv_index, role, seg_id, start_ms, end_ms, CAST(coalesce(start_ms - lag(end_ms) OVER w > {gap}, FALSE) AS INT) AS o FROM seg
    WINDOW w AS (PARTITION BY run, conv_index, role ORDER BY seg_id)),
    g AS (SELECT *, CAST(sum(o) OVER (PARTITION BY run, conv_index, role ORDER BY seg_id) AS BIGINT) AS seg_no FROM f)
    SELECT run, conv_index, role, seg_no, CAST(0 AS INT) AS part, arg_min(start_ms, seg_id) AS start_ms, {end} AS end_ms,
    string_agg(concat('w', CAST(seg_id % 7 AS VARCHAR)), '{sep}' ORDER BY seg_id) AS text, CAST(count(*) AS INT) AS n_words FROM g GROUP BY 1, 2, 3, 4, 5"""
_ACT = """act AS (SELECT f.run, f.conv_index, f.frame, f.now_pm / 1000.0::DOUBLE AS p_now0, f.future_pm / 1000.0::DOUBLE AS p_future0,
    CAST(coalesce(max(CASE WHEN s.role = 'tutor' THEN 1 END), 0) AS INT) AS tutor_active, CAST(coalesce(max(CASE WHEN s.role = 'student' THEN 1 END), 0) AS INT) AS student_active
    FROM frames f LEFT JOIN seg s ON s.run = f.run AND s.conv_index = f.conv_index AND s.start_ms <= f.t_ms AND f.t_ms < s.end_ms GROUP BY 1, 2, 3, 4, 5)"""
_WIN = """w AS (SELECT f.run, f.conv_index, t_ms // 30000 AS window_index, label, 270000 + u % 7 * 100 AS total FROM frames f JOIN convs USING (run, conv_index))
    SELECT run, conv_index, window_index, window_index * 30.0::DOUBLE AS window_start_s, least((window_index + 1) * 30000, any_value(total)) / 1000.0::DOUBLE AS window_end_s,
    count(*) AS n_frames, count(*) FILTER (WHERE label = 'C') AS C, count(*) FILTER (WHERE label = 'NA') AS NA, count(*) FILTER (WHERE label = 'I') AS I,
    count(*) FILTER (WHERE label = 'BC') AS BC, count(*) FILTER (WHERE label = 'T') AS T FROM w GROUP BY 1, 2, 3
    HAVING least((window_index + 1) * 30000, any_value(total)) - window_index * 30000 >= 240"""

ORACLES = {
    "frame_decode": with_ctes(
        "frames",
        """WITH p AS (SELECT run, conv_index, t_ms // 30000 AS window_index, frame, [now_pm, future_pm, frame * 7 % 1000, frame * 11 % 1000, frame * 13 % 1000] AS v
        FROM frames WHERE frame % 17 <> 0 AND frame % 19 <> 0)
        SELECT run, conv_index, window_index, CAST(row_number() OVER (PARTITION BY run, conv_index, window_index ORDER BY frame) - 1 AS INT) AS frame,
        (['C', 'NA', 'I', 'BC', 'T'])[list_position(v, list_max(v))] AS label FROM p""",
    ),
    "frame_downsample": with_ctes("frames", "SELECT run, conv_index, frame, now_pm / 1000.0::DOUBLE AS p_now0 FROM frames WHERE frame % 6 = 0"),
    "frame_clock": with_ctes(
        "frames seg",
        """SELECT f.run, f.conv_index, f.frame, greatest(0, o.onset - 800) + f.frame * 20 AS t_ms FROM frames f
        JOIN (SELECT run, conv_index, min(start_ms) AS onset FROM seg GROUP BY 1, 2) o USING (run, conv_index)""",
    ),
    "frame_activity": with_ctes("frames seg", f"WITH {_ACT} SELECT * FROM act"),
    "channel_detection": with_ctes(
        "frames seg",
        f"""WITH {_ACT}, s AS (SELECT run, conv_index, coalesce(corr(p_now0, tutor_active), 0) - coalesce(corr(p_now0, student_active), 0)
        + coalesce(corr(p_future0, student_active), 0) - coalesce(corr(p_future0, tutor_active), 0) AS score FROM act GROUP BY 1, 2)
        SELECT run, conv_index, round(score, 6) AS score, CAST(score < 0 AS INT) AS tutor_channel FROM s""",
    ),
    "tumbling_label_counts": with_ctes("frames", f"WITH {_WIN}"),
    "first_label_window": with_ctes("frames", f"WITH {_WIN} AND window_index = 0"),
    "sliding_stitch": with_ctes(
        "frames",
        "SELECT run, conv_index, frame, t_ms, CASE WHEN t_ms < 25000 THEN 0 ELSE (t_ms - 25000) // 5000 + 1 END AS chunk FROM frames",
    ),
    "frame_arrays": """SELECT vec_id, CAST(i AS BIGINT) AS frame, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS embedding
        FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
    "words_to_segments": with_ctes("seg", "WITH " + _SPLIT.format(gap=1000, end="max(end_ms)", sep=" ")),
    "words_corpus_split": with_ctes("seg", "WITH " + _SPLIT.format(gap=500, end="arg_max(end_ms, seg_id)", sep=" ")),
    "words_split_last": with_ctes("seg", "WITH " + _SPLIT.format(gap=1500, end="arg_max(end_ms, seg_id)", sep="")),
    "extend_segments": with_ctes(
        "seg convs",
        """SELECT run, conv_index, role, seg_id, start_ms, greatest(start_ms, coalesce(lead(start_ms) OVER (PARTITION BY run, conv_index, role ORDER BY seg_id),
        u * 97 % 3000 + 258000)) AS end_ms FROM seg JOIN convs USING (run, conv_index)""",
    ),
    "clamp_to_audio": with_ctes(
        "seg convs",
        """SELECT run, conv_index, seg_id, start_ms, least(end_ms, u * 97 % 3000 + 258000) AS end_ms FROM seg JOIN convs USING (run, conv_index)
        WHERE text <> '' AND least(end_ms, u * 97 % 3000 + 258000) - start_ms >= 100""",
    ),
    "drop_silence": with_ctes(
        "seg", "SELECT run, conv_index, seg_id, CASE seg_id % 6 WHEN 2 THEN 'hello' ELSE 'ok' END AS word, start_ms, end_ms FROM seg WHERE seg_id % 6 IN (2, 5)"
    ),
    "flatten_words": with_ctes(
        "seg",
        """SELECT run, conv_index, role, CAST(0 AS INT) AS word_no, 'a' AS word, start_ms, start_ms AS end_ms, seg_id % 5 > 2 AS low_confidence FROM seg WHERE seg_id % 2 = 0
        UNION ALL SELECT run, conv_index, role, 1, 'b', start_ms, end_ms, NULL FROM seg WHERE seg_id % 4 = 2""",
    ),
    "word_intervals": with_ctes(
        "seg",
        """SELECT run, conv_index, role, start_ms, start_ms AS end_ms FROM seg WHERE seg_id % 2 = 0
        UNION ALL SELECT run, conv_index, role, start_ms, end_ms FROM seg WHERE seg_id % 4 = 2
        UNION ALL SELECT run, conv_index, role, start_ms, end_ms FROM seg WHERE seg_id % 2 = 1""",
    ),
}
