"""Round trips through files: Spark writes what it derives from the tables, the scans
and sinks under test read and write it in the shared folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from queries import inputs as I
from queries.inputs import with_ctes
from talkmetry.constants import KEYS
from talkmetry.operators.conversation import conversation_stats
from talkmetry.session import shared_dir
from talkmetry.sinks import write
from talkmetry.sources import flatten, imports, lines, runs

TURN = StructType(
    [
        StructField("conv_index", LongType()),
        StructField("turn", LongType()),
        StructField("role", StringType()),
        StructField("text", StringType()),
    ]
)


def _lines(spark, d, path: str, broken: bool) -> None:
    """One JSON line per turn in a directory per run; turns 2 and up lack their index, and
    every ninth conversation has cut-off lines if ``broken``."""
    record = F.to_json(F.struct(F.when(F.col("turn") < 2, F.col("conv_id")).alias("conv_index"), "turn", "role", "text"))
    bad = F.lit(broken) & (F.col("conv_id") % 9 == 0)
    rows = I.table(spark, d, "conversations").select(
        (F.col("conv_id") % 5).alias("run"),
        "conv_id",
        "turn",
        F.when(bad, F.left(record, F.length(record) - 1)).otherwise(record).alias("value"),
    )
    ordered = rows.repartition("run").sortWithinPartitions("run", "conv_id", "turn")
    ordered.select("run", "value").write.partitionBy("run").text(path)


def _tolerant(spark, d, want: int):
    path = shared_dir(spark, "lines")
    _lines(spark, d, path, True)
    pair = lines.split_bad(lines.read_tolerant(spark, path + "/*", TURN))
    if want:
        return pair[1].select(F.regexp_extract("_corrupt", '"turn":(\\d+)', 1).cast("long").alias("turn"), F.length("_corrupt").alias("chars"))
    return pair[0].select("conv_index", "turn", "role", "text")


def _dense(spark, d):
    path = shared_dir(spark, "lines")
    _lines(spark, d, path, True)
    good = lines.split_bad(lines.read_tolerant(spark, path + "/*", TURN))[0]
    run = F.regexp_extract("_file", "run=(\\d+)", 1).cast("long")
    return lines.with_dense_index(good).select(run.alias("run"), "turn", "role", "conv_index", F.col("_position").alias("position"))


def _strict(spark, d):
    path = shared_dir(spark, "lines")
    _lines(spark, d, path, False)
    return lines.read_strict(spark, path + "/*", TURN).select("conv_index", "turn", "role", "text")


def _auto_scan(spark, d):
    """The turns once as JSON lines and once as whole files that hold an array of some conversations each."""
    path = shared_dir(spark, "lines")
    _lines(spark, d, path, False)
    as_lines = lines.read_json(spark, path + "/*", TURN, multi_line=False)
    record = F.to_json(F.struct(F.when(F.col("turn") < 2, F.col("conv_id")).alias("conv_index"), "turn", "role", "text"))
    turns = I.table(spark, d, "conversations").select(F.expr("conv_id div 20").alias("file"), "conv_id", "turn", record.alias("value"))
    by_turn = Window.partitionBy("file").orderBy("conv_id", "turn")  # a file is twenty conversations
    turns = turns.withColumns({"n": F.row_number().over(by_turn), "last": F.lead(F.lit(1)).over(by_turn).isNull()})
    # The brackets stand in the rows: a union with rows for them would count as dealt by file, and be coalesced side by side.
    value = F.concat(F.when(F.col("n") == 1, "[").otherwise(","), "value", F.when(F.col("last"), "]").otherwise(""))
    arrays = shared_dir(spark, "arrays")
    files = turns.select("file", "n", value.alias("value")).repartition("file").sortWithinPartitions("file", "n")
    files.select("file", "value").write.partitionBy("file").text(arrays)
    whole = lines.read_json(spark, arrays + "/*", TURN, multi_line=True)
    columns = ["conv_index", "turn", "role", "text"]
    return as_lines.select(F.lit("lines").alias("form"), *columns).union(whole.select(F.lit("array").alias("form"), *columns))


def _aligned(spark, d):
    path = shared_dir(spark, "lines")
    _lines(spark, d, path, True)
    good = lines.split_bad(lines.read_tolerant(spark, path + "/*", TURN))[0]
    return lines.aligned_by_index(good).select("conv_index", "turn", "role", "text")


def _run_dirs(spark, d):
    path = shared_dir(spark, "runs")
    rows = I.rubric_raw(spark, d).select(
        F.concat("run", F.when(F.col("judge_model") == "view", F.lit("")).otherwise(F.concat(F.lit("__judge-"), "judge_model"))).alias("dir"),
        F.to_json(F.struct("conv_index", "raw")).alias("value"),
    )
    write.write_per_group(rows, path, ["dir"], "text")
    return runs.discover_runs(spark, path, "*.txt").select(F.regexp_replace("run", "^dir=", "").alias("run"), F.col("n_records").cast("long").alias("n_records"))


def _csv(spark, d):
    path = shared_dir(spark, "csv")
    stats = conversation_stats(I.segments(spark, d))
    columns = ["run", "conv_index", "duration_s", "tutor_words", "tutor_talk_ratio"]
    write.write_csv(stats, path, columns)
    return spark.read.option("header", True).schema("run string, conv_index long, duration_s double, tutor_words long, tutor_talk_ratio double").csv(path)


def _per_group(spark, d):
    path = shared_dir(spark, "groups")
    rows = I.preference_rows(spark, d).select("judge_model", "comparison_key", "row_idx", "side", "score")
    write.write_per_group(rows, path, ["judge_model", "comparison_key"])
    return spark.read.schema("row_idx long, side string, score double, judge_model string, comparison_key string").json(path)


def _rewrite(spark, d):
    """Write all runs, then replace two of them; the others must survive."""
    path = shared_dir(spark, "rewrite")
    base = I.paired(spark, d).select("run", "conv_index", "pq")
    write.rewrite_sorted(base, path)
    write.rewrite_sorted(base.filter(F.col("run").isin("view", "click")).withColumn("pq", F.col("pq") * 2), path)
    return spark.read.schema("conv_index long, pq double, run string").parquet(path)


def _append(spark, d):
    path = shared_dir(spark, "append")
    base = I.paired(spark, d).select("run", "conv_index", "ce")
    write.append_rows(base, path)
    write.append_rows(base.filter(F.col("run") == "error"), path)
    return spark.read.schema("run string, conv_index long, ce double").json(path)


def _xml(spark, d):
    """Timed units, some without text or with times that make no interval."""
    path = shared_dir(spark, "units")
    start = F.format_string("%.4f", F.col("start_ms") / 1000.0)
    end = F.when(F.col("seg_id") % 11 == 0, start).when(F.col("seg_id") % 13 == 0, F.lit("n/a")).otherwise(F.format_string("%.4f", F.col("end_ms") / 1000.0))
    unit = F.concat(F.lit('<tu start="'), start, F.lit('" end="'), end, F.lit('" utt="'), F.col("seg_id").cast("string"), F.lit('">'), F.when(F.col("seg_id") % 7 == 0, F.lit(" ")).otherwise(F.lit("word")), F.lit("</tu>"))
    rows = I.segments(spark, d).select("run", "role", F.col("seg_id").alias("place"), unit.alias("value"))
    frame = F.array(
        F.struct(F.lit(-1).cast("long").alias("place"), F.lit("<units>").alias("value")),
        F.struct(F.lit(2**62).cast("long").alias("place"), F.lit("</units>").alias("value")),
    )
    root = rows.select("run", "role").distinct().select("run", "role", F.explode(frame).alias("f")).select("run", "role", "f.*")
    files = rows.unionByName(root).repartition("run", "role").sortWithinPartitions("run", "role", "place")
    files.select("run", "role", "value").write.partitionBy("run", "role").text(path)
    source = F.regexp_replace(F.col("_metadata.file_path"), r"^.*/run=([^/]+)/role=(.)[^/]*/.*$", "$1.$2.timed-units.xml")
    name = F.replace(source, F.lit(".t."), F.lit(".g."))
    return imports.timed_units(spark, path + "/*/*", name)


def _nested_round_trip(spark, d):
    """Conversation records as JSON lines, back to segment rows."""
    path = shared_dir(spark, "nested")
    item = F.struct("seg_id", "role", "text", (F.col("start_ms") / 1000.0).alias("start_time"), (F.col("end_ms") / 1000.0).alias("end_time"))
    nested = I.segments(spark, d).groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("segments"))
    nested.write.json(path)
    from talkmetry.schemas import CONVERSATION

    schema = StructType([StructField("run", StringType()), *CONVERSATION.fields])
    return flatten.segment_rows(lines.read_strict(spark, path, schema)).drop("audio_path")


QUERIES = {
    "jsonl_tolerant": lambda s, d: _tolerant(s, d, 0),
    "jsonl_quarantine": lambda s, d: _tolerant(s, d, 1),
    "jsonl_strict": _strict,
    "json_auto_scan": _auto_scan,
    "dense_index": _dense,
    "aligned_last_wins": _aligned,
    "run_discovery": _run_dirs,
    "judge_run_discovery": lambda s, d: runs.judge_runs(_run_dirs(s, d)),
    "csv_export": _csv,
    "write_per_group": _per_group,
    "rewrite_sorted": _rewrite,
    "append_rows": _append,
    "timed_unit_xml": _xml,
    "nested_round_trip": _nested_round_trip,
}

_STORED = "SELECT conv_id, CASE WHEN turn < 2 THEN conv_id END AS conv_index, turn, role, text FROM conversations"

ORACLES = {
    "jsonl_tolerant": f"SELECT conv_index, turn, role, text FROM ({_STORED}) WHERE conv_id % 9 <> 0",
    "jsonl_quarantine": """SELECT turn, length(to_json({'conv_index': conv_index, 'turn': turn, 'role': role, 'text': text}))
        - CASE WHEN conv_index IS NULL THEN length('"conv_index":null,') ELSE 0 END - 1 AS chars FROM (SELECT CASE WHEN turn < 2 THEN conv_id END AS conv_index, * FROM conversations) WHERE conv_id % 9 = 0""",
    "jsonl_strict": f"SELECT conv_index, turn, role, text FROM ({_STORED})",
    "json_auto_scan": f"SELECT form, conv_index, turn, role, text FROM ({_STORED}) CROSS JOIN (SELECT unnest(['lines', 'array']) AS form)",
    "dense_index": f"""WITH s AS (SELECT *, conv_id % 5 AS run, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id, turn) - 1 AS position FROM ({_STORED}) WHERE conv_id % 9 <> 0)
        SELECT run, turn, role, coalesce(conv_index, position) AS conv_index, position FROM s""",
    "aligned_last_wins": f"""SELECT conv_index, turn, role, text FROM ({_STORED}) WHERE conv_id % 9 <> 0 AND conv_index IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY conv_index ORDER BY turn DESC) = 1""",
    "run_discovery": with_ctes("raw", "SELECT concat(run, CASE WHEN judge_model = 'view' THEN '' ELSE concat('__judge-', judge_model) END) AS run, count(*) AS n_records FROM raw GROUP BY 1"),
    "judge_run_discovery": with_ctes("raw", "SELECT DISTINCT concat(run, '__judge-', judge_model) AS directory, run, judge_model FROM raw WHERE judge_model <> 'view'"),
    "csv_export": with_ctes(
        "seg",
        """SELECT run, conv_index, pyround(max(end_ms) / 1000.0::DOUBLE, 3) AS duration_s, CAST(coalesce(sum(words) FILTER (WHERE role = 'tutor'), 0) AS BIGINT) AS tutor_words,
        pyround(CAST(coalesce(sum(end_ms - start_ms) FILTER (WHERE role = 'tutor'), 0) AS BIGINT) / max(end_ms), 3) AS tutor_talk_ratio FROM seg GROUP BY 1, 2""",
    ),
    "write_per_group": with_ctes("pref", "SELECT judge_model, comparison_key, row_idx, CASE WHEN neg = 0 THEN 'pos' ELSE 'neg' END AS side, score FROM pref"),
    "rewrite_sorted": with_ctes("paired", "SELECT run, conv_index, CASE WHEN run IN ('view', 'click') THEN pq * 2 ELSE pq END AS pq FROM paired"),
    "append_rows": with_ctes("paired", "SELECT run, conv_index, ce FROM paired UNION ALL SELECT run, conv_index, ce FROM paired WHERE run = 'error'"),
    "timed_unit_xml": with_ctes(
        "seg",
        """SELECT run AS dialogue, role, 'word' AS word, start_ms, end_ms, CAST(seg_id AS VARCHAR) AS utt FROM seg
        WHERE seg_id % 11 <> 0 AND seg_id % 13 <> 0 AND seg_id % 7 <> 0 AND end_ms > start_ms""",
    ),
    "nested_round_trip": with_ctes(
        "seg",
        """SELECT run, conv_index, row_number() OVER (PARTITION BY run, conv_index ORDER BY seg_id) - 1 AS seg_id, role, text, start_ms, end_ms FROM seg""",
    ),
}
