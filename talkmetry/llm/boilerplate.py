"""Line dedup: remove lines that spread over many sites, keep each such line where it occurs first.

A line's spread is the number of distinct sites that carry it. Spark's HyperLogLog sketches, one per line hash, are
built before the shuffle and merged by the aggregation, so a line on a third of all pages costs one sketch per task.
The estimate decides lines far from the threshold; lines within ``MARGIN`` of it get an exact distinct count. Lines
are told apart by two independent 64-bit hashes of the line without outer white space.

``strip_documents``, the pipeline's form, lets the distinct sites decide for every line that is not blank. ``line_report`` is held to
its check SQL, which leaves lines with fewer than ``MIN_WORDS`` words in place whatever their spread. The first occurrence (smallest
id, then line number) of a boilerplate line stays, so a copied document survives once. Null text has no lines; a null
site counts as one site of its own; of rows that repeat an id, a line's first occurrence is kept in each of them
(they are the same document). Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmetry.llm.common import store, under_plain_names

#: Distinct sites from which a line counts as boilerplate.
SITES = 5
#: Every line with a word counts; a caller may leave shorter ones alone.
MIN_WORDS = 1
LG_K = 8
#: Five relative standard errors of the sketch, 5 * 1.04 / sqrt(2 ** LG_K): outside, the estimate decides alone.
MARGIN = 0.33


def _trimmed(line: str) -> str:
    return f"regexp_replace({line}, '^[\\\\x20\\\\x09-\\\\x0D]+|[\\\\x20\\\\x09-\\\\x0D]+$', '')"


def _lines(docs: DataFrame, site: Column, min_words: int) -> DataFrame:
    """doc_id, site, line number and the two hashes of every line of ``min_words`` words or more."""
    body = docs.select("doc_id", F.coalesce(site.cast("string"), F.lit("\0null")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    body = body.where(F.expr(f"raw rlike '(?:[^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]+){{{min_words - 1}}}[^\\\\x20\\\\x09-\\\\x0D]'"))
    body = body.withColumn("line", F.expr(_trimmed("raw")))
    return body.select("doc_id", "site", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("other"), "line").alias("g"))


def spread_lines(docs: DataFrame, site: Column, sites: int = SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """(h, g, first_doc, first_line): lines on at least ``sites`` sites, with their first occurrence."""
    lines = _lines(docs, site, min_words)
    per_line = lines.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("doc_id", "line_no")).alias("first"),
    ).where(F.col("n") >= sites)
    likely = per_line.where(F.col("estimate") >= sites * (1 - MARGIN))
    likely = store(likely, "spread")
    near = likely.where(F.col("estimate") <= sites * (1 + MARGIN)).select("h", "g")
    exact = (
        lines.select("h", "g", "site").join(near, ["h", "g"], "left_semi").distinct()
        .groupBy("h", "g").agg(F.count(F.lit(1)).alias("spread")).where(F.col("spread") >= sites).select("h", "g")
    )
    sure = likely.where(F.col("estimate") > sites * (1 + MARGIN)).select("h", "g").union(exact)
    return likely.join(sure, ["h", "g"], "left_semi").select("h", "g", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


def strip_lines(docs: DataFrame, site: str = "source", sites: int = SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text`` and the added columns n_lines and n_removed.

    The line numbers to cut travel to the document, not the lines: one short row per cut, one array per document.
    """
    spread = spread_lines(docs, F.col(site), sites, min_words)
    cuts = (
        _lines(docs, F.col(site), min_words).select("doc_id", "line_no", "h", "g").join(spread, ["h", "g"])
        .where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))))
        .groupBy(F.col("doc_id").alias("_cut_id")).agg(F.collect_set("line_no").alias("_cut"))
    )
    split = F.split("text", "\n", -1)
    out = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("_cut_id")), "left")
    none = F.array().cast("array<int>")
    out = out.withColumn("_cut", F.coalesce("_cut", none)).withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long"))
    kept = F.filter(split, lambda _, i: ~F.array_contains("_cut", i))
    out = out.withColumn("n_removed", F.size("_cut").cast("long"))
    out = out.withColumn("text", F.when(F.size("_cut") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.drop("_cut", "_cut_id")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of what stays, of every document."""
    out = strip_lines(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def strip_documents(docs: DataFrame) -> DataFrame:
    """The documents without boilerplate lines; one that consisted of nothing else is dropped. Columns as given, whatever their names."""
    return under_plain_names(docs, ("doc_id", "source", "text", "n_chars"), _strip_documents)


def _strip_documents(docs: DataFrame) -> DataFrame:
    out = strip_lines(docs)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def oracle(table: str = "documents", sites: int = SITES) -> str:
    """DuckDB SQL for ``line_report``: exact distinct counts, no sketches."""
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(1) || 'null') AS site, u.i AS line_no, u.raw AS raw,
         regexp_replace(u.raw, '^{space}+|{space}+$', '', 'g') AS line
  FROM (SELECT doc_id, source, unnest(list_transform(str_split(text, chr(10)), lambda x, k: {{'i': k, 'raw': x}})) AS u
        FROM {table} WHERE text IS NOT NULL) x
), w AS (
  SELECT *, regexp_matches(raw, '(?:{word}+{space}+){{{MIN_WORDS - 1}}}{word}') AS long_enough FROM l
), s AS (
  SELECT line, min(doc_id * 10000000 + line_no) AS first_at FROM w WHERE long_enough GROUP BY line HAVING count(DISTINCT site) >= {sites}
), m AS (
  SELECT w.doc_id, w.line_no, w.raw, (s.line IS NOT NULL AND w.long_enough AND w.doc_id * 10000000 + w.line_no <> s.first_at) AS cut
  FROM w LEFT JOIN s ON w.line = s.line
), a AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT cut), '') AS kept
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_removed, 0) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM {table} d LEFT JOIN a ON a.doc_id = d.doc_id
"""
