"""Secret scan with DataFrame expressions only: fixed patterns, and Markov models of random strings and identifiers.

Base spans are leftmost, non-overlapping matches per kind. ``split`` gives what lies between the matches and
``regexp_extract_all`` the matches, so a running sum of their lengths gives each span in code points.

The method adds spans of kind ``markov``. Strings of ``LEAST`` or more characters of ``ALPHABET`` are candidates. Two first-order
character models are counted over the whole corpus: one from the values that base patterns find (labelled random), one
from the other candidates that consist of words (labelled identifiers). A candidate outside all base spans is a secret if its log-likelihood ratio
reaches ``LEAST_RATIO``. The model is at most 67 x 67 numbers, whatever the corpus.

Null text counts as empty and has no spans. With no random or no ordinary sample to learn from, nothing is added.
Extra columns are not read; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmetry.llm.common import store

KEYWORDS = "password|passwd|secret|token|api_?key"
#: kind: (pattern, group whose length counts, least length), in the order of the report.
KINDS = {
    "assign": (rf"((?i:{KEYWORDS}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # greedy, so the same maximal runs as [0-9a-f]+ without the short ones
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
SMOOTHING = 0.5
BACKOFF = 20.0
#: A candidate without a letter behind a digit and without a lower-case letter on its own consists of words.
NO_WORDS = r"[0-9][A-Za-z]|(?<![a-z])[a-z](?![a-z])"
#: Log-odds a string must reach: about one secret in 20 000 candidates is expected beforehand.
LEAST_RATIO = 10.0
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def _spans(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Array of (start, rank, end, value) of the matches of ``pattern`` whose ``group`` is long enough."""
    none = F.array().cast(_SPAN)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(between, F.length).alias("skip"), F.transform(found, F.length).alias("size"), value.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["skip"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(begin.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), x["value"].alias("value"))
        keep = x["value"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.cast("long").alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, add, lambda acc: acc["out"])).otherwise(none)


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the three kinds, ordered) and candidates (spans outside them)."""
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = [(name, *rule, i) for i, (name, rule) in enumerate(KINDS.items())]
    for name, pattern, group, least, rank in kinds:
        body = body.withColumn(name, _spans(F.col("text"), pattern, group, least, rank))
    body = body.withColumn("any", _spans(F.col("text"), CANDIDATE, 0, LEAST, len(KINDS)))
    body = body.withColumn("base", F.array_sort(F.concat(*KINDS)))
    free = F.filter("any", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return body.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "base", F.when(F.size("any") == 0, F.col("any")).otherwise(free).alias("candidates"))


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def train(spans: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(a, b, ratio): log of the chance of b after a in random strings over that in identifiers, for every pair."""
    n = len(ALPHABET)
    labelled = spans.select(F.explode(F.concat(
        F.transform("base", lambda s: F.struct(F.lit(1).alias("random"), s["value"].alias("value"))),
        F.transform(F.filter("candidates", lambda s: ~s["value"].rlike(NO_WORDS)), lambda s: F.struct(F.lit(0).alias("random"), s["value"].alias("value"))),
    )).alias("x")).select("x.random", "x.value").where(F.length("value") >= 2)
    # Equal strings count once for each label, so that a much copied token does not become the model.
    coded = labelled.distinct().withColumn("code", _codes(F.col("value")))
    pairs = coded.select("random", F.explode(F.zip_with(
        F.slice("code", 1, F.size("code") - 1), F.slice("code", 2, F.size("code") - 1), lambda a, b: F.when((a >= 0) & (b >= 0), a * n + b))).alias("pair")).where("pair IS NOT NULL")
    counts = pairs.groupBy("pair").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("i"))
    every = spans.sparkSession.range(n * n).withColumnRenamed("id", "pair")
    full = every.join(counts, "pair", "left").select((F.expr(f"pair div {n}")).alias("a"), (F.col("pair") % n).alias("b"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("i", F.lit(0)).alias("i"))
    # A pair backs off to its second character's own share, so that characters a class never shows speak against it.
    first = full.groupBy("a").agg(F.sum("r").alias("r_a"), F.sum("i").alias("i_a"))
    second = full.groupBy("b").agg(F.sum("r").alias("r_b"), F.sum("i").alias("i_b"))
    total = full.agg(F.sum("r").alias("r_n"), F.sum("i").alias("i_n")).withColumn("one", F.lit(1))
    every = full.join(first, "a").join(second, "b").withColumn("one", F.lit(1)).join(total, "one")  # n * n rows

    def chance(k: str) -> Column:
        share = (F.col(f"{k}_b") + smoothing) / (F.col(f"{k}_n") + smoothing * n)
        return (F.col(k) + BACKOFF * share) / (F.col(f"{k}_a") + BACKOFF)

    known = (F.col("r_n") > 0) & (F.col("i_n") > 0)
    return every.select("a", "b", F.when(known, F.log(chance("r") / chance("i"))).otherwise(0.0).alias("ratio"))


def ratio_of(value: Column, model: DataFrame) -> Column:
    """Log-likelihood ratio of a string under a trained model, which becomes one constant of the plan."""
    n = len(ALPHABET)
    got = {(r["a"], r["b"]): r["ratio"] for r in model.collect()}  # n * n rows
    table = F.split(F.lit(",".join(f"{got[a, b]:.6f}" for a in range(n) for b in range(n))), ",").cast("array<double>")
    codes = _codes(value)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * n + b + 1)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.element_at(table, p))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    found = store(with_spans(docs), "spans")
    model = train(found)
    names = F.array(*[F.lit(k) for k in (*KINDS, "markov")])
    show = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    line = lambda column: F.array_join(F.transform(column, show), ",")
    ratio = lambda s: ratio_of(s["value"], model)
    added = F.filter("candidates", lambda s: ratio(s) >= LEAST_RATIO)
    out = found.withColumn("added", added)
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line(F.array_sort(F.concat("base", "added"))).alias("spans"))
