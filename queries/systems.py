"""Comparison of systems: intervals, paired tests, distribution distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as I
from queries import transcript as T
from queries.inputs import with_ctes
from talkmetry.constants import EVENT_LABELS, KEYS, T_975
from talkmetry.functions import stats
from talkmetry.operators import compare as C
from talkmetry.operators import distance as D
from talkmetry.operators import events as E
from talkmetry.operators import timing
from talkmetry.session import materialize

RUNS = ("click", "error", "purchase", "signup", "view")
REFERENCE = "sys0"


def samples(spark, d):
    return timing.timing_samples(timing.speech_runs(I.segments(spark, d)))


def counts(spark, d):
    """Stored once: the distances and the bootstrap read it several times."""
    return materialize(D.value_counts(samples(spark, d)), "timing-counts")


def _rates(spark, d):
    """False-interruption rate per conversation and scope, stored once for all pairs."""
    cells = E.conversation_cells(T.classified(spark, d), I.conversations_of(spark, d))
    return materialize(cells.select(*KEYS, "scope", F.col("fi_rate").alias("score")), "fi-rates")


def _fi_summary(spark, d):
    cells = E.conversation_cells(T.classified(spark, d), I.conversations_of(spark, d))
    return C.means_ci(cells, ["run", "scope"], "fi_rate", "mean_fi_rate")


def _fi_contrasts(spark, d):
    return C.paired_wilcoxon(_rates(spark, d), ["scope"], method="approx")


def _event_contrasts(spark, d):
    shares = C.label_percentages(I.frames(spark, d)).filter(F.col("label").isin(*EVENT_LABELS))
    shares = materialize(shares.withColumnRenamed("pct", "score"), "label-shares")
    return C.paired_wilcoxon(shares, ["label"], method="approx")


def _outer(spark, d):
    quality = I.paired(spark, d).filter(F.col("cu") < 5).select("run", "conv_index", "pq", "ce")
    labels = I.paired(spark, d).filter(F.col("pc") >= 12).select("run", "conv_index", "pc")
    return C.quality_and_labels(quality, labels)


def _system_table(spark, d):
    means = C.means_ci(I.scores(spark, d), ["run", "channel", "axis"])
    return C.system_table(means, [("mixed", "PQ"), ("mixed", "CE"), ("tutor", "PQ")])


def _emd_matrix(spark, d):
    """Runs renamed to <student>_<tutor>_v1: the user's last digit picks both halves."""
    s = samples(spark, d).withColumn(
        "run",
        F.when(F.col("run") == REFERENCE, F.col("run")).otherwise(
            F.concat(
                F.when(F.col("run").isin("sys1", "sys2"), F.lit("a")).otherwise(F.lit("b")),
                F.when(F.col("run").isin("sys1", "sys3"), F.lit("_x_v1")).otherwise(F.lit("_y_v1")),
            )
        ),
    )
    counts = materialize(D.value_counts(s), "timing-counts")
    return D.pair_matrix(D.distances(counts, REFERENCE), ["x", "y"])


def _blocks(spark, d):
    """Scores in blocks of 25 conversations, few enough for the exact distribution."""
    return I.paired(spark, d).select("run", "conv_index", F.expr("conv_index div 25").alias("block"), F.col("pq").alias("score"))


QUERIES = {
    "system_means_ci": lambda s, d: C.means_ci(I.scores(s, d), ["run", "channel", "axis"]),
    "fi_summary": _fi_summary,
    "fi_contrasts": _fi_contrasts,
    "event_rate_contrasts": _event_contrasts,
    "axis_correlations": lambda s, d: C.axis_correlations(I.scores(s, d)),
    "role_gap": lambda s, d: C.role_gap(I.quality(s, d)),
    "quality_label_outer": _outer,
    "system_table": _system_table,
    "label_percentages": lambda s, d: C.label_percentages(I.frames(s, d)).withColumn("pct", F.round("pct", 6)),
    "label_shares": lambda s, d: C.label_shares(I.frames(s, d)),
    "label_matrix": lambda s, d: C.label_matrix(C.label_shares(I.frames(s, d))),
    "signed_rank_sums": lambda s, d: C.signed_rank_sums(C.paired_differences(I.scores(s, d))).select(
        "channel", "axis", "system_a", "system_b", "n_pairs", "n_nonzero", "w_plus", "w_minus"
    ),
    "paired_wilcoxon": lambda s, d: C.paired_wilcoxon(I.scores(s, d), method="approx"),
    "paired_wilcoxon_exact": lambda s, d: C.paired_wilcoxon(materialize(_blocks(s, d), "score-blocks"), ["block"]),
    "pairwise_matrix": lambda s, d: C.symmetric_matrix(C.paired_wilcoxon(I.scores(s, d), method="approx"), RUNS),
    "ks_emd_js": lambda s, d: D.distances(counts(s, d), REFERENCE),
    "ecdf": lambda s, d: D.ecdf(D.value_counts(samples(s, d))),
    "quartiles": lambda s, d: D.quartiles(I.scores(s, d), ["run", "channel", "axis"]),
    "emd_matrix": _emd_matrix,
    "bootstrap_ci": lambda s, d: D.reference_distances(counts(s, d), REFERENCE),
}


def _t(df: str) -> str:
    series = "0.0::DOUBLE"
    for g in reversed(stats._expansion()):
        series = f"(({series}) / {df} + {g!r}::DOUBLE)"
    table = " ".join(f"WHEN {i} THEN {v!r}::DOUBLE" for i, v in enumerate(T_975, 1))
    return f"CASE {df} {table} ELSE {series} END"


def _ci(source: str, by: str, value: str, mean: str) -> str:
    return f"""SELECT {by}, n, round(m, 6) AS {mean}, round(h, 6) AS ci_half, round(m - h, 6) AS lo, round(m + h, 6) AS hi
        FROM (SELECT *, CASE WHEN n >= 2 THEN sd / sqrt(n) * ({_t("(n - 1)")}) END AS h FROM (
        SELECT {by}, count({value}) AS n, avg({value}) AS m, stddev_samp({value}) AS sd FROM {source} GROUP BY {by}))"""


def _p(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {stats.ERF_P!r}::DOUBLE * {x}))"
    poly = "0.0::DOUBLE"
    for a in reversed(stats.ERF_A):
        poly = f"(({poly} + ({a!r})::DOUBLE) * {t})"
    return f"{poly} * exp(-{x} * {x})"


def _wilcoxon(source: str, family: str, out: str, exact: str = "") -> str:
    """Average ranks by rank() and group size, then Holm as a maximum over smaller p; ``exact`` is a case before the approximation."""
    join = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in family.split(","))
    fa = ", ".join(f"a.{c.strip()}" for c in family.split(","))
    pair = f"{family}, system_a, system_b"
    return f"""d AS (SELECT {fa}, a.run AS system_a, b.run AS system_b, a.score - b.score AS d FROM {source} a JOIN {source} b
        ON {join} AND a.conv_index = b.conv_index AND a.run < b.run WHERE a.score IS NOT NULL AND b.score IS NOT NULL),
    rk AS (SELECT *, rank() OVER (PARTITION BY {pair} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {pair}, abs(d)) - 1) / 2 AS r,
        count(*) OVER (PARTITION BY {pair}, abs(d)) AS tied FROM d WHERE d <> 0),
    ws AS (SELECT {pair}, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus,
        count(*) AS n, sum(CAST(tied AS DOUBLE) * tied - 1) AS tie FROM rk GROUP BY {pair}),
    np AS (SELECT {pair}, count(*) AS n_pairs FROM d GROUP BY {pair}),
    grid AS (SELECT DISTINCT {fa}, a.run AS system_a, b.run AS system_b FROM (SELECT DISTINCT {family}, run FROM {source}) a
        JOIN (SELECT DISTINCT {family}, run FROM {source}) b ON {join} AND a.run < b.run),
    pr AS (SELECT {", ".join("grid." + c.strip() for c in pair.split(","))}, coalesce(n_pairs, 0) AS n_pairs,
        CASE WHEN n_pairs >= 2 THEN least(w_plus, w_minus) END AS W,
        CASE WHEN n_pairs >= 2 AND n IS NULL THEN 1.0::DOUBLE {exact} WHEN n_pairs >= 2 THEN {_p("((least(w_plus, w_minus) - n * (n + 1.0::DOUBLE) / 4) / sqrt((n * (n + 1.0::DOUBLE) * (2 * n + 1) - 0.5::DOUBLE * tie) / 24))")} END AS p_raw
        FROM grid LEFT JOIN np USING ({pair}) LEFT JOIN ws USING ({pair})),
    hs AS (SELECT *, count(*) OVER (PARTITION BY {family}) - row_number() OVER w + 1 AS mult,
        row_number() OVER w AS pos FROM pr WINDOW w AS (PARTITION BY {family} ORDER BY coalesce(p_raw, 1.0), system_a, system_b)),
    hm AS (SELECT *, CASE WHEN p_raw IS NOT NULL THEN least(1.0::DOUBLE, max(mult * coalesce(p_raw, 1.0)) OVER (PARTITION BY {family} ORDER BY pos)) END AS adj FROM hs),
    {out} AS (SELECT {pair}, n_pairs, W, round(p_raw, 6) AS p_raw, round(adj, 6) AS p_holm, coalesce(adj <= 0.05, FALSE) AS significant_at_05 FROM hm)"""


#: ways.l[s + 1] is the number of subsets of 1 to n with sum s.
_WAYS = """ways AS (SELECT 0 AS n, list_transform(range(326), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS l
    UNION ALL SELECT n + 1, list_transform(range(326), lambda s: l[s + 1] + CASE WHEN s > n THEN l[s - n] ELSE 0.0::DOUBLE END) FROM ways WHERE n < 25)"""
_EXACT = """WHEN n_pairs >= 2 AND tie = 0 AND n = n_pairs THEN (SELECT least(1.0::DOUBLE, 2 * list_sum(l[1:CAST(least(w_plus, w_minus) AS BIGINT) + 1]) / pow(2.0::DOUBLE, n_pairs)) FROM ways WHERE ways.n = n_pairs)"""


def _after(ctes: str, more: str, body: str) -> str:
    return with_ctes(ctes, f"WITH {more}\n{body}")


_PCT = """pct AS (SELECT f.run, f.conv_index, n_frames, label, 100.0::DOUBLE * count(*) FILTER (WHERE f.label2 = label) / n_frames AS pct
    FROM (SELECT f.run, f.conv_index, f.label AS label2, n_frames, l.label FROM (SELECT *, count(*) OVER (PARTITION BY run, conv_index) AS n_frames FROM frames) f
    CROSS JOIN (SELECT unnest(['C', 'NA', 'I', 'BC', 'T']) AS label) l) f GROUP BY f.run, f.conv_index, n_frames, label)"""
_RATES = """sc AS (SELECT *, responder AS scope FROM cls UNION ALL SELECT *, 'pooled' FROM cls),
    r AS (SELECT run, conv_index, scope, count(*) FILTER (WHERE cell = 'false_interruption') AS fi,
    count(*) FILTER (WHERE cell = 'appropriate_restraint') AS ar FROM sc GROUP BY 1, 2, 3),
    rates AS (SELECT c.run, c.conv_index, s.scope, CASE WHEN fi + ar > 0 THEN fi / (fi + ar) END AS score FROM convs c
    CROSS JOIN (SELECT unnest(['tutor', 'student', 'pooled']) AS scope) s
    LEFT JOIN r ON r.run = c.run AND r.conv_index = c.conv_index AND r.scope = s.scope)"""

_DIST = """m AS (SELECT unnest(['fto_s', 'gap_s', 'overlap_s', 'within_pause_s', 'turn_dur_s']) AS metric,
        unnest([-2000, 0, 0, 0, 0]) AS lo, unnest([100, 50, 50, 50, 500]) AS width),
    sy AS (SELECT DISTINCT run AS system FROM samples WHERE run <> 'sys0'),
    v AS (SELECT sy.system, m.metric, c.value_ms, CAST(c.run = 'sys0' AS INT) AS is_ref, least((c.value_ms - lo) // width, 39) AS bin
        FROM sy, m, clipped c WHERE c.metric = m.metric AND c.run IN (sy.system, 'sys0')),
    tot AS (SELECT system, metric, count(*) FILTER (WHERE is_ref = 0) AS ns, count(*) FILTER (WHERE is_ref = 1) AS nr FROM v GROUP BY 1, 2),
    pts AS (SELECT system, metric, value_ms, count(*) FILTER (WHERE is_ref = 0) AS cs, count(*) FILTER (WHERE is_ref = 1) AS cr FROM v GROUP BY 1, 2, 3),
    cdf AS (SELECT p.system, p.metric, lead(value_ms) OVER w - value_ms AS step,
        abs(sum(cs) OVER w / ns - sum(cr) OVER w / nr) AS gap FROM pts p JOIN tot USING (system, metric)
        WINDOW w AS (PARTITION BY p.system, p.metric ORDER BY value_ms)),
    ke AS (SELECT system, metric, max(gap) AS ks, sum(gap * step) / 1000 AS emd FROM cdf GROUP BY 1, 2),
    h AS (SELECT v.system, v.metric, bin, count(*) FILTER (WHERE is_ref = 0) / any_value(ns) AS p, count(*) FILTER (WHERE is_ref = 1) / any_value(nr) AS q
        FROM v JOIN tot USING (system, metric) GROUP BY 1, 2, 3),
    js AS (SELECT system, metric, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2) AS js FROM h GROUP BY 1, 2),
    dist AS (SELECT sy.system, m.metric, coalesce(ns, 0) AS n_system, coalesce(nr, 0) AS n_reference,
        CASE WHEN ns >= 2 AND nr >= 2 THEN round(ks, 6) END AS ks, CASE WHEN ns >= 2 AND nr >= 2 THEN round(emd, 6) END AS emd,
        CASE WHEN ns >= 2 AND nr >= 2 THEN round(js, 6) END AS js
        FROM sy CROSS JOIN m LEFT JOIN tot USING (system, metric) LEFT JOIN ke USING (system, metric) LEFT JOIN js USING (system, metric))"""

_FMT = "CASE WHEN m IS NULL THEN 'n/a' WHEN h IS NULL THEN printf('%.2f', m) ELSE printf('%.2f ± %.2f', m, h) END"

ORACLES = {
    "system_means_ci": with_ctes("scores", _ci("scores", "run, channel, axis", "score", "mean")),
    "fi_summary": _after("cls", _RATES, _ci("rates", "run, scope", "score", "mean_fi_rate")),
    "fi_contrasts": _after("cls", _RATES + ",\n" + _wilcoxon("rates", "scope", "res"), "SELECT * FROM res"),
    "event_rate_contrasts": _after(
        "frames",
        _PCT + ",\nev4 AS (SELECT run, conv_index, label, pct AS score FROM pct WHERE label <> 'C'),\n" + _wilcoxon("ev4", "label", "res"),
        "SELECT * FROM res",
    ),
    "axis_correlations": with_ctes(
        "scores",
        """SELECT a.run, a.axis AS axis_a, b.axis AS axis_b, round(corr(a.score, b.score), 6) AS r
        FROM scores a JOIN scores b USING (run, conv_index) GROUP BY 1, 2, 3""",
    ),
    "role_gap": with_ctes(
        "quality",
        """SELECT run, round(t, 6) AS tutor, round(s, 6) AS student, round(t - s, 6) AS delta_tutor_minus_student FROM (
        SELECT run, avg(score) FILTER (WHERE channel = 'tutor') AS t, avg(score) FILTER (WHERE channel = 'student') AS s
        FROM quality WHERE axis = 'PQ' GROUP BY run)""",
    ),
    "quality_label_outer": with_ctes(
        "paired",
        """SELECT run, conv_index, a.pq, a.ce, CAST(b.pc AS BIGINT) AS pc FROM (SELECT * FROM paired WHERE cu < 5) a
        FULL JOIN (SELECT * FROM paired WHERE pc >= 12) b USING (run, conv_index)""",
    ),
    "system_table": with_ctes(
        "scores",
        f"""WITH ci AS ({_ci("scores", "run, channel, axis", "score", "m").replace("ci_half", "h")}),
        cell AS (SELECT run, axis, {_FMT} AS txt FROM ci)
        SELECT run AS system, coalesce(max(txt) FILTER (WHERE axis = 'PQ'), 'n/a') AS mixed_PQ,
        coalesce(max(txt) FILTER (WHERE axis = 'CE'), 'n/a') AS mixed_CE, 'n/a' AS tutor_PQ FROM cell GROUP BY run""",
    ),
    "label_percentages": _after("frames", _PCT, "SELECT run, conv_index, n_frames, label, round(pct, 6) AS pct FROM pct"),
    "label_shares": _after("frames", _PCT, _ci("pct", "run, label", "pct", "mean_pct")),
    "label_matrix": _after(
        "frames",
        _PCT,
        f"""SELECT run, {", ".join(f"round(avg(pct) FILTER (WHERE label = '{x}'), 6) AS {x}" for x in ("C", "NA", "I", "BC", "T"))} FROM pct GROUP BY run""",
    ),
    "signed_rank_sums": _after(
        "scores",
        _wilcoxon("scores", "channel, axis", "res"),
        "SELECT channel, axis, system_a, system_b, n_pairs, n AS n_nonzero, w_plus, w_minus FROM np LEFT JOIN ws USING (channel, axis, system_a, system_b)",
    ),
    "paired_wilcoxon_exact": _after(
        "paired", f"{_WAYS},\nblk AS (SELECT run, conv_index, conv_index // 25 AS block, pq AS score FROM paired),\n" + _wilcoxon("blk", "block", "res", _EXACT), "SELECT * FROM res"
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "paired_wilcoxon": _after("scores", _wilcoxon("scores", "channel, axis", "res"), "SELECT * FROM res"),
    "pairwise_matrix": _after(
        "scores",
        _wilcoxon("scores", "channel, axis", "res"),
        f"""SELECT channel, axis, system, {", ".join(f"max(p_holm) FILTER (WHERE other = '{r}') AS {r}" for r in RUNS)} FROM (
        SELECT channel, axis, system_a AS system, system_b AS other, p_holm FROM res
        UNION ALL SELECT channel, axis, system_b, system_a, p_holm FROM res) GROUP BY 1, 2, 3""",
    ),
    "ks_emd_js": _after("clipped", _DIST, "SELECT * FROM dist"),
    "ecdf": with_ctes(
        "clipped",
        """SELECT DISTINCT run, metric, value_ms, count(*) OVER (PARTITION BY run, metric, value_ms) AS n,
        round(cume_dist() OVER (PARTITION BY run, metric ORDER BY value_ms), 9) AS ecdf FROM clipped""",
    ),
    "quartiles": with_ctes(
        "scores",
        """SELECT run, channel, axis, count(*) AS n, min(score) AS min, round(quantile_cont(score, 0.25), 6) AS q1,
        round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3, max(score) AS max
        FROM scores GROUP BY run, channel, axis""",
    ),
    "emd_matrix": _after(
        "clipped",
        _DIST,
        """SELECT CASE WHEN system IN ('sys1', 'sys2') THEN 'a' ELSE 'b' END AS student,
        max(emd) FILTER (WHERE system IN ('sys1', 'sys3')) AS x, max(emd) FILTER (WHERE system IN ('sys2', 'sys4')) AS y
        FROM dist WHERE metric = 'fto_s' GROUP BY 1""",
    ),
}
