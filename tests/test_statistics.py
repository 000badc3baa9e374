"""Distribution distances, paired tests, intervals."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from talkmetry.functions import stats
from talkmetry.operators import compare, distance

SAMPLE = "run string, conv_index long, metric string, value_ms long"
SCORE = "run string, conv_index long, channel string, axis string, score double"


def normal(rnd, run, mean, n=400, metric="fto_s"):
    return [(run, i, metric, round(rnd.gauss(mean, 100))) for i in range(n)]


@pytest.fixture(scope="module")
def three(spark):
    rnd = random.Random(0)
    data = normal(rnd, "ref", 200) + normal(rnd, "same", 200) + normal(rnd, "shift", 700)
    return distance.value_counts(spark.createDataFrame(data, SAMPLE))


def test_distances_order_systems(three):
    got = {r.system: r for r in distance.reference_distances(three, "ref", replicates=100).collect() if r.metric == "fto_s"}
    assert got["same"].emd < 0.05 and got["shift"].emd > 0.3
    assert got["same"].ks < got["shift"].ks
    for r in got.values():
        for d in ("ks", "emd", "js"):
            assert 0 <= r[f"{d}_lo"] <= r[f"{d}_hi"]
        assert r.emd_lo - 0.02 <= r.emd <= r.emd_hi + 0.02
        assert 0 <= r.js <= 1


def test_every_metric_has_a_row_and_small_samples_are_null(three):
    got = distance.distances(three, "ref").collect()
    assert len(got) == 10
    assert all(r.ks is None and r.n_system == 0 for r in got if r.metric != "fto_s")


@pytest.mark.parametrize("reference", ["nobody", "only"])
def test_no_reference_or_nothing_else_gives_a_typed_empty_table(spark, reference):
    data = [("only", 0, "fto_s", 1), ("only", 0, "fto_s", 2)]
    df = distance.reference_distances(distance.value_counts(spark.createDataFrame(data, SAMPLE)), reference, replicates=10)
    assert df.count() == 0
    assert df.columns == [
        "system", "metric", "n_system", "n_reference", "ks", "ks_lo", "ks_hi", "emd", "emd_lo", "emd_hi", "js", "js_lo", "js_hi",
    ]


def test_distances_against_numpy(spark):
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(-1500, 1500, 300), rnd.integers(-2500, 2100, 200)
    data = [("s", 0, "fto_s", int(x)) for x in a] + [("r", 0, "fto_s", int(x)) for x in b]
    got = [r for r in distance.distances(distance.value_counts(spark.createDataFrame(data, SAMPLE)), "r").collect() if r.metric == "fto_s"][0]
    a, b = (x[(x >= -2000) & (x <= 2000)] for x in (a, b))
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(x), grid, side="right") / len(x) for x in (a, b))
    assert got.ks == pytest.approx(np.abs(fa - fb).max(), abs=1e-6)
    assert got.emd == pytest.approx((np.abs(fa - fb)[:-1] * np.diff(grid)).sum() / 1000, abs=1e-6)
    p, q = (np.histogram(x, bins=np.linspace(-2000, 2000, 41))[0] / len(x) for x in (a, b))
    m = (p + q) / 2
    kl = lambda x: np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0))
    assert got.js == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2), abs=1e-6)


def test_distance_is_symmetric(spark):
    rnd = random.Random(9)
    data = normal(rnd, "a", 100, 90) + normal(rnd, "b", 300, 70)
    counts = distance.value_counts(spark.createDataFrame(data, SAMPLE))
    one, two = (next(r for r in distance.distances(counts, ref).collect() if r.metric == "fto_s") for ref in ("a", "b"))
    assert (one.ks, one.emd, one.js) == (two.ks, two.emd, two.js)


def test_bootstrap_is_reproducible_and_partition_free(spark, three):
    a = rows(distance.bootstrap_ci(three, "ref", 60, seed=1))
    assert rows(distance.bootstrap_ci(three.repartition(7), "ref", 60, seed=1)) == a
    assert rows(distance.bootstrap_ci(three, "ref", 60, seed=2)) != a


def scores(spark, **runs):
    data = [(run, i, "mixed", "PQ", v) for run, values in runs.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, SCORE)


def brute_exact(d):
    d = [x for x in d if x]
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    w = sum(k + 1 for k, i in enumerate(order) if d[i] > 0)
    n = len(d)
    w = min(w, n * (n + 1) // 2 - w)
    hits = sum(sum(k + 1 for k in range(n) if mask >> k & 1) <= w for mask in range(2**n))
    return w, min(1.0, 2 * hits / 2**n)


def test_exact_p_of_a_small_sample(spark):
    x = [1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30]
    y = [0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29]
    r = compare.paired_wilcoxon(scores(spark, a=x, b=y)).first()
    w, p = brute_exact([a - b for a, b in zip(x, y)])
    assert (r.W, r.n_pairs) == (w, 9) and r.p_raw == pytest.approx(p, abs=1e-6)
    assert (w, round(p, 5)) == (5, 0.03906)  # published value of this sample


def test_normal_approximation_with_ties_and_zeros(spark):
    d = [1, 1, 2, -1, 3, 0, 4, -2, 5, 6, 0, 7]
    r = compare.paired_wilcoxon(scores(spark, a=[float(v) for v in d], b=[0.0] * len(d))).first()
    nz = [v for v in d if v]
    ranks = {}
    for v in sorted({abs(v) for v in nz}):
        below, tied = sum(abs(u) < v for u in nz), sum(abs(u) == v for u in nz)
        ranks[v] = below + (tied + 1) / 2
    w = min(sum(ranks[abs(v)] for v in nz if v > 0), sum(ranks[abs(v)] for v in nz if v < 0))
    n = len(nz)
    tie = sum(t**3 - t for t in (sum(abs(u) == v for u in nz) for v in ranks))
    z = (w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - tie / 2) / 24)
    assert r.n_pairs == 12 and r.W == w
    assert r.p_raw == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)


def test_degenerate_pairs(spark):
    s = scores(spark, a=[1.0, 2.0, 3.0], b=[1.0, 2.0, 3.0], c=[5.0])
    got = {(r.system_a, r.system_b): r for r in compare.paired_wilcoxon(s).collect()}
    assert got["a", "b"].p_raw == 1.0 and got["a", "b"].W is None
    assert got["a", "c"].n_pairs == 1 and got["a", "c"].p_raw is None and got["a", "c"].p_holm is None
    assert not got["a", "c"].significant_at_05


def test_one_run_gives_an_empty_table_with_columns(spark):
    df = compare.paired_wilcoxon(scores(spark, a=[1.0, 2.0]))
    assert df.count() == 0 and {"p_raw", "p_holm", "significant_at_05"} <= set(df.columns)


def test_pairs_without_common_conversations_stay(spark):
    data = [("a", 0, "m", "x", 1.0), ("a", 1, "m", "x", 1.0), ("b", 8, "m", "x", 1.0)]
    r = compare.paired_wilcoxon(spark.createDataFrame(data, SCORE)).first()
    assert (r.n_pairs, r.p_raw) == (0, None)


def test_holm_counts_null_tests(spark):
    tests = spark.createDataFrame(
        [("f", "a", "b", 0.01), ("f", "a", "c", 0.04), ("f", "b", "c", None), ("g", "a", "b", 0.04)],
        "fam string, system_a string, system_b string, p_raw double",
    )
    got = {(r.fam, r.system_a, r.system_b): r.p_holm for r in compare.holm(tests, ["fam"]).collect()}
    assert got["f", "a", "b"] == pytest.approx(0.03) and got["f", "a", "c"] == pytest.approx(0.08)
    assert got["f", "b", "c"] is None and got["g", "a", "b"] == 0.04


def test_holm_is_monotone_and_not_below_raw(spark):
    rnd = random.Random(1)
    tests = spark.createDataFrame([("f", "a", str(i), rnd.random()) for i in range(20)], "fam string, system_a string, system_b string, p_raw double")
    got = sorted((r.p_raw, r.p_holm) for r in compare.holm(tests, ["fam"]).collect())
    assert all(h >= p for p, h in got) and [h for _, h in got] == sorted(h for _, h in got)


def test_t_points(spark):
    known = {1: 12.7062, 2: 4.30265, 9: 2.26216, 10: 2.22814, 30: 2.04227, 120: 1.97993}
    df = spark.createDataFrame([(k,) for k in known], "df long").select("df", stats.t_975(F.col("df")).alias("t"))
    for r in df.collect():
        assert r.t == pytest.approx(known[r.df], abs=2e-5)


def test_normal_tail(spark):
    df = spark.createDataFrame([(z / 10,) for z in range(0, 50)], "z double").select("z", stats.two_sided_normal_p(F.col("z")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), abs=2e-7)


def test_wilson_limits(spark):
    df = spark.createDataFrame([(0.0, 0), (5.5, 10), (10.0, 10)], "k double, n long")
    lo, hi = stats.wilson_95(F.col("k"), F.col("n"))
    got = [(r.lo, r.hi) for r in df.select(lo.alias("lo"), hi.alias("hi")).collect()]
    assert got[0] == (0.0, 1.0)
    assert got[1] == (pytest.approx(0.2744, abs=1e-3), pytest.approx(0.7974, abs=1e-2))
    assert got[2][1] == 1.0


def test_means_ci_small_samples(spark):
    s = scores(spark, a=[1.0], b=[1.0, 3.0])
    got = {r.run: r for r in compare.means_ci(s, ["run"]).collect()}
    assert got["a"].ci_half is None and got["a"]["mean"] == 1.0
    assert got["b"].ci_half == pytest.approx(12.7062, abs=1e-3)


def test_mean_ci_text(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, None), (None, None)], "m double, h double")
    assert [r[0] for r in df.select(compare.format_mean_ci(F.col("m"), F.col("h"))).collect()] == ["1.00 ± 0.50", "1.00", "n/a"]
