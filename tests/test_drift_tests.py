"""Two-sample tests against direct NumPy computations and their mathematical properties."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdrift.functions.ks_exact import lattice_tail_function
from sparkdrift.functions.numeric import chi2_sf, ks_asymptotic_p
from sparkdrift.operators import drift as T
from sparkdrift.operators.distribution import (
    TwoSample,
    exact_quantiles,
    running_counts,
    to_long,
    with_cells,
)


def sample_of(spark, reference, current, name="x"):
    frame = pd.DataFrame(
        {
            name: np.concatenate([np.asarray(reference, float), np.asarray(current, float)]),
            "ref": [True] * len(reference) + [False] * len(current),
        }
    )
    df = spark.createDataFrame(frame)
    return TwoSample.split(df, [name], F.col("ref"))


def numpy_histogram(ref, cur, bins=10):
    lo, hi = min(ref.min(), cur.min()), max(ref.max(), cur.max())
    edges = np.linspace(lo, hi, bins + 1)
    return np.histogram(ref, edges)[0], np.histogram(cur, edges)[0]


def numpy_psi(ref, cur, bins=10):
    r, c = numpy_histogram(ref, cur, bins)
    r, c = np.clip(r / r.sum(), 1e-10, 1), np.clip(c / c.sum(), 1e-10, 1)
    return float(np.sum((c - r) * np.log(c / r)))


def numpy_js(ref, cur, bins=10):
    p, q = (x / x.sum() + 1e-10 for x in numpy_histogram(ref, cur, bins))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float((p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2)


def numpy_cdf_gap(ref, cur):
    values = np.unique(np.concatenate([ref, cur]))
    f = np.searchsorted(np.sort(ref), values, side="right") / len(ref)
    g = np.searchsorted(np.sort(cur), values, side="right") / len(cur)
    gap = np.abs(f - g)
    return float(gap.max()), float((gap[:-1] * np.diff(values)).sum())


@pytest.fixture(scope="module")
def pairs():
    rng = np.random.RandomState(42)
    return {
        "same": (rng.normal(0, 1, 1000), rng.normal(0, 1, 500)),
        "shift": (rng.normal(0, 1, 1000), rng.normal(3, 1, 1000)),
        "wide": (rng.normal(0, 1, 800), rng.normal(0, 3, 800)),
        "negative": (rng.normal(-50, 5, 300), rng.normal(-40, 9, 200)),
        "rounded": (rng.normal(20, 5, 1000).round(1), rng.normal(21, 5, 700).round(1)),
        "tail": (rng.lognormal(0, 2, 500), np.append(rng.lognormal(0, 2, 499), 1e9)),
        "zeros": (np.append(np.zeros(100), rng.exponential(2, 50)), rng.exponential(2, 90) - 1),
    }


@pytest.mark.parametrize(
    "name", ["same", "shift", "wide", "negative", "rounded", "tail", "zeros"]
)
def test_statistics_equal_direct_computation(spark, pairs, name):
    ref, cur = pairs[name]
    sample = sample_of(spark, ref, cur)
    tests = T.histogram_tests(sample.long(), sample.limits()).first()
    assert tests["psi"] == pytest.approx(numpy_psi(ref, cur), abs=1e-9)
    assert tests["js_divergence"] == pytest.approx(numpy_js(ref, cur), abs=1e-9)
    ks, distance = numpy_cdf_gap(ref, cur)
    cdf = T.cdf_tests(sample.counts()).first()
    assert cdf["ks_statistic"] == pytest.approx(ks, abs=1e-12)
    assert cdf["wasserstein"] == pytest.approx(distance, rel=1e-9)


def test_identical_samples_score_zero(spark, pairs):
    ref = pairs["same"][0]
    sample = sample_of(spark, ref, ref)
    assert T.psi(sample).first()["psi"] == 0
    assert T.jensen_shannon(sample).first()["js_divergence"] == 0
    row = T.ks_test(sample).first()
    assert (row["ks_statistic"], row["ks_p_value"]) == (0, 1)
    assert T.wasserstein(sample).first()["wasserstein"] == 0


def test_symmetry_and_bounds(spark, pairs):
    ref, cur = pairs["wide"]
    there, back = sample_of(spark, ref, cur), sample_of(spark, cur, ref)
    a, b = (T.jensen_shannon(s).first()["js_divergence"] for s in (there, back))
    assert a == pytest.approx(b, abs=1e-12) and 0 <= a <= 1
    a, b = (T.wasserstein(s).first()["wasserstein"] for s in (there, back))
    assert a == pytest.approx(b, rel=1e-12)
    assert T.psi(there).first()["psi"] >= 0


def test_shift_is_the_distance(spark):
    values = np.random.RandomState(7).normal(0, 1, 400)
    distance = T.wasserstein(sample_of(spark, values, values + 3)).first()["wasserstein"]
    assert distance == pytest.approx(3, rel=1e-9)


@pytest.mark.parametrize(
    "a, b, expected",
    [(5, 5, (0, 0, 0, 1, 0)), (5, 10, (math.inf, 1, 1, 0, 5))],
)
def test_constants(spark, a, b, expected):
    sample = sample_of(spark, [a] * 20, [b] * 30)
    hist = T.histogram_tests(sample.long(), sample.limits()).first()
    cdf = T.cdf_tests(sample.counts()).first()
    got = (hist["psi"], hist["js_divergence"], cdf["ks_statistic"], cdf["ks_p_value"], cdf["wasserstein"])
    assert got == expected


def test_single_values(spark):
    sample = sample_of(spark, [1.0], [2.0])
    assert T.wasserstein(sample).first()["wasserstein"] == 1
    assert T.psi(sample).first()["psi"] == math.inf


def test_missing_values_are_dropped_and_empty_sides_fail(spark):
    nan = float("nan")
    clean = T.psi(sample_of(spark, [1.0, 2, 3, 4], [1.0, 2, 2, 4])).first()["psi"]
    dirty = T.psi(sample_of(spark, [1.0, nan, 2, 3, 4], [1.0, 2, 2, nan, 4])).first()["psi"]
    assert dirty == clean
    for ref, cur in (([nan, nan], [1.0, 2]), ([1.0, 2], [nan])):
        for test in (T.psi, T.ks_test, T.chi_square_test):
            with pytest.raises(Exception, match="sample is empty"):
                test(sample_of(spark, ref, cur)).collect()


def chi2_by_hand(r, c):
    r, c = np.asarray(r, float), np.asarray(c, float)
    seen = r + c
    expected = np.array([seen * r.sum(), seen * c.sum()]) / seen.sum()
    observed = np.array([r, c])
    if len(r) == 2:
        gap = expected - observed
        observed = observed + np.sign(gap) * np.minimum(0.5, np.abs(gap))
    return float(((observed - expected) ** 2 / expected).sum())


def test_chi_square_categories_bins_and_correction(spark):
    rng = np.random.RandomState(3)
    ref, cur = rng.choice(5, 500, p=[0.4, 0.3, 0.1, 0.1, 0.1]), rng.choice(5, 300)
    row = T.chi_square_test(sample_of(spark, ref, cur)).first()
    assert row["n_cells"] == 5
    counts = [np.bincount(x, minlength=5) for x in (ref, cur)]
    assert row["chi2_statistic"] == pytest.approx(chi2_by_hand(*counts))
    two = T.chi_square_test(sample_of(spark, [0] * 30 + [1] * 20, [0] * 15 + [1] * 40)).first()
    assert two["chi2_statistic"] == pytest.approx(chi2_by_hand([30, 20], [15, 40]))
    one = T.chi_square_test(sample_of(spark, [1] * 5, [1] * 9)).first()
    assert (one["chi2_statistic"], one["chi2_p_value"]) == (0, 1)
    ref, cur = rng.normal(0, 1, 400), rng.normal(0.2, 1, 300)
    binned = T.chi_square_test(sample_of(spark, ref, cur)).first()
    r, c = numpy_histogram(ref, cur)
    keep = (r + c) > 0
    assert binned["n_cells"] == keep.sum()
    assert binned["chi2_statistic"] == pytest.approx(chi2_by_hand(r[keep], c[keep]))


def test_chi_square_tail(spark):
    # Reference points: exact closed forms for 1 and 2 degrees of freedom, table values above.
    rows = [(x, d) for x in (0.1, 1.0, 4.0, 12.0, 60.0) for d in (1, 2)]
    rows += [(3.841458820694124, 1), (18.307038053275146, 10), (16.918977604620448, 9), (7.814727903251179, 3)]
    df = spark.createDataFrame([(float(x), d) for x, d in rows], "x double, d int")
    got = df.select("x", "d", chi2_sf(F.col("x"), F.col("d")).alias("p")).collect()
    for r in got[:10]:
        want = math.erfc(math.sqrt(r["x"] / 2)) if r["d"] == 1 else math.exp(-r["x"] / 2)
        assert r["p"] == pytest.approx(want, rel=1e-10)
    for r in got[10:]:
        assert r["p"] == pytest.approx(0.05, rel=1e-9)


def brute_tail(stat, n, m):
    """Share of all orderings whose CDF gap reaches the statistic, by enumeration."""
    import itertools

    hits = total = 0
    for where in itertools.combinations(range(n + m), n):
        picked = set(where)
        i = j = 0
        worst = 0.0
        for k in range(n + m):
            if k in picked:
                i += 1
            else:
                j += 1
            worst = max(worst, abs(i / n - j / m))
        total += 1
        hits += worst >= stat - 1e-12
    return hits / total


@pytest.mark.parametrize("n, m", [(3, 3), (4, 6), (5, 7), (8, 4)])
def test_exact_ks_tail_equals_enumeration(n, m):
    tail = lattice_tail_function()
    steps = sorted({abs(i / n - j / m) for i in range(n + 1) for j in range(m + 1)} - {0.0})
    for stat in steps:
        assert tail(stat, n, m) == pytest.approx(brute_tail(stat, n, m), abs=1e-12)


def test_asymptotic_ks_tail_is_close_to_exact(spark):
    tail = lattice_tail_function()
    df = spark.createDataFrame(
        [(d, 2000, 2000) for d in (0.01, 0.02, 0.03, 0.04, 0.05, 0.06)], "d double, n bigint, m bigint"
    )
    for r in df.select("d", ks_asymptotic_p("d", "n", "m").alias("p")).collect():
        assert r["p"] == pytest.approx(tail(r["d"], 2000, 2000), abs=0.01)


def test_ks_method_is_the_one_asked_for(spark, pairs):
    ref, cur = pairs["rounded"]
    ref, cur = ref[:40], cur[:30]
    row = T.ks_test(sample_of(spark, ref, cur), p_mode="exact").first()
    want = lattice_tail_function()(row["ks_statistic"], 40, 30)
    assert row["ks_p_value"] == pytest.approx(want, abs=1e-12)
    # The default doesn't change with the number of rows.
    small = T.ks_test(sample_of(spark, ref, cur))
    again = small.select(ks_asymptotic_p("ks_statistic", "40L", "30L").alias("p")).first()["p"]
    assert small.first()["ks_p_value"] == again
    with pytest.raises(ValueError, match="mode"):
        T.ks_test(sample_of(spark, ref, cur), p_mode="auto")


def test_kolmogorov_tail_has_its_published_values(spark):
    # Critical values of the limiting distribution: 1.2238 at 10 %, 1.3581 at 5 %, 1.6276 at 1 %.
    n = 10**12
    rows = [(c / (n / 2) ** 0.5, n, p) for c, p in ((1.2238, 0.10), (1.3581, 0.05), (1.6276, 0.01), (0.8276, 0.5))]
    df = spark.createDataFrame(rows, "d double, n bigint, p double")
    for r in df.select("p", ks_asymptotic_p("d", "n", "n").alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], rel=2e-3)


def test_chi_square_tail_does_not_underflow(spark):
    # Published points: 0.05 at 3.841 (1), 18.307 (10), 124.342 (100); the middle of many degrees is near 1/2.
    rows = [(3.841, 1, 0.05), (18.307, 10, 0.05), (124.342, 100, 0.05), (2000.0, 2000, 0.5), (1999.0, 1999, 0.5)]
    df = spark.createDataFrame(rows, "x double, dof int, p double")
    for r in df.select("p", chi2_sf(F.col("x"), F.col("dof")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], abs=6e-3 if r["p"] == 0.5 else 1e-4)


def test_chi_square_tells_its_form(spark):
    values = [float(i % 25) for i in range(500)]
    sample = sample_of(spark, values, values)
    assert T.chi_square_test(sample).first()["categorical"] is False
    assert T.chi_square_test(sample, category_limit=30).first()["categorical"] is True


def test_cells_follow_the_data(spark):
    for start in (1.7e9, 900.0, -5.0):
        df = spark.range(20_000).select((F.col("id") + start).alias("v"))
        cells = with_cells(to_long(df, ["v"])).groupBy("cell").count().toPandas()
        assert len(cells) > 1_000 and cells["count"].max() < 400


def test_names_with_quotes_and_any_number_of_features(spark):
    names = ["it's", "a`b", "c d", *[f"f{i}" for i in range(70)]]
    rows = [tuple(float(i * j % 7) for j in range(1, len(names) + 1)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, names)
    first = F.col("`f0`") < 3
    found = T.psi(TwoSample.split(df, names, first)).collect()
    assert {r["feature"] for r in found} == set(names)


def test_detect_methods(spark, pairs):
    sample = sample_of(spark, *pairs["shift"])
    for method in T.METHODS:
        row = T.detect(sample, method.upper()).first()
        assert row["method"] == method
        assert row["drift_detected"] == (method != "wasserstein")
    assert T.detect(sample, "wasserstein", threshold=1.0).first()["drift_detected"]
    assert T.detect(sample, "psi").first()["interpretation"].startswith("Significant")
    with pytest.raises(ValueError, match="unknown method"):
        T.detect(sample, "other")


def test_running_counts_and_quantiles_match_numpy(spark):
    rng = np.random.RandomState(11)
    data = {
        "dense": rng.uniform(990, 1030, 700).round(2),
        "mixed": rng.normal(0, 1e-6, 700),
        "spread": rng.choice([-1, 1], 700) * rng.lognormal(0, 8, 700),
        "few": rng.randint(0, 4, 700).astype(float),
    }
    df = spark.createDataFrame(pd.DataFrame(data))
    long = to_long(df, list(data))
    counts = long.groupBy("feature", "value").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")
    )
    running = running_counts(counts).toPandas()
    probs = [0.0, 0.05, 0.1, 0.25, 0.333, 0.5, 0.9, 0.999, 1.0]
    quantiles = {r["feature"]: r["quantiles"] for r in exact_quantiles(long, probs).collect()}
    for name, values in data.items():
        mine = running[running.feature == name].sort_values("value")
        unique, n = np.unique(values, return_counts=True)
        assert (mine["value"].to_numpy() == unique).all()
        assert (mine["cum_cur"].to_numpy() == np.cumsum(n)).all()
        assert (mine["next_value"].to_numpy()[:-1] == unique[1:]).all()
        assert quantiles[name] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_no_shuffle_of_values_for_psi(spark, sf_dir):
    from contract.views import li_sample

    plan = T.psi(li_sample(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(feature" in plan
    assert "value#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert "Python" not in plan
