"""Statistics: intervals, ranks, corrections, box values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.operators import stats


def test_percentile_is_linear(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8)], "x double")
    assert df.select(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))).first()[0] == [pytest.approx(1.075), pytest.approx(7.7)]


def test_bootstrap_weights_are_poisson():
    w = stats.poisson_weights(np.arange(2000), 500)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert (w == stats.poisson_weights(np.arange(2000), 500)).all()


def test_summary_tracks_numpys_bootstrap(spark):
    rng = np.random.default_rng(5)
    values = rng.gamma(2.0, 0.1, 400)
    rows = [("s", i, float(v)) for i, v in enumerate(values)] + [("s", 1000 + i, None) for i in range(7)] + [(None, 1, 0.5), ("e", 2, None)]
    df = spark.createDataFrame(rows, "system string, n int, v double")
    got = {r["system"]: r for r in stats.summarize(df, ["system"], ["v"], F.col("n")).collect()}
    mean, lo, hi = stats.bootstrap_numpy(values)
    r = got["s"]
    assert r["n_pages"] == 407 and r["n_values"] == 400 and r["mean"] == pytest.approx(mean)
    assert abs(r["ci_lo"] - lo) < 0.004 and abs(r["ci_hi"] - hi) < 0.004
    assert got[None]["mean"] == 0.5 and got["e"]["mean"] is None and got["e"]["ci_lo"] is None
    again = stats.summarize(df.repartition(3), ["system"], ["v"], F.col("n")).where("system = 's'").first()
    assert again["ci_lo"] == pytest.approx(r["ci_lo"])


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "system string, n int, v double")
    assert stats.summarize(empty, ["system"], ["v"], F.col("n")).count() == 0
    assert stats.bootstrap_numpy([]) == (None, None, None)


def brute_wilcoxon(d):
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    ranks = [0.0] * len(d)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and abs(d[order[j]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j):
            ranks[order[k]] = (i + 1 + j) / 2
        i = j
    plus = sum(r if x > 0 else r / 2 if x == 0 else 0 for r, x in zip(ranks, d))
    return min(plus, sum(ranks) - plus)


def test_wilcoxon_against_brute_force(spark):
    rng = np.random.default_rng(1)
    d = [round(float(x), 1) for x in rng.normal(0.1, 1.0, 60)] + [0.0, 0.0]
    few = [0.1, 0.2, 0.3, 0.4]
    df = spark.createDataFrame([("a", x) for x in d] + [("few", x) for x in few] + [("b", x) for x in (1.0, 2.0, 3.0, 4.0, -5.0)], "k string, d double")
    got = {r["k"]: r for r in stats.wilcoxon(df, ["k"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["wilcoxon_stat"] == brute_wilcoxon(d) and got["a"]["mean_diff"] == pytest.approx(sum(d) / len(d))
    # exact: subsets of 1..5 with sum at most 5 are 10 of 32
    assert got["b"]["wilcoxon_stat"] == 5 and got["b"]["p_value"] == pytest.approx(2 * 10 / 32)


def test_normal_approximation():
    n, stat = 100, 2000.0
    z = (stat - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert stats.signed_rank_p(n, stat, 0.0, True) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert stats.signed_rank_p(5, 7.5, 120.0 * 100, False) == 1.0


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.011), (2, 0.5)], "o int, p_value double")
    got = [r["p_holm"] for r in stats.holm(df, ["o"]).orderBy("o").collect()]
    assert got == [pytest.approx(0.03), pytest.approx(0.022), pytest.approx(0.5)]
    strict = [r["p_holm"] for r in stats.holm(df, ["o"], strict=True).orderBy("o").collect()]
    assert strict == [pytest.approx(0.03), pytest.approx(0.03), pytest.approx(0.5)]


def test_box(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("a", None)], "k string, v double")
    r = stats.box_stats(df, ["k"], "v").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_lo"], r["whisker_hi"]) == (2, 3, 4, 1, 4)


def test_one_draw_equals_the_reference_loop():
    """All resamples drawn at once are those drawn one after the other."""
    x = np.arange(1, 38) / 7
    rng = np.random.default_rng(stats.SEED)
    means = [rng.choice(x, size=len(x), replace=True).mean() for _ in range(1000)]
    assert stats.bootstrap_numpy(x) == (pytest.approx(x.mean()), pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))


def test_summary_without_keys(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "n int, v double")
    r = stats.summarize(df, [], ["v"], F.col("n")).first()
    assert (r["n_pages"], r["n_values"], r["mean"]) == (3, 2, 3.0)
    assert stats.summarize(df.limit(0), [], ["v"], F.col("n")).count() == 0


def test_summary_with_numpys_draws(spark):
    rows = [("a", i, float(i % 7)) for i in range(50)] + [("b", 1, 2.0), ("b", 2, None), (None, 1, 3.0)]
    df = spark.createDataFrame(rows, "system string, n int, v double")
    got = {r["system"]: r for r in stats.summarize_numpy(df.repartition(3), ["system"], "v", "n").collect()}
    mean, lo, hi = stats.bootstrap_numpy([float(i % 7) for i in range(50)])
    assert (got["a"]["mean"], got["a"]["ci_lo"], got["a"]["ci_hi"], got["a"]["n_values"]) == (mean, lo, hi, 50)
    assert got["b"]["n_values"] == 1 and got["b"]["ci_lo"] == 2.0 and got[None]["mean"] == 3.0
    with pytest.raises(ValueError):
        stats.summarize_numpy(df, ["system"], "v", "n", most=10)
    assert stats.summarize_numpy(df.limit(0), ["system"], "v", "n").count() == 0
