import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.tails import chi2_tail, f_tail
from evenkeel.operators import bootstrap, dispersion, models, quality, resample, windows
from evenkeel.plans.model import MetricSpec

SPEC = [MetricSpec("m", "v", "ok")]


def cells(spark, values):
    return spark.createDataFrame([(i, "c", None if v is None else float(v), v is not None) for i, v in enumerate(values)], "id int, cell string, v double, ok boolean")


@pytest.mark.parametrize("values, expected", [
    ([1, 2, 3], {"std": 1.0}), ([0, 0, 3], {"mean": 1.0, "delta_min_pct": -100.0, "delta_max_pct": 200.0, "range": 3.0}), ([0] * 12 + [1], {"delta_max_pct": 1200.0}),
    ([4], {"std": None, "std_pct": None}), ([None], {"n_metric": 0, "mean": None, "range": None}), ([0, 1, 5, None, 10.5], {"q25": 0.75, "q75": 6.375}),
])
def test_dispersion(spark, values, expected):
    out = dispersion.dispersion(cells(spark, values), ["cell"], SPEC)
    row = out.first()
    for k, v in expected.items():
        assert row[k] == (pytest.approx(v) if v is not None else None)
    assert dispersion.bounds_violations(out).count() == 0


def test_sorted_quantile_equals_percentile(spark):
    df = cells(spark, np.random.default_rng(1).integers(0, 40, 101)).unionByName(cells(spark, [7]).withColumn("cell", F.lit("d")))
    for p in (0.0, 0.25, 0.31, 0.5, 1.0):
        want = {r[0]: r[1] for r in df.groupBy("cell").agg(F.percentile("v", F.lit(p))).collect()}
        assert {r[0]: pytest.approx(r[1], rel=1e-9) for r in dispersion.sorted_quantile(df, ["cell"], "v", p).collect()} == want


def test_a_null_level_is_a_level(spark):
    df = spark.createDataFrame([(None, 1.0, True), (None, 3.0, True), ("b", 5.0, True), ("c", 2.0, False)], "cell string, v double, ok boolean")
    got = {r.cell: (r.n_metric, r.q25, r.q75) for r in dispersion.dispersion(df, ["cell"], SPEC).collect()}
    assert got == {None: (2, 1.5, 2.5), "b": (1, 5.0, 5.0), "c": (0, None, None)}


def test_maxima_of_sums_that_change_from_pass_to_pass(spark):
    """Means may differ in their last bits whenever they are summed again; each maximum has its cell, and ties go to the first."""
    shaken = F.udf(lambda v: None if v is None else v * (1 + random.random() * 1e-13), "double").asNondeterministic()
    rows = [("b", 7.5, 3), ("a", 7.5, 2), ("c", 2.0, 1), ("d", None, 0)]
    cells_ = spark.createDataFrame(rows, "c string, range double, n_metric int").withColumns({"metric": F.lit("m"), "delta_min_pct": -F.col("range")}).repartition(4)
    cells_ = cells_.withColumns({x: shaken(x) for x in ("range", "delta_min_pct")})
    got = {r.statistic: (r.n_estimable, r.n_two_values, r.cell, round(r.value, 6)) for r in dispersion.scope_maxima(cells_, ["c"], ["range", "delta_min_pct"]).collect()}
    assert got == {"range": (3, 2, "1:a", 7.5), "delta_min_pct": (3, 2, "1:a", -7.5)}


def test_intervals_that_are_broken(spark):
    df = spark.createDataFrame([(3, 1.0, 2.0), (3, 2.0, 1.0), (0, None, None), (0, 1.0, None), (2, None, 1.0)], "n_defined long, lower double, upper double")
    assert resample.interval_violations(df).count() == 3
    assert quality.missing_columns(df, ["lower", "x"]) == ["x"]
    quality.require_none(df.limit(0), "rows")
    with pytest.raises(ValueError, match="rows"):
        quality.require_none(df, "rows")


def test_windows(spark):
    df = cells(spark, [1, 2, 3, 4, 5])
    dev = windows.deviations(df, ["cell"], "v", "ok").collect()
    assert sum(r.deviation for r in dev) == pytest.approx(0)
    assert sorted(r.offset for r in windows.offsets(df, ["cell"], ["id"]).collect()) == pytest.approx([-0.18, -0.09, 0, 0.09, 0.18])
    assert sorted((r.period, r.id) for r in windows.halves(df, ["cell"], ["id"]).collect()) == [("early", 0), ("early", 1), ("late", 3), ("late", 4)]


def test_resampling(spark):
    df = cells(spark, range(20))
    sample = resample.balanced_sample(df, ["cell"], "id", 9, 7, 12)
    rows = [(r.replicate, r.id) for r in sample.collect()]
    assert len(rows) == len(set(rows)) == 108
    assert sorted(rows) == sorted((r.replicate, r.id) for r in resample.balanced_sample(df.repartition(5), ["cell"], "id", 9, 7, 12).collect())
    with pytest.raises(Exception, match="too few rows in cell c"):
        resample.balanced_sample(df, ["cell"], "id", 21, 7, 1).collect()
    assert resample.long_enough(df, ["cell"], 21).count() == 0
    subsets = [tuple(sorted(r.ids)) for r in resample.balanced_sample(df.limit(4), ["cell"], "id", 2, 7, 6000).groupBy("replicate").agg(F.collect_list("id").alias("ids")).collect()]
    counts = Counter(subsets)
    assert len(counts) == 6 and all(800 < c < 1200 for c in counts.values())  # each pair of four is as likely
    assert resample.short_cells(df, ["cell"], 21).count() == 1
    assert spark.range(1).select(resample.outside(F.lit(12.93), F.lit(6.73), F.lit(12.82))).first()[0]


def test_tails():
    assert f_tail(4.0, 2, 10) == pytest.approx((1 + 2 * 4 / 10) ** -5)  # closed form for two numerator degrees
    assert chi2_tail(7.0, 2) == pytest.approx(math.exp(-3.5))
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert f_tail(5840.97, 4, 250) == pytest.approx(0, abs=1e-200)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    rows = []
    for a in range(3):
        for b in range(4):
            for c in range(2):
                for _ in range(rng.integers(3, 7)):
                    rows.append((f"a{a}", f"b{b}", f"c{c}", float(np.exp(0.3 * a - 0.2 * b * a + 0.1 * c + rng.normal(0, 0.4 + 0.1 * a))), bool(rng.random() < 0.3 + 0.15 * a)))
    df = spark.createDataFrame(rows, "a string, b string, c string, v double, pos boolean").withColumn("ok", F.lit(True))
    return rows, df


def test_ols_equals_row_level_formulas(spark, fitted):
    rows, df = fitted
    fit = models.ols(models.cell_stats(df, ["a", "b", "c"], "v", "ok"), ["a", "b", "c"])
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["a", "b", "c", "v", "pos"])
    x, y = fit.design.matrix(pdf), np.log(pdf.v.to_numpy())
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    hc3 = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    groups = pdf.groupby(["a", "b", "c"]).ngroup().to_numpy()
    scores = np.stack([(x[groups == g] * e[groups == g, None]).sum(0) for g in range(groups.max() + 1)])
    n, k, G = len(y), x.shape[1], groups.max() + 1
    assert np.allclose(fit.beta, beta, atol=1e-8) and np.allclose(fit.hc3, hc3, atol=1e-8)
    assert np.allclose(fit.cluster, inv @ scores.T @ scores @ inv * G / (G - 1) * (n - 1) / (n - k), atol=1e-8)
    d = fit.diagnostics
    s, ku = (e**3).mean() / (e**2).mean() ** 1.5, (e**4).mean() / (e**2).mean() ** 2
    assert d["jarque_bera"] == pytest.approx(n / 6 * (s**2 + (ku - 3) ** 2 / 4), rel=1e-6)
    e2 = e * e
    r2 = 1 - ((e2 - x @ np.linalg.lstsq(x, e2, rcond=None)[0]) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    assert d["breusch_pagan"] == pytest.approx(n * r2, rel=1e-6)
    assert d["rank"] == k and {t[0] for t in models.term_tests(fit, "type2_cluster")} == {"a", "b", "c", "a:b", "a:c", "b:c"}
    assert all(t[3] == G - 1 for t in models.term_tests(fit, "type2_cluster"))
    assert sum(x for _, x in models.anova_shares(fit)) == pytest.approx(100)


def test_empty_cells_are_aliased(spark, fitted):
    _, df = fitted
    cells_ = models.cell_stats(df.filter("NOT (a = 'a0' AND b = 'b0')"), ["a", "b"], "v", "ok")
    fit = models.ols(cells_, ["a", "b"])
    assert fit.diagnostics["deficiency"] == 1 and len(fit.design.columns(("a", "b"))) == 5


def test_logistic_against_spark_ml(spark, fitted):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    _, df = fitted
    designs, fits = models.outcome_models(models.outcome_cells(df, ["a", "b"], "pos"), ["a", "b"])
    lr = {t: (x, k) for t, x, k, _ in models.likelihood_ratio(fits)}
    dummies = [F.when(F.col(f) == v, 1.0).otherwise(0.0).alias(f"{f}{v}") for f, vs in (("a", ["a1", "a2"]), ("b", ["b1", "b2", "b3"])) for v in vs]
    data = df.select(F.col("pos").cast("double").alias("label"), *dummies)

    def deviance(columns):
        vec = VectorAssembler(inputCols=columns, outputCol="features").transform(data)
        return GeneralizedLinearRegression(family="binomial", maxIter=50).fit(vec).summary.deviance

    full = -2 * fits["a:b"]["loglik"]
    names = [c for c in data.columns if c != "label"]
    assert deviance(names) == pytest.approx(full, rel=1e-6)
    assert lr["a:b"][1] == 6 and lr["a"][1] == 8
    assert 0.5 < models.auc(models.outcome_cells(df, ["a", "b"], "pos"), designs["full"], fits["full"]["beta"]) <= 1


def test_reml_equals_balanced_anova(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(0, 1, (12, 1)) + rng.normal(0, 0.4, (12, 8))
    msb, msw = 8 * y.mean(1).var(ddof=1), y.var(axis=1, ddof=1).mean()
    means = y.mean(1)
    (between,), (within,) = models.reml(*(np.array([[x]]) for x in (8.0, 12.0, means.sum(), (means**2).sum())), np.array([(8 * y.var(axis=1)).sum()]))
    assert within == pytest.approx(msw, rel=1e-5) and between == pytest.approx((msb - msw) / 8, rel=1e-5)
    stats = spark.createDataFrame([("k", f"g{i}", 8, float(r.mean()), float(8 * r.var())) for i, r in enumerate(y)], "key string, g string, n long, mean double, m2 double")
    fits = models.icc_reml(stats, ["key"], 30, 1)
    row = models.icc_intervals(fits, ["key"]).first()
    assert 0 <= row.lower <= row.icc <= row.upper <= 1 and row.n_failed == 0 and row.converged
    assert models.require_converged(models.icc_intervals(fits, ["key"])).count() == 1
    failed = models.icc_intervals(fits.withColumn("icc", F.when(F.col("replicate") < 10, F.col("icc")).otherwise(float("nan"))), ["key"])
    with pytest.raises(Exception, match="too few replicates"):
        models.require_converged(failed).collect()


def test_targeted_terms(spark, fitted):
    _, df = fitted
    term = ("a", "b", "c")
    stats = models.cell_stats(df, list("abc"), "v", "ok")
    row = models.targeted_performance(stats, list("abc"), [term])[0]
    fit = models.ols(stats, list("abc"), [term])
    want = {r[0]: r for r in models.term_tests(fit, "type2_hc3")}["a:b:c"]
    assert row == ("a:b:c", want[4], 6, want[3], want[5], 6, 6, "reported")
    gaps = models.targeted_performance(stats.filter("NOT (a = 'a0' AND b = 'b0')"), list("abc"), [term])[0]
    assert gaps[5] == 6 and gaps[6] < 6 and gaps[7] == "reported on observed support"
    counts = models.outcome_cells(df, list("abc"), "pos")
    name, x, k, p, columns, added, status = models.targeted_outcome(counts, list("abc"), [term])[0]
    lr = {t: (s, d) for t, s, d, _ in models.likelihood_ratio(models.outcome_models(counts, list("abc"), [term])[1])}
    assert (name, k, columns, added, status) == ("a:b:c", 6, 6, 6, "reported") and (pytest.approx(x, rel=1e-6), k) == lr["a:b:c"]
    holes = models.targeted_outcome(counts.filter("NOT (a = 'a0' AND b = 'b0')"), list("abc"), [term])[0]
    assert holes[-1] == "not estimable" and math.isnan(holes[1])
    both = models.terms_side_by_side(spark.createDataFrame([("a", 1.0, 2, 0.5)], "term string, statistic double, df long, p double"), spark.createDataFrame([("m", "a", 3.0, 2, 9.0, 0.1, 0.2)], "metric string, term string, f double, df long, denominator_df double, p double, partial_eta2 double"), ["m"])
    assert both.first().m_f == 3.0 and both.first().outcome_statistic == 1.0


def test_tables_written_in_a_block_go_with_it(spark):
    from pathlib import Path

    from evenkeel.functions.storage import kept, materialize, scratch, shared_folder

    left = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("evenkeel-*")}
    before = left()
    with scratch(spark):
        lost = materialize(spark.range(3))
        out = kept(lost.selectExpr("id + 1 AS id"))
    assert len(left() - before) == 1 and out.count() == 3


@pytest.mark.parametrize("points", [[0.0, 0.25, 0.5, 1.0]])
def test_quantiles_of_many_cells(spark, points):
    from evenkeel.functions.ranks import quantiles

    rng = np.random.default_rng(4)
    rows = [(f"k{rng.integers(0, 3)}", float(rng.integers(0, 40))) for _ in range(700)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: [r.a, r.b, r.c, r.d] for r in quantiles(df, ["k"], "v", points, list("abcd")).collect()}
    assert got == {k: pytest.approx(list(np.quantile([v for x, v in rows if x == k], points))) for k in ("k0", "k1", "k2", "one")}
