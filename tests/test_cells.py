"""Cells with missing levels, exact selection, resampling by ranges, and fits from factors and sums."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.cells import cell_label, join_cells
from evenkeel.functions.selection import in_sets, quantiles_of_columns, quantiles_of_groups
from evenkeel.operators import bootstrap, dispersion, factors, models, resample, windows
from evenkeel.plans import oracle
from evenkeel.plans.model import MetricSpec

CFG = ["a", "b"]
SPEC = [MetricSpec("m", "v", "ok")]
LEVELS = [("x", "y"), ("x", None), (None, "y"), (None, None), ("x|y", None), ("x", "y|-")]


@pytest.fixture(scope="module")
def runs(spark):
    """12 runs of each cell, in three batches, one of them without a name."""
    rows = [(a, b, 100 * c + i, (None, "p", "q")[i // 4], float(1 + (7 * i + 3 * c) % 11), i % 5 != 0, i % 3 == 0) for c, (a, b) in enumerate(LEVELS) for i in range(12)]
    return spark.createDataFrame(rows, "a string, b string, id long, batch string, v double, ok boolean, positive boolean")


def cells_of(df):
    return {(r.a, r.b) for r in df.select(*CFG).distinct().collect()}


OPERATORS = {
    "deviations": lambda df: windows.deviations(df, CFG, "v", "ok"),
    "offsets": lambda df: windows.offsets(df, CFG, ["id"]),
    "halves": lambda df: windows.halves(df, CFG, ["id"]),
    "end_batches": lambda df: windows.end_batches(df, CFG, "batch", ["id"]),
    "period_contrast": lambda df: windows.period_contrast(windows.halves(df, CFG, ["id"]), CFG, {"m": ("v", "ok")}),
    "balanced_sample": lambda df: resample.balanced_sample(df, CFG, "id", 9, 7, 2),
    "config_sensitivity": lambda df: resample.config_sensitivity(resample.balanced_sample(df, CFG, "id", 9, 7, 2), dispersion.dispersion(df, CFG, SPEC), CFG, SPEC, ["mean"]),
    "denominators": lambda df: resample.denominators(resample.balanced_sample(df, CFG, "id", 9, 7, 2), df, CFG, ["ok"]),
    "bootstrap": lambda df: bootstrap.bootstrap(df, CFG, "id", SPEC, 3, 2),
    "dispersion": lambda df: dispersion.dispersion(df, CFG, SPEC),
    "legacy_aggregate": lambda df: dispersion.legacy_aggregate(df, CFG, {"m": "v"}, "v"),
    "long_enough": lambda df: resample.long_enough(df, CFG, 12),
    "one_to_one": lambda df: factors.one_to_one(df.select(*CFG).distinct(), df.groupBy(*CFG).agg(F.sum("v").alias("s")), CFG).filter("s IS NOT NULL"),
    "medians_by": lambda df: factors.medians_by(df, CFG, ["v"]).filter("median_v IS NOT NULL"),
    "icc_reml": lambda df: models.icc_reml(models.cell_stats(df, [*CFG, "batch"], "v", "ok"), CFG, 2).filter("replicate = 0"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_cell_with_a_missing_level_is_lost(runs, name):
    assert cells_of(OPERATORS[name](runs)) == set(LEVELS)


def test_counts_with_missing_levels(runs):
    count = {n: OPERATORS[n](runs).count() for n in ("deviations", "offsets", "halves", "end_batches", "balanced_sample", "bootstrap")}
    assert count == {"deviations": runs.filter("ok").count(), "offsets": 72, "halves": 72, "end_batches": 48, "balanced_sample": 9 * 2 * 6, "bootstrap": 12}
    grid = factors.factor_grid(runs, CFG, "ok")
    assert {(r.a, r.b): r.n for r in grid.collect() if r.n} == {c: 9 for c in LEVELS} and grid.count() == 3 * 3
    assert factors.cells_without(runs, CFG, "ok").count() == 0
    labels = [r[0] for r in runs.select(*CFG).distinct().select(cell_label(CFG)).collect()]
    assert len(set(labels)) == 6
    assert join_cells(runs, runs.select("a").distinct(), ["a"]).count() == 72
    assert runs.filter("false").transform(lambda d: windows.offsets(d, CFG, ["id"])).count() == 0


def test_models_with_a_missing_level(spark):
    """A missing level is one more level: the fit is that of the same table with a name in its place."""
    rng = np.random.default_rng(3)
    rows = [(a, b, float(np.exp(rng.normal()))) for a in ("p", None, "q") for b in ("u", "w", None) for _ in range(5)]
    named = [(a or "-", b or "-", v) for a, b, v in rows]
    fits = [models.term_tests(models.ols(models.cell_stats(spark.createDataFrame(r, "a string, b string, v double").withColumn("ok", F.lit(True)), CFG, "v", "ok"), CFG), "type2_hc3") for r in (rows, named)]
    assert [t[4] for t in fits[0]] == pytest.approx([t[4] for t in fits[1]], rel=1e-9)


@pytest.mark.parametrize("small, bins", [(5000, 8), (20, 8), (200, 64)])
def test_quantiles_of_groups(spark, small, bins):
    rng = np.random.default_rng(4)
    odd = [float("inf"), float("-inf"), -1e308, 1e308, 0.5, None, float("nan")]
    values = {"skewed": rng.lognormal(0, 5, 2000).tolist(), None: rng.integers(0, 4, 2000).astype(float).tolist(), "odd": [odd[i] for i in rng.integers(0, 7, 2000)], "same": [5.0] * 500, "one": [2.0], "none": [None]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    points = {"low": 0.01, "middle": 0.5, "high": 0.975}
    got = {r.g: r for r in quantiles_of_groups(df, ["g"], "v", points, small, bins).collect()}
    assert set(got) == set(values) - {"none"}
    for g in got:
        x = np.sort([v for v in values[g] if v is not None and v == v])
        for name, p in points.items():
            h = (len(x) - 1) * p
            a, b, share = x[int(np.floor(h))], x[int(np.ceil(h))], h - np.floor(h)
            assert got[g][name] == (a if a == b else pytest.approx((1 - share) * a + share * b, rel=1e-12))


def test_quantiles_of_sets_and_columns(runs):
    rows = in_sets(runs, [["a"], []], ["v"])
    got = {(r["__set"], r.a): r.v_m for r in quantiles_of_columns(rows, ["__set", "a"], ["v"], {"m": 0.5}).collect()}
    all_ = [(r.a, r.v) for r in runs.collect()]
    want = {(0, a): np.median([v for x, v in all_ if x == a]) for a in {x for x, _ in all_}} | {(1, None): np.median([v for _, v in all_])}
    assert got == want


@pytest.mark.parametrize("size", [4096, 64])
def test_bootstrap_by_ranges(spark, size):
    """Every resample as its draws are stated, for cells of one range and of many."""
    rng = np.random.default_rng(6)
    values = {"x": rng.normal(50, 9, 300).tolist(), None: rng.integers(1, 9, 130).astype(float).tolist(), "two": [1.0, 2.0], "same": [3.0] * 5, "one": [4.0]}
    rows = [(c, i, v) for c, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "c string, id long, v double").withColumn("ok", F.lit(True))
    got = {(r.c, r.replicate): r for r in bootstrap.bootstrap(df, ["c"], "id", SPEC, 5, 40, size).collect()}
    assert len(got) == 40 * len(values)
    for c, vs in values.items():
        w, label = np.sort(vs), f"{'-' if c is None else f'{len(c)}:{c}'}|1:m"
        blocks = [w[k : k + size] for k in range(0, len(w), size)]
        counts = [bootstrap.dealt(5, label, len(w), k, size, 40) for k in range(len(blocks))]
        assert (sum(counts) == len(w)).all()
        for r in (1, 17, 40):
            own = [n[r - 1] for n in counts]
            drawn = np.concatenate([b[bootstrap.places(5, label, k, np.full(n, r), np.arange(n), len(b))] for k, (b, n) in enumerate(zip(blocks, own))])
            if len(w) < 2:
                assert got[c, r].std_pct is None and got[c, r].iqr_pct is None
            else:
                q = np.percentile(drawn, [25, 75])
                assert (got[c, r].iqr_pct, got[c, r].std_pct) == (pytest.approx(100 * (q[1] - q[0]) / drawn.mean()), pytest.approx(100 * drawn.std(ddof=1) / drawn.mean(), abs=1e-6))


@pytest.mark.parametrize("size", [262144, 64])
def test_bootstrap_equals_sql_by_ranges(spark, size):
    """SQL states the same draws, for cells of one range and of many."""
    rng = np.random.default_rng(8)
    cells_ = {"x": rng.integers(1, 40, 300) / 10, None: rng.integers(1, 9, 130) / 10, "z": [1.5], "even": rng.integers(1, 90, 128) / 10}
    rows = [(c, 1000 * i + k, float(v)) for i, (c, vs) in enumerate(cells_.items()) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "c string, run_id long, tps double").withColumn("ok", F.lit(True))
    got = {(r.c, r.replicate): (r.iqr_pct, r.std_pct) for r in bootstrap.bootstrap(df, ["c"], "run_id", [MetricSpec("tps", "tps", "ok")], 20260831, 100, size).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE u (c VARCHAR, run_id BIGINT, tps DOUBLE, tps_point_valid BOOLEAN)")
    con.executemany("INSERT INTO u VALUES (?, ?, ?, true)", rows)
    want = con.execute(f"WITH {oracle._boot_by_ranges('c', 'u', ('tps',), size)} SELECT c, replicate, iqr_pct, std_pct FROM boot").fetchall()
    assert len(want) == len(got) == 400
    for c, replicate, *stats in want:
        assert got[c, replicate] == tuple(None if x is None else pytest.approx(x, rel=1e-9, abs=1e-6) for x in stats)


def test_one_range_up_to_its_size(spark):
    """A cell of more than 4,096 values, but not of more than a range, draws among all of them."""
    v = np.arange(1.0, 6001.0)
    df = spark.range(1, 6001).select(F.lit("x").alias("c"), "id", F.col("id").cast("double").alias("v"), F.lit(True).alias("ok"))
    got = {r.replicate: r.std_pct for r in bootstrap.bootstrap(df, ["c"], "id", SPEC, 5, 3).collect()}
    for r in (1, 2, 3):
        drawn = v[bootstrap.places(5, "1:x|1:m", 0, np.full(6000, r), np.arange(6000), 6000)]
        assert got[r] == pytest.approx(100 * drawn.std(ddof=1) / drawn.mean())


def test_draws_are_fair():
    """Ranges get draws by their size, and places are as likely as each other."""
    counts = np.array([bootstrap.dealt(1, "cell", 1000, k, 300, 4000) for k in range(4)])
    assert counts.mean(1) == pytest.approx([300, 300, 300, 100], rel=0.01)
    assert counts.var(1) == pytest.approx([210, 210, 210, 90], rel=0.1)
    hits = np.bincount(np.concatenate([bootstrap.places(1, "cell", 0, np.full(50, r), np.arange(50), 7) for r in range(2000)]), minlength=7)
    assert hits == pytest.approx(np.full(7, 100_000 / 7), rel=0.03)


def test_tall_qr_keeps_what_products_lose(spark):
    """Two columns that differ by 1e-9: their matrix of products is singular in doubles, their triangular factor isn't."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 1))
    a = np.hstack([np.ones((400, 1)), x, x + 1e-9 * rng.normal(size=(400, 1)), 2 * x - 1])
    df = spark.createDataFrame([(r.tolist(),) for r in a], "r array<double>").repartition(20)
    r = models.tall_qr(df, lambda b: np.vstack(b.r.to_list()), 4)
    assert np.abs(r.T @ r - a.T @ a).max() < 1e-9
    assert np.linalg.cond(a[:, :3]) > 1e9 and np.linalg.matrix_rank(a[:, :3].T @ a[:, :3]) == 2
    kept = models.estimable(r, [[1], [2], [3]])
    assert kept == [0, 1, 2]
    assert models.rank_report(r[:, :3], 3)["rank"] == 3


def test_reml_from_sums(spark):
    """Cells of many sizes: the sums give what a search over the cells themselves gives, and resamples of blocks are resamples of cells."""
    rng = np.random.default_rng(8)
    n = rng.integers(1, 9, 150)
    y = [rng.normal(10 + rng.normal(0, 2), 1, k) for k in n]
    stats = [("k", None if i == 5 else f"g{i}", int(k), float(v.mean()), float(((v - v.mean()) ** 2).sum())) for i, (k, v) in enumerate(zip(n, y))]
    df = spark.createDataFrame(stats, "key string, g string, n long, mean double, m2 double")

    def loglik(ratio):
        w, mean, inner = n / (1 + n * ratio), np.array([s[3] for s in stats]), sum(s[4] for s in stats)
        mu = (w * mean).sum() / w.sum()
        within = (inner + (w * (mean - mu) ** 2).sum()) / (n.sum() - 1)
        return 0.5 * ((n.sum() - 1) * np.log(within) + np.log1p(n * ratio).sum() + np.log(w.sum())), within

    grid = np.linspace(0.01, 30, 300_000)
    best = min(grid, key=lambda r: loglik(r)[0])
    fits = {r.replicate: r for r in models.icc_reml(df, ["key"], 200, 1).collect()}
    assert fits[0].n_cells == 150 and fits[0].within == pytest.approx(loglik(best)[1], rel=1e-5) and fits[0].between == pytest.approx(best * loglik(best)[1], rel=1e-3)
    draws = np.array([fits[r].icc for r in range(1, 201)])
    assert all(fits[r].n_cells == 150 for r in range(1, 201)) and 0 < draws.std() < 0.1 and abs(draws.mean() - fits[0].icc) < 0.05


def test_legacy_shares(spark):
    """Type II sums of squares by fits with and without each term, row by row."""
    rng = np.random.default_rng(9)
    rows = [(a, b, c, d, float(len(a) + 2 * len(b) + (a == b) + rng.normal())) for a in ("x", "yy", "z") for b in ("x", "vv") for c in ("s", "tt") for d in ("m", "n") for _ in range(rng.integers(1, 5))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, v double").withColumn("ok", F.lit(True))
    got = dict(models.legacy_shares(models.cell_stats(df, list("abcd"), "v", "ok", log=False), "a", ["b", "c"], ["d"]))
    y, code = np.array([r[4] for r in rows]), {}
    for i, f in enumerate("abcd"):
        levels = sorted({r[i] for r in rows})
        code[f] = np.array([[r[i] == x for x in levels[1:]] for r in rows], float)

    def rss(terms):
        x = [np.ones((len(rows), 1))]
        for t in terms:
            block = code[t[0]]
            for f in t[1:]:
                block = (block[:, :, None] * code[f][:, None, :]).reshape(len(rows), -1)
            x.append(block)
        return ((y - np.hstack(x) @ np.linalg.lstsq(np.hstack(x), y, rcond=None)[0]) ** 2).sum()

    terms = ["a", "b", "c", "d", "ab", "ac"]
    sums = {":".join(t): rss([u for u in terms if not set(t) < set(u) and u != t]) - rss([u for u in terms if not set(t) < set(u)]) for t in terms} | {"residual": rss(terms)}
    total = sum(sums.values())
    assert got == {t: pytest.approx(x / total, rel=1e-8, abs=1e-12) for t, x in sums.items()}
