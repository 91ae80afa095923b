"""Two-part factorial models from cell statistics: runs are aggregated once by cell, cells become triangular factors and
partial sums in the executors, and only k by k matrices reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from evenkeel.functions.cells import cell_key, cell_label, join_cells
from evenkeel.functions.ranks import gapless_rank
from evenkeel.functions.storage import materialize
from evenkeel.functions.tails import chi2_tail, f_tail
from evenkeel.operators import bootstrap as B
from evenkeel.operators.dispersion import long_form
from evenkeel.plans.model import MetricSpec

Term = tuple[str, ...]


def cell_stats(df: DataFrame, cfg: Sequence[str], value: str, eligible: str, log: bool = True) -> DataFrame:
    """n, mean and the central sums M2, M3, M4 of the (log) value in each cell with a value that counts. Values without a
    logarithm are left out and counted as n_dropped."""
    v = F.when(F.col(eligible), F.col(value))
    y = F.when(v > 0, F.ln(v)) if log else v
    out = df.groupBy(*cfg).agg(F.count(y).alias("n"), (F.count(v) - F.count(y)).alias("n_dropped"), F.avg(y).alias("mean"), F.var_pop(y).alias("var"), F.skewness(y).alias("skew"), F.kurtosis(y).alias("kurt"))
    zero = lambda c: F.when(F.col("var") > 0, F.nanvl(c, F.lit(0.0))).otherwise(0.0)
    n, var = F.col("n"), F.col("var")
    return out.filter("n > 0").select(*cfg, "n", "n_dropped", "mean", (n * var).alias("m2"), (n * zero(F.col("skew")) * F.pow(var, 1.5)).alias("m3"), (n * (zero(F.col("kurt")) + F.when(var > 0, 3.0).otherwise(0.0)) * var * var).alias("m4"))


def cell_stats_by_metric(df: DataFrame, cfg: Sequence[str], metrics: Sequence[MetricSpec], log: bool = True) -> DataFrame:
    """cell_stats of all metrics from one pass over the runs. Fits read their cells several times: write this table once before."""
    rows = long_form(df, cfg, metrics).filter("v IS NOT NULL").withColumn("counts", F.lit(True))
    return cell_stats(rows, [*cfg, "metric"], "v", "counts", log)


def outcome_cells(df: DataFrame, cfg: Sequence[str], flag: str) -> DataFrame:
    return df.groupBy(*cfg).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("s"))


@dataclass
class Design:
    """A sum-to-zero design of factors and interactions over the levels that the cells have."""

    levels: dict[str, list[str]]
    terms: list[Term]
    keep: np.ndarray | None = None  # columns of an estimable basis
    spans: dict[Term, list[int]] = field(init=False)

    def __post_init__(self) -> None:
        at, self.spans = 1, {}
        for t in self.terms:
            n = int(np.prod([len(self.levels[f]) - 1 for f in t]))
            self.spans[t] = list(range(at, at + n))
            at += n
        self.width = at

    def matrix(self, cells: pd.DataFrame) -> np.ndarray:
        coded = {}
        for f, levels in self.levels.items():
            code, place = np.vstack([np.eye(len(levels) - 1), -np.ones(len(levels) - 1)]), {x: i for i, x in enumerate(levels)}
            coded[f] = code[[place[None if x is None or x != x else x] for x in cells[f]]]  # pandas may hold a missing level as NaN
        blocks = [np.ones((len(cells), 1))]
        for t in self.terms:
            b = coded[t[0]]
            for f in t[1:]:
                b = (b[:, :, None] * coded[f][:, None, :]).reshape(len(cells), -1)
            blocks.append(b)
        x = np.hstack(blocks)
        return x if self.keep is None else x[:, self.keep]

    def columns(self, t: Term) -> list[int]:
        """Where the term's kept columns are in the matrix."""
        own = set(self.spans[t])
        kept = range(self.width) if self.keep is None else self.keep
        return [i for i, c in enumerate(kept) if c in own]


def two_way(cells: DataFrame, factors: Sequence[str], extra: Sequence[Term] = ()) -> Design:
    """All main effects and two-way interactions."""
    return design_of(cells, [(f,) for f in factors] + list(combinations(factors, 2)) + list(extra))


def design_of(cells: DataFrame, terms: Sequence[Term]) -> Design:
    """The design of these terms. Only the levels of each factor are collected; a missing level is the first."""
    factors = dict.fromkeys(f for t in terms for f in t)
    levels = {f: sorted((r[0] for r in cells.select(f).distinct().collect()), key=lambda x: (x is not None, x)) for f in factors}
    return Design(levels, list(terms))


def summed(cells: DataFrame, parts: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of parts(batch), a flat array, over all batches of cells: partial sums by task, one aggregate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                p = parts(b)
                total = p if total is None else total + p
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "x": total})

    rows = cells.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["x"]
    return out


#: Triangular factors that one task merges into one.
MERGED = 8


def triangular(a: np.ndarray) -> np.ndarray:
    """The triangular factor of a, with as many rows as columns."""
    r = np.linalg.qr(a, mode="r")
    return np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))]) if len(r) < a.shape[1] else r


def tall_qr(cells: DataFrame, rows: Callable[[pd.DataFrame], np.ndarray], width: int) -> np.ndarray:
    """The triangular factor of all rows(batch) below each other: one for each task, then merged by MERGED in a tree.

    Unlike a matrix of products it keeps the condition number of the rows, not its square.
    """

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for b in batches:
            if len(b):
                a = rows(b)
                r = triangular(a if r is None else np.vstack([r, a]))
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for b in batches:
            for flat in b.r:
                own = np.asarray(flat, float).reshape(width, width)
                r = own if r is None else triangular(np.vstack([r, own]))
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel()]})

    parts, n = cells.mapInPandas(of_task, "r array<double>"), cells.rdd.getNumPartitions()
    while n > MERGED:
        n = -(-n // MERGED)
        parts = materialize(parts).repartition(n).mapInPandas(merge, "r array<double>")
    r = np.zeros((width, width))
    for row in parts.collect():  # MERGED at most
        r = triangular(np.vstack([r, np.array(row["r"]).reshape(width, width)]))
    return r


@dataclass
class Factored:
    """What a least-squares fit needs of the runs: the triangular factor of [design, value], and their totals."""

    r: np.ndarray  # of the design
    qy: np.ndarray
    totals: dict[str, float]


def factor(cells: DataFrame, design: Design) -> Factored:
    """From cells with n, mean and m2; a cell is one row that weighs as much as its runs."""

    def rows(b: pd.DataFrame) -> np.ndarray:
        return np.hstack([design.matrix(b), b["mean"].to_numpy(float)[:, None]]) * np.sqrt(b.n.to_numpy(float))[:, None]

    r = tall_qr(cells, rows, design.width + 1)
    mean = F.col("mean")
    s = cells.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("G"), F.sum(F.col("n") * mean).alias("sy"), (F.sum(F.col("n") * mean * mean) + F.sum("m2")).alias("syy"), F.sum("m2").alias("inner")).first()
    return Factored(r[:-1, :-1], r[:-1, -1], {k: float(s[k] or 0) for k in ("N", "G", "sy", "syy", "inner")})


def counted(cells: DataFrame) -> DataFrame:
    """Outcome cells as cells of a design without a value."""
    return cells.withColumns({"mean": F.lit(0.0), "m2": F.lit(0.0)})


def estimable(r: np.ndarray, terms: Sequence[Sequence[int]], tolerance: float = 1e-11) -> list[int]:
    """Columns of a basis of a triangular factor: the first, then the terms (columns of each) in order, and in a term the column
    with the largest share outside the basis first. Columns that are in it but for ``tolerance`` of their length are left out."""
    norm = np.maximum(np.linalg.norm(r, axis=0), 1e-300)
    left = r / norm
    kept = [0]

    def take(c: int) -> None:
        for _ in range(2):  # once more against rounding
            q = left[:, c] / np.linalg.norm(left[:, c])
            rest = [x for x in range(r.shape[1]) if x not in kept]
            left[:, rest] -= np.outer(q, q @ left[:, rest])

    take(0)
    for columns in terms:
        todo = list(columns)
        while todo:
            size = np.linalg.norm(left[:, todo], axis=0)
            best = int(np.argmax(size))
            if size[best] <= tolerance:
                break
            kept.append(todo.pop(best))
            take(kept[-1])
    return sorted(kept)


def basis(r: np.ndarray, design: Design) -> list[int]:
    return estimable(r, [design.spans[t] for t in design.terms])


def rank_report(r: np.ndarray, columns: int) -> dict[str, float]:
    values = np.linalg.svd(r / np.maximum(np.linalg.norm(r, axis=0), 1e-300), compute_uv=False)
    good = values[values > 1e-11 * values.max()]
    return {"columns": columns, "rank": len(good), "deficiency": columns - len(good), "condition": float(good.max() / good.min())}


@dataclass
class Fit:
    design: Design
    beta: np.ndarray
    inverse: np.ndarray
    N: float
    G: float
    sse: float
    sst: float
    hc3: np.ndarray
    cluster: np.ndarray
    diagnostics: dict[str, float]


def ols(cells: DataFrame, factors: Sequence[str], extra: Sequence[Term] = (), terms: Sequence[Term] | None = None) -> Fit:
    """Least squares on an estimable basis, with HC3 and cell-cluster covariances and residual diagnostics; two passes over the
    cells. The terms are all mains and pairs and the extra ones, or those given."""
    design = two_way(cells, factors, extra) if terms is None else design_of(cells, terms)
    whole = factor(cells, design)
    s, report = whole.totals, rank_report(whole.r, design.width)
    design.keep = np.array(basis(whole.r, design))
    k = len(design.keep)
    q, r = np.linalg.qr(whole.r[:, design.keep])
    half = np.linalg.inv(r)
    inverse, beta = half @ half.T, half @ (q.T @ whole.qy)

    def parts(b: pd.DataFrame) -> np.ndarray:
        x, n, y = design.matrix(b), b.n.to_numpy(float), b["mean"].to_numpy()
        d = y - x @ beta
        h = np.einsum("ij,jk,ik->i", x, inverse, x)
        e2 = b.m2.to_numpy() + n * d * d
        e3 = b.m3.to_numpy() + 3 * d * b.m2.to_numpy() + n * d**3
        e4 = b.m4.to_numpy() + 4 * d * b.m3.to_numpy() + 6 * d * d * b.m2.to_numpy() + n * d**4
        ok = 1 - h > 1e-9  # a cell of leverage 1 has no HC3 weight; it is counted instead
        w = np.where(ok, e2 / np.where(ok, (1 - h) ** 2, 1), 0)
        score = x * (n * d)[:, None]
        return np.concatenate([(x.T @ (x * w[:, None])).ravel(), (score.T @ score).ravel(), x.T @ e2, [e2.sum(), e3.sum(), e4.sum(), (~ok).sum()]])

    t = summed(cells, parts)
    N, G = s["N"], s["G"]
    hc3 = inverse @ t[: k * k].reshape(k, k) @ inverse
    cluster = inverse @ t[k * k : 2 * k * k].reshape(k, k) @ inverse * (G / (G - 1)) * ((N - 1) / (N - k))
    xe, (sse, e3, e4, full) = t[2 * k * k : -4], t[-4:]
    sst = s["syy"] - s["sy"] ** 2 / N
    m = sse / N
    bp = N * (xe @ inverse @ xe - N * m * m) / (e4 - N * m * m)
    skew, kurt = (e3 / N) / m**1.5, (e4 / N) / m**2
    jb = N / 6 * (skew**2 + (kurt - 3) ** 2 / 4)
    r2 = 1 - sse / sst
    diagnostics = report | {"n_runs": N, "n_cells": G, "basis": k, "r2": r2, "adjusted_r2": 1 - (1 - r2) * (N - 1) / (N - k), "breusch_pagan": bp, "breusch_pagan_p": chi2_tail(bp, k - 1), "jarque_bera": jb, "jarque_bera_p": chi2_tail(jb, 2), "n_full_leverage": full}
    return Fit(design, beta, inverse, N, G, sse, sst, hc3, cluster, diagnostics)


def _f(fit: Fit, r: np.ndarray, cov: np.ndarray) -> float:
    b = r @ fit.beta
    return float(b @ np.linalg.solve(r @ cov @ r.T, b) / len(r))


def type2_restriction(fit: Fit, term: Term, cov: np.ndarray) -> np.ndarray:
    """What the term adds beyond the terms that contain it, orthogonal to them in the given covariance."""
    own = fit.design.columns(term)
    higher = [i for t in fit.design.terms if set(term) < set(t) for i in fit.design.columns(t)]
    eye = np.eye(len(fit.beta))
    if not higher:
        return eye[own]
    regression = np.linalg.solve(cov[np.ix_(higher, higher)], cov[np.ix_(higher, own)])
    return eye[own] - regression.T @ eye[higher]


def term_tests(fit: Fit, kind: str) -> list[tuple[str, int, int, float, float, float, float]]:
    """(term, df, nominal df, denominator df, F, p, partial eta squared). kind: type2_hc3, type3_hc3 or type2_cluster."""
    out = []
    cov = fit.cluster if kind.endswith("cluster") else fit.hc3
    k = len(fit.beta)
    den = fit.G - 1 if kind.endswith("cluster") else fit.N - k
    classical = fit.inverse * fit.sse / (fit.N - k)
    for t in fit.design.terms:
        own = fit.design.columns(t)
        if not own:
            continue
        r = np.eye(k)[own] if kind.startswith("type3") else type2_restriction(fit, t, cov)
        plain = np.eye(k)[own] if kind.startswith("type3") else type2_restriction(fit, t, classical)
        f = _f(fit, r, cov)
        ss = _f(fit, plain, classical) * len(own) * fit.sse / (fit.N - k)
        out.append((":".join(t), len(own), len(fit.design.spans[t]), float(den), f, f_tail(f, len(own), den), ss / (ss + fit.sse)))
    return out


def binomial(cells: DataFrame, designs: dict[str, Design], iterations: int = 200, tolerance: float = 1e-8) -> dict[str, dict]:
    """Logistic fits of several designs at once: each step of IRLS is one pass over the cells for all of them."""
    beta = {k: np.zeros(len(d.keep)) for k, d in designs.items()}
    last = {k: -np.inf for k in designs}
    result: dict[str, dict] = {}
    for step in range(iterations):
        todo = [k for k in designs if k not in result]
        if not todo:
            break
        now = {k: (designs[k], beta[k]) for k in todo}

        def parts(b: pd.DataFrame) -> np.ndarray:
            out, n, s = [], b.n.to_numpy(float), b.s.to_numpy(float)
            for d, bt in now.values():  # noqa: B023
                x = d.matrix(b)
                eta = np.clip(x @ bt, -30, 30)
                p = 1 / (1 + np.exp(-eta))
                w = np.maximum(n * p * (1 - p), 1e-10)
                out += [((x * w[:, None]).T @ x).ravel(), x.T @ (w * eta + s - n * p), [(s * np.log(p) + (n - s) * np.log1p(-p)).sum(), ((s - n * p) ** 2 / np.maximum(n * p * (1 - p), 1e-12)).sum(), (n * p * p - 2 * s * p + s).sum(), (n * ((p < 1e-6) | (p > 1 - 1e-6))).sum(), n.sum(), s.sum()]]
            return np.concatenate(out)

        flat, at = summed(cells, parts), 0
        for k in todo:
            m = len(beta[k])
            h, z, tail = flat[at : at + m * m].reshape(m, m), flat[at + m * m : at + m * m + m], flat[at + m * m + m : at + m * m + m + 6]
            at += m * m + m + 6
            if abs(tail[0] - last[k]) <= tolerance * (abs(tail[0]) + 0.1) or step == iterations - 1:
                null = tail[5] * np.log(tail[5] / tail[4]) + (tail[4] - tail[5]) * np.log(1 - tail[5] / tail[4]) if 0 < tail[5] < tail[4] else 0.0
                result[k] = {"loglik": tail[0], "df": m, "pearson_df": tail[1] / max(1.0, tail[4] - m), "brier": tail[2] / tail[4], "mcfadden": 1 - tail[0] / null if null else float("nan"), "max_abs_coef": float(np.abs(beta[k]).max()), "share_extreme": tail[3] / tail[4], "iterations": step + 1, "beta": beta[k]}
            last[k] = tail[0]
            beta[k] = np.linalg.lstsq(h, z, rcond=None)[0]
    return result


def outcome_models(cells: DataFrame, factors: Sequence[str], extra: Sequence[Term] = ()) -> tuple[dict[str, Design], dict[str, dict]]:
    """The full logistic fit, and one without each term; a main factor goes with its interactions."""
    base = two_way(cells, factors, extra)
    r = factor(counted(cells), base).r
    designs = {}
    for name, gone in {"full": (), **{":".join(t): t for t in base.terms}}.items():
        terms = [t for t in base.terms if not gone or not set(gone) <= set(t)]
        d = Design(base.levels, terms)
        d.keep = np.array(basis(r[:, [0, *(c for t in terms for c in base.spans[t])]], d))
        designs[name] = d
    return designs, binomial(cells, designs)


def likelihood_ratio(fits: dict[str, dict]) -> list[tuple[str, float, int, float]]:
    """(term, statistic, df, p) for the deletion of each term."""
    full, out = fits["full"], []
    for name, fit in fits.items():
        if name != "full":
            x, df = max(0.0, 2 * (full["loglik"] - fit["loglik"])), full["df"] - fit["df"]
            out.append((name, float(x), df, chi2_tail(x, df) if df else 1.0))
    return out


def targeted_outcome(cells: DataFrame, factors: Sequence[str], terms: Sequence[Term]) -> list[tuple]:
    """(term, statistic, df, p, added columns, added rank, status) of three-way terms added to the two-way logistic model. A term
    is tested only if all its columns are estimable."""
    wide = two_way(cells, factors, terms)
    r = factor(counted(cells), wide).r
    pairs = [t for t in wide.terms if t not in terms]
    designs, ranks = {}, {}
    for name, extra in {"two_way": [], **{":".join(t): [t] for t in terms}}.items():
        d = Design(wide.levels, [*pairs, *extra])
        d.keep = np.array(basis(r[:, [0, *(c for t in d.terms for c in wide.spans[t])]], d))
        designs[name], ranks[name] = d, len(d.keep)
    base = designs["two_way"]
    columns = {":".join(t): len(wide.spans[t]) for t in terms}
    whole = {n: ranks[n] - ranks["two_way"] == c and ranks["two_way"] == base.width for n, c in columns.items()}
    fits = binomial(cells, {n: d for n, d in designs.items() if n == "two_way" or whole[n]}) if any(whole.values()) else {}
    out = []
    for name, n in columns.items():
        added = ranks[name] - ranks["two_way"]
        if whole[name]:
            x = max(0.0, 2 * (fits[name]["loglik"] - fits["two_way"]["loglik"]))
            out.append((name, float(x), added, chi2_tail(x, added), n, added, "reported"))
        else:
            out.append((name, float("nan"), added, float("nan"), n, added, "not estimable"))
    return out


def targeted_performance(cells: DataFrame, factors: Sequence[str], terms: Sequence[Term]) -> list[tuple]:
    """(term, statistic, df, denominator df, p, added columns, added rank, status): HC3 F of each three-way term on the columns that the cells support."""
    out = []
    for t in terms:
        fit = ols(cells, factors, [t])
        name, columns, added = ":".join(t), len(fit.design.spans[t]), len(fit.design.columns(t))
        test = {r[0]: r for r in term_tests(fit, "type2_hc3")}.get(name)
        status = "not estimable" if not added else "reported" if added == columns else "reported on observed support"
        out.append((name, test[4], added, test[3], test[5], columns, added, status) if test else (name, float("nan"), added, fit.N - len(fit.beta), float("nan"), columns, added, status))
    return out


def terms_side_by_side(outcome: DataFrame, performance: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row for each term: the outcome's statistic, df and p, and f, df, denominator_df, p and partial_eta2 of each metric."""
    wide = performance.groupBy(*keys, "term").pivot("metric", list(metrics)).agg(*(F.first(c).alias(c) for c in ("f", "df", "denominator_df", "p", "partial_eta2")))
    left = outcome.select(*keys, "term", *(F.col(c).alias(f"outcome_{c}") for c in ("statistic", "df", "p")))
    return join_cells(left, wide, [*keys, "term"], "left")


def auc(cells: DataFrame, design: Design, beta: np.ndarray) -> float:
    """Rank-sum AUC: cells are counted by fitted probability, and ties share their ranks."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"eta": np.round(design.matrix(b) @ beta, 9), "s": b.s.astype(float), "n": b.n.astype(float)})

    ties = cells.mapInPandas(score, "eta double, s double, n double").groupBy("eta").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    ranked = ties.selectExpr("s", "n", "sum(n) OVER (ORDER BY eta) - n / 2 + 0.5 AS rank")  # at most one row a cell
    r = ranked.agg(F.sum(F.col("s") * F.col("rank")).alias("r"), F.sum("s").alias("p"), F.sum(F.col("n") - F.col("s")).alias("q")).first()
    return float((r["r"] - r["p"] * (r["p"] + 1) / 2) / (r["p"] * r["q"])) if r["p"] and r["q"] else float("nan")


def icc_anova(df: DataFrame, cfg: Sequence[str], keys: Sequence[str], value: str, eligible: str) -> DataFrame:
    """One-way random-effects ICC of cells within each key, truncated at 0; null where a degree of freedom is missing."""
    v = F.when(F.col(eligible), F.col(value))
    cells = df.groupBy(*dict.fromkeys([*keys, *cfg])).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("var")).filter("n > 0")
    n, m = F.col("n"), F.col("m")
    a = cells.groupBy(*keys).agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("G"), F.sum(n * m).alias("sy"), F.sum(n * m * m).alias("sm2"), F.sum(n * F.col("var")).alias("ssw"))
    a = a.withColumns({"msb": F.when(F.col("G") > 1, (F.col("sm2") - F.col("sy") * F.col("sy") / F.col("N")) / (F.col("G") - 1)), "msw": F.when(F.col("N") > F.col("G"), F.col("ssw") / (F.col("N") - F.col("G")))})
    a = a.withColumn("between", F.when(F.col("msb").isNotNull() & F.col("msw").isNotNull(), F.greatest((F.col("msb") - F.col("msw")) * F.col("G") / F.col("N"), F.lit(0.0))))
    return a.select(*keys, F.col("N").alias("n_runs"), F.col("G").alias("n_cells"), "between", F.col("msw").alias("within"), F.try_divide(F.col("between"), F.col("between") + F.col("msw")).alias("icc"))


def reml(n: np.ndarray, count: np.ndarray, s1: np.ndarray, s2: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(between, within) variances of random-intercept models, one a row, by the profile restricted likelihood in their ratio.

    The likelihood depends on cells only through sums by their size: how many cells have each size n, the sums of their means and of
    the squares of these (less any common number), and all inner sums of squares. Sizes that a row lacks have count 0. All
    rows search their ratio together.
    """
    N = (count * n).sum(1)

    def parts(ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = 1 + n * ratio[:, None]
        a = n / spread
        all_ = (a * count).sum(1)
        mu = ((a * s1).sum(1) / all_)[:, None]
        within = (inner + np.maximum((a * (s2 - 2 * mu * s1 + mu * mu * count)).sum(1), 0.0)) / (N - 1)
        return 0.5 * ((N - 1) * np.log(within) + (count * np.log(spread)).sum(1) + np.log(all_)), within

    grid = np.r_[0, np.exp(np.linspace(-12, 8, 60))]
    values = np.array([parts(np.full(len(n), x))[0] for x in grid])
    i = values.argmin(0)
    lo, hi = grid[np.maximum(0, i - 1)], grid[np.minimum(len(grid) - 1, i + 1)]
    golden = (np.sqrt(5) - 1) / 2
    a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
    at_a, at_b = parts(a)[0], parts(b)[0]
    for _ in range(60):
        down = at_a < at_b
        lo, hi = np.where(down, lo, a), np.where(down, b, hi)
        new = np.where(down, hi - golden * (hi - lo), lo + golden * (hi - lo))
        at_new = parts(new)[0]
        a, b, at_a, at_b = np.where(down, new, b), np.where(down, a, new), np.where(down, at_new, at_b), np.where(down, at_a, at_new)
    ratio = (lo + hi) / 2
    ratio = np.where(values[0] <= parts(ratio)[0], 0.0, ratio)
    within = parts(ratio)[1]
    return ratio * within, within


#: Models that search together.
MODELS = 1000


def _sums_by_size(blocks: DataFrame, replicates: int, seed: int) -> DataFrame:
    """cell (the key), replicate, n and the sums of a block's cells of that size, for the estimate (replicate 0) and the resamples of cells."""
    names = ["count", "s1", "s2", "inner"]
    schema = StructType([blocks.schema["cell"], *(StructField(c, LongType()) for c in ("replicate", "n")), *(StructField(c, DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.select(["block", "members", "G", "center", "label"]).to_pylist()):
                own = r["members"]
                n, mean, m2 = (np.array([x[c] for x in own], float) for c in ("n", "mean", "m2"))
                sizes, of = np.unique(n, return_inverse=True)
                one = np.zeros((len(own), len(sizes)))
                one[np.arange(len(own)), of] = 1.0
                d = mean - r["center"]
                parts = [one, one * d[:, None], one * (d * d)[:, None], one * m2[:, None]]
                drawn = B.dealt(seed, r["label"], r["G"], r["block"], B.RANGE, replicates)
                numbers = np.arange(1, replicates + 1)
                for w, numbered in [(np.ones((1, len(own))), np.zeros(1, np.int64)), *((B.weights(seed, r["label"], r["block"], numbers[c], drawn[c], len(own)), numbers[c]) for c in B.chunks(drawn, len(own)))]:
                    sums = [(w @ p).ravel() for p in parts]
                    some = np.flatnonzero(sums[0])
                    same = pa.array(np.full(len(some), i))
                    columns = [pa.array(np.repeat(numbered, len(sizes))[some]), pa.array(np.tile(sizes.astype(np.int64), len(numbered))[some]), *(pa.array(x[some]) for x in sums)]
                    yield pa.RecordBatch.from_arrays([batch.column("cell").take(same), *columns], names=schema.names)

    return blocks.mapInArrow(run, schema)


def icc_reml(cells: DataFrame, keys: Sequence[str], replicates: int = 0, seed: int = 20260901) -> DataFrame:
    """The ICC of each key, and with replicates of its cluster bootstraps (replicate 0 is the estimate).

    Cells are numbered in their key, by ranges, and cut into blocks; a replicate draws as many cells with replacement, dealt to the blocks as
    the bootstrap of values deals its draws. A block sends on sums by cell size, and a fit sees these alone: no task holds a
    key's cells. Null levels are levels.
    """
    others = [c for c in cells.columns if c not in {*keys, "n", "mean", "m2", "m3", "m4", "n_dropped"}]
    rows = materialize(cells.select(*keys, *others, "n", "mean", "m2"))
    of_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("G"), F.avg("mean").alias("center")).select(cell_key(keys).alias("cell"), "G", "center", cell_label(keys).alias("label"))
    placed = gapless_rank(rows, keys, others, "place")
    member = F.struct("place", F.col("n").cast("long").alias("n"), "mean", "m2")
    blocks = placed.groupBy(cell_key(keys).alias("cell"), F.floor(F.col("place") / B.RANGE).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = _sums_by_size(blocks.join(of_key, "cell").repartition(tasks), replicates, seed).groupBy("cell", "replicate", "n").agg(*(F.sum(c).alias(c) for c in ("count", "s1", "s2", "inner")))
    sizes = sums.groupBy("cell", "replicate").agg(F.collect_list(F.struct("n", "count", "s1", "s2", "inner")).alias("sizes"))  # distinct sizes: few even of many cells
    schema = StructType([sizes.schema["cell"], StructField("replicate", LongType()), StructField("n_cells", LongType()), *(StructField(c, DoubleType()) for c in ("between", "within", "icc"))])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, MODELS):
                batch = whole.slice(first, MODELS)
                lists = batch.column("sizes").to_pylist()
                table = np.zeros((5, len(lists), max(map(len, lists))))
                table[0] = 1.0
                for i, own in enumerate(lists):
                    table[:, i, : len(own)] = np.array([[x[c] for x in own] for c in ("n", "count", "s1", "s2", "inner")])
                n, count, s1, s2, inner = table
                cells_, runs, inner = count.sum(1), (count * n).sum(1), inner.sum(1)
                between, within = np.full(len(lists), np.nan), np.full(len(lists), np.nan)
                ok = np.flatnonzero((cells_ > 1) & (runs > cells_) & (inner > 0))
                if ok.size:
                    between[ok], within[ok] = reml(n[ok], count[ok], s1[ok], s2[ok], inner[ok])
                icc = np.where(within > 0, between / np.where(within > 0, between + within, 1.0), np.nan)
                yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("replicate"), pa.array(np.rint(cells_).astype(np.int64)), pa.array(between), pa.array(within), pa.array(icc)], names=schema.names)

    return sizes.mapInArrow(fit, schema).select("cell.*", "replicate", "n_cells", "between", "within", "icc")


def icc_intervals(fits: DataFrame, keys: Sequence[str], least_share: float = 0.8) -> DataFrame:
    """Estimate, 95 % interval, failures, and whether enough replicates gave a result."""
    v = F.when((F.col("replicate") > 0) & ~F.isnan("icc"), F.col("icc"))
    tried = F.count_if(F.col("replicate") > 0)
    return fits.groupBy(*keys).agg(F.max(F.when(F.col("replicate") == 0, F.col("icc"))).alias("icc"), F.percentile(v, F.lit(0.025)).alias("lower"), F.percentile(v, F.lit(0.975)).alias("upper"), (tried - F.count(v)).alias("n_failed"), (F.count(v) >= least_share * tried).alias("converged"))


def require_converged(intervals: DataFrame) -> DataFrame:
    """intervals as they are; a key with too few replicates that gave a result raises when its row is read."""
    message = F.concat(F.lit("too few replicates of the intraclass correlation gave a result; failed: "), F.col("n_failed").cast("string"))
    return intervals.filter(F.when(F.col("converged"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def type2_sums(fit: Fit) -> dict[str, float]:
    """Type II sums of squares of the terms, and the residual's."""
    scale = fit.sse / (fit.N - len(fit.beta))
    classical = fit.inverse * scale
    out = {":".join(t): _f(fit, type2_restriction(fit, t, classical), classical) * len(fit.design.columns(t)) * scale for t in fit.design.terms if fit.design.columns(t)}
    return out | {"residual": fit.sse}


def legacy_shares(cells: DataFrame, main: str, crossed: Sequence[str], alone: Sequence[str]) -> list[tuple[str, float]]:
    """The older shares of the type II sums of squares in their total, from cells of raw values: main effects of all factors, and
    the main one's interaction with the crossed ones."""
    factors = [main, *crossed, *alone]
    sums = type2_sums(ols(cells, factors, terms=[*((f,) for f in factors), *((main, f) for f in crossed)]))
    total = sum(sums.values())
    return [(t, x / total) for t, x in sums.items()]


def anova_shares(fit: Fit, digits: int = 1) -> list[tuple[str, float]]:
    """Type II shares of the variance in percent; the residual takes up the rounding, so the row sums to 100."""
    ss = type2_sums(fit)
    total = sum(ss.values())
    del ss["residual"]
    shares = [(t, round(100 * x / total, digits)) for t, x in ss.items()]
    return [*shares, ("residual", round(max(0.0, 100 - sum(x for _, x in shares)), digits))]


def three_way(cells: DataFrame, factors: Sequence[str], terms: Sequence[Term] = ()) -> list[tuple[str, int, int]]:
    """(term, nominal columns, added rank) of the given three-way interactions, or of all."""
    out = []
    for t in terms or combinations(factors, 3):
        design = two_way(cells, factors, [t])
        kept = set(basis(factor(cells, design).r, design))
        out.append((":".join(t), len(design.spans[t]), len(kept & set(design.spans[t]))))
    return out
