"""The queries over the run corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.storage import materialize
from evenkeel.operators import bootstrap as B
from evenkeel.operators import dispersion as D
from evenkeel.operators import factors as FA
from evenkeel.operators import graph as G
from evenkeel.operators import inventory as I
from evenkeel.operators import labels as L
from evenkeel.operators import models as M
from evenkeel.operators import outcomes as O
from evenkeel.operators import quality as Q
from evenkeel.operators import resample as R
from evenkeel.operators import windows as WI
from evenkeel.plans.model import METRICS, RUNS, MetricSpec
from evenkeel.plans.oracle import oracle_sql
from evenkeel.plans.runs_view import outcome_runs, runs, table
from evenkeel.sources.files import manifest

CFG = list(RUNS.cfg)
PAIR = ["chain", "topology"]
SCOPES = {"all": None, "two_regions": ["ASIA", "EUROPE"]}
CHAINS = {"AUTOMOBILE": "auto", "BUILDING": "build", "MACHINERY": "machine"}
STATS = ["n_metric", "mean", "iqr_pct", "std_pct", "delta_min_pct", "delta_max_pct", "range", "wcd", "wcd_pct"]
EXTREMA = {"delta_min_pct": "min", "delta_max_pct": "max", "range": "max", "wcd": "max", "wcd_pct": "max"}
FLAGS = ["submitted", "positive", "zero", "none", "tps_point_valid", "latency_valid", "energy_valid_positive"]
#: Three-way terms that are added to the two-way models.
TARGETED = [("chain", "topology", "workload"), ("chain", "workload", "size")]
VALUES = {"tps": "tps", "latency": "latency", "energy": "energy_clean"}
#: Replicates and seeds of the registered resampling queries; the operators take 5,000 by default, the published number, which SQL can't check in time.
REPLICATES, ICC_REPLICATES, BALANCED_N, BALANCED_SEED, BOOTSTRAP_SEED = 100, 1000, 9, 20260830, 20260831
Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}

__all__ = ["oracle_sql", "queries"]


def query(f: Query) -> Query:
    _REGISTERED[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_REGISTERED)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with -0.0 as 0.0."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


def settled(df: DataFrame, digits: int = 5) -> DataFrame:
    """As rounded, but a hair up: means and quantiles of short decimals often lie just between two, where sums in another order would decide."""
    kinds = dict(df.dtypes)
    return rounded(df.select(*((F.col(c) + 1e-9).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns)), digits)


def _cells(spark, sf_dir):
    return D.dispersion(outcome_runs(spark, sf_dir), CFG, METRICS)


def _legacy(spark, sf_dir, keys=CFG):
    return D.legacy_aggregate(O.legacy_ratios(runs(spark, sf_dir)), keys, VALUES)


def _slim_runs(spark, sf_dir):
    """What resampling reads of the runs, written once."""
    return materialize(outcome_runs(spark, sf_dir).select(*dict.fromkeys([*CFG, "run_id", *(m.value for m in METRICS), *FLAGS])))


def _enough_runs(spark, sf_dir):
    """Runs of the cells that have as many as a balanced sample draws."""
    return R.long_enough(_slim_runs(spark, sf_dir), CFG, BALANCED_N)


def _sample(enough):
    return R.balanced_sample(enough, CFG, "run_id", BALANCED_N, BALANCED_SEED, REPLICATES)


def _in_scopes(df):
    return L.in_scopes(df, "workload", SCOPES)


def _rows(spark, rows, schema):
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], schema)


@query
def label_recode(spark, sf_dir):
    named = L.normalise(runs(spark, sf_dir), {"chain": CHAINS}, {"topology": "-NOT SPECIFIED", "workload": "-l"})
    return named.groupBy("chain_raw", "chain", "topology").agg(F.count(F.lit(1)).alias("n_runs"))


@query
def controlled_selection(spark, sf_dir):
    named = L.normalise(runs(spark, sf_dir), {"chain": CHAINS})
    chosen = L.select_controlled(named, {"chain": "build", "size": "F"}, {"chain": CHAINS})
    return L.in_scopes(chosen, "workload", SCOPES).select("scope", "run_id", "chain", "topology", "workload", L.position(F.col("workload"), ["EUROPE", "ASIA"]).alias("place"))


@query
def run_outcomes(spark, sf_dir):
    return outcome_runs(spark, sf_dir).select("run_id", "outcome", *dict.fromkeys(O.COUNTERS.values()))


@query
def outcome_counts_by_config(spark, sf_dir):
    return O.outcome_counts(outcome_runs(spark, sf_dir), CFG)


@query
def outcome_flag_violations(spark, sf_dir):
    """Runs whose flags disagree, after every 97th run's flag was turned over."""
    turned = outcome_runs(spark, sf_dir).withColumn("positive", F.col("positive") != (F.col("run_id") % 97 == 0))
    return O.flag_violations(turned).agg(F.count(F.lit(1)).alias("n_violations"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))


@query
def status_counts_zero_filled(spark, sf_dir):
    return O.status_counts(outcome_runs(spark, sf_dir), PAIR)


@query
def scope_outcome_summary(spark, sf_dir):
    scoped = L.in_scopes(outcome_runs(spark, sf_dir), "workload", SCOPES)
    counts = O.outcome_counts(scoped, ["scope", *CFG])
    out = [O.scope_summary(counts.filter(F.col("scope") == s)).withColumn("scope", F.lit(s)) for s in SCOPES]
    return out[0].unionByName(out[1])


@query
def legacy_projections(spark, sf_dir):
    df = O.legacy_ratios(runs(spark, sf_dir))
    return rounded(df.select("run_id", "commit_ratio", "latency_per_load", "energy_clean"))


@query
def config_inventory(spark, sf_dir):
    return I.config_inventory(runs(spark, sf_dir), CFG, "batch", "ts")


@query
def batch_inventory(spark, sf_dir):
    return I.batch_inventory(runs(spark, sf_dir), CFG, "batch", "run", "ts")


@query
def run_count_distribution(spark, sf_dir):
    df = runs(spark, sf_dir)
    parts = {"runs_by_config": (df, CFG), "runs_by_batch": (df, ["batch"]), "batches_by_config": (df.select(*CFG, "batch").distinct(), CFG)}
    return reduce(DataFrame.unionByName, (I.distribution(d, keys).withColumn("distribution", F.lit(name)) for name, (d, keys) in parts.items()))


@query
def corpus_summary(spark, sf_dir):
    return I.corpus_summary(runs(spark, sf_dir), CFG, "batch")


@query
def provenance_duplicates(spark, sf_dir):
    return I.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def provenance_crossing(spark, sf_dir):
    return I.crossing_batches(table(spark, sf_dir, "events"), ["event_type"], "user_id")


@query
def missing_keys(spark, sf_dir):
    return I.missing_keys(runs(spark, sf_dir), [*CFG, "batch", "run", "latency"])


@query
def identifier_audit(spark, sf_dir):
    return I.identifier_audit(runs(spark, sf_dir), CFG, "batch", "run", "ts")


@query
def batch_structure(spark, sf_dir):
    return I.batch_structure(runs(spark, sf_dir), CFG, "batch")


@query
def dispersion_long(spark, sf_dir):
    return rounded(_cells(spark, sf_dir), 7)


@query
def dispersion_sorted_quantile(spark, sf_dir):
    return rounded(D.sorted_quantile(table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice")), ["l_returnflag"], "v", 0.9), 4)


@query
def dispersion_scope_maxima(spark, sf_dir):
    return settled(D.scope_maxima(_cells(spark, sf_dir), CFG, ["range", "delta_max_pct", "delta_min_pct", "wcd"]), 4)


@query
def dispersion_bounds_violations(spark, sf_dir):
    """Cells outside what arithmetic allows, after the upper ends of one chain were moved."""
    moved = _cells(spark, sf_dir).withColumn("range", F.when((F.col("chain") == "BUILDING") & (F.col("metric") == "tps"), F.col("range") + 1).otherwise(F.col("range")))
    return D.bounds_violations(moved).groupBy("chain", "metric").agg(F.count(F.lit(1)).alias("n_violations"))


@query
def metric_eligibility_summary(spark, sf_dir):
    return D.eligibility(_in_scopes(_cells(spark, sf_dir)), ["scope"])


@query
def legacy_aggregate(spark, sf_dir):
    return rounded(_legacy(spark, sf_dir), 7)


@query
def legacy_dispersion(spark, sf_dir):
    return rounded(D.legacy_dispersion(_legacy(spark, sf_dir), CFG, list(VALUES)))


@query
def legacy_by_factor(spark, sf_dir):
    return rounded(FA.medians_by_sets(O.legacy_ratios(runs(spark, sf_dir)), [["chain"], ["chain", "topology"], ["chain", "workload"]], list(VALUES.values())))


@query
def legacy_scaling_pivot(spark, sf_dir):
    return rounded(FA.scaling_pivot(runs(spark, sf_dir), "chain", "size", ["F", "O", "P"], "tps"))


@query
def worst_case_swings(spark, sf_dir):
    return rounded(FA.worst_swings(_legacy(spark, sf_dir), "chain", "tps"))


@query
def bar_summary(spark, sf_dir):
    return rounded(FA.bar_summary(_legacy(spark, sf_dir), PAIR, "tps"))


@query
def best_worst_marks(spark, sf_dir):
    return rounded(FA.best_worst(FA.medians_by(runs(spark, sf_dir), PAIR, ["tps"]), ["topology"], "median_tps"))


@query
def offered_vs_committed(spark, sf_dir):
    return rounded(FA.offered_vs_committed(outcome_runs(spark, sf_dir), [["workload"], ["workload", "chain"]]))


@query
def catalog_accounting(spark, sf_dir):
    catalog = table(spark, sf_dir, "region").select(F.col("r_name").alias("workload"), F.col("r_regionkey").alias("catalog_id"))
    return FA.catalog_accounting(O.outcome_counts(outcome_runs(spark, sf_dir), CFG), "workload", catalog)


@query
def one_to_one_join(spark, sf_dir):
    df = runs(spark, sf_dir)
    return FA.one_to_one(I.config_inventory(df, CFG, "batch", "ts"), I.batch_structure(df, CFG, "batch").drop("n_runs", "n_batches"), CFG)


@query
def factor_grid_gaps(spark, sf_dir):
    """Empty and sparse cells of the last, unfinished year."""
    return FA.grid_gaps(FA.factor_grid(outcome_runs(spark, sf_dir).filter("year(ts) = 1998"), CFG, "tps_point_valid"), 3)


@query
def cells_without_eligible(spark, sf_dir):
    return FA.cells_without(outcome_runs(spark, sf_dir), [*CFG, "batch"], "tps_point_valid")


@query
def single_outcome_cells(spark, sf_dir):
    return FA.single_outcome_cells(outcome_runs(spark, sf_dir), CFG, "positive")


@query
def outcome_accounting_rollup(spark, sf_dir):
    return FA.outcome_rollup(O.outcome_counts(outcome_runs(spark, sf_dir), CFG), PAIR)


@query
def factor_cell_means(spark, sf_dir):
    return rounded(FA.factor_means(_in_scopes(_cells(spark, sf_dir)), CFG[1:], ["iqr_pct", "std_pct"], ["scope", "chain"]))


def _unspecified(spark, sf_dir):
    """Runs whose unspecified topology is a missing level."""
    return outcome_runs(spark, sf_dir).withColumn("topology", F.when(~F.col("topology").endswith("NOT SPECIFIED"), F.col("topology")))


@query
def unspecified_deviations(spark, sf_dir):
    """Deviations, offsets, halves and ends of cells of which some have no topology."""
    df = materialize(_unspecified(spark, sf_dir))
    off = WI.deviations(df, CFG, "tps", "tps_point_valid").select(*CFG, "run_id", "cell_mean", "deviation")
    placed = WI.offsets(df.filter("tps_point_valid"), CFG, ["ts", "run_id"]).select("run_id", "offset")
    half = WI.halves(df, CFG, ["ts", "batch", "run"]).select("run_id", "period")
    ends = WI.end_batches(df, CFG, "batch", ["ts", "batch", "run"]).select("run_id", F.col("period").alias("batch_period"))
    return rounded(off.join(placed, "run_id").join(half, "run_id", "left").join(ends, "run_id", "left"))


@query
def unspecified_grid(spark, sf_dir):
    """The grid of chain, topology and size with a missing topology among the levels."""
    return FA.factor_grid(_unspecified(spark, sf_dir), ["chain", "topology", "size"], "tps_point_valid")


@query
def unspecified_bootstrap(spark, sf_dir):
    """Bootstrap intervals of cells of which some have no topology."""
    by = ["chain", "topology", "size"]
    long = R.long_statistics(B.bootstrap(_unspecified(spark, sf_dir), by, "run_id", METRICS[:1], BOOTSTRAP_SEED, REPLICATES), [*by, "metric", "replicate"], ["iqr_pct", "std_pct"])
    return settled(R.summary(long, [*by, "metric", "statistic"]))


@query
def deviation_sums(spark, sf_dir):
    """Cells whose deviations don't sum to 0 but for rounding, after one chain's were moved."""
    off = WI.deviations(outcome_runs(spark, sf_dir), CFG, "tps", "tps_point_valid")
    moved = off.withColumn("deviation", F.col("deviation") + F.when(F.col("chain") == "MACHINERY", 0.5).otherwise(0.0))
    return WI.uncentred(moved, CFG).groupBy("chain").agg(F.count(F.lit(1)).alias("n_violations"))


@query
def run_deviations(spark, sf_dir):
    out = WI.deviations(outcome_runs(spark, sf_dir), CFG, "tps", "tps_point_valid")
    return rounded(out.select("run_id", "cell_mean", "deviation", "deviation_pct", "clipped_pct", "overflow"))


@query
def deviation_offsets(spark, sf_dir):
    out = WI.offsets(outcome_runs(spark, sf_dir).filter("tps_point_valid"), CFG, ["ts", "run_id"])
    return rounded(out.select("run_id", "offset", O.compact("chain", "topology", "size").alias("cell")))


@query
def label_agreement(spark, sf_dir):
    """Runs of a raw label against runs of its display label: their numbers, and the runs that only one of them has."""
    named = L.normalise(runs(spark, sf_dir), {"chain": CHAINS})
    return L.agreement(named, "run_id", "chain", CHAINS)


@query
def corpus_link(spark, sf_dir):
    """Whether the runs of a workload have one submitted count and known loads only."""
    chosen = outcome_runs(spark, sf_dir).filter("workload = 'ASIA' AND size = 'F'")
    return Q.corpus_link(chosen, 999, "submit", "load", [1.0, 2.0])


@query
def identifiers(spark, sf_dir):
    """Each configuration's label and dense number, and its compact outcome counts."""
    counts = O.outcome_counts(outcome_runs(spark, sf_dir), CFG)
    named = L.dense_codes(counts, CFG)
    place = L.composite_position([(F.col("workload"), ["EUROPE", "ASIA"]), (F.col("size"), ["F", "O"])])
    return named.select("config_id", "config_code", O.compact().alias("outcome"), place.alias("place"))


def _contrasts(df):
    return WI.period_contrast(df, CFG, {"tps": ("tps", "tps_point_valid"), "latency": ("latency", "latency_valid")})


@query
def half_contrast(spark, sf_dir):
    return rounded(_contrasts(WI.halves(outcome_runs(spark, sf_dir), CFG, ["ts", "batch", "run"])))


@query
def batch_contrast(spark, sf_dir):
    return rounded(_contrasts(WI.end_batches(outcome_runs(spark, sf_dir), CFG, "batch", ["ts", "batch", "run"])))


@query
def period_contrast_summary(spark, sf_dir):
    halves = _contrasts(WI.halves(outcome_runs(spark, sf_dir), CFG, ["ts", "batch", "run"]))
    return rounded(WI.contrast_summary(halves, ["positive_points", "tps_change_pct", "latency_change_pct"]))


@query
def balanced_sample(spark, sf_dir):
    return _sample(_enough_runs(spark, sf_dir)).select("replicate", "run_id", *CFG)


@query
def balanced_config_sensitivity(spark, sf_dir):
    enough = _enough_runs(spark, sf_dir)
    return settled(R.config_sensitivity(_sample(enough), D.dispersion(enough, CFG, METRICS), CFG, METRICS, STATS))


@query
def balanced_factor_sensitivity(spark, sf_dir):
    enough = _enough_runs(spark, sf_dir)
    cells = materialize(R.replicate_cells(_sample(enough), CFG, METRICS))
    return settled(R.factor_sensitivity(_in_scopes(cells), _in_scopes(D.dispersion(enough, CFG, METRICS)), CFG, STATS[1:], ["scope"]))


@query
def balanced_extrema(spark, sf_dir):
    enough = _enough_runs(spark, sf_dir)
    cells = materialize(R.replicate_cells(_sample(enough), CFG, METRICS))
    return settled(R.extrema_sensitivity(_in_scopes(cells), _in_scopes(D.dispersion(enough, CFG, METRICS)), EXTREMA, ["scope"]))


@query
def balanced_denominators(spark, sf_dir):
    enough = _enough_runs(spark, sf_dir)
    return settled(R.denominators(_sample(enough), enough, CFG, FLAGS))


def _bootstrap(df):
    return B.bootstrap(df, CFG, "run_id", METRICS, BOOTSTRAP_SEED, REPLICATES)


@query
def bootstrap_config_intervals(spark, sf_dir):
    long = R.long_statistics(_bootstrap(outcome_runs(spark, sf_dir)), [*CFG, "metric", "replicate"], ["iqr_pct", "std_pct"])
    return settled(R.summary(long, [*CFG, "metric", "statistic"]))


@query
def bootstrap_factor_intervals(spark, sf_dir):
    """Of each chain and level of the other factors."""
    df = _slim_runs(spark, sf_dir)
    drawn, own = materialize(_bootstrap(df)), D.dispersion(df, CFG, METRICS)
    return settled(R.factor_intervals(_in_scopes(drawn), _in_scopes(own), CFG, "chain", CFG[1:], ["iqr_pct", "std_pct"], ["scope"]))


@query
def bootstrap_outside_markers(spark, sf_dir):
    df = _slim_runs(spark, sf_dir)
    long = R.long_statistics(_bootstrap(df), [*CFG, "metric", "replicate"], ["iqr_pct", "std_pct"])
    own = R.long_statistics(D.dispersion(df, CFG, METRICS), [*CFG, "metric"], ["iqr_pct", "std_pct"]).withColumnRenamed("value", "point")
    both = own.join(R.summary(long, [*CFG, "metric", "statistic"]), [*CFG, "metric", "statistic"])
    return both.select(*CFG, "metric", "statistic", R.outside(F.col("point"), F.col("lower"), F.col("upper")).alias("is_outside"))


@query
def icc_anova(spark, sf_dir):
    return rounded(M.icc_anova(outcome_runs(spark, sf_dir), CFG, ["chain"], "tps", "tps_point_valid"))


@query
def cell_sufficient_stats(spark, sf_dir):
    return rounded(M.cell_stats(outcome_runs(spark, sf_dir), CFG, "tps", "tps_point_valid").select(*CFG, "n", "n_dropped", "mean", "m2"))


@query
def expectations_report(spark, sf_dir):
    """Totals of the outcome table against those of the raw tables, and one number that is never met."""
    done = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F' AND l_quantity > 0").select("l_orderkey").distinct()
    expected = {"n_observed": table(spark, sf_dir, "orders").count(), "n_positive_commit": done.count(), "n_inconsistent": -1}
    return Q.expectations(O.outcome_counts(outcome_runs(spark, sf_dir), []).drop("service_regime"), expected)


@query
def regime_reconciliation(spark, sf_dir):
    """Cells whose parts don't add up to their total, after the totals of one size were raised."""
    counts = O.outcome_counts(outcome_runs(spark, sf_dir), CFG)
    off = Q.reconcile(counts, F.col("n_observed") + (F.col("size") == "P").cast("int"), [F.col(c) for c in ("n_positive_commit", "n_zero_commit", "n_no_submission", "n_inconsistent")])
    return off.groupBy("size").agg(F.count(F.lit(1)).alias("n_violations"))


@query
def schedule_rules(spark, sf_dir):
    seconds = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.second("ts").alias("second"), F.floor("value").cast("int").alias("tps"))
    return Q.schedule_violations(seconds.groupBy("trace_id", "second").agg(F.max("tps").alias("tps")), 10, 20, 0, 100, 59)


@query
def not_unique_keys(spark, sf_dir):
    return Q.not_unique(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query
def graph_degrees(spark, sf_dir):
    return G.degrees(*G.trade_graph(spark, sf_dir))


@query
def graph_shortest_paths(spark, sf_dir):
    edges, nodes = G.trade_graph(spark, sf_dir)
    return G.distances(edges, nodes).select("source", "v", "hops")


@query
def graph_summary(spark, sf_dir):
    edges, nodes = G.trade_graph(spark, sf_dir)
    return rounded(G.path_summary(G.reach(edges, nodes)[1], nodes).join(G.sizes(edges, nodes).drop("n_nodes"), "graph_id").join(G.degree_summary(edges, nodes), "graph_id"))


@query
def graph_size_check(spark, sf_dir):
    """Counts of a graph against expected ones, of another graph that isn't there too; suppliers stand for its validators."""
    expected = spark.createDataFrame([("trade", 25, 40, 100), ("absent", 4, 3, 1)], "graph_id string, n_nodes long, n_edges long, n_validators long")
    validators = table(spark, sf_dir, "supplier").select(F.lit("trade").alias("graph_id"), "s_suppkey")
    return G.size_check(*G.trade_graph(spark, sf_dir), expected, validators)


@query
def edge_disjoint_paths(spark, sf_dir):
    return G.edge_disjoint_paths(*G.trade_graph(spark, sf_dir)).select("a", "b", "paths")


@query
def edge_connectivity(spark, sf_dir):
    return G.edge_connectivity(*G.trade_graph(spark, sf_dir))


def _scoped(cells: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    for scope in SCOPES:
        yield scope, L.of_scope(cells, "workload", SCOPES, scope)


def _metric_cells(spark, sf_dir) -> Iterator[tuple[str, str, DataFrame]]:
    """(scope, metric, cell statistics): one pass over the runs, whose table all fits read."""
    cells = materialize(M.cell_stats_by_metric(outcome_runs(spark, sf_dir), CFG, METRICS))
    for scope, part in _scoped(cells):
        for m in METRICS:
            yield scope, m.name, part.filter(F.col("metric") == m.name)


def _outcome_cells(spark, sf_dir) -> Iterator[tuple[str, DataFrame]]:
    return _scoped(materialize(M.outcome_cells(outcome_runs(spark, sf_dir), CFG, "positive")))


_KEYS = "scope string, metric string, "
_TESTS = "term string, df long, nominal_df long, denominator_df double, f double, p double, partial_eta2 double"


def _term_query(kind: str) -> Query:
    return lambda spark, sf_dir: _rows(spark, [(s, m, *r) for s, m, c in _metric_cells(spark, sf_dir) for r in M.term_tests(M.ols(c, CFG), kind)], _KEYS + _TESTS)


_REGISTERED |= {f"performance_{k}": _term_query(k) for k in ("type2_hc3", "type3_hc3", "type2_cluster")}


@query
def outcome_glm_lr(spark, sf_dir):
    rows = [(s, *r) for s, c in _outcome_cells(spark, sf_dir) for r in M.likelihood_ratio(M.outcome_models(c, CFG)[1])]
    return _rows(spark, rows, "scope string, term string, statistic double, df long, p double")


@query
def outcome_and_performance_tests(spark, sf_dir):
    tests = _REGISTERED["performance_type2_hc3"](spark, sf_dir)
    return M.terms_side_by_side(outcome_glm_lr(spark, sf_dir), tests, [m.name for m in METRICS], ["scope"])


def _outcome_report(cells: DataFrame) -> dict[str, float]:
    designs, fits = M.outcome_models(cells, CFG)
    full = fits["full"]
    out = {k: float(full[k]) for k in ("brier", "mcfadden", "pearson_df", "max_abs_coef", "share_extreme", "iterations")}
    quasi = full["max_abs_coef"] > 15 or full["share_extreme"] > 0.05
    return out | {"auc": M.auc(cells, designs["full"], full["beta"]), "quasi_separated": float(quasi), "columns": float(designs["full"].width), "basis": float(len(designs["full"].keep))}


@query
def model_diagnostics(spark, sf_dir):
    rows = [(s, m, k, float(v)) for s, m, c in _metric_cells(spark, sf_dir) for k, v in M.ols(c, CFG).diagnostics.items()]
    rows += [(s, "outcome", k, v) for s, c in _outcome_cells(spark, sf_dir) for k, v in _outcome_report(c).items()]
    return _rows(spark, rows, "scope string, model string, measure string, value double")


@query
def model_battery(spark, sf_dir):
    """For each scope, whether the designs of all models have full rank, and whether all targeted three-way terms are estimable."""
    flags: dict[str, list[bool]] = {s: [True, True] for s in SCOPES}
    for scope, _, cells in _metric_cells(spark, sf_dir):
        design = M.two_way(cells, CFG, TARGETED)
        kept = M.basis(M.factor(cells, design).r, design)
        pairs = sum(len(design.spans[t]) for t in design.terms if t not in TARGETED) + 1
        flags[scope][0] &= sum(c < pairs for c in kept) == pairs
        flags[scope][1] &= all(set(design.spans[t]) <= set(kept) for t in TARGETED)
    for scope, cells in _outcome_cells(spark, sf_dir):
        design = M.two_way(cells, CFG)
        flags[scope][0] &= len(M.basis(M.factor(M.counted(cells), design).r, design)) == design.width
    return _rows(spark, [(s, *map(bool, f)) for s, f in flags.items()], "scope string, all_full_rank boolean, all_three_way_estimable boolean")


@query
def three_way_estimability(spark, sf_dir):
    rows = [(s, m, *r) for s, m, c in _metric_cells(spark, sf_dir) for r in M.three_way(c, CFG, TARGETED)]
    return _rows(spark, rows, _KEYS + "term string, nominal_columns long, added_rank long").withColumn("fully_estimable", F.col("nominal_columns") == F.col("added_rank"))


@query
def three_way_sensitivity(spark, sf_dir):
    rows = [(s, "outcome", "likelihood ratio chi2", t, x, float(df), None, p, n, k, status) for s, c in _outcome_cells(spark, sf_dir) for t, x, df, p, n, k, status in M.targeted_outcome(c, CFG, TARGETED)]
    rows += [(s, m, "HC3 type II F", t, x, float(df), float(den), p, n, k, status) for s, m, c in _metric_cells(spark, sf_dir) for t, x, df, den, p, n, k, status in M.targeted_performance(c, CFG, TARGETED)]
    return _rows(spark, rows, "scope string, model string, test string, term string, statistic double, df double, denominator_df double, p double, added_columns long, added_rank long, status string")


@query
def anova_shares(spark, sf_dir):
    return _rows(spark, [(s, m, *r) for s, m, c in _metric_cells(spark, sf_dir) for r in M.anova_shares(M.ols(c, CFG))], _KEYS + "term string, share double")


@query
def legacy_anova_shares(spark, sf_dir):
    """The older variance shares, of raw values without masks."""
    df = O.legacy_ratios(runs(spark, sf_dir))
    raw = [MetricSpec(m, c, f"known_{m}") for m, c in VALUES.items()]
    known = df.withColumns({m.eligible: F.col(m.value).isNotNull() for m in raw})
    cells = materialize(M.cell_stats_by_metric(known, CFG, raw, log=False))
    return _rows(spark, [(m.name, *r) for m in raw for r in M.legacy_shares(cells.filter(F.col("metric") == m.name), "chain", ["topology", "workload"], ["size"])], "metric string, term string, share double")


def _icc_cells(spark, sf_dir):
    return materialize(_in_scopes(M.cell_stats_by_metric(outcome_runs(spark, sf_dir), CFG, METRICS)))


@query
def icc_reml(spark, sf_dir):
    return M.icc_reml(_icc_cells(spark, sf_dir), ["scope", "metric", "chain"]).drop("replicate")


@query
def icc_cluster_bootstrap(spark, sf_dir):
    keys = ["scope", "metric", "chain"]
    return M.icc_intervals(M.icc_reml(_icc_cells(spark, sf_dir), keys, ICC_REPLICATES), keys)


@query
def file_manifest(spark, sf_dir):
    return manifest(spark, sf_dir)
