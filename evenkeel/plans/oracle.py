"""The same queries in DuckDB's SQL, written for themselves."""

from __future__ import annotations

_RUNS = """
l AS (
  SELECT l_orderkey, sum(l_quantity) AS submit, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS commit, count(*) FILTER (l_linestatus = 'F') AS n_done,
    sum(CASE WHEN l_linestatus = 'F' THEN date_diff('day', DATE '1970-01-01', l_shipdate::DATE) END) AS ship_days, sum(l_extendedprice) AS rx, sum(l_extendedprice * (1 - l_discount)) AS tx
  FROM lineitem GROUP BY l_orderkey
),
r0 AS (
  SELECT o_orderkey AS run_id, c_mktsegment AS chain, o_orderpriority AS topology, r_name AS workload, o_orderstatus AS size,
    concat_ws('|', c_mktsegment, o_orderpriority, r_name, o_orderstatus, year(o_orderdate)::VARCHAR) AS batch, o_orderdate AS ts,
    coalesce(submit, 0)::DOUBLE AS submit, coalesce(commit, 0)::DOUBLE AS commit, floor(coalesce(commit, 0) / 10) / 10 AS tps,
    CASE WHEN n_done > 0 THEN ship_days / n_done - date_diff('day', DATE '1970-01-01', o_orderdate::DATE) END AS latency,
    c_acctbal AS energy, o_totalprice AS load, rx, tx
  FROM orders LEFT JOIN l ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
r1 AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ts, run_id) AS run FROM r0),
r2 AS (SELECT *, CASE WHEN NOT (submit >= 0 AND commit >= 0 AND commit <= submit AND submit = floor(submit) AND commit = floor(commit)) THEN 'inconsistent' WHEN commit > 0 THEN 'positive_commit' WHEN submit > 0 THEN 'zero_commit' ELSE 'no_submission' END AS outcome FROM r1),
r AS (
  SELECT *, outcome IN ('positive_commit', 'zero_commit') AS submitted, outcome = 'positive_commit' AS positive, outcome = 'zero_commit' AS zero, outcome = 'no_submission' AS "none", outcome = 'inconsistent' AS inconsistent,
    outcome = 'positive_commit' AND tps >= 0 AS tps_valid, outcome = 'positive_commit' AND tps = 0 AS tps_censored, outcome = 'positive_commit' AND tps > 0 AS tps_point_valid,
    outcome = 'positive_commit' AND coalesce(latency > 0, false) AS latency_valid, coalesce(energy >= 0, false) AS energy_valid, outcome = 'positive_commit' AND coalesce(energy >= 0, false) AS energy_valid_positive,
    coalesce(rx >= 0 AND tx >= 0, false) AS network_valid
  FROM r2
)"""
_FLAGS = "submitted, positive, zero, \"none\", inconsistent, tps_valid, tps_censored, tps_point_valid, latency_valid, energy_valid, energy_valid_positive, network_valid"
_COUNTS = """count(*) AS n_observed, count(*) FILTER (submitted) AS n_submitted, count(*) FILTER (positive) AS n_positive_commit, count(*) FILTER (zero) AS n_zero_commit, count(*) FILTER ("none") AS n_no_submission,
  count(*) FILTER (inconsistent) AS n_inconsistent, count(*) FILTER (tps_valid) AS n_tps_valid, count(*) FILTER (tps_censored) AS n_tps_censored, count(*) FILTER (tps_point_valid) AS n_tps_point_valid,
  count(*) FILTER (latency_valid) AS n_latency_valid, count(*) FILTER (energy_valid) AS n_energy_valid_observed, count(*) FILTER (energy_valid_positive) AS n_energy_valid_positive_commit, count(*) FILTER (network_valid) AS n_network_valid_observed,
  CASE WHEN count(*) FILTER (positive) = count(*) THEN 'all_positive' WHEN count(*) FILTER (positive) = 0 THEN 'no_positive' ELSE 'mixed' END AS service_regime"""
_CFG = "chain, topology, workload, size"
_CELLS = f"counts AS (SELECT {_CFG}, {_COUNTS} FROM r GROUP BY ALL)"


def _long(keys: str, source: str = "r", metrics=("tps", "latency", "energy")) -> str:
    flags = {"tps": "tps_point_valid", "latency": "latency_valid", "energy": "energy_valid_positive"}
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, CASE WHEN {flags[m]} THEN {m} END AS v FROM {source}" for m in metrics)


def _dispersion(keys: str, source: str) -> str:
    return f"""
SELECT *, q75 - q25 AS iqr, CASE WHEN mean > 0 THEN 100 * (q75 - q25) / mean END AS iqr_pct, CASE WHEN mean > 0 THEN 100 * std / mean END AS std_pct, "min" - mean AS delta_min, "max" - mean AS delta_max,
  CASE WHEN mean > 0 THEN 100 * ("min" - mean) / mean END AS delta_min_pct, CASE WHEN mean > 0 THEN 100 * ("max" - mean) / mean END AS delta_max_pct, "max" - "min" AS range,
  greatest(abs("max" - mean), abs("min" - mean)) AS wcd, CASE WHEN mean > 0 THEN 100 * greatest(abs("max" - mean), abs("min" - mean)) / mean END AS wcd_pct
FROM (SELECT {keys}, metric, count(v) AS n_metric, avg(v) AS mean, min(v) AS "min", max(v) AS "max", quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, stddev_samp(v) AS std FROM ({source}) GROUP BY {keys}, metric)"""


_STATS16 = ("mean", "min", "max", "q25", "q75", "std", "iqr", "iqr_pct", "std_pct", "delta_min", "delta_max", "delta_min_pct", "delta_max_pct", "range", "wcd", "wcd_pct")


def _round(columns, digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


def _unpivot(source: str, keys: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS statistic, \"{c}\"::DOUBLE AS value FROM ({source})" for c in columns)


def _settled(value: str) -> str:
    return f"round({value} + 1e-9, 5)"


def _summary(source: str, keys: str, settle=_settled) -> str:
    ends = (("median", "quantile_cont(value, 0.5)"), ("lower", "quantile_cont(value, 0.025)"), ("upper", "quantile_cont(value, 0.975)"), ("min", "min(value)"), ("max", "max(value)"))
    return f"SELECT {keys}, count(value) AS n_defined, " + ", ".join(f'{settle(x)} AS "{n}"' for n, x in ends) + f" FROM ({source}) GROUP BY {keys}"


def _levels(source: str, factors, rest: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS level, {rest} FROM ({source})" for f in factors)


def _legacy(keys: str) -> str:
    out = []
    for n, c in (("tps", "tps"), ("latency", "latency"), ("energy", "CASE WHEN energy >= 0 THEN energy END")):
        out += [f"avg({c}) AS {n}_mean", f"median({c}) AS {n}_median", f"stddev_samp({c}) AS {n}_std", f"min({c}) AS {n}_min", f"max({c}) AS {n}_max"]
        out += [f"CASE WHEN count({c}) = count(*) THEN quantile_cont({c}, {p}) END AS {n}_q{q}" for p, q in ((0.25, 25), (0.75, 75))]
    return f"legacy AS (SELECT {keys}, {', '.join(out)}, avg(commit) AS commit_mean FROM r GROUP BY ALL)"


_LEGACY_COLUMNS = [f"{n}_{s}" for n in ("tps", "latency", "energy") for s in ("mean", "median", "std", "min", "max", "q25", "q75")] + ["commit_mean"]


def _legacy_dispersion() -> str:
    out = []
    for n in ("tps", "latency", "energy"):
        pct = lambda x, s: f"round(CASE WHEN {n}_mean > 0 THEN 100 * ({x}) / {n}_mean END, 6) AS {n}_{s}"  # noqa: B023, E731
        out += [f"round(CASE WHEN {n}_min > 0 AND {n}_mean > 0 THEN 100 * ({n}_min - {n}_mean) / {n}_mean END, 6) AS {n}_min_pct", pct(f"{n}_max - {n}_mean", "max_pct"), f"round({n}_q75 - {n}_q25, 6) AS {n}_iqr", pct(f"{n}_q75 - {n}_q25", "iqr_pct"), f"round({n}_max - {n}_min, 6) AS {n}_range", pct(f"{n}_std", "std_pct")]
    return ", ".join(out)


def _contrast(source: str) -> str:
    med = lambda m, f, p: f"median(CASE WHEN period = '{p}' AND {f} THEN {m} END)"
    out = ["100 * avg(CASE WHEN period = 'late' THEN positive::INT END) - 100 * avg(CASE WHEN period = 'early' THEN positive::INT END) AS positive_points"]
    for m, f in (("tps", "tps_point_valid"), ("latency", "latency_valid")):
        out.append(f"CASE WHEN {med(m, f, 'early')} > 0 THEN 100 * ({med(m, f, 'late')} - {med(m, f, 'early')}) / {med(m, f, 'early')} END AS {m}_change_pct")
    return f"SELECT {_CFG}, {', '.join(out)} FROM ({source}) GROUP BY ALL"


_HALVES = f"""SELECT *, CASE WHEN rn <= n // 2 THEN 'early' WHEN rn > n - n // 2 THEN 'late' END AS period
FROM (SELECT *, row_number() OVER (PARTITION BY {_CFG} ORDER BY ts, batch, run) AS rn, count(*) OVER (PARTITION BY {_CFG}) AS n FROM r)"""
_BATCHES = f"""SELECT r.*, CASE WHEN a = 1 THEN 'early' ELSE 'late' END AS period FROM r JOIN (
  SELECT {_CFG}, batch, row_number() OVER (PARTITION BY {_CFG} ORDER BY ts, batch, run) AS a, row_number() OVER (PARTITION BY {_CFG} ORDER BY ts DESC, batch DESC, run DESC) AS z, count(*) OVER (PARTITION BY {_CFG}) AS n
  FROM (SELECT {_CFG}, batch, ts, run FROM r QUALIFY row_number() OVER (PARTITION BY {_CFG}, batch ORDER BY ts, run) = 1)) b USING ({_CFG}, batch) WHERE n > 1 AND (a = 1 OR z = 1)"""
_CONTRASTS = ("positive_points", "tps_change_pct", "latency_change_pct")

def _label(*keys: str) -> str:
    """A cell's levels, each behind its length."""
    return " || '|' || ".join(f"coalesce(length({k}) || ':' || {k}, '-')" for k in keys)


def _mixed(source: str, x: str, out: str) -> str:
    """The rows of source, with 32 mixed bits of the column x."""
    times = lambda c, n, k: f"(xor({c}, {c} >> {n})::HUGEINT * {k} % 4294967296)::BIGINT"
    return f"SELECT *, xor(y2, y2 >> 16) AS {out} FROM (SELECT *, {times('y1', 15, 2221713035)} AS y2 FROM (SELECT *, {times(x, 16, 2146121005)} AS y1 FROM ({source})))"


def _drawn(keys: str, label: str, source: str) -> str:
    """Moments and quartiles of the resamples of cells of one range, from values with place (from 0) and n."""
    base = f"SELECT *, (CAST('0x' || substr(md5('20260831|' || {label} || '|0'), 1, 8) AS BIGINT) + replicate * 2654435769) & 4294967295 AS x1 FROM {source}, {_REPLICATE}"
    own = f"SELECT {keys}, metric, replicate, n, place, own FROM ({_mixed(base, 'x1', 'own')})"
    draw = f"SELECT *, (own + place * 2246822507) & 4294967295 AS x2 FROM ({own})"
    return f"SELECT {keys}, metric, replicate, ((bits::HUGEINT * n) >> 32)::BIGINT AS place FROM ({_mixed(draw, 'x2', 'bits')})"


#: As many replicates as the catalog registers.
_REPLICATE = "range(1, 101) t(replicate)"
_SAMPLE = f"""enough AS (SELECT *, row_number() OVER (PARTITION BY {_CFG} ORDER BY run_id) - 1 AS place, count(*) OVER (PARTITION BY {_CFG}) AS n_cell FROM r QUALIFY count(*) OVER (PARTITION BY {_CFG}) >= 9),
floyd AS (
  SELECT {_CFG}, replicate, unnest(list_reduce(
    list_transform(range(1, 10), lambda k: [n - 9 + k, CAST('0x' || substr(md5('20260830|' || replicate || '|' || {_label(*_CFG.split(", "))} || '|' || k), 1, 15) AS BIGINT) % (n - 9 + k)]),
    lambda s, x: CASE WHEN list_contains(s, x[2]) THEN list_append(s, x[1] - 1) ELSE list_append(s, x[2]) END, []::BIGINT[])) AS place
  FROM (SELECT {_CFG}, count(*) AS n FROM enough GROUP BY ALL), {_REPLICATE}
),
sample AS (SELECT enough.*, replicate FROM floyd JOIN enough USING ({_CFG}, place))"""


def _boot(keys: str, source: str = "r", metrics=("tps", "latency", "energy")) -> str:
    n = f"OVER (PARTITION BY {keys}, metric"
    same = " AND ".join(f"d.{k} IS NOT DISTINCT FROM v.{k}" for k in (*keys.split(", "), "metric", "place"))
    own = ", ".join(f"d.{k}" for k in keys.split(", "))
    return f"""vals AS (SELECT *, row_number() {n} ORDER BY v, run_id) - 1 AS place, count(*) {n}) AS n FROM ({_long(keys + ", run_id", source, metrics)}) WHERE v IS NOT NULL),
draws AS ({_drawn(keys, _label(*keys.split(", "), "metric"), "vals")}),
drawn AS (SELECT {own}, d.metric, replicate, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, stddev_samp(v) AS std FROM draws d JOIN vals v ON {same} GROUP BY ALL),
boot AS (SELECT {keys}, metric, replicate, CASE WHEN n >= 2 AND mean > 0 THEN 100 * (q75 - q25) / mean END AS iqr_pct, CASE WHEN n >= 2 AND mean > 0 THEN 100 * std / mean END AS std_pct FROM drawn)"""


def _boot_by_ranges(keys: str, source: str, metrics, size: int = 262144) -> str:
    """As _boot, for cells of any size: a cell is cut into ranges of size values, a draw's first number says its range, and a range's draws fall among its own values."""
    n = f"OVER (PARTITION BY {keys}, metric"
    same = " AND ".join(f"d.{k} IS NOT DISTINCT FROM v.{k}" for k in (*keys.split(", "), "metric", "place"))
    own, label = ", ".join(f"d.{k}" for k in keys.split(", ")), _label(*keys.split(", "), "metric")
    based = lambda source, name: f"SELECT *, (CAST('0x' || substr(md5('20260831|' || {label} || '|' || {name}), 1, 8) AS BIGINT) + replicate * 2654435769) & 4294967295 AS x1 FROM ({source})"
    turned = lambda source, name, m: f"SELECT *, (own + draw * 2246822507) & 4294967295 AS x2 FROM (SELECT * EXCLUDE (y1, y2), unnest(range({m})) AS draw FROM ({_mixed(based(source, name), 'x1', 'own')}))"
    cells = f"SELECT DISTINCT {keys}, metric, n, replicate FROM vals, {_REPLICATE} WHERE n"
    first = _mixed(turned(f"{cells} > {size}", "'ranges'", "n"), "x2", "bits")
    second = _mixed(turned("SELECT * FROM shares", "block", "m"), "x2", "bits")
    return f"""vals AS (SELECT *, row_number() {n} ORDER BY v, run_id) - 1 AS place, count(*) {n}) AS n FROM ({_long(keys + ", run_id", source, metrics)}) WHERE v IS NOT NULL),
shares AS (SELECT {keys}, metric, n, replicate, ((bits::HUGEINT * n) >> 32)::BIGINT // {size} AS block, count(*) AS m FROM ({first}) GROUP BY ALL UNION ALL SELECT *, 0 AS block, n AS m FROM ({cells} <= {size})),
draws AS (SELECT {keys}, metric, replicate, block * {size} + ((bits::HUGEINT * least({size}, n - block * {size})) >> 32)::BIGINT AS place FROM ({second})),
drawn AS (SELECT {own}, d.metric, replicate, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, stddev_samp(v) AS std FROM draws d JOIN vals v ON {same} GROUP BY ALL),
boot AS (SELECT {keys}, metric, replicate, CASE WHEN n >= 2 AND mean > 0 THEN 100 * (q75 - q25) / mean END AS iqr_pct, CASE WHEN n >= 2 AND mean > 0 THEN 100 * std / mean END AS std_pct FROM drawn)"""


_BOOT = _boot(_CFG)
_IN_SCOPES = "SELECT c.*, s.scope FROM ({}) c, (VALUES ('all'), ('two_regions')) s(scope) WHERE s.scope = 'all' OR workload IN ('ASIA', 'EUROPE')"
_TRADE = """w AS (
  SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL
),
sides AS (SELECT a, b, w FROM w UNION ALL SELECT b, a, w FROM w),
e AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM sides QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 3),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)"""
_DIST = "dist AS (SELECT n_nationkey AS source, n_nationkey AS v, 0 AS hops FROM nation UNION SELECT source, b.v, hops + 1 FROM dist JOIN both_ways b ON dist.v = b.u WHERE hops < 24)"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    run = lambda body, *ctes: f"WITH {', '.join([_RUNS, *ctes])} {body}"
    q["label_recode"] = run("SELECT chain AS chain_raw, CASE chain WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'BUILDING' THEN 'build' WHEN 'MACHINERY' THEN 'machine' ELSE chain END AS chain, regexp_replace(topology, '-NOT SPECIFIED$', '') AS topology, count(*) AS n_runs FROM r GROUP BY ALL")
    q["controlled_selection"] = run("SELECT scope, run_id, 'build' AS chain, topology, workload, CASE workload WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END AS place FROM r, (VALUES ('all'), ('two_regions')) s(scope) WHERE chain = 'BUILDING' AND size = 'F' AND (scope = 'all' OR workload IN ('ASIA', 'EUROPE'))")
    q["run_outcomes"] = run(f"SELECT run_id, outcome, {_FLAGS} FROM r")
    q["outcome_counts_by_config"] = run(f"SELECT {_CFG}, {_COUNTS} FROM r GROUP BY ALL")
    turned = "SELECT *, positive <> (run_id % 97 = 0) AS turned FROM r"
    q["outcome_flag_violations"] = run(f"SELECT count(*) AS n_violations, min(run_id) AS first_run, max(run_id) AS last_run FROM ({turned}) WHERE submitted::INT + turned::INT + zero::INT + \"none\"::INT + inconsistent::INT <> CASE WHEN submitted THEN 2 ELSE 1 END")
    q["status_counts_zero_filled"] = run("SELECT k.chain, k.topology, s.outcome, count(run_id) AS n_runs FROM (SELECT DISTINCT chain, topology FROM r) k CROSS JOIN (VALUES ('positive_commit'), ('zero_commit'), ('no_submission'), ('inconsistent')) s(outcome) LEFT JOIN r ON r.chain = k.chain AND r.topology = k.topology AND r.outcome = s.outcome GROUP BY ALL")
    totals = ", ".join(f"sum(n_{c})::BIGINT AS total_{c}" for c in ("submitted", "positive_commit", "zero_commit", "no_submission", "inconsistent", "tps_valid", "tps_censored", "tps_point_valid", "latency_valid", "energy_valid_observed", "energy_valid_positive_commit", "network_valid_observed"))
    regimes = "count(*) FILTER (service_regime = 'all_positive') AS n_all_positive, count(*) FILTER (service_regime = 'mixed') AS n_mixed, count(*) FILTER (service_regime = 'no_positive') AS n_no_positive"
    q["scope_outcome_summary"] = run(f"SELECT scope, count(*) AS n_cells, sum(n_observed)::BIGINT AS n_runs, {regimes}, count(*) FILTER (n_positive_commit >= 9) AS n_cells_enough_positive, {totals} FROM counts, (VALUES ('all'), ('two_regions')) s(scope) WHERE scope = 'all' OR workload IN ('ASIA', 'EUROPE') GROUP BY scope", _CELLS)
    q["legacy_projections"] = run("SELECT run_id, round(coalesce(CASE WHEN submit = 0 AND commit > 0 THEN 'inf'::DOUBLE WHEN submit <> 0 THEN commit / submit END, 0), 6) AS commit_ratio, round(coalesce(CASE WHEN load = 0 AND latency > 0 THEN 'inf'::DOUBLE WHEN load <> 0 THEN latency / load END, 0), 6) AS latency_per_load, round(CASE WHEN energy >= 0 THEN energy END, 6) AS energy_clean FROM r")
    q["config_inventory"] = run(f"SELECT {_CFG}, count(*) AS n_runs, count(DISTINCT batch) AS n_batches, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY ALL")
    q["batch_inventory"] = run(f"SELECT batch, {_CFG}, count(*) AS n_runs, min(run) AS run_min, max(run) AS run_max, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY ALL")
    groups = {"runs_by_config": (_CFG, "r"), "runs_by_batch": ("batch", "r"), "batches_by_config": (_CFG, f"(SELECT DISTINCT {_CFG}, batch FROM r)")}
    q["run_count_distribution"] = run(" UNION ALL ".join(f"SELECT '{k}' AS distribution, n_members, count(*) AS n_groups FROM (SELECT {g}, count(*) AS n_members FROM {t} GROUP BY ALL) GROUP BY ALL" for k, (g, t) in groups.items()))
    levels = ", ".join(f"string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS levels_{c}" for c in _CFG.split(", "))
    q["corpus_summary"] = run(f"SELECT count(*) AS n_runs, count(DISTINCT batch) AS n_batches, {levels}, (SELECT count(*) FROM c) AS n_configs, (SELECT min(n) FROM c) AS runs_min, (SELECT max(n) FROM c) AS runs_max FROM r", f"c AS (SELECT {_CFG}, count(*) AS n FROM r GROUP BY ALL)")
    q["provenance_duplicates"] = "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"
    q["provenance_crossing"] = "SELECT user_id, count(DISTINCT event_type) AS n_configs FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1"
    q["missing_keys"] = run("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in (*_CFG.split(", "), "batch", "run", "latency")) + " FROM r")
    audits = {"configs_per_batch": ("batch", f"SELECT DISTINCT {_CFG}, batch FROM r"), "batches_per_config": (_CFG, f"SELECT DISTINCT {_CFG}, batch FROM r"), "configs_per_run_index": ("run", f"SELECT DISTINCT {_CFG}, run FROM r"), "runs_per_batch": ("batch", "SELECT batch FROM r"), "times_per_batch": ("batch", "SELECT DISTINCT batch, ts FROM r")}
    q["identifier_audit"] = run(" UNION ALL ".join(f"SELECT '{k}' AS \"check\", min(c) AS least, quantile_cont(c, 0.5)::DOUBLE AS middle, max(c) AS most, count(*) FILTER (c = 1) AS n_single, count(*) FILTER (c > 1) AS n_repeated FROM (SELECT {g}, count(*) AS c FROM ({s}) GROUP BY {g})" for k, (g, s) in audits.items()))
    q["batch_structure"] = run(f"SELECT {_CFG}, count(*) AS n_batches, sum(n)::BIGINT AS n_runs, count(*) FILTER (n >= 2) AS n_repeated_batches, min(n) AS batch_min, max(n) AS batch_max FROM (SELECT {_CFG}, batch, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL")
    cells = f"cells AS ({_dispersion(_CFG, _long(_CFG))})"
    q["dispersion_long"] = run(f"SELECT {_CFG}, metric, n_metric, {_round(_STATS16, 7)} FROM cells", cells)
    q["dispersion_sorted_quantile"] = "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS quantile FROM lineitem GROUP BY ALL"
    maxima = _unpivot("SELECT * FROM cells", f"metric, n_metric, {_label(*_CFG.split(', '))} AS cell", ("range", "delta_max_pct", "delta_min_pct", "wcd"))
    q["dispersion_scope_maxima"] = run("SELECT metric, statistic, count(value) AS n_estimable, count(*) FILTER (n_metric >= 2) AS n_two_values, arg_min(cell, cell) FILTER (size = top) AS cell, round(arg_min(value, cell) FILTER (size = top) + 1e-9, 4) AS value FROM (SELECT *, max(size) OVER (PARTITION BY metric, statistic) AS top FROM (SELECT *, round(CASE WHEN statistic = 'delta_min_pct' THEN abs(value) ELSE value END + 1e-9, 6) AS size FROM m)) GROUP BY ALL", cells, f"m AS ({maxima})")
    q["dispersion_bounds_violations"] = run("SELECT chain, metric, count(*) AS n_violations FROM (SELECT * REPLACE (CASE WHEN chain = 'BUILDING' AND metric = 'tps' THEN range + 1 ELSE range END AS range) FROM cells) WHERE n_metric > 0 AND (delta_min_pct < -100 - 1e-9 OR delta_max_pct > 100 * (n_metric - 1) + 1e-9 OR abs(range - (delta_max - delta_min)) > 1e-9 * greatest(1, abs(\"max\"))) GROUP BY ALL", cells)
    q["metric_eligibility_summary"] = run(f"SELECT scope, metric, count(*) AS n_cells, count(*) FILTER (n_metric >= 9) AS n_enough, min(n_metric) AS n_min, max(n_metric) AS n_max FROM ({_IN_SCOPES.format('SELECT * FROM cells')}) GROUP BY ALL", cells)
    q["legacy_aggregate"] = run(f"SELECT {_CFG}, {_round(_LEGACY_COLUMNS, 7)} FROM legacy", _legacy(_CFG))
    q["legacy_dispersion"] = run(f"SELECT {_CFG}, {_legacy_dispersion()} FROM legacy", _legacy(_CFG))
    q["legacy_by_factor"] = run("SELECT chain, topology, workload, round(median(tps), 6) AS median_tps, round(median(latency), 6) AS median_latency, round(median(CASE WHEN energy >= 0 THEN energy END), 6) AS median_energy_clean FROM r GROUP BY GROUPING SETS ((chain), (chain, topology), (chain, workload))")
    q["legacy_scaling_pivot"] = run("SELECT chain, " + ", ".join(f"round(median(tps) FILTER (size = '{s}'), 6) AS \"{s}\"" for s in "FOP") + " FROM r GROUP BY ALL")
    rise, drop = "tps_max - tps_mean", "tps_mean - tps_min"
    q["worst_case_swings"] = run(f"SELECT chain, round(max(tps_max - tps_min), 6) AS max_range, round(max(greatest({drop}, 0)), 6) AS max_drop, round(max(greatest({rise}, 0)), 6) AS max_rise, round(max(CASE WHEN tps_mean > 0 THEN greatest(100 * ({drop}) / tps_mean, 0) END), 6) AS max_drop_pct, round(max(CASE WHEN tps_mean > 0 THEN greatest(100 * ({rise}) / tps_mean, 0) END), 6) AS max_rise_pct FROM legacy GROUP BY ALL", _legacy(_CFG))
    q["bar_summary"] = run("SELECT chain, topology, round(avg(tps_mean), 6) AS mean, round(avg(tps_min), 6) AS \"min\", round(avg(tps_max), 6) AS \"max\", round(min(CASE WHEN tps_mean > 0 THEN 100 * (tps_min - tps_mean) / tps_mean END), 6) AS pct_min, round(max(CASE WHEN tps_mean > 0 THEN 100 * (tps_max - tps_mean) / tps_mean END), 6) AS pct_max, count(CASE WHEN tps_mean > 0 THEN 1 END) = 0 AS all_missing FROM legacy GROUP BY ALL", _legacy(_CFG))
    q["best_worst_marks"] = run("SELECT chain, topology, round(m, 6) AS median_tps, lo < hi AND m = lo AS is_min, lo < hi AND m = hi AS is_max FROM (SELECT *, min(m) OVER (PARTITION BY topology) AS lo, max(m) OVER (PARTITION BY topology) AS hi FROM (SELECT chain, topology, median(tps) AS m FROM r GROUP BY ALL))")
    q["offered_vs_committed"] = run("SELECT workload, chain, count(*) AS n_runs, count(*) FILTER (submitted) AS n_submitted, count(*) FILTER (positive) AS n_positive, round(median(load) FILTER (submitted), 6) AS median_load, round(median(tps) FILTER (submitted AND positive), 6) AS median_tps, round(median(100 * commit / submit) FILTER (submitted AND submit > 0), 6) AS median_commit_pct FROM r GROUP BY GROUPING SETS ((workload), (workload, chain))")
    q["catalog_accounting"] = run("SELECT r_name AS workload, r_regionkey AS catalog_id, count(n_observed) AS n_cells, sum(n_observed)::BIGINT AS n_runs, sum(n_positive_commit)::BIGINT AS n_positive, sum(n_zero_commit)::BIGINT AS n_zero, sum(n_no_submission)::BIGINT AS n_none, min(n_observed) AS cell_min, max(n_observed) AS cell_max FROM region LEFT JOIN counts ON workload = r_name GROUP BY ALL", _CELLS)
    q["one_to_one_join"] = run(f"SELECT {_CFG}, sum(n)::BIGINT AS n_runs, count(*) AS n_batches, min(a) AS first_ts, max(z) AS last_ts, count(*) FILTER (n >= 2) AS n_repeated_batches, min(n) AS batch_min, max(n) AS batch_max FROM (SELECT {_CFG}, batch, count(*) AS n, min(ts) AS a, max(ts) AS z FROM r GROUP BY ALL) GROUP BY ALL")
    levels4 = " CROSS JOIN ".join(f"(SELECT DISTINCT {c} FROM p)" for c in _CFG.split(", "))
    q["factor_grid_gaps"] = run(f"SELECT {_CFG}, n, CASE WHEN n = 0 THEN 'empty' ELSE 'sparse' END AS kind FROM (SELECT {_CFG}, coalesce(n, 0) AS n FROM ({levels4}) LEFT JOIN (SELECT {_CFG}, count(*) AS n FROM p WHERE tps_point_valid GROUP BY ALL) USING ({_CFG})) WHERE n < 3", "p AS (SELECT * FROM r WHERE year(ts) = 1998)")
    q["label_agreement"] = run("SELECT CASE chain WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'BUILDING' THEN 'build' ELSE 'machine' END AS label, count(*) AS n_raw, count(*) AS n_shown, 0::BIGINT AS n_apart FROM r WHERE chain IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') GROUP BY ALL")
    q["corpus_link"] = run("SELECT \"check\", ok FROM (SELECT count(*) = 999 AS a, count(DISTINCT submit) = 1 AS b, count(*) FILTER (NOT coalesce(load IN (1.0, 2.0), false)) = 0 AS c FROM r WHERE workload = 'ASIA' AND size = 'F'), LATERAL (VALUES ('rows', a), ('one_submitted_count', b), ('known_loads', c)) t(\"check\", ok)")
    q["identifiers"] = run("SELECT config_id, row_number() OVER (ORDER BY config_id) - 1 AS config_code, concat_ws('/', n_positive_commit, n_zero_commit, n_no_submission) AS outcome, CASE workload WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END * 3 + CASE size WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS place FROM (SELECT *, concat_ws('|', chain, topology, workload, size) AS config_id FROM counts)", _CELLS)
    q["cells_without_eligible"] = run(f"SELECT {_CFG}, batch FROM r GROUP BY ALL HAVING count(*) FILTER (tps_point_valid) = 0")
    q["single_outcome_cells"] = run(f"SELECT {_CFG}, bool_or(positive) AS value FROM r GROUP BY ALL HAVING count(DISTINCT positive) = 1")
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("n_observed", "n_positive_commit", "n_zero_commit", "n_no_submission", "n_inconsistent", "n_tps_valid", "n_latency_valid"))
    q["outcome_accounting_rollup"] = run(f"SELECT chain, topology, count(*) AS n_cells, {regimes}, {sums} FROM counts GROUP BY GROUPING SETS ((chain, topology), ())", _CELLS)
    stats = ", ".join(f"round({f}({s}), 6) AS {n}_{s}" for s in ("iqr_pct", "std_pct") for n, f in (("mean", "avg"), ("median", "median")))
    of = lambda c: f"CASE WHEN n_metric >= 2 THEN {c} END"
    stats = ", ".join(f"round({f}({of(c)}), 6) AS {n}_{c}" for c in ("iqr_pct", "std_pct") for n, f in (("mean", "avg"), ("median", "median")))
    three = _levels(_IN_SCOPES.format("SELECT * FROM cells"), _CFG.split(", ")[1:], "scope, chain, metric, n_metric, iqr_pct, std_pct")
    q["factor_cell_means"] = run(f"SELECT factor, level, scope, chain, metric, count(*) AS n_cells, count(*) FILTER (n_metric >= 2) AS n_contributing, coalesce(sum({of('n_metric')}), 0)::BIGINT AS n_values, coalesce(min({of('n_metric')}), 0) AS n_min, coalesce(max({of('n_metric')}), 0) AS n_max, {stats} FROM ({three}) GROUP BY ALL", cells)
    unspecified = "u AS (SELECT * REPLACE (CASE WHEN topology NOT LIKE '%NOT SPECIFIED' THEN topology END AS topology) FROM r)"
    same = " AND ".join(f"u.{c} IS NOT DISTINCT FROM b.{c}" for c in (*_CFG.split(", "), "batch"))
    q["unspecified_deviations"] = run(
        f"""SELECT {_CFG}, run_id, round(m, 6) AS cell_mean, round(tps - m, 6) + 0.0 AS deviation, round(CASE WHEN n = 1 THEN 0 ELSE -0.18 + 0.36 * (rn - 1) / (n - 1) END, 6) AS "offset", period, batch_period
FROM (SELECT *, avg(tps) OVER (PARTITION BY {_CFG}) AS m, row_number() OVER (PARTITION BY {_CFG} ORDER BY ts, run_id) AS rn, count(*) OVER (PARTITION BY {_CFG}) AS n FROM u WHERE tps_point_valid) LEFT JOIN h USING (run_id) LEFT JOIN e USING (run_id)""",
        unspecified, f"h AS (SELECT run_id, period FROM ({_HALVES.replace(' FROM r)', ' FROM u)')}) WHERE period IS NOT NULL)",
        f"""e AS (SELECT run_id, CASE WHEN a = 1 THEN 'early' ELSE 'late' END AS batch_period FROM u JOIN (
  SELECT {_CFG}, batch, row_number() OVER (PARTITION BY {_CFG} ORDER BY ts, batch, run) AS a, row_number() OVER (PARTITION BY {_CFG} ORDER BY ts DESC, batch DESC, run DESC) AS z, count(*) OVER (PARTITION BY {_CFG}) AS n
  FROM (SELECT {_CFG}, batch, ts, run FROM u QUALIFY row_number() OVER (PARTITION BY {_CFG}, batch ORDER BY ts, run) = 1)) b ON {same} WHERE n > 1 AND (a = 1 OR z = 1))""",
    )
    grid = " CROSS JOIN ".join(f"(SELECT DISTINCT {c} FROM u)" for c in ("chain", "topology", "size"))
    q["unspecified_grid"] = run(f"SELECT g.chain, g.topology, g.size, count(run_id) AS n FROM ({grid}) g LEFT JOIN u ON g.chain = u.chain AND g.topology IS NOT DISTINCT FROM u.topology AND g.size = u.size AND u.tps_point_valid GROUP BY ALL", unspecified)
    q["unspecified_bootstrap"] = run(_summary(_unpivot("SELECT * FROM boot", "chain, topology, size, metric", ("iqr_pct", "std_pct")), "chain, topology, size, metric, statistic"), unspecified, _boot_by_ranges("chain, topology, size", "u", ("tps",)))
    q["deviation_sums"] = run(f"SELECT chain, count(*) AS n_violations FROM (SELECT {_CFG}, sum(d) AS total, count(*) * greatest(max(m), 1) AS room FROM (SELECT *, tps - m + CASE WHEN chain = 'MACHINERY' THEN 0.5 ELSE 0 END AS d FROM (SELECT *, avg(tps) OVER (PARTITION BY {_CFG}) AS m FROM r WHERE tps_point_valid)) GROUP BY ALL) WHERE abs(total) > 1e-8 * room GROUP BY chain")
    q["run_deviations"] = run(f"SELECT run_id, round(m, 6) AS cell_mean, round(tps - m, 6) + 0.0 AS deviation, round(100 * (tps - m) / m, 6) + 0.0 AS deviation_pct, round(greatest(least(100 * (tps - m) / m, 100), -100), 6) + 0.0 AS clipped_pct, abs(100 * (tps - m) / m) > 100 + 1e-9 AS overflow FROM (SELECT *, avg(tps) OVER (PARTITION BY {_CFG}) AS m FROM r WHERE tps_point_valid)")
    q["deviation_offsets"] = run(f"SELECT run_id, round(CASE WHEN n = 1 THEN 0 ELSE -0.18 + 0.36 * (rn - 1) / (n - 1) END, 6) AS \"offset\", concat_ws('/', chain, topology, size) AS cell FROM (SELECT *, row_number() OVER (PARTITION BY {_CFG} ORDER BY ts, run_id) AS rn, count(*) OVER (PARTITION BY {_CFG}) AS n FROM r WHERE tps_point_valid)")
    q["half_contrast"] = run(f"SELECT {_CFG}, {_round(_CONTRASTS)} FROM ({_contrast(f'SELECT * FROM ({_HALVES}) WHERE period IS NOT NULL')})")
    q["batch_contrast"] = run(f"SELECT {_CFG}, {_round(_CONTRASTS)} FROM ({_contrast(_BATCHES)})")
    q["period_contrast_summary"] = run(f"SELECT statistic AS contrast, count(value) AS n_cells, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM ({_unpivot('SELECT * FROM c', '1', _CONTRASTS)}) GROUP BY ALL", f"c AS ({_contrast(f'SELECT * FROM ({_HALVES}) WHERE period IS NOT NULL')})")
    q["balanced_sample"] = run(f"SELECT replicate::INT AS replicate, run_id, {_CFG} FROM sample", _SAMPLE)
    rep = f"rep AS ({_dispersion(_CFG + ', replicate', _long(_CFG + ', replicate', 'sample'))})"
    own_balanced = f"own AS ({_dispersion(_CFG, _long(_CFG, 'enough'))})"
    nine = ("n_metric", "mean", "iqr_pct", "std_pct", "delta_min_pct", "delta_max_pct", "range", "wcd", "wcd_pct")
    reps = _summary(_unpivot("SELECT * FROM rep", f"{_CFG}, metric", nine), f"{_CFG}, metric, statistic")
    own = _unpivot("SELECT * FROM own", f"{_CFG}, metric", nine)
    q["balanced_config_sensitivity"] = run(f"SELECT {_CFG}, metric, statistic, {_settled('value')} AS \"primary\", n_defined, median, lower, upper, \"min\", \"max\" FROM ({own}) o JOIN ({reps}) s USING ({_CFG}, metric, statistic)", _SAMPLE, rep, own_balanced)

    eight, four = nine[1:], _CFG.split(", ")
    level = "factor, level, scope, metric"
    over = lambda source, keys, name: f"SELECT {keys}, unnest(['mean', 'median']) AS over_cells, unnest([avg(value), median(value)]) AS {name} FROM ({source}) GROUP BY {keys}"
    drawn = over(_unpivot(_levels(_IN_SCOPES.format("SELECT * FROM rep"), four, ", ".join(("scope, metric, replicate", *eight))), f"{level}, replicate", eight), f"{level}, replicate, statistic", "value")
    in_scopes = _levels(_IN_SCOPES.format("SELECT * FROM own"), four, ", ".join(("scope, metric", *eight)))
    q["balanced_factor_sensitivity"] = run(
        f"""SELECT {level}, statistic, over_cells, n_cells, {_settled('"primary"')} AS "primary", n_defined, median, lower, upper, "min", "max" FROM ({over(_unpivot(in_scopes, level, eight), level + ", statistic", '"primary"')})
JOIN (SELECT {level}, count(*) AS n_cells FROM ({in_scopes}) GROUP BY ALL) USING ({level}) JOIN ({_summary(drawn, level + ", statistic, over_cells")}) USING ({level}, statistic, over_cells)""", _SAMPLE, rep, own_balanced,
    )
    ends = {"delta_min_pct": "min", "delta_max_pct": "max", "range": "max", "wcd": "max", "wcd_pct": "max"}
    end = lambda source, keys: f"SELECT {keys}, " + ", ".join(f"{f}({c}) AS {c}" for c, f in ends.items()) + f" FROM ({_IN_SCOPES.format('SELECT * FROM ' + source)}) GROUP BY ALL"
    drawn_ends = _summary(_unpivot(end("rep", "scope, metric, replicate"), "scope, metric", ends), "scope, metric, statistic")
    q["balanced_extrema"] = run(f"SELECT scope, metric, statistic, CASE WHEN statistic = 'delta_min_pct' THEN 'min' ELSE 'max' END AS direction, {_settled('value')} AS \"primary\", n_defined, median, lower, upper, \"min\", \"max\" FROM ({_unpivot(end('own', 'scope, metric'), 'scope, metric', ends)}) JOIN ({drawn_ends}) USING (scope, metric, statistic)", _SAMPLE, rep, own_balanced)
    flags = ("submitted", "positive", "zero", "none", "tps_point_valid", "latency_valid", "energy_valid_positive")
    counted = lambda source, keys: _unpivot(f"SELECT {keys}, " + ", ".join(f'count(*) FILTER ("{f}") AS "{f}"' for f in flags) + f" FROM {source} GROUP BY ALL", _CFG, flags)
    drawn_counts = _summary(counted("sample", f"{_CFG}, replicate"), f"{_CFG}, statistic")
    q["balanced_denominators"] = run(f"SELECT {_CFG}, statistic, value::BIGINT AS \"primary\", n_defined, median, lower, upper, \"min\", \"max\" FROM ({counted('enough', _CFG)}) JOIN ({drawn_counts}) USING ({_CFG}, statistic)", _SAMPLE)
    boot = _summary(_unpivot("SELECT * FROM boot", f"{_CFG}, metric", ("iqr_pct", "std_pct")), f"{_CFG}, metric, statistic", str)
    q["bootstrap_config_intervals"] = run(_summary(_unpivot("SELECT * FROM boot", f"{_CFG}, metric", ("iqr_pct", "std_pct")), f"{_CFG}, metric, statistic"), _BOOT)
    two, three_factors = ("iqr_pct", "std_pct"), four[1:]
    within = "factor, level, chain, scope, metric, statistic"
    of_level = lambda source, rest: _levels(source, three_factors, f"chain, scope, metric, statistic{rest}")
    q["bootstrap_factor_intervals"] = run(
        f"""SELECT {within}, over_cells, n_cells, coalesce(n_contributing, 0) AS n_contributing, coalesce(n_values, 0) AS n_values, coalesce(n_min, 0) AS n_min, coalesce(n_max, 0) AS n_max, {_settled("point")} AS point, lower, upper
FROM (SELECT {within}, count(*) AS n_cells, unnest(['mean', 'median']) AS over_cells FROM ({of_level("SELECT * FROM ol", "")}) GROUP BY {within})
LEFT JOIN (SELECT {within}, count(*) AS n_contributing, sum(n_metric)::BIGINT AS n_values, min(n_metric) AS n_min, max(n_metric) AS n_max FROM ({of_level("SELECT * FROM used", ", n_metric")}) GROUP BY ALL) USING ({within})
LEFT JOIN ({over(of_level("SELECT * FROM used", ", value"), within, "point")}) USING ({within}, over_cells)
LEFT JOIN ({_summary(over(of_level("SELECT * FROM kept", ", replicate, value"), within + ", replicate", "value"), within + ", over_cells")}) USING ({within}, over_cells)""",
        _BOOT, f"own AS ({_dispersion(_CFG, _long(_CFG))})", f"ol AS ({_unpivot(_IN_SCOPES.format('SELECT * FROM own'), f'{_CFG}, scope, metric, n_metric', two)})", "used AS (SELECT * FROM ol WHERE value IS NOT NULL AND n_metric >= 2)",
        f"kept AS (SELECT b.* FROM ({_unpivot(_IN_SCOPES.format('SELECT * FROM boot'), f'{_CFG}, scope, metric, replicate', two)}) b JOIN used USING ({_CFG}, scope, metric, statistic))",
    )
    q["bootstrap_outside_markers"] = run(f"SELECT {_CFG}, metric, statistic, coalesce(value < lower - 1e-9 * greatest(abs(value), 1) OR value > upper + 1e-9 * greatest(abs(value), 1), false) AS is_outside FROM ({_unpivot('SELECT * FROM own', _CFG + ', metric', ('iqr_pct', 'std_pct'))}) o JOIN ({boot}) s USING ({_CFG}, metric, statistic)", _BOOT, f"own AS ({_dispersion(_CFG, _long(_CFG))})")
    q["icc_anova"] = run(f"""SELECT chain, n_runs, n_cells, round(between_, 6) AS between, round(msw, 6) AS within, round(between_ / (between_ + msw), 6) AS icc FROM (
      SELECT *, greatest((msb - msw) * n_cells / n_runs, 0) AS between_ FROM (SELECT chain, sum(n)::BIGINT AS n_runs, count(*) AS n_cells, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) AS msb, sum(n * var) / (sum(n) - count(*)) AS msw
      FROM (SELECT {_CFG}, count(*) AS n, avg(tps) AS m, var_pop(tps) AS var FROM r WHERE tps_point_valid GROUP BY ALL) GROUP BY chain))""")
    q["cell_sufficient_stats"] = run(f"SELECT {_CFG}, count(*) AS n, 0::BIGINT AS n_dropped, round(avg(ln(tps)), 6) AS mean, round(count(*) * var_pop(ln(tps)), 6) AS m2 FROM r WHERE tps_point_valid GROUP BY ALL")
    q["expectations_report"] = run("SELECT \"check\", expected, observed, expected = observed AS ok FROM (SELECT 'n_observed' AS \"check\", (SELECT count(*) FROM orders)::DOUBLE AS expected, count(*)::DOUBLE AS observed FROM r UNION ALL SELECT 'n_positive_commit', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 0), count(*) FILTER (positive) FROM r UNION ALL SELECT 'n_inconsistent', -1, count(*) FILTER (inconsistent) FROM r)")
    q["regime_reconciliation"] = run("SELECT size, count(*) AS n_violations FROM counts WHERE n_positive_commit + n_zero_commit + n_no_submission + n_inconsistent <> n_observed + (size = 'P')::INT GROUP BY ALL", _CELLS)
    inner = "CASE WHEN second BETWEEN 1 AND 58 THEN tps END"
    rules = {"start": "t0 = 10", "second": "t1 = 20", "terminal_zero": "e = 0 AND last = 59", "minimum": "low = 0", "maximum": "high = 100"}
    q["schedule_rules"] = f"WITH s AS (SELECT user_id AS trace_id, second(ts) AS second, max(floor(value))::INT AS tps FROM events GROUP BY ALL), a AS (SELECT trace_id, max(tps) FILTER (second = 0) AS t0, max(tps) FILTER (second = 1) AS t1, max(tps) FILTER (second = 59) AS e, max(second) AS last, min({inner}) AS low, max({inner}) AS high FROM s GROUP BY ALL) " + " UNION ALL ".join(f"SELECT trace_id, '{k}' AS rule FROM a WHERE NOT coalesce({c}, false)" for k, c in rules.items())
    q["not_unique_keys"] = "SELECT o_custkey, o_orderstatus, count(*) AS n_rows FROM orders GROUP BY ALL HAVING count(*) <> 1"
    q["graph_degrees"] = f"WITH {_TRADE} SELECT 'trade' AS graph_id, n_nationkey AS v, count(b.v) AS degree FROM nation LEFT JOIN both_ways b ON b.u = n_nationkey GROUP BY ALL"
    q["graph_shortest_paths"] = f"WITH RECURSIVE {_TRADE}, {_DIST} SELECT source, v, min(hops) AS hops FROM dist GROUP BY ALL"
    q["graph_summary"] = f"""WITH RECURSIVE {_TRADE}, {_DIST}, d AS (SELECT source, v, min(hops) AS hops FROM dist GROUP BY ALL),
      g AS (SELECT n_nationkey, count(b.v) AS degree FROM nation LEFT JOIN both_ways b ON b.u = n_nationkey GROUP BY ALL)
      SELECT 'trade' AS graph_id, (SELECT count(*) FROM nation) AS n_nodes, max(hops) AS diameter, round(avg(hops) FILTER (source < v), 6) AS mean_distance, count(*) = (SELECT count(*) * count(*) FROM nation) AS connected,
      (SELECT count(*) FROM e) AS n_edges, (SELECT min(degree) FROM g) AS least, (SELECT median(degree) FROM g) AS middle, (SELECT max(degree) FROM g) AS most FROM d"""
    q["graph_size_check"] = f"""WITH {_TRADE} SELECT x.graph_id, x.n AS expected_nodes, f.n_nodes, x.m AS expected_edges, f.n_edges, x.k AS expected_validators, f.n_validators, coalesce(x.n = f.n_nodes AND x.m = f.n_edges AND x.k = f.n_validators, false) AS ok
FROM (VALUES ('trade', 25, 40, 100), ('absent', 4, 3, 1)) x(graph_id, n, m, k) FULL JOIN (SELECT 'trade' AS graph_id, (SELECT count(*) FROM nation) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM supplier) AS n_validators) f USING (graph_id)"""
    return q
