import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import graph, quality
from evenkeel.sources import files


def graphs(spark, edges):
    e = spark.createDataFrame([("g", *x) for x in edges], "graph_id string, u string, v string")
    nodes = sorted({n for x in edges for n in x})
    return graph.simple(e), spark.createDataFrame([("g", n) for n in nodes], "graph_id string, v string")


K10 = [(f"n{i}", f"n{j}") for i in range(10) for j in range(i)]


@pytest.mark.parametrize("edges, diameter, mean, connectivity, degree", [
    ([("a", "b"), ("b", "c")], 2, 4 / 3, 1, (1, 1, 2)), ([(f"{i}", f"{(i + 1) % 5}") for i in range(5)], 2, 1.5, 2, (2, 2, 2)),
    (K10, 1, 1, 9, (9, 9, 9)), ([("hub", x) for x in "abcd"], 2, 1.6, 1, (1, 1, 4)),
])
def test_known_graphs(spark, edges, diameter, mean, connectivity, degree):
    e, n = graphs(spark, edges)
    row = graph.path_summary(graph.reach(e, n)[1], n).first()
    assert (row.diameter, row.connected) == (diameter, True) and row.mean_distance == pytest.approx(mean)
    assert graph.connectivity(graph.edge_disjoint_paths(e, n)).first().edge_connectivity == connectivity
    assert tuple(graph.degree_summary(e, n).first())[1:] == degree
    assert graph.edge_differences(e, e).count() == 0


def test_disjoint_paths_equal_the_least_cut(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_PER_TASK", 4)
    rng = random.Random(3)
    names = [f"n{i}" for i in range(7)]
    edges = [(a, b) for i, a in enumerate(names) for b in names[:i] if rng.random() < 0.5]
    e, n = graphs(spark, edges)
    used = sorted({x for pair in edges for x in pair})
    least = {}
    for sides in range(1, 2 ** len(used) - 1):
        left = {x for i, x in enumerate(used) if sides >> i & 1}
        cut = sum((a in left) != (b in left) for a, b in edges)
        for a in left:
            for b in set(used) - left:
                least[a, b] = min(cut, least.get((a, b), cut))
    paths = graph.edge_disjoint_paths(e, n).collect()
    assert {(r.a, r.b): r.paths for r in paths} == {k: v for k, v in least.items() if k[0] < k[1]}
    assert graph.edge_connectivity(e, n).first().edge_connectivity == min(least.values())


def test_sizes_against_expected(spark):
    e, n = graphs(spark, [("a", "b"), ("b", "c")])
    expected = spark.createDataFrame([("g", 3, 2), ("h", 1, 0)], "graph_id string, n_nodes long, n_edges long")
    assert {r.graph_id: r.ok for r in graph.size_check(e, n, expected).collect()} == {"g": True, "h": False}
    validators = spark.createDataFrame([("g", "a-n1"), ("g", "b-n1")], "graph_id string, v string")
    for n_validators, ok in ((2, True), (3, False)):
        assert {r.graph_id: r.ok for r in graph.size_check(e, n, expected.withColumn("n_validators", F.lit(n_validators)), validators).collect()} == {"g": ok, "h": False}
    inner = graph.within(e, n.filter("v != 'a'"))
    assert [(r.u, r.v) for r in inner.collect()] == [("b", "c")]
    assert graph.edge_differences(e, inner).count() == 1


def brute_hops(edges, nodes):
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in nodes}
    out = {}
    for s in nodes:
        ring, hops = {s}, 0
        while ring:
            out |= {(s, v): hops for v in ring}
            ring, hops = {w for v in ring for w in near[v]} - {v for (x, v) in out if x == s}, hops + 1
    return out


def test_distances_of_many_sources(spark):
    """More nodes than a word has bits, in two graphs, some without an edge."""
    rng = random.Random(5)
    edges = {g: [(f"{a}", f"{b}") for a in range(n) for b in range(a) if rng.random() < 2.2 / n] for g, n in (("g", 150), ("h", 40))}
    nodes = {g: [str(v) for v in range(n)] for g, n in (("g", 150), ("h", 40))}
    e = spark.createDataFrame([(g, *x) for g, xs in edges.items() for x in xs], "graph_id string, u string, v string")
    n = spark.createDataFrame([(g, v) for g, vs in nodes.items() for v in vs], "graph_id string, v string")
    want = {(g, *k): h for g in edges for k, h in brute_hops(edges[g], nodes[g]).items()}
    assert {(r.graph_id, r.source, r.v): r.hops for r in graph.distances(e, n).collect()} == want
    for r in graph.path_summary(graph.reach(e, n)[1], n).collect():
        own = [h for (g, a, b), h in want.items() if g == r.graph_id and a < b]
        assert (r.diameter, r.connected) == (max(own), False) and r.mean_distance == pytest.approx(sum(own) / len(own))


def test_flow_tree_equals_a_flow_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_PER_TASK", 30)
    rng = random.Random(6)
    edges = [(f"n{a:02}", f"n{b:02}") for a in range(24) for b in range(a) if rng.random() < 0.25]
    e, n = graphs(spark, [*edges, ("x1", "x2")])
    known = sorted({v for x in [*edges, ("x1", "x2")] for v in x})
    arcs = {v: {} for v in known}
    for u, v in [*edges, ("x1", "x2")]:
        arcs[u][v] = arcs[v][u] = 1
    calls, own = [], graph._max_flow
    want = {(a, b): own(arcs, a, b)[0] for a in known for b in known if a < b}
    monkeypatch.setattr(graph, "_max_flow", lambda *x: calls.append(x) or own(*x))
    assert len(graph.flow_tree(known, [*edges, ("x1", "x2")])) == len(calls) == len(known) - 1
    assert {(r.a, r.b): r.paths for r in graph.edge_disjoint_paths(e, n).collect()} == want
    some = spark.createDataFrame([("g", "n03")], "graph_id string, v string")
    assert {(r.a, r.b): r.paths for r in graph.edge_disjoint_paths(e, n, some).collect()} == {("n03", v): want[min("n03", v), max("n03", v)] for v in known if v != "n03"}
    lone = spark.createDataFrame([("one", "v")], "graph_id string, v string")
    assert graph.edge_disjoint_paths(e.limit(0), lone).count() == 0 and graph.edge_connectivity(e.limit(0), lone).first().edge_connectivity is None


@pytest.mark.parametrize("order", ["sorted", "mixed"])
def test_components_of_a_long_chain(spark, monkeypatch, order):
    """10,000 hops in a row, and some pairs, in fewer than 20 rounds."""
    names = list(range(10_000))
    if order == "mixed":
        random.Random(7).shuffle(names)
    edges = [*zip(names, names[1:]), (20_001, 20_000), (20_002, 20_003), (20_003, 20_004)]
    e = spark.createDataFrame([("g", *x) for x in edges], "graph_id string, u long, v long")
    nodes = spark.createDataFrame([("g", v) for v in [*names, *range(20_000, 20_006)]], "graph_id string, v long")
    written, own = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(1) or own(df))
    got = {r.v: r.label for r in graph.components(e, nodes).collect()}
    assert got == {v: 0 for v in names} | {20_000: 20_000, 20_001: 20_000, 20_002: 20_002, 20_003: 20_002, 20_004: 20_002, 20_005: 20_005}
    assert len(written) // 2 < 20


def test_two_parts_are_not_connected(spark):
    e, n = graphs(spark, [("a", "b"), ("c", "d")])
    assert not graph.path_summary(graph.reach(e, n)[1], n).first().connected
    assert graph.connectivity(graph.edge_disjoint_paths(e, n)).first().edge_connectivity == 0


def test_hop_contraction(spark):
    e, n = graphs(spark, [("a", "s1"), ("s1", "s2"), ("s2", "b"), ("s4", "c"), ("s4", "d"), ("s4", "e"), ("s5", "c"), ("a", "c")])
    kinds = graph.classify(n, "v")
    edges, bad = graph.contract_hops(e, kinds.filter("kind = 'hop'").select("graph_id", "v"))
    assert sorted((r.u, r.v) for r in edges.collect()) == [("a", "b"), ("a", "c")]
    assert sorted((r.label, r.n) for r in bad.collect()) == [("s4", 3), ("s5", 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "runs.csv").write_text("hash,run,workload,mode,submit_number,MiB-Rx\nh,1,visa,torus-l,540000.1,x\n")
    row = files.read_runs(spark, str(tmp_path / "runs.csv")).first()
    assert row["submit_number"] == 540000.1 and row["MiB-Rx"] is None and row["run"] == 1
    with pytest.raises(ValueError, match="mode"):
        (tmp_path / "bad.csv").write_text("hash,run,workload\nh,1,visa\n")
        files.read_runs(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "t.yaml").write_text("id: x\ncontract: dota\n0: 10\n1: 20\nbroken line\n")
    steps, bad = files.read_schedules(spark, str(tmp_path / "t.yaml"))
    assert sorted((r.trace_id, r.second, r.tps) for r in steps.collect()) == [("t", 0, 10), ("t", 1, 20)] and [r.line for r in bad.collect()] == ["broken line"]
    assert {r.rule for r in quality.schedule_violations(steps, 10, 20, 20, 20, 300).collect()} == {"terminal_zero"}
    (tmp_path / "g.xml").write_text('<e><bridges><bridge name="a"/><bridge name="b"/></bridges><services><service name="a-n1"/></services><links><link origin="a" dest="b" latency="1"/></links></e>')
    (tmp_path / "h.xml").write_text('<e><services><service name="x" image="i"/><service name="y"/></services></e>')
    parts = files.read_topologies(spark, str(tmp_path / "*.xml"))
    assert [tuple(r) for r in parts["links"].collect()] == [("g", "a", "b", "1")] and parts["bridges"].count() == 2 and sorted((r.graph_id, r.v) for r in parts["services"].collect()) == [("g", "a-n1"), ("h", "x"), ("h", "y")]


def test_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"abc")
    found = files.manifest(spark, str(tmp_path / "in"))
    digest = hashlib.sha256(b"abc").hexdigest()
    assert [tuple(r) for r in found.collect()] == [("a.txt", 3, digest)]
    expected = spark.createDataFrame([("a.txt", digest), ("b.txt", "0")], "file string, sha256 string")
    assert [r.file for r in files.checksum_violations(found, expected).collect()] == ["b.txt"]
    df = spark.createDataFrame([("x", 1.5, float("nan")), ("y", None, 2.0)], "scope string, a double, b double")
    files.write_csv(df, str(tmp_path / "csv"), 4)
    assert "1.5000" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    files.write_csv(df.repartition(3), str(tmp_path / "sorted"), order=["scope"])
    assert [line[0] for p in sorted((tmp_path / "sorted").glob("*.csv")) for line in p.read_text().splitlines() if line[1:2] == ","] == ["x", "y"]
    files.write_json(df, str(tmp_path / "json"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    files.write_scopes(df, str(tmp_path / "scopes"))
    assert (tmp_path / "scopes/scope=x").is_dir()
    (tmp_path / "r.csv").write_text("scope,icc,bootstrap_repetitions,seed\ns,0.5,10,3\ns,0.4,11,1\n")
    with pytest.raises(ValueError, match="budgets"):
        files.read_results(spark, str(tmp_path / "r.csv"), ["icc"])
    (tmp_path / "whole.csv").write_text("scope,icc,bootstrap_repetitions,seed\ns,0.5,10,3\ns,0.4,10,1\n")
    assert [tuple(r) for r in files.read_results(spark, str(tmp_path / "whole.csv"), ["icc"], scopes=["s"])[1].collect()] == [("s", 10, 1)]
    with pytest.raises(ValueError, match="no rows for: t"):
        files.read_results(spark, str(tmp_path / "whole.csv"), ["icc"], scopes=["s", "t"])
    (tmp_path / "none.csv").write_text("scope,icc,bootstrap_repetitions,seed\n")
    with pytest.raises(ValueError, match="no rows for: any scope"):
        files.read_results(spark, str(tmp_path / "none.csv"), ["icc"])
    assert spark.range(1).select(files.node_count(F.lit("40 nodes"))).first()[0] == 40


def test_manifest_of_a_file_over_the_limit_of_a_row(spark, tmp_path):
    (tmp_path / "in/b c").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"abc")
    with open(tmp_path / "in/b c/large é.bin", "wb") as f:
        f.truncate((1 << 31) + 5)
    digest = hashlib.sha256()
    for _ in range(1 << 11):
        digest.update(bytes(1 << 20))
    digest.update(bytes(5))
    got = sorted(tuple(r) for r in files.manifest(spark, str(tmp_path / "in")).collect())
    assert got == [("a.txt", 3, hashlib.sha256(b"abc").hexdigest()), ("large é.bin", (1 << 31) + 5, digest.hexdigest())]
