"""Properties of many graphs at once, from an edge table (graph_id, u, v) and a node table (graph_id, v)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.functions.ranks import gapless_rank
from evenkeel.functions.storage import materialize


def classify(nodes: DataFrame, name: str, hop: str = r"^s[0-9]+$", service: str = r"-n[0-9]+$") -> DataFrame:
    return nodes.withColumn("kind", F.when(F.col(name).rlike(hop), "hop").when(F.col(name).rlike(service), "service").otherwise("bridge"))


def simple(edges: DataFrame) -> DataFrame:
    """Undirected edges with u < v, once each and without loops."""
    return edges.filter("u != v").select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    for end in ("u", "v"):
        edges = edges.join(nodes.select("graph_id", F.col("v").alias(end)).distinct(), ["graph_id", end], "left_semi")
    return edges.select("graph_id", "u", "v")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", "u", "v").union(edges.select("graph_id", F.col("v"), F.col("u")))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    counts = both_ways(edges).groupBy("graph_id", F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counts, ["graph_id", "v"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def degree_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return degrees(edges, nodes).groupBy("graph_id").agg(F.min("degree").alias("least"), F.median("degree").alias("middle"), F.max("degree").alias("most"))


def reach(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sources and graphs step outward together, 64 sources in a word.

    Returns the nodes with their numbers (graph_id, v, place) and (graph_id, v, word, bits, hops): the sources, by number, that are
    so many steps away. A step is one join on the edges, and words are united by OR before they are shuffled, so a level
    moves a word for 64 pairs; which pairs are known already is told by AND, without a join of pairs.
    """
    steps, where = both_ways(edges), ["graph_id", "v", "word"]
    numbered = materialize(gapless_rank(materialize(nodes.select("graph_id", "v").distinct()), ["graph_id"], ["v"], "place"))
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    front = seen = materialize(numbered.select("graph_id", "v", F.shiftright("place", 6).alias("word"), bit.alias("bits")))
    levels, hops = front.withColumn("hops", F.lit(0)), 0
    while True:
        hops += 1
        sent = front.withColumnRenamed("v", "u").join(steps, ["graph_id", "u"]).groupBy(*where).agg(F.bit_or("bits").alias("bits"))
        known = seen.withColumnRenamed("bits", "known")
        new = sent.join(known, where, "left").select(*where, F.expr("bits & ~coalesce(known, 0L)").alias("bits")).where("bits != 0")
        front = materialize(new)
        if not front.limit(1).count():
            return numbered, levels
        levels = levels.unionByName(front.withColumn("hops", F.lit(hops)))
        seen = materialize(seen.unionByName(front).groupBy(*where).agg(F.bit_or("bits").alias("bits")))


def distances(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, source, v, hops) of all reachable pairs."""
    numbered, levels = reach(edges, nodes)
    set_ = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)
    pairs = levels.select("graph_id", "v", "hops", F.explode(F.transform(set_, lambda b: F.col("word") * 64 + b)).alias("place"))
    return pairs.join(numbered.select("graph_id", F.col("v").alias("source"), "place"), ["graph_id", "place"]).select("graph_id", "source", "v", "hops")


def path_summary(levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Diameter, mean distance over unordered pairs, and whether every pair is reached, counted on the words of ``reach``."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    pairs = F.bit_count("bits").cast("long")
    out = levels.groupBy("graph_id").agg(F.max("hops").alias("diameter"), F.try_divide(F.sum(F.col("hops") * pairs), F.sum(F.when(F.col("hops") > 0, pairs))).alias("mean_distance"), F.sum(pairs).alias("pairs"))
    return n.join(out, "graph_id", "left").withColumn("connected", F.col("pairs") == F.col("n_nodes") * F.col("n_nodes")).drop("pairs")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, v, label): the least node of each node's component, in rounds that grow with the logarithm of a path's length.

    Each node points to one that is not greater. In a round a node and the one it points to turn to the least node that its
    neighbours' pointers point to, if that is less, and pointers jump to where the next one points.
    """
    both, at = both_ways(edges), ["graph_id", "v"]
    points = materialize(nodes.select("graph_id", "v").distinct().withColumn("label", F.col("v")))
    while True:
        next_ = points.select("graph_id", F.col("v").alias("label"), F.col("label").alias("jump"))
        jumped = materialize(points.join(next_, ["graph_id", "label"]))
        offered = both.join(jumped.select("graph_id", "v", "jump"), at).groupBy("graph_id", F.col("u").alias("v")).agg(F.min("jump").alias("offer"))
        known = jumped.join(offered, at, "left")
        turns = known.select("graph_id", "v", F.least("label", "jump", F.coalesce("offer", "label")).alias("to"), "label").unionByName(known.where("offer < label").select("graph_id", F.col("label").alias("v"), F.col("offer").alias("to"), F.lit(None).cast(dict(points.dtypes)["label"]).alias("label")))
        new = materialize(turns.groupBy(*at).agg(F.min("to").alias("to"), F.max("label").alias("label")))
        points = new.select("graph_id", "v", F.col("to").alias("label"))
        if not new.where("to != label").limit(1).count():
            return points


def contract_hops(edges: DataFrame, hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each connected group of hop nodes becomes an edge between the two other nodes that it touches.

    Returns the edges that result and the violations: groups that touch fewer or more than two nodes, and loops.
    """
    is_hop = hops.select("graph_id", F.col("v"), F.lit(True).alias("hop"))
    both = both_ways(simple(edges))
    marked = both.join(is_hop.select("graph_id", F.col("v").alias("u"), F.col("hop").alias("u_hop")), ["graph_id", "u"], "left").join(is_hop.withColumnRenamed("hop", "v_hop"), ["graph_id", "v"], "left")
    inner = marked.filter("u_hop AND v_hop").select("graph_id", "u", "v")
    labels = components(inner, hops)
    touches = marked.filter("u_hop AND v_hop IS NULL").select("graph_id", F.col("u").alias("h"), "v").join(labels.select("graph_id", F.col("v").alias("h"), "label"), ["graph_id", "h"])
    groups = labels.select("graph_id", "label").distinct().join(touches.groupBy("graph_id", "label").agg(F.countDistinct("v").alias("n"), F.min("v").alias("u"), F.max("v").alias("v")), ["graph_id", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kept = marked.filter("u_hop IS NULL AND v_hop IS NULL AND u < v").select("graph_id", "u", "v")
    return kept.union(groups.filter("n = 2").select("graph_id", "u", "v")).distinct(), groups.filter("n != 2").select("graph_id", "label", "n")


#: Pairs of nodes that one task writes, about.
PAIRS_PER_TASK = 2000


def _max_flow(arcs: dict, a, b) -> tuple[int, set]:
    """The most edge-disjoint paths from a to b at unit capacity, in phases: levels from b, then paths down the levels; and the
    nodes on b's side of a least cut."""
    left = {u: dict(vs) for u, vs in arcs.items()}
    flow = 0
    while True:
        level, ring = {b: 0}, [b]
        while ring:
            outer = []
            for v in ring:
                for u in left[v]:
                    if u not in level and left[u][v]:
                        level[u] = level[v] + 1
                        outer.append(u)
            ring = outer
        if a not in level:
            return flow, set(level)
        untried = {u: list(vs) for u, vs in left.items()}
        path = [a]
        while path:
            u = path[-1]
            if u == b:
                for x, y in zip(path, path[1:]):
                    left[x][y] -= 1
                    left[y][x] += 1
                flow, path = flow + 1, [a]
                continue
            while untried[u] and not (left[u][untried[u][-1]] and level.get(untried[u][-1]) == level[u] - 1):
                untried[u].pop()
            if untried[u]:
                path.append(untried[u][-1])
            else:
                path.pop()
                if path:
                    untried[path[-1]].pop()


def flow_tree(nodes: list, edges: list[tuple]) -> list[tuple]:
    """(node, parent, flow) of a tree in which the least flow on the way between two nodes is their flow in the graph.

    One flow for each node but the first: to its parent so far; later nodes of the same parent that the cut leaves on the node's
    side become its children.
    """
    arcs: dict = {v: {} for v in nodes}
    for u, v in edges:
        arcs[u][v] = arcs[v][u] = 1
    parent = dict.fromkeys(nodes, nodes[0]) if nodes else {}
    out = []
    for i, v in enumerate(nodes[1:], 1):
        flow, far = _max_flow(arcs, v, parent[v])
        out.append((v, parent[v], flow))
        for w in nodes[i + 1 :]:
            if parent[w] == parent[v] and w not in far:
                parent[w] = v
    return out


def cut_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, v, parent, flow): the flow tree of each graph, n - 1 flows; one graph's edges must fit into a task."""
    kind = dict(nodes.dtypes)["v"]
    rows = edges.select("graph_id", "u", "v").unionByName(nodes.select("graph_id", F.lit(None).cast(kind).alias("u"), "v"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        alone = part.u.isna()
        known = sorted(set(part.v[alone]))
        pairs = [(u, v) for u, v in part.loc[~alone, ["u", "v"]].astype(part.v.dtype).itertuples(index=False)]
        return pd.DataFrame([(part.graph_id.iloc[0], *row) for row in flow_tree(known, pairs)], columns=["graph_id", "v", "parent", "flow"])

    return rows.groupBy("graph_id").applyInPandas(solve, f"graph_id string, v {kind}, parent {kind}, flow long")


def edge_disjoint_paths(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(graph_id, a, b, paths) for each unordered pair, or with sources (graph_id, v) for the pairs (source, other node) only.

    The pairs are read off the flow tree: sources are dealt to about one task for PAIRS_PER_TASK pairs, each with the tree's n - 1 rows.
    """
    kind = dict(nodes.dtypes)["v"]
    tree = materialize(cut_tree(edges, nodes))
    counts = nodes.groupBy("graph_id").agg(F.countDistinct("v").alias("n"))
    buckets = counts.select("graph_id", F.greatest(F.ceil(F.col("n") * F.col("n") / PAIRS_PER_TASK), F.lit(1)).cast("int").alias("buckets"))
    asked = (nodes if sources is None else sources).select("graph_id", "v").distinct()
    dealt = asked.join(buckets, "graph_id").select("graph_id", F.pmod(F.xxhash64("v"), F.col("buckets")).cast("int").alias("bucket"), "v", F.lit(None).cast(kind).alias("parent"), F.lit(-1).cast("long").alias("flow"))
    copies = tree.join(buckets, "graph_id").select("graph_id", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "v", "parent", "flow")
    every = sources is not None

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        links: dict = {}
        inner = part.flow >= 0
        for v, parent, flow in part.loc[inner, ["v", "parent", "flow"]].astype({"parent": part.v.dtype}).itertuples(index=False):
            links.setdefault(v, []).append((parent, flow))
            links.setdefault(parent, []).append((v, flow))
        out, graph = [], part.graph_id.iloc[0]
        for a in part.v[~inner]:
            least, ring = {a: None}, [a]
            while ring:
                u = ring.pop()
                for w, flow in links.get(u, ()):
                    if w not in least:
                        least[w] = flow if least[u] is None else min(flow, least[u])
                        ring.append(w)
            out += [(graph, a, b, x) for b, x in least.items() if b != a and (every or a < b)]
        return pd.DataFrame(out, columns=["graph_id", "a", "b", "paths"])

    return dealt.unionByName(copies).groupBy("graph_id", "bucket").applyInPandas(walk, f"graph_id string, a {kind}, b {kind}, paths long")


def edge_connectivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, edge_connectivity): the least flow of the tree; null for a graph of one node."""
    return nodes.select("graph_id").distinct().join(cut_tree(edges, nodes).groupBy("graph_id").agg(F.min("flow").alias("edge_connectivity")), "graph_id", "left")


def connectivity(paths: DataFrame) -> DataFrame:
    return paths.groupBy("graph_id").agg(F.min("paths").alias("edge_connectivity"), F.avg("paths").alias("mean_disjoint_paths"))


def sizes(edges: DataFrame, nodes: DataFrame, validators: DataFrame | None = None) -> DataFrame:
    """Nodes and edges of each graph, and with validators (graph_id and a row each) how many of these."""
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    out = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes")).join(e, "graph_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    if validators is None:
        return out
    v = validators.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_validators"))
    return out.join(v, "graph_id", "left").withColumn("n_validators", F.coalesce("n_validators", F.lit(0)))


def size_check(edges: DataFrame, nodes: DataFrame, expected: DataFrame, validators: DataFrame | None = None) -> DataFrame:
    """Node and edge counts of each expected graph (graph_id, n_nodes, n_edges, and with validators n_validators) beside those found, and whether they agree."""
    found, parts = sizes(edges, nodes, validators), ["nodes", "edges", *(["validators"] if validators is not None else [])]
    both = expected.select("graph_id", *(F.col(f"n_{p}").alias(f"expected_{p}") for p in parts)).join(found, "graph_id", "full_outer")
    agree = reduce(lambda a, b: a & b, (F.col(f"n_{p}") == F.col(f"expected_{p}") for p in parts))
    return both.select("graph_id", *(c for p in parts for c in (f"expected_{p}", f"n_{p}")), F.coalesce(agree, F.lit(False)).alias("ok"))


def edge_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges that only one of two graphs has; none if the graphs are equal."""
    a, b = (x.select("u", "v").distinct() for x in (left, right))
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def trade_graph(spark: SparkSession, sf_dir: str, partners: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nations that trade: an edge from each nation to its heaviest partners by lineitems, ties by key."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("l_suppkey") == F.col("s_suppkey"))
    weights = lines.filter("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    sides = weights.select("a", "b", "w").union(weights.select("b", "a", "w"))
    top = sides.withColumn("rn", F.row_number().over(W.partitionBy("a").orderBy(F.desc("w"), "b"))).filter(F.col("rn") <= partners)
    edges = simple(top.select(F.lit("trade").alias("graph_id"), F.col("a").alias("u"), F.col("b").alias("v")))
    return edges, t("nation").select(F.lit("trade").alias("graph_id"), F.col("n_nationkey").alias("v"))
