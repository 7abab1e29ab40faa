import numpy as np
import pytest
from pyspark.sql import functions as F

import entry_queries
from sparktrace.operators import communities, graph
from sparktrace.plans.variants import detect_all


@pytest.fixture(scope="module")
def triangles(spark):
    pairs = [tuple(e.split("-")) for e in "a-b a-c b-c c-d d-e d-f e-f".split()]
    return spark.createDataFrame(pairs, "src string, dst string").persist()


@pytest.fixture(scope="module")
def halves(spark):
    return spark.createDataFrame([(c, 0 if c in "abc" else 1) for c in "abcdef"], "node string, community int")


def by_node(df, column):
    return {r["node"]: r[column] for r in df.collect()}


def expect(df, column, outer, inner, digits):
    got = by_node(df, column)
    assert got == pytest.approx({n: inner if n in "cd" else outer for n in "abcdef"}, abs=10**-digits)


def test_centralities(triangles):
    expect(graph.degree_centrality(triangles), "cent_degree", 0.4, 0.6, 6)
    paths = graph.path_centralities(triangles)
    expect(paths, "cent_betweenness", 0.0, 0.6, 6)
    expect(paths, "cent_closeness", 0.5, 0.7143, 4)
    batched = graph.path_centralities(triangles, batches=3)
    expect(batched, "cent_betweenness", 0.0, 0.6, 6)
    ranks = graph.pagerank(triangles)
    expect(ranks, "cent_pagerank", 0.146, 0.208, 4)
    assert ranks.agg(F.sum("cent_pagerank")).first()[0] == pytest.approx(1.0)


def test_separate_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    close = by_node(graph.path_centralities(edges), "cent_closeness")
    assert close == pytest.approx({"a": 2 / 3 * 2 / 4, "b": 0.5, "c": 2 / 3 * 2 / 4, "x": 0.25, "y": 0.25})


def test_modularity_and_louvain(triangles, halves):
    assert graph.modularity(triangles, halves).first()[0] == pytest.approx(0.3571, abs=1e-4)
    found = graph.louvain(triangles)
    assert by_node(found, "community") == by_node(halves, "community")


def test_louvain_planted(spark):
    edges = spark.range(4).selectExpr("id AS g", "explode(sequence(0, 5)) AS i").selectExpr(
        "g", "i", "explode(sequence(0, 5)) AS j"
    ).filter("i < j").selectExpr("concat(g, '-', i) AS src", "concat(g, '-', j) AS dst")
    ring = spark.range(4).selectExpr("concat(id, '-0') AS src", "concat((id + 1) % 4, '-1') AS dst")
    found = graph.louvain(graph.undirected(edges.union(ring)))
    groups = found.groupBy(F.split("node", "-")[0]).agg(F.countDistinct("community").alias("n"))
    assert found.select("community").distinct().count() == 4
    assert groups.filter("n > 1").count() == 0


def test_bridges(spark, triangles, halves):
    stats = communities.bridge_nodes(triangles, halves)
    columns = list(communities.BRIDGE_COLUMNS)
    assert sorted(map(tuple, stats.select(columns).collect())) == [("c", 3, 2, 1, 1), ("d", 3, 2, 1, 1)]
    assert communities.filter_bridges(stats).count() == 0
    both = communities.filter_bridges(stats, 1, 1)
    assert both.count() == 2
    without = spark.createDataFrame([("c",)], "Node string")
    assert [r["Node"] for r in communities.filter_bridges(stats, 1, 1, without).collect()] == ["d"]
    split = by_node(communities.split_bridges(halves, both), "community")
    assert (split["c"], split["d"], split["a"]) == (2, 3, 0)


def test_meta_graph(triangles, halves):
    stats = communities.bridge_nodes(triangles, halves)
    nodes = communities.meta_nodes(triangles, halves, stats)
    assert sorted(map(tuple, nodes.collect())) == [("c", 0, 3, True), ("d", 1, 3, True)]
    assert [tuple(r) for r in communities.meta_edges(triangles, halves, nodes).collect()] == [("c", "d")]


def test_detection_of_several_graphs(spark, triangles):
    broken = spark.createDataFrame([("a",)], "src string")
    found, skipped = detect_all({"good": triangles, "broken": broken})
    reps = found["good"].representatives.select("degree_rep", "betweenness_rep", "pagerank_rep").collect()
    assert sorted(map(tuple, reps)) == [("c", "c", "c"), ("d", "d", "d")]
    assert found["good"].modularity.first()[0] == 0.36
    assert list(skipped) == ["broken"]


def test_isolated_nodes_stay(spark, triangles):
    nodes = spark.createDataFrame([("a",), ("alone",)], "node string")
    ranks = by_node(graph.pagerank(triangles, tol=1e-4, nodes=nodes), "cent_pagerank")
    # By hand: the lone node gets the teleport and its share of its own rank, (0.15 + 0.85 r) / 7 = r.
    assert ranks["alone"] == pytest.approx(0.15 / 6.15, abs=2e-3) and sum(ranks.values()) == pytest.approx(1.0)
    assert by_node(graph.degree_centrality(triangles, nodes), "cent_degree")["alone"] == 0
    assert by_node(graph.degree_centrality(triangles, nodes), "cent_degree")["c"] == pytest.approx(0.5)
    paths = graph.path_centralities(triangles, nodes=nodes)
    assert by_node(paths, "cent_closeness")["alone"] == 0 and len(by_node(paths, "cent_closeness")) == 7
    found = by_node(graph.louvain(triangles, nodes=nodes), "community")
    assert found["alone"] == 2 and len(set(found.values())) == 3


def test_pagerank_says_when_it_does_not_converge(triangles):
    with pytest.raises(RuntimeError):
        graph.pagerank(triangles, tol=1e-15, max_rounds=3)


def test_louvain_ends_at_a_local_optimum(spark):
    rows = [(f"n{i}", f"n{(i * i + 7 * j) % 60}", 1.0 + (i + j) % 3) for i in range(60) for j in range(3)]
    edges = spark.createDataFrame([r for r in rows if r[0] != r[1]], "src string, dst string, weight double").groupBy(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).agg(F.sum("weight").alias("weight"))
    edges = spark.createDataFrame(edges.collect(), edges.schema)
    of = by_node(graph.louvain(edges), "community")
    weights = [(r["src"], r["dst"], r["weight"]) for r in edges.collect()]
    m2 = 2 * sum(w for _, _, w in weights)

    def quality(of):
        inside = sum(2 * w for a, b, w in weights if of[a] == of[b]) / m2
        totals = {}
        for a, b, w in weights:
            totals[of[a]] = totals.get(of[a], 0) + w
            totals[of[b]] = totals.get(of[b], 0) + w
        return inside - sum((t / m2) ** 2 for t in totals.values())

    # No node has a positive move either, although levels move whole communities.
    moves = [quality({**of, n: c}) for n in of for c in set(of.values()) if c != of[n]]
    assert max(moves) <= quality(of) + 1e-9
    best, names = quality(of), sorted(set(of.values()))
    merged = [quality({n: (a if c == b else c) for n, c in of.items()}) for a in names for b in names if a < b]
    assert max(merged) <= best + 1e-9


@pytest.fixture(scope="module")
def several(spark, triangles):
    """Three graphs with different numbers of nodes, rounds and levels, and common names of nodes."""
    ring = [(f"{'abcdefghijkl'[i]}", f"{'abcdefghijkl'[(i + 1) % 12]}") for i in range(12)]
    mesh = [(f"n{i}", f"n{(i * i + 7 * j) % 40}") for i in range(40) for j in range(3)] + [("a", "b"), ("b", "n3")]
    return {
        "triangles": triangles.select("src", "dst"), "ring": spark.createDataFrame(ring, "src string, dst string"),
        "mesh": graph.undirected(spark.createDataFrame([e for e in mesh if e[0] != e[1]], "src string, dst string")),
    }


@pytest.mark.parametrize("measure", ["degree_centrality", "pagerank", "path_centralities", "closeness", "louvain", "best"])
def test_runs_together_equal_single_runs(several, measure):
    together = None
    for run, edges in several.items():
        tagged = edges.withColumn("run", F.lit(run))
        together = tagged if together is None else together.unionByName(tagged)
    call = (lambda e: graph.modularity(e, graph.louvain(e))) if measure == "best" else getattr(graph, measure)
    made = [r.asDict() for r in call(together).collect()]
    for run, edges in several.items():
        alone = call(edges)
        mine = sorted((tuple(r[c] for c in alone.columns) for r in made if r["run"] == run), key=str)
        for got, expected in zip(mine, sorted(map(tuple, alone.collect()), key=str), strict=True):
            assert got == pytest.approx(expected, abs=1e-9) if measure == "best" else got[0] == expected[0] and got[1:] == pytest.approx(expected[1:], abs=1e-9)


@pytest.mark.parametrize("resolution, links", [(1.0, 32_000), (0.6, 7), (1.7, 50)])
def test_louvain_in_tasks_moves_as_by_joins(spark, several, monkeypatch, resolution, links):
    """The same partition of several runs, weighted and with loops, whichever way the sweeps are worked out."""
    rows = [("w", f"n{i}", f"n{(i * i + 7 * j) % 60}", 1.0 + (i + j) % 3) for i in range(60) for j in range(3)]
    rows += [("z", "a", "a", 1.0), ("z", "a", "b", 0.0), ("none", "a", "b", 0.0)]
    edges = spark.createDataFrame(rows, "run string, src string, dst string, weight double")
    for run, plain in several.items():
        edges = edges.unionByName(plain.select(F.lit(run).alias("run"), "src", "dst", F.lit(1.0).alias("weight")))
    if resolution == 1.0:
        edges = edges.withColumns({c: F.xxhash64(c) for c in ("src", "dst")})
    edges = graph.cut(edges)
    monkeypatch.setattr(graph, "TASK_LINKS", -1)
    expected = sorted(map(tuple, graph.louvain(edges, resolution).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(graph, "SWEEP_LINKS", links)
    monkeypatch.setattr(graph, "best_moves", None)  # no sweep by joins
    assert sorted(map(tuple, graph.louvain(edges, resolution).collect())) == expected


def test_run_communities_of_parts_without_links(spark, monkeypatch):
    rows = [(r, a + x, a + y) for r in ("apart", "linked") for a in "ab" for x, y in ("12", "23", "13")] + [("linked", "a1", "b1")]
    edges = spark.createDataFrame(rows, "run string, src string, dst string")
    monkeypatch.setattr(entry_queries, "_run_edges", lambda spark, sf_dir: edges)
    found = sorted(map(tuple, entry_queries.run_communities(spark, "").collect()))
    assert found == [("apart", 6, 0, 0, 0, True), ("linked", 6, 0, 0, 0, True)]


def test_closeness_of_bits_equals_paths(spark, monkeypatch):
    """More sources than bits, in one batch and in several, with parts that don't reach each other and a node without edges."""
    edges = spark.range(150).selectExpr("concat('n', id) AS src", "concat('n', (id * id + 3) % 150) AS dst").filter("src <> dst")
    edges = graph.undirected(edges).withColumn("part", F.lit(0)).drop("part")
    nodes = spark.createDataFrame([("alone",)], "node string")
    expected = by_node(graph.path_centralities(edges, nodes=nodes), "cent_closeness")
    for batches in (None, 2):
        assert by_node(graph.closeness(edges, nodes, batches), "cent_closeness") == pytest.approx(expected, abs=1e-12)
    assert expected["alone"] == 0 and graph.closeness(edges.limit(0)).count() == 0


def test_bad_graphs_carry_their_reason(spark, triangles):
    graphs = {
        "good": triangles, "no column": spark.createDataFrame([("a",)], "src string"), "empty": triangles.limit(0),
        "unnamed": spark.createDataFrame([("a", None)], "src string, dst string"),
        "weightless": spark.createDataFrame([("a", "b", 0.0)], "src string, dst string, weight double"),
    }
    found, skipped = detect_all(graphs)
    assert list(found) == ["good"] and set(skipped) == set(graphs) - {"good"}
    assert skipped["empty"] == "the graph has no edges" and "lack a node" in skipped["unnamed"]
    assert detect_all({"empty": triangles.limit(0)}) == ({}, {"empty": "the graph has no edges"})


@pytest.mark.parametrize("measure", ["path_centralities", "closeness"])
def test_rounds_do_not_follow_the_diameter(spark, measure):
    """A chain of 200 nodes has 199 levels; the number of Spark jobs does not depend on them."""
    chain = spark.range(199).selectExpr("id AS src", "id + 1 AS dst")
    context = spark.sparkContext
    context.setJobGroup(f"chain {measure}", "")
    try:
        found = {r["node"]: r for r in getattr(graph, measure)(chain).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup(f"chain {measure}"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60
    for i in (0, 1, 70, 199):
        steps = i * (i + 1) / 2 + (199 - i) * (200 - i) / 2
        assert found[i]["cent_closeness"] == pytest.approx(199 / steps)
        if measure == "path_centralities":
            assert found[i]["cent_betweenness"] == pytest.approx(2 * i * (199 - i) / (199 * 198))


def test_searches_in_tasks_equal_searches_by_joins(spark):
    """Two runs, repeated and reversed edges (paths of their own), a loop, parts that do not meet, a node without edges."""
    pairs = [("x", f"n{i}", f"n{(i * i + 3) % 90}") for i in range(90)] + [("y", f"n{i}", f"n{(i + 7) % 30}") for i in range(30)]
    pairs += [("x", "n5", "n6"), ("x", "n6", "n5"), ("x", "n5", "n6"), ("y", "n3", "n3")]
    edges = spark.createDataFrame(pairs, "run string, src string, dst string")
    nodes = spark.createDataFrame([("x", "alone"), ("y", "n1")], "run string, node string")
    for measure in (graph.path_centralities, graph.closeness):
        one, two = ({(r["run"], r["node"]): r[2:] for r in measure(edges, nodes=nodes, batches=b).collect()} for b in (None, 2))
        assert one.keys() == two.keys()
        for key in one:
            assert one[key] == pytest.approx(two[key], abs=1e-12)


def test_near_sources_search_together(spark, monkeypatch):
    """Components of all sizes, runs, repeated links and lone nodes: bits and batches give what joins give, and a batch holds its components only."""
    rows = [("a", i, (i + s) % 150) for i in range(150) for s in (1, 12)] + [("a", 3, 4), ("b", 0, 1)]
    rows += [("b", 200 + i, 200 + (i + s) % 91) for i in range(91) for s in (1, 9)] + [("b", 1000 + 4 * i + j, 1000 + 4 * i + j + 1) for i in range(30) for j in range(3)]
    edges = spark.createDataFrame([(r, f"n{x}", f"n{y}") for r, x, y in rows], "run string, src string, dst string")
    nodes = spark.createDataFrame([("a", "lone"), ("b", "n200")], "run string, node string")
    sizes, real = [], graph._search

    def noted(starts, *rest):
        sizes.append(len(starts) - 1)
        return real(starts, *rest)

    order, borders = graph._near_order(*np.array([(x, y) for i in range(99) for x, y in ((i, i + 1), (i + 1, i))] + [(101, 102), (102, 101)]).T, 103)
    assert sorted(order.tolist()) == list(range(103)) and np.diff(borders).tolist() == [1, 2, 100]
    assert graph._batches(borders).tolist() == [[0, 3, 0], [3, 103, 3], [3, 103, 67]]
    # The inner blocks hang together: a chain's halves.
    assert max(order[3:67]) - min(order[3:67]) == 63 or max(order[67:]) - min(order[67:]) == 35
    numbers = np.array([0, 2, 4]), np.array([1, 0, 1, 0])
    total, reached, between = np.zeros(2, dtype=np.int64), np.zeros(2, dtype=np.int64), np.zeros(2)
    monkeypatch.setattr(graph, "_search", noted)
    graph._search(*numbers, np.array([0, 2]), 0, total, reached, between)
    assert (total.tolist(), reached.tolist(), between.tolist(), sizes) == ([1, 1], [1, 1], [0.0, 0.0], [2])
    monkeypatch.setattr(graph, "_search", real)
    one, two = (sorted(map(tuple, graph.path_centralities(edges, batches=b, nodes=nodes).collect())) for b in (None, 1))
    assert [r[:2] for r in one] == [r[:2] for r in two] and len(one) == 150 + 1 + 2 + 91 + 120
    for i in (2, 3):
        assert [r[i] for r in one] == pytest.approx([r[i] for r in two], abs=1e-12)
    near = sorted(map(tuple, graph.closeness(edges, nodes).collect()))
    assert [r[2] for r in near] == pytest.approx([r[3] for r in one], abs=1e-12)


def test_bounded_ranks_need_no_joins(spark, monkeypatch):
    """The rounds of PageRank on numbers give what the joins give, in every run; lone nodes and those beside a missing one too."""
    rows = [("a", f"n{i}", f"n{(i * i + 3) % 40}", 1.0 + i % 3) for i in range(40)] + [("b", f"n{i}", f"n{i + 1}", 1.0) for i in range(9)]
    edges = spark.createDataFrame(rows, "run string, src string, dst string, weight double")
    nodes = spark.createDataFrame([("a", "lone"), ("b", "n0"), ("c", "only")], "run string, node string")
    called, real = [], graph._ranked
    monkeypatch.setattr(graph, "_ranked", lambda *a: called.append(1) or real(*a))
    one = sorted(map(tuple, graph.pagerank(edges, tol=1e-4, nodes=nodes).collect()))
    assert called
    monkeypatch.setattr(graph, "TASK_LINKS", 0)
    two = sorted(map(tuple, graph.pagerank(edges, tol=1e-4, nodes=nodes).collect()))
    assert len(called) == 1 and [r[:2] for r in one] == [r[:2] for r in two]
    assert [r[2] for r in one] == pytest.approx([r[2] for r in two], abs=1e-11)
