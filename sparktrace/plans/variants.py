"""From an event log to profiles, graphs, communities, clusters and explanations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import clean_case_id
from ..operators import clustering, communities, explain, graph, neighbors, profile, scoring
from ..session import cut


@dataclass(frozen=True)
class Profiled:
    """Sparse profiles with their alphabet."""

    profiles: DataFrame
    alphabet: profile.Alphabet


def profile_log(log: DataFrame, order: str = "first_seen") -> Profiled:
    alphabet = profile.activity_dict(log, order)
    return Profiled(profile.profile(log, alphabet), alphabet)


def knn_graph(
    profiled: Profiled, k: int = 3, w_act: float = 1.0, w_tra: float = 1.0, w_time: float = 0.5,
    time_scale: str = "none",
) -> DataFrame:
    """Directed neighbours (src, dst, dist, rank) under the mixed distance; ``neighbors.knn_edges`` makes the graph."""
    scaled = neighbors.scale_time(profiled.profiles, time_scale)
    points = neighbors.mixed_points(profile.profile_strings(scaled, profiled.alphabet.size))
    return neighbors.knn(points, neighbors.mixed_metric(w_act, w_tra, w_time), k)


@dataclass(frozen=True)
class Communities:
    nodes: DataFrame
    representatives: DataFrame
    modularity: DataFrame


def detect_communities(
    edges: DataFrame, resolution: float = 1.0, attributes: DataFrame | None = None, all_nodes: DataFrame | None = None
) -> Communities:
    """Communities, centralities per node, and representatives per community. ``all_nodes`` may name nodes without edges.

    With a column ``run`` in the edges (and nodes) all graphs are worked on together and every result has the column.
    """
    partition = graph.louvain(edges, resolution, all_nodes)
    nodes = cut(
        communities.node_table(
            partition, graph.degree_centrality(edges, all_nodes), graph.path_centralities(edges, nodes=all_nodes),
            graph.pagerank(edges, nodes=all_nodes),
            attributes=attributes,
        )
    )
    quality = graph.modularity(edges, partition).withColumn("modularity", F.round("modularity", 2))
    return Communities(nodes, communities.representatives(nodes), quality)


def gather_graphs(graphs: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """The graphs that can be worked on as one edge table with a column ``run``, and the reason for each that can't."""
    tagged, skipped = [], {}
    for run, edges in sorted(graphs.items()):
        try:
            weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
            tagged.append(edges.select(F.lit(run).alias("run"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), weight.alias("weight")))
        except AnalysisException as reason:  # no such column, no such file; lost executors stop the batch
            skipped[run] = str(reason)
    if not tagged:
        return None, skipped
    together = cut(reduce(DataFrame.unionByName, tagged))
    # One row per run.
    found = together.groupBy("run").agg(
        F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("unnamed"), F.count_if(~F.coalesce(F.col("weight") > 0, F.lit(False))).alias("weightless")
    )
    state = {r["run"]: r for r in found.collect()}
    for run in graphs.keys() - skipped.keys():
        if run not in state:
            skipped[run] = "the graph has no edges"
        elif state[run]["unnamed"]:
            skipped[run] = f"{state[run]['unnamed']} edges lack a node"
        elif state[run]["weightless"]:
            skipped[run] = f"{state[run]['weightless']} edges have no positive weight"
    return together.filter(~F.col("run").isin(list(skipped))) if skipped else together, skipped


def detect_all(graphs: dict[str, DataFrame], resolution: float = 1.0) -> tuple[dict[str, Communities], dict[str, str]]:
    """Communities of several graphs by name; a graph that can't be worked on is reported and the others go on.

    The graphs go through every step together (``detect_communities`` on one table keyed by run); each result is its part of it.
    """
    together, skipped = gather_graphs(graphs)
    names = graphs.keys() - skipped.keys()
    if not names:
        return {}, skipped
    made = detect_communities(together, resolution)

    def of(table: DataFrame, run: str) -> DataFrame:
        return table.filter(F.col("run") == run).drop("run")

    return {run: Communities(of(made.nodes, run), of(made.representatives, run), of(made.modularity, run)) for run in names}, skipped


def cluster_log(profiled: Profiled, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Clustered profiles (with ``cluster``) and medoids."""
    size = profiled.alphabet.size
    points = clustering.cluster_points(profiled.profiles, size)
    assigned, _ = clustering.kprototypes(points, k, seed)
    clustered = cut(profiled.profiles.join(assigned.select("case_id", "cluster"), "case_id"))
    raw = clustering.cluster_points(clustered, size, scaled=False)
    return clustered, clustering.medoids(raw, size)


def sweep_clusters(profiled: Profiled, ks: list[int], seed: int = 0) -> DataFrame:
    """Scores for several cluster counts, clustered and scored together: one row per k, with the rounds it took and whether it settled."""
    made = clustering.sweep_kprototypes(clustering.cluster_points(profiled.profiles, profiled.alphabet.size), ks, seed)
    points = scoring.profile_vectors(profiled.profiles.withColumn("cluster", F.lit(0))).select("id", "vec")
    labels = made.clustered.select(F.col("case_id").alias("id"), F.col("k").alias("run"), F.col("cluster").alias("label"))
    went = profiled.profiles.sparkSession.createDataFrame([(k, made.rounds[k], k not in made.moving) for k in ks], "k int, rounds int, settled boolean")
    return scoring.score_labelings(points, labels).withColumnRenamed("run", "k").join(went, "k")


def explain_representatives(
    profiled: Profiled, runs: dict[str, DataFrame], metric: str = "degree_rep", compact: bool = True
) -> DataFrame:
    """Explanations of the representatives of several runs, keyed by ``run``; compact ones come from one pass over all runs."""
    if not compact:
        return reduce(DataFrame.unionByName, [
            explain.explain_variants(explain.only_representatives(profiled.profiles, reps, metric), profiled.alphabet, False).withColumn("run", F.lit(run))
            for run, reps in sorted(runs.items())
        ])
    for reps in runs.values():
        if metric not in reps.columns:
            raise ValueError(f"representatives need a column {metric!r}")
    named = [reps.select(F.lit(run).alias("run"), clean_case_id(F.col(metric)).alias("case_id")) for run, reps in sorted(runs.items())]
    chosen = reduce(DataFrame.unionByName, named).distinct()
    return explain.explain_runs(profiled.profiles.join(chosen, "case_id"), profiled.alphabet)
