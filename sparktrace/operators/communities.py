"""Communities: node tables, representatives, bridge nodes and meta-graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dense_index
from .graph import degrees, symmetric

# Column names of the bridge table.
BRIDGE_COLUMNS = ("Node", "TotalEdges", "InternalEdges", "ExternalEdges", "DistinctExternalCommunities")


def node_table(partition: DataFrame, *measures: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """Partition joined with node measures (and node attributes, if any) on ``node``, and on ``run`` if the partition has one."""
    table, keys = partition, ["run", "node"] if "run" in partition.columns else ["node"]
    for measure in measures:
        table = table.join(measure, keys)
    return table.join(attributes, [k for k in keys if k in attributes.columns], "left") if attributes is not None else table


def representatives(nodes: DataFrame) -> DataFrame:
    """Per community (of each run) the node with the largest degree, betweenness and PageRank; the smallest node wins ties."""
    def top(measure: str):
        return F.min(F.struct((-F.col(measure)).alias("cost"), F.col("node").alias("node")))["node"]

    keys = ["run", "community"] if "run" in nodes.columns else ["community"]
    return nodes.groupBy(*keys).agg(
        top("cent_degree").alias("degree_rep"),
        top("cent_betweenness").alias("betweenness_rep"),
        top("cent_pagerank").alias("pagerank_rep"),
    )


def community_sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy("community").agg(F.count("*").alias("size"))


def bridge_nodes(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges of each node inside and outside its community; only nodes with an edge to the outside."""
    mine = partition.select(F.col("node").alias("src"), F.col("community").alias("c_src"))
    theirs = partition.select(F.col("node").alias("dst"), F.col("community").alias("c_dst"))
    outside = F.col("c_src") != F.col("c_dst")
    per_pair = (
        symmetric(edges).select("src", "dst").join(theirs, "dst").join(mine, "src")
        .groupBy(F.col("src").alias("Node"), "c_src", "c_dst").agg(F.count("*").alias("n"))
    )
    return (
        per_pair.groupBy("Node")
        .agg(
            F.sum("n").alias("TotalEdges"),
            F.sum(F.when(outside, 0).otherwise(F.col("n"))).alias("InternalEdges"),
            F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("ExternalEdges"),
            F.count_if(outside).alias("DistinctExternalCommunities"),
        )
        .filter(F.col("ExternalEdges") > 0)
    )


def filter_bridges(
    stats: DataFrame, min_external_edges: int = 2, min_external_communities: int = 1, exclude: DataFrame | None = None
) -> DataFrame:
    """Bridges with enough external edges and communities, without the nodes listed in ``exclude`` (column ``Node``)."""
    kept = stats.filter(
        (F.col("ExternalEdges") >= min_external_edges)
        & (F.col("DistinctExternalCommunities") >= min_external_communities)
    )
    return kept.join(exclude, "Node", "left_anti") if exclude is not None else kept


def split_bridges(partition: DataFrame, stats: DataFrame) -> DataFrame:
    """Give every listed node a community of its own, numbered on from the largest id in node order."""
    largest = partition.agg(F.max("community")).first()[0]
    fresh = dense_index(stats.select(F.col("Node").alias("node")), ["node"], "fresh", start=largest + 1)
    return partition.join(fresh, "node", "left").select(
        "node", F.coalesce("fresh", F.col("community").cast("bigint")).alias("community")
    )


def meta_nodes(edges: DataFrame, partition: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One node per community, the member with the most edges, with the community's size and a bridge flag."""
    ranked = partition.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    tops = ranked.groupBy(F.col("community").alias("community_id")).agg(
        F.min(F.struct((-F.col("degree")).alias("cost"), "node"))["node"].alias("node"), F.count("*").alias("size")
    )
    if stats is None:
        return tops.select("node", "community_id", "size", F.lit(False).alias("is_bridge"))
    flags = stats.select(F.col("Node").alias("node"), F.lit(True).alias("is_bridge"))
    return tops.join(flags, "node", "left").select(
        "node", "community_id", "size", F.coalesce("is_bridge", F.lit(False)).alias("is_bridge")
    )


def meta_edges(edges: DataFrame, partition: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge between two meta-nodes when any edge joins their communities."""
    mine = partition.select(F.col("node").alias("src"), F.col("community").alias("c_src"))
    theirs = partition.select(F.col("node").alias("dst"), F.col("community").alias("c_dst"))
    pairs = (
        edges.select("src", "dst").join(mine, "src").join(theirs, "dst")
        .filter(F.col("c_src") != F.col("c_dst"))
        .select(F.least("c_src", "c_dst").alias("c_a"), F.greatest("c_src", "c_dst").alias("c_b")).distinct()
    )
    a = nodes.select(F.col("community_id").alias("c_a"), F.col("node").alias("a"))
    b = nodes.select(F.col("community_id").alias("c_b"), F.col("node").alias("b"))
    return pairs.join(a, "c_a").join(b, "c_b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
