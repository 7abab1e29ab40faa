"""The registered queries: each reads the driver's tables under ``sf_dir`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.functions.labels import normalize_label
from sparktrace.functions.timefeatures import TIME_FEATURES, epoch_us
from sparktrace.operators import clustering, communities, eventlog, explain, graph, neighbors, profile, scoring
from sparktrace.plans import variants
from sparktrace.session import cut

K = 3
RUN_KS = (3, 4, 5)
RUN_GROUPS = (3, 5, 7)
GROUPS = 5
PAGERANK_TOLERANCE = 1e-13
CLUSTERS = 3
WEIGHTS = {"w_act": 1.0, "w_tra": 1.0, "w_time": 0.5}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.event_log(_table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.event_log(
        _table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", normalize=True
    )


def _object_log(spark: SparkSession, sf_dir: str):
    """Orders as events; their customer, parts and suppliers as objects."""
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    events = orders.select(F.col("o_orderkey").alias("eid"), F.col("o_orderpriority").alias("activity"), F.col("o_orderdate").alias("ts"))
    relations = (
        orders.select(F.col("o_orderkey").alias("eid"), F.concat(F.lit("customer-"), "o_custkey").alias("oid"), F.lit("placed by").alias("qualifier"))
        .unionByName(items.select(F.col("l_orderkey").alias("eid"), F.concat(F.lit("part-"), "l_partkey").alias("oid"), F.lit("contains").alias("qualifier")))
        .unionByName(items.select(F.col("l_orderkey").alias("eid"), F.concat(F.lit("supplier-"), "l_suppkey").alias("oid"), F.lit("shipped by").alias("qualifier")))
    )
    objects = relations.select("oid", F.split("oid", "-")[0].alias("type")).distinct()
    return events, objects, relations


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


# Stages hand over through written tables: the profile of the event log, its k-NN graph and its node measures are
# written once per session and folder, and the queries on later stages start from them.
_stages: dict[tuple, object] = {}


def _stage(spark: SparkSession, sf_dir: str, name: str, build: Callable):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        _stages[key] = build()
    return _stages[key]


def forget_stages() -> None:
    _stages.clear()


def _profiled(spark: SparkSession, sf_dir: str) -> variants.Profiled:
    def build():
        made = variants.profile_log(event_log(spark, sf_dir))
        alphabet = profile.Alphabet(cut(made.alphabet.table), made.alphabet.size)
        return variants.Profiled(cut(made.profiles), alphabet)

    return _stage(spark, sf_dir, "profile", build)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "graph", lambda: cut(
        neighbors.knn_edges(variants.knn_graph(_profiled(spark, sf_dir), K, **WEIGHTS))
    ))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "paths", lambda: graph.path_centralities(_edges(spark, sf_dir)))


def _fixed_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases grouped by the remainder of their id."""
    return _profiled(spark, sf_dir).profiles.select(
        F.col("case_id").alias("node"), (F.col("case_id").cast("bigint") % GROUPS).cast("int").alias("community")
    )


def _bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.bridge_nodes(_edges(spark, sf_dir), _fixed_partition(spark, sf_dir))


def _busy_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least 4 edges to at least 3 other communities; cases of more than 80 events are excluded."""
    long_cases = _profiled(spark, sf_dir).profiles.filter(F.col("events") > 80).select(F.col("case_id").alias("Node"))
    return communities.filter_bridges(_bridges(spark, sf_dir), 4, 3, long_cases)


def _representative_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group the case with the most events, smallest id first."""
    profiles = _profiled(spark, sf_dir).profiles
    return profiles.groupBy((F.col("case_id").cast("bigint") % GROUPS).alias("community")).agg(
        F.min(F.struct((-F.col("events")).alias("cost"), F.col("case_id").cast("bigint").alias("id")))["id"]
        .cast("string").alias("case")
    )


def _representative_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.only_representatives(
        _profiled(spark, sf_dir).profiles, _representative_cases(spark, sf_dir), "case"
    )


def _cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _profiled(spark, sf_dir)
    return clustering.cluster_points(made.profiles, made.alphabet.size)


def _first_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _cluster_points(spark, sf_dir)
    return clustering.assign_clusters(points, clustering.sample_centroids(points, CLUSTERS))


# --- log ------------------------------------------------------------------------------------------------------------


def flatten_ocel(spark, sf_dir):
    flat = eventlog.flatten_ocel(*_object_log(spark, sf_dir), "supplier")
    return flat.select("case_id", "activity", epoch_us(F.col("ts")).alias("ts_us"), "seq")


def flatten_ocel_by_event(spark, sf_dir):
    flat = eventlog.flatten_ocel(*_object_log(spark, sf_dir), "customer", case_key="event")
    return flat.select("case_id", "activity", epoch_us(F.col("ts")).alias("ts_us"), "seq")


def normalize_labels(spark, sf_dir):
    raw = F.col("o_orderpriority")
    return _table(spark, sf_dir, "orders").groupBy(raw.alias("label"), normalize_label(raw).alias("activity")).agg(
        F.count("*").alias("n")
    )


def trace_corpus(spark, sf_dir):
    return eventlog.trace_corpus(order_log(spark, sf_dir))


def event_time_features(spark, sf_dir):
    return eventlog.event_time_features(event_log(spark, sf_dir))


def explode_cases(spark, sf_dir):
    """Orders as events whose case is the list of their suppliers, one row per order and supplier."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("activity"))
    suppliers = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("case"))
    return eventlog.explode_cases(orders.join(suppliers, "l_orderkey"), "case").select(F.col("l_orderkey").alias("seq"), "activity", "case")


# --- profile --------------------------------------------------------------------------------------------------------


def activity_dict(spark, sf_dir):
    return profile.activity_dict(order_log(spark, sf_dir)).table


def onehot_profile(spark, sf_dir):
    made = variants.profile_log(order_log(spark, sf_dir))
    return profile.profile_strings(made.profiles, made.alphabet.size).select(
        "case_id", F.size("acts").alias("n_activities"), "act_text"
    )


def presence(spark, sf_dir):
    return profile.presence(order_log(spark, sf_dir))


def transition_profile(spark, sf_dir):
    return profile.transition_counts(order_log(spark, sf_dir))


def transition_text(spark, sf_dir):
    made = variants.profile_log(order_log(spark, sf_dir))
    return profile.profile_strings(made.profiles, made.alphabet.size).select("case_id", "tra_text")


def dfg(spark, sf_dir):
    return profile.directly_follows(event_log(spark, sf_dir))


def dfg_matrix(spark, sf_dir):
    return profile.directly_follows_matrix(event_log(spark, sf_dir))


def time_profile(spark, sf_dir):
    return profile.time_profile(order_log(spark, sf_dir))


def profile_merge(spark, sf_dir):
    made = variants.profile_log(event_log(spark, sf_dir))
    text = profile.profile_strings(made.profiles, made.alphabet.size)
    return text.select(
        "case_id", "events", "act_text", "tra_text",
        *[F.col("time")[i].alias(name) for i, name in enumerate(TIME_FEATURES)],
    )


def wide_profile(spark, sf_dir):
    made = variants.profile_log(event_log(spark, sf_dir))
    return profile.wide_profile(made.profiles, made.alphabet)


# --- distances and neighbours ---------------------------------------------------------------------------------------


def _order_points(spark, sf_dir):
    made = variants.profile_log(order_log(spark, sf_dir))
    return neighbors.mixed_points(profile.profile_strings(made.profiles, made.alphabet.size))


def _embedding_points(spark, sf_dir):
    return neighbors.vector_points(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def pair_distance(spark, sf_dir):
    """Mixed distance of every order case and the first case (by id) of its group."""
    points = cut(_order_points(spark, sf_dir))
    group = (F.col("id").cast("bigint") % GROUPS).alias("group")
    firsts = points.groupBy(group).agg(F.min(F.col("id").cast("bigint")).cast("string").alias("dst"))
    pairs = points.select(F.col("id").alias("src"), group).join(firsts, "group").select("src", "dst")
    return neighbors.pair_distances(points, pairs, neighbors.mixed_metric(**WEIGHTS))


def radius_pairs(spark, sf_dir):
    """All pairs of different order cases whose mixed distance is at most the mean distance to the nearest case."""
    points, metric = cut(_order_points(spark, sf_dir)), neighbors.mixed_metric(**WEIGHTS)
    radius = neighbors.knn(points, metric, 1).agg(F.round(F.avg("dist"), 6)).first()[0]
    return neighbors.radius_join(points, metric, radius).pairs


def radius_members(spark, sf_dir):
    """Every event case with the smallest id of those equal to it and the number of other such classes near it, no farther than the
    farthest second neighbour of any case."""
    made = _profiled(spark, sf_dir)
    points = neighbors.mixed_points(profile.profile_strings(made.profiles, made.alphabet.size))
    metric = neighbors.mixed_metric(**WEIGHTS)
    near = neighbors.radius_join(points, metric, neighbors.knn(points, metric, 2).agg(F.round(F.max("dist"), 6)).first()[0])
    return near.members.join(near.degrees(), "representative", "left").select(
        "id", "representative", F.coalesce("near", F.lit(0)).alias("near")
    )


def knn_neighbors(spark, sf_dir):
    return variants.knn_graph(variants.profile_log(event_log(spark, sf_dir)), K, **WEIGHTS)


def knn_neighbors_orders(spark, sf_dir):
    return variants.knn_graph(variants.profile_log(order_log(spark, sf_dir)), K, **WEIGHTS)


def knn_edges(spark, sf_dir):
    return neighbors.knn_edges(knn_neighbors(spark, sf_dir))


def knn_euclidean(spark, sf_dir):
    points = neighbors.vector_points(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return neighbors.knn(points, neighbors.euclidean_metric(), K, include_self=True)


def euclidean_pairs(spark, sf_dir):
    """Euclidean distance of every vector and the first one of its label."""
    points = _embedding_points(spark, sf_dir)
    labelled = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), "label")
    firsts = labelled.groupBy("label").agg(F.min("src").alias("dst"))
    return neighbors.pair_distances(points, labelled.join(firsts, "label").select("src", "dst"), neighbors.euclidean_metric())


def euclidean_radius_pairs(spark, sf_dir):
    """All pairs of vectors no farther apart than the mean distance to the third nearest."""
    points, metric = _embedding_points(spark, sf_dir), neighbors.euclidean_metric()
    radius = neighbors.knn(points, metric, 3).filter("rank = 3").agg(F.round(F.avg("dist"), 6)).first()[0]
    return neighbors.radius_join(points, metric, radius).pairs


# --- graph ----------------------------------------------------------------------------------------------------------


def degree_centrality(spark, sf_dir):
    return graph.degree_centrality(_edges(spark, sf_dir)).select("node", F.round("cent_degree", 6).alias("cent_degree"))


def modularity(spark, sf_dir):
    return graph.modularity(_edges(spark, sf_dir), _fixed_partition(spark, sf_dir)).select(
        F.round("modularity", 6).alias("modularity"), "num_communities"
    )


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "ranks", lambda: graph.pagerank(_edges(spark, sf_dir), tol=PAGERANK_TOLERANCE))


def pagerank(spark, sf_dir):
    ranks = _ranks(spark, sf_dir)
    return ranks.select("node", F.round("cent_pagerank", 8).alias("cent_pagerank"))


def betweenness(spark, sf_dir):
    return _paths(spark, sf_dir).select("node", F.round("cent_betweenness", 6).alias("cent_betweenness"))


def closeness(spark, sf_dir):
    return graph.closeness(_edges(spark, sf_dir)).select("node", F.round("cent_closeness", 6).alias("cent_closeness"))


def louvain_communities(spark, sf_dir):
    return graph.louvain(_edges(spark, sf_dir))


def node_table(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    ranks = _ranks(spark, sf_dir)
    table = communities.node_table(
        _fixed_partition(spark, sf_dir), graph.degree_centrality(edges), _paths(spark, sf_dir), ranks
    )
    rounded = [F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in table.dtypes]
    return table.select(*rounded)


def representatives(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    ranks = _ranks(spark, sf_dir)
    table = communities.node_table(
        _fixed_partition(spark, sf_dir), graph.degree_centrality(edges), _paths(spark, sf_dir), ranks
    )
    measures = [F.round(c, 8).alias(c) for c in ("cent_degree", "cent_betweenness", "cent_pagerank")]
    return communities.representatives(table.select("node", "community", *measures))


def community_sizes(spark, sf_dir):
    return communities.community_sizes(_fixed_partition(spark, sf_dir))


def bridge_nodes(spark, sf_dir):
    return _bridges(spark, sf_dir)


def bridge_filter(spark, sf_dir):
    return _busy_bridges(spark, sf_dir)


def split_bridges(spark, sf_dir):
    return communities.split_bridges(_fixed_partition(spark, sf_dir), _busy_bridges(spark, sf_dir))


def meta_nodes(spark, sf_dir):
    return communities.meta_nodes(_edges(spark, sf_dir), _fixed_partition(spark, sf_dir), _busy_bridges(spark, sf_dir))


def meta_edges(spark, sf_dir):
    """Meta-graph after every busy bridge has become a community of its own."""
    edges = _edges(spark, sf_dir)
    partition = cut(communities.split_bridges(_fixed_partition(spark, sf_dir), _busy_bridges(spark, sf_dir)))
    return communities.meta_edges(edges, partition, communities.meta_nodes(edges, partition))


def detect_communities(spark, sf_dir):
    return variants.detect_communities(_edges(spark, sf_dir)).nodes


def detected_representatives(spark, sf_dir):
    return variants.detect_communities(_edges(spark, sf_dir)).representatives


def _run_edges(spark, sf_dir):
    """The graphs of the 3, 4 and 5 nearest neighbours of every event case, keyed by run."""
    def build():
        near = cut(variants.knn_graph(_profiled(spark, sf_dir), max(RUN_KS), **WEIGHTS))
        return cut(reduce(DataFrame.unionByName, [
            neighbors.knn_edges(near.filter(F.col("rank") <= k)).withColumn("run", F.lit(f"k{k}")) for k in RUN_KS
        ]))

    return _stage(spark, sf_dir, "run graphs", build)


def run_measures(spark, sf_dir):
    """Centralities of the nodes of three graphs, worked out together."""
    edges = _run_edges(spark, sf_dir)
    paths = graph.path_centralities(edges).drop("cent_closeness")
    made = communities.node_table(graph.degree_centrality(edges), paths, graph.closeness(edges), graph.pagerank(edges, tol=PAGERANK_TOLERANCE))
    return made.select("run", "node", *[F.round(c, 6).alias(c) for c in ("cent_degree", "cent_betweenness", "cent_closeness", "cent_pagerank")])


def run_communities(spark, sf_dir):
    """What holds for Louvain's partitions of three graphs: every node is in one community, no move of a node and no merger of two
    communities raises the modularity, and the reported modularity is the partition's."""
    edges = _run_edges(spark, sf_dir)
    found = cut(graph.louvain(edges))
    links = graph.symmetric(edges)
    strength = links.groupBy("run", F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    placed = cut(strength.join(found, ["run", "node"]))
    totals = cut(placed.groupBy("run", "community").agg(F.sum("k").alias("tot")))
    whole = totals.groupBy("run").agg(F.sum("tot").alias("m2"))
    sides = links.join(placed.select("run", F.col("node").alias("src"), F.col("community").alias("c"), "k"), ["run", "src"]).join(
        placed.select("run", F.col("node").alias("dst"), F.col("community").alias("d")), ["run", "dst"]
    )
    to = sides.groupBy("run", "src", "k", "c", "d").agg(F.sum("weight").alias("w")).join(totals.withColumnsRenamed({"community": "d", "tot": "tot_d"}), ["run", "d"])
    own = sides.filter("c = d").groupBy("run", "src").agg(F.sum("weight").alias("w_own"))
    stay = totals.withColumnsRenamed({"community": "c", "tot": "tot_c"})
    gains = to.filter("c <> d").join(own, ["run", "src"], "left").join(stay, ["run", "c"]).join(whole, "run").select(
        "run", (F.col("w") - F.coalesce("w_own", F.lit(0.0)) - F.col("k") * (F.col("tot_d") - F.col("tot_c") + F.col("k")) / F.col("m2")).alias("gain")
    )
    joint = sides.filter("c < d").groupBy("run", "c", "d").agg(F.sum("weight").alias("w"))
    mergers = joint.join(stay, ["run", "c"]).join(totals.withColumnsRenamed({"community": "d", "tot": "tot_d"}), ["run", "d"]).join(whole, "run").select(
        "run", (F.col("w") - F.col("tot_c") * F.col("tot_d") / F.col("m2")).alias("gain")
    )
    inside = sides.filter("c = d").groupBy("run").agg(F.sum("weight").alias("inside"))
    again = totals.join(whole, "run").groupBy("run").agg(F.sum(F.col("tot") * F.col("tot") / F.col("m2") / F.col("m2")).alias("expected"), F.first("m2").alias("m2"))
    quality = again.join(inside, "run").select("run", (F.col("inside") / F.col("m2") - F.col("expected")).alias("again")).join(graph.modularity(edges, found), "run")
    return (  # a run without links between its communities has no move and no merger
        found.groupBy("run").agg(F.count("*").alias("nodes"), F.min("community").alias("first"))
        .join(gains.groupBy("run").agg(F.count_if(F.col("gain") > 1e-6).alias("moves")), "run", "left")
        .join(mergers.groupBy("run").agg(F.count_if(F.col("gain") > 1e-6).alias("mergers")), "run", "left")
        .na.fill(0, ["moves", "mergers"])
        .join(quality.select("run", (F.abs(F.col("again") - F.col("modularity")) < 1e-9).alias("same")), "run")
    )


# --- clusters -------------------------------------------------------------------------------------------------------


def standardize(spark, sf_dir):
    return scoring.standardize(_vectors(spark, sf_dir)).select(
        "id", F.posexplode("vec").alias("pos", "x")
    ).select("id", "pos", F.round("x", 6).alias("x"))


def sample_centroids(spark, sf_dir):
    return clustering.sample_cases(_cluster_points(spark, sf_dir), CLUSTERS).select("case_id")


def assign_clusters(spark, sf_dir):
    return _first_assignment(spark, sf_dir).select("case_id", "cluster", F.round("dist", 4).alias("dist"))


def cluster_modes(spark, sf_dir):
    return clustering.cluster_modes(_first_assignment(spark, sf_dir))


def cluster_means(spark, sf_dir):
    return clustering.cluster_means(_first_assignment(spark, sf_dir)).select(
        "cluster", "members", F.posexplode("num").alias("pos", "x")
    ).select("cluster", "members", "pos", F.round("x", 5).alias("x"))


def kprototypes(spark, sf_dir):
    return clustering.kprototypes(_cluster_points(spark, sf_dir), CLUSTERS)[0].select("case_id", "cluster", "dist")


def kprototypes_settled(spark, sf_dir):
    """What holds for k-prototypes with 2, 3 and 5 clusters, run together: every case is at its nearest centroid, every centroid is made of
    the modes and means of its members, and no round was left."""
    points = cut(_cluster_points(spark, sf_dir))
    made = clustering.sweep_kprototypes(points, [2, 3, 5])
    centers = spark.createDataFrame(
        [(k, c.cluster, c.cells, c.num) for k, some in made.centroids.items() for c in some], "k int, cluster int, cells map<bigint,int>, num array<double>"
    )
    listed = centers.agg(F.collect_list(F.struct("k", "cluster", "cells", "num"))).scalar()
    reached = points.withColumn("all", listed).select("case_id", "cells", "num", F.explode("all").alias("c")).select(
        "case_id", "c.k", clustering.mixed_distance(F.struct("cells", "num"), F.col("c")).alias("to")
    )
    nearest = reached.groupBy("k", "case_id").agg(F.min("to").alias("least"))
    away = made.clustered.join(nearest, ["k", "case_id"]).groupBy("k").agg(F.count("*").alias("cases"), F.count_if(F.col("dist") > F.col("least")).alias("away"))
    moved = []
    for k, some in made.centroids.items():
        assigned = cut(points.join(made.clustered.filter(F.col("k") == k).select("case_id", "cluster"), "case_id"))
        own = centers.filter(F.col("k") == k)
        cells = own.select("cluster", F.explode("cells").alias("pos", "n"))
        modes = clustering.cluster_modes(assigned).select("cluster", F.col("pos").cast("bigint").alias("pos"), "n")
        means = clustering.cluster_means(assigned).select("cluster", F.col("num").alias("mean")).join(own, "cluster", "right")
        off = F.coalesce(F.exists(F.zip_with("mean", "num", lambda a, b: F.abs(a - b) > 1e-8), lambda x: x), F.lit(True))
        wrong = cells.exceptAll(modes).count() + modes.exceptAll(cells).count() + means.filter(off).count()
        moved.append((k, wrong, k not in made.moving))
    return away.join(spark.createDataFrame(moved, "k int, wrong bigint, settled boolean"), "k")


def _fixed_clusters(spark, sf_dir):
    made = _profiled(spark, sf_dir)
    clustered = made.profiles.withColumn("cluster", (F.col("case_id").cast("bigint") % GROUPS).cast("int"))
    return clustering.cluster_points(clustered, made.alphabet.size, scaled=False), made.alphabet.size


def minhash_signature(spark, sf_dir):
    points, size = _fixed_clusters(spark, sf_dir)
    return clustering.signatures(points, size).select("case_id", F.posexplode("sig").alias("slot", "value"))


def medoid_minhash(spark, sf_dir):
    points, size = _fixed_clusters(spark, sf_dir)
    return clustering.medoids(points, size).select("case_id", "cluster", F.round("total", 2).alias("total"))


def cluster_medoids(spark, sf_dir):
    return variants.cluster_log(_profiled(spark, sf_dir), CLUSTERS)[1].select(
        F.col("case_id").alias("case"), F.col("cluster").alias("community")
    )


def silhouette(spark, sf_dir):
    scaled = scoring.standardize(_vectors(spark, sf_dir))
    return scoring.silhouette(scaled).select(F.round("silhouette", 6).alias("silhouette"))


def davies_bouldin(spark, sf_dir):
    scaled = scoring.standardize(_vectors(spark, sf_dir))
    return scoring.davies_bouldin(scaled, scoring.check_labels(scaled)).select(
        F.round("davies_bouldin", 6).alias("davies_bouldin")
    )


def calinski_harabasz(spark, sf_dir):
    scaled = scoring.standardize(_vectors(spark, sf_dir))
    return scoring.calinski_harabasz(scaled, scoring.check_labels(scaled)).select(
        F.round("calinski_harabasz", 6).alias("calinski_harabasz")
    )


def score_runs(spark, sf_dir):
    """The given labels, a grouping by id, and a grouping into one cluster, which cannot be scored."""
    points = _vectors(spark, sf_dir)
    runs = {
        "label": points,
        "remainder": points.withColumn("label", (F.col("id") % 4).cast("int")),
        "single": points.withColumn("label", F.lit(0)),
    }
    return scoring.score_runs(runs)[0]


def sweep_clusters(spark, sf_dir):
    return variants.sweep_clusters(_profiled(spark, sf_dir), list(range(2, 12)))


# --- explanations ---------------------------------------------------------------------------------------------------


def explain_global(spark, sf_dir):
    long = explain.difference_from_mean(_representative_profiles(spark, sf_dir), _profiled(spark, sf_dir).alphabet)
    return long.withColumn("value", F.round("value", 4))


def explain_compact(spark, sf_dir):
    long = explain.difference_from_mean(_representative_profiles(spark, sf_dir), _profiled(spark, sf_dir).alphabet)
    short = explain.reduce_zero_features(long.withColumn("value", F.round("value", 4)))
    return explain.with_legend(short).select(
        "case_id", "segment", "feature", "value", "title", "unit", "vmin", "vmax"
    )


def explain_local(spark, sf_dir):
    """Difference of the busiest case of group 0 from that of group 1."""
    cases = {r["community"]: r["case"] for r in _representative_cases(spark, sf_dir).collect()}
    made = _profiled(spark, sf_dir)
    return explain.explain_case(made.profiles, made.alphabet, cases[0], cases[1]).select(
        "case_id", "variant_id", "segment", "feature", F.round("value", 4).alias("value"), "title", "unit", "vmin", "vmax"
    )


def _busiest(spark, sf_dir, groups: int) -> DataFrame:
    """(community, case): the case with the most events of each of so many groups of ids, smallest id first."""
    number = F.col("case_id").cast("bigint")
    return _profiled(spark, sf_dir).profiles.groupBy((number % groups).alias("community")).agg(
        F.min(F.struct((-F.col("events")).alias("cost"), number.alias("id")))["id"].cast("string").alias("case")
    )


def explain_runs(spark, sf_dir):
    """Compact explanations of the busiest cases of 3, 5 and 7 groups, three runs in one pass; ids as a float round trip leaves them."""
    runs = {f"g{g}": _busiest(spark, sf_dir, g).withColumn("case", F.concat("case", F.lit(".0"))) for g in RUN_GROUPS}
    made = variants.explain_representatives(_profiled(spark, sf_dir), runs, "case")
    rounded = [F.round(c, 4).alias(c) for c in ("value", "vmin")]
    return made.select("run", "case_id", "case_pos", "segment", "feature", *rounded, "title", "unit")


def explain_pairs(spark, sf_dir):
    """Differences of the busiest case of every group from that of group 0, for 3, 5 and 7 groups."""
    pairs = []
    for g in RUN_GROUPS:
        reps = _busiest(spark, sf_dir, g)
        first = reps.filter("community = 0").select(F.col("case").alias("variant_id"))
        pairs.append(reps.filter("community > 0").select(F.lit(f"g{g}").alias("run"), F.col("case").alias("case_id")).join(F.broadcast(first)))
    made = _profiled(spark, sf_dir)
    found = explain.explain_pairs(made.profiles, made.alphabet, reduce(DataFrame.unionByName, pairs))
    return found.select("run", "case_id", "variant_id", "segment", "feature", F.round("value", 4).alias("value"), "title", "unit", "vmin", "vmax")


def explain_order(spark, sf_dir):
    """All cases, labelled by group letter and id, in the order of the number in the label."""
    label = F.concat(F.element_at(F.array(*[F.lit(x) for x in "EDCBA"]), (F.col("case_id").cast("bigint") % 5 + 1).cast("int")), F.lit("_"), "case_id")
    return explain.case_order(_profiled(spark, sf_dir).profiles.select(label.alias("case_id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        flatten_ocel, flatten_ocel_by_event, normalize_labels, trace_corpus, event_time_features, explode_cases, activity_dict,
        onehot_profile, presence, transition_profile, transition_text, dfg, dfg_matrix, time_profile, profile_merge,
        wide_profile, pair_distance, radius_pairs, radius_members, knn_neighbors, knn_neighbors_orders, knn_edges, knn_euclidean, euclidean_pairs, euclidean_radius_pairs,
        degree_centrality, modularity, pagerank, betweenness, closeness, louvain_communities, run_measures, run_communities, node_table,
        representatives, community_sizes, bridge_nodes, bridge_filter, split_bridges, meta_nodes, meta_edges,
        detect_communities, detected_representatives, standardize, sample_centroids, assign_clusters, cluster_modes,
        cluster_means, kprototypes, kprototypes_settled, minhash_signature, medoid_minhash, cluster_medoids, silhouette, davies_bouldin,
        calinski_harabasz, score_runs, sweep_clusters, explain_global, explain_compact, explain_local, explain_runs, explain_pairs, explain_order,
    )
}
