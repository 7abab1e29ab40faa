"""Registered queries on readers and sinks: a table of the driver is written in a format to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import entry_queries as base
from entry_oracles import ORACLES as BASE
from sparktrace.functions.timefeatures import epoch_us
from sparktrace.operators import scoring
from sparktrace.session import scratch
from sparktrace.sources import logs, tables


def xes_roundtrip(spark, sf_dir):
    path = scratch(spark, "xes")
    logs.write_xes(base.event_log(spark, sf_dir), path)
    return logs.read_xes(spark, path, normalize=False).select("case_id", "activity", epoch_us(F.col("ts")).alias("ts_us"), "seq")


def _ocel_json(spark, sf_dir) -> logs.ObjectLog:
    events, objects, relations = base._object_log(spark, sf_dir)
    path = scratch(spark, "ocel")
    logs.write_ocel2_json(logs.ObjectLog(events, objects, relations), path)
    return logs.read_ocel2_json(spark, path)


def ocel_json_roundtrip(spark, sf_dir):
    return _ocel_json(spark, sf_dir).relations


def ocel_json_flatten(spark, sf_dir):
    """Flat log of a file that was found by its format, customers as cases."""
    events, objects, relations = base._object_log(spark, sf_dir)
    path = scratch(spark, "ocel") + "/log.json"
    logs.write_ocel2_json(logs.ObjectLog(events, objects, relations), path)
    flat = logs.read_log(spark, path, "customer", lines=True)
    return flat.select("case_id", "activity", epoch_us(F.col("ts")).alias("ts_us"))


def ocel1_tables(spark, sf_dir):
    """Objects and relations of the older relational layout, its tables taken from the given ones."""
    events, objects, relations = base._object_log(spark, sf_dir)
    layout = {
        "EVENTS": events.select(F.col("eid").alias("ocel:eid"), F.col("activity").alias("ocel:activity"), F.col("ts").alias("ocel:timestamp")),
        "OBJECTS": objects.select(F.col("oid").alias("ocel:oid"), F.col("type").alias("ocel:type")),
        "RELATIONS": relations.select(F.col("eid").alias("ocel:eid"), F.col("oid").alias("ocel:oid")),
    }
    return logs.read_ocel1_tables(layout.get).flatten("supplier").select("case_id", "activity", epoch_us(F.col("ts")).alias("ts_us"))


def ocel2_tables(spark, sf_dir):
    """The newer relational layout: one event table per activity."""
    events, objects, relations = base._object_log(spark, sf_dir)
    kinds = events.select("activity").distinct().select(F.col("activity").alias("ocel_type"), F.regexp_replace("activity", "[^A-Za-z0-9]", "").alias("ocel_type_map"))

    def load(table: str) -> DataFrame:
        if table == "event_map_type":
            return kinds
        if table == "object":
            return objects.select(F.col("oid").alias("ocel_id"), F.col("type").alias("ocel_type"))
        if table == "event_object":
            return relations.select(F.col("eid").alias("ocel_event_id"), F.col("oid").alias("ocel_object_id"), F.col("qualifier").alias("ocel_qualifier"))
        kind = table.removeprefix("event_")
        return events.filter(F.regexp_replace("activity", "[^A-Za-z0-9]", "") == kind).select(F.col("eid").alias("ocel_id"), F.col("ts").alias("ocel_time"))

    return logs.read_ocel2_tables(load).flatten("supplier").select("case_id", "activity", epoch_us(F.col("ts")).alias("ts_us"))


def profile_csv_roundtrip(spark, sf_dir):
    path = scratch(spark, "profile")
    tables.write_csv(base.wide_profile(spark, sf_dir), path)
    return tables.read_profile_csv(spark, path)


def representatives_csv(spark, sf_dir):
    path = scratch(spark, "representatives")
    tables.write_csv(base.representatives(spark, sf_dir), path)
    return tables.read_representatives_csv(spark, path)


def clustered_csv_scores(spark, sf_dir):
    """Vectors and labels as a clustered profile, read back and scored."""
    points = base._vectors(spark, sf_dir)
    width = points.select(F.size("vec")).first()[0]
    wide = points.select(F.col("id").alias("case"), *[F.col("vec")[i].alias(f"f{i}") for i in range(width)], F.col("label").alias("cluster"))
    path = scratch(spark, "clustered")
    tables.write_csv(wide, path)
    scaled = scoring.standardize(tables.read_clustered_csv(spark, path))
    return scoring.calinski_harabasz(scaled, scoring.check_labels(scaled)).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


def graphml_roundtrip(spark, sf_dir):
    """Customers as nodes with a segment, linked to their orders' priorities with the number of orders as weight."""
    customers, orders = base._table(spark, sf_dir, "customer"), base._table(spark, sf_dir, "orders")
    edges = orders.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    nodes = customers.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("segment"))
    path = scratch(spark, "graph")
    tables.write_graphml(edges, path, nodes)
    found_nodes, found_edges = tables.read_graphml(spark, path, ("segment",))
    return found_nodes.select("node", "segment", F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("weight")).unionByName(
        found_edges.select(F.col("src").alias("node"), F.lit(None).cast("string").alias("segment"), F.col("dst").alias("other"), "weight")
    )


def run_tables(spark, sf_dir):
    """Community sizes of two runs, appended under their run keys; rows of one of them."""
    path = scratch(spark, "runs")
    sizes = base.community_sizes(spark, sf_dir)
    tables.write_run(sizes, path, dataset="events", k=3)
    tables.write_run(sizes.withColumn("size", F.col("size") * 2), path, dataset="events", k=5)
    return tables.read_run(spark, path, dataset="events", k=5).select("community", "size")


def run_names(spark, sf_dir):
    """Bridge statistics of two runs as CSV folders, read together with the run taken from the path; next to it its file count."""
    path = scratch(spark, "results")
    bridges = base.bridge_nodes(spark, sf_dir)
    tables.write_csv(bridges, f"{path}/base_k3.csv")
    tables.write_csv(bridges.filter("ExternalEdges > 3"), f"{path}/base_k3_busy.csv")
    found = tables.read_runs(spark, path)
    files = tables.files_of(spark, f"{path}/*", "part-").groupBy().agg((F.count("*") > 0).alias("has_files"))
    return found.groupBy("run").agg(F.count("*").alias("nodes"), F.sum(F.col("TotalEdges").cast("bigint")).alias("edges")).join(files)


def node_table_csv(spark, sf_dir):
    path = scratch(spark, "nodes")
    tables.write_node_table(base.node_table(spark, sf_dir), path)
    return spark.read.option("header", True).schema("node string, community int, cent_degree double, cent_betweenness double, cent_closeness double, cent_pagerank double").csv(path)


def medoids_csv(spark, sf_dir):
    path = scratch(spark, "medoids")
    tables.write_medoids(base.medoid_minhash(spark, sf_dir), path)
    return tables.read_representatives_csv(spark, path, None)


def scores_csv(spark, sf_dir):
    path = scratch(spark, "scores")
    made = base.score_runs(spark, sf_dir)
    tables.write_csv(made, path)
    return spark.read.option("header", True).schema(made.schema).csv(path)


FILE_QUERIES: dict[str, Callable] = {
    f.__name__: f
    for f in (
        xes_roundtrip, ocel_json_roundtrip, ocel_json_flatten, ocel1_tables, ocel2_tables, profile_csv_roundtrip, representatives_csv, clustered_csv_scores,
        graphml_roundtrip, run_tables, run_names, node_table_csv, medoids_csv, scores_csv,
    )
}

_FLAT = """
SELECT DISTINCT {case} AS case_id, o_orderpriority AS activity, epoch_us(o_orderdate) AS ts_us{order}
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""

FILE_ORACLES: dict[str, str] = {
    "xes_roundtrip": """
SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, epoch_us(ts) AS ts_us,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events""",
    "ocel_json_roundtrip": """
SELECT CAST(o_orderkey AS VARCHAR) AS eid, 'customer-' || o_custkey AS oid, 'placed by' AS qualifier FROM orders
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'part-' || l_partkey, 'contains' FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'supplier-' || l_suppkey, 'shipped by' FROM lineitem""",
    "ocel_json_flatten": "SELECT 'customer-' || o_custkey AS case_id, o_orderpriority AS activity, epoch_us(o_orderdate) AS ts_us FROM orders",
    "ocel1_tables": "SELECT case_id, activity, ts_us FROM (" + _FLAT.format(case="'supplier-' || l_suppkey", order=", o_orderkey") + ")",
    "ocel2_tables": "SELECT case_id, activity, ts_us FROM (" + _FLAT.format(case="'supplier-' || l_suppkey", order=", o_orderkey") + ")",
    "profile_csv_roundtrip": f'SELECT "case", CAST(COLUMNS(* EXCLUDE ("case")) AS DOUBLE) FROM ({BASE["wide_profile"]})',
    "representatives_csv": f"SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({BASE['representatives']})",
    "clustered_csv_scores": BASE["calinski_harabasz"],
    "graphml_roundtrip": """
SELECT 'c' || c_custkey AS node, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS other, CAST(NULL AS DOUBLE) AS weight FROM customer
UNION ALL SELECT least('c' || o_custkey, o_orderpriority), NULL, greatest('c' || o_custkey, o_orderpriority), CAST(count(*) AS DOUBLE)
FROM orders GROUP BY o_custkey, o_orderpriority""",
    "run_tables": f"SELECT community, size * 2 AS size FROM ({BASE['community_sizes']})",
    "run_names": f"""
WITH b AS ({BASE['bridge_nodes']})
SELECT 'base_k3' AS run, count(*) AS nodes, CAST(sum("TotalEdges") AS BIGINT) AS edges, true AS has_files FROM b
UNION ALL SELECT 'base_k3_busy', count(*), CAST(sum("TotalEdges") AS BIGINT), true FROM b WHERE "ExternalEdges" > 3""",
    "node_table_csv": BASE["node_table"],
    "medoids_csv": f"SELECT CAST(case_id AS VARCHAR) AS \"case\", CAST(cluster AS VARCHAR) AS community FROM ({BASE['medoid_minhash']})",
    "scores_csv": BASE["score_runs"],
}
