import gzip
import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sparktrace.operators import profile
from sparktrace.plans.variants import profile_log
from sparktrace.sources import logs, tables

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0">
  <trace><string key="concept:name" value="task-1"/>
    <event><string key="org:group" value="g"/><string key="concept:name" value="0_A - b (1)"/><date key="time:timestamp" value="2024-01-01T10:00:00.000+02:00"/></event>
    <event><string key="concept:name" value="C"/><date key="time:timestamp" value="2024-01-01T11:00:00.500+02:00"/></event>
  </trace>
  <trace><string key="concept:name" value="task-2"/>
    <event><string key="concept:name" value="C"/><date key="time:timestamp" value="2024-01-02T00:00:00Z"/></event>
  </trace>
</log>"""

OCEL = {
    "objectTypes": [], "eventTypes": [],
    "objects": [{"id": "o1", "type": "order"}, {"id": "i1", "type": "item"}],
    "events": [
        {"id": "e1", "type": "pay", "time": "2024-01-01T00:00:00Z", "relationships": [{"objectId": "o1", "qualifier": "x"}, {"objectId": "i1", "qualifier": "y"}]},
        {"id": "e2", "type": "ship", "time": "2024-01-02T00:00:00Z", "relationships": [{"objectId": "o1", "qualifier": "x"}]},
    ],
}


def test_xes_of_a_long_case(spark, tmp_path):
    """A case is written in elements of bounded length and read as one."""
    log = spark.range(95).selectExpr(
        "concat('c', CAST(id < 70 AS int)) AS case_id", "chr(65 + cast(id % 7 AS int)) AS activity",
        "timestampadd(SECOND, cast(id div 3 AS int), timestamp_ntz'2024-01-01 00:00:00') AS ts", "id AS seq",
    )
    logs.write_xes(log, str(tmp_path / "xes"), part_events=16)
    elements = spark.read.format("xml").option("rowTag", "trace").schema("event array<struct<string: array<struct<_key: string>>>>").load(str(tmp_path / "xes"))
    assert sorted(r[0] for r in elements.selectExpr("size(event)").collect()) == [6, 9, 16, 16, 16, 16, 16]
    back = logs.read_xes(spark, str(tmp_path / "xes"), normalize=False)
    columns = ["case_id", "activity", "ts"]
    assert back.orderBy("case_id", "seq").select(columns).collect() == log.orderBy("case_id", "seq").select(columns).collect()
    assert [r[0] for r in back.filter("case_id = 'c1'").orderBy("seq").select("seq").collect()] == list(range(70))


@pytest.mark.parametrize("packed", [False, True])
def test_xes(spark, tmp_path, packed):
    path = tmp_path / ("log.xes.gz" if packed else "log.xes")
    path.write_bytes(gzip.compress(XES.encode()) if packed else XES.encode())
    got = logs.read_log(spark, str(path)).orderBy("case_id", "seq").selectExpr("case_id", "activity", "cast(ts AS string)", "seq")
    assert [tuple(r) for r in got.collect()] == [
        ("task-1", "A__b_1", "2024-01-01 08:00:00", 0),
        ("task-1", "C", "2024-01-01 09:00:00.5", 1),
        ("task-2", "C", "2024-01-02 00:00:00", 0),
    ]


def test_ocel_json(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text(json.dumps(OCEL, indent=1))
    flat = logs.read_log(spark, str(path), "order")
    assert sorted((r["case_id"], r["activity"]) for r in flat.collect()) == [("o1", "pay"), ("o1", "ship")]
    with pytest.raises(ValueError):
        logs.read_log(spark, str(path))
    assert profile_log(flat).profiles.count() == 1


def test_ocel_tables(spark):
    layout2 = {
        "event_map_type": spark.createDataFrame([("pay order", "payorder")], "ocel_type string, ocel_type_map string"),
        "event_payorder": spark.createDataFrame([("e1", "2024-01-01 00:00:00")], "ocel_id string, ocel_time string"),
        "object": spark.createDataFrame([("o1", "order")], "ocel_id string, ocel_type string"),
        "event_object": spark.createDataFrame([("e1", "o1", "x")], "ocel_event_id string, ocel_object_id string, ocel_qualifier string"),
    }
    flat = logs.read_ocel2_tables(layout2.__getitem__).flatten("order")
    assert [(r["case_id"], r["activity"]) for r in flat.collect()] == [("o1", "pay order")]
    layout1 = {
        "EVENTS": spark.createDataFrame([("1", "pay", "2024-01-01 00:00:00")], ["ocel:eid", "ocel:activity", "ocel:timestamp"]),
        "OBJECTS": spark.createDataFrame([("o1", "order")], ["ocel:oid", "ocel:type"]),
        "RELATIONS": spark.createDataFrame([("1", "o1")], ["ocel:eid", "ocel:oid"]),
    }
    flat = logs.read_ocel1_tables(layout1.__getitem__).flatten("order")
    assert [(r["case_id"], r["activity"]) for r in flat.collect()] == [("o1", "pay")]


def test_formats():
    names = {"a.xes": "xes", "x/b.sqlite2": "ocel2_sqlite", "sqlite/c.db": "ocel_sqlite", "d.json": "ocel2_json"}
    assert {n: logs.detect_format(n) for n in names} == names


def test_profile_csv(spark, small_log, tmp_path):
    made = profile_log(small_log)
    wide = profile.wide_profile(made.profiles, made.alphabet)
    tables.write_csv(wide, str(tmp_path / "profile"))
    back, alphabet = profile.sparse_profile(tables.read_profile_csv(spark, str(tmp_path / "profile")))
    columns = ["case_id", "acts", "trans", "time"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, made.profiles.select(columns).collect()))
    clustered = wide.withColumn("cluster", F.when(F.col("case") == "c1", 0).otherwise(1))
    tables.write_csv(clustered, str(tmp_path / "clustered"))
    points = tables.read_clustered_csv(spark, str(tmp_path / "clustered"))
    assert {(r["id"], r["label"], len(r["vec"])) for r in points.collect()} == {("c1", 0, 22), ("c2", 1, 22), ("c3", 1, 22)}


def test_unnamed_index(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",A,A->A,t\n1093.0,1,2,x\n")
    row = tables.read_profile_csv(spark, str(tmp_path / "p.csv")).first()
    assert tuple(row) == ("1093", 1.0, 2.0, None)


def test_representatives(spark, tmp_path):
    (tmp_path / "r.csv").write_text("community,degree_rep,betweenness_rep,pagerank_rep\n0,41.0,7,7\n")
    assert tables.read_representatives_csv(spark, str(tmp_path / "r.csv")).first()["degree_rep"] == "41"
    with pytest.raises(ValueError):
        tables.read_representatives_csv(spark, str(tmp_path / "r.csv"), None)
    assert [r["path"].rsplit("/", 1)[1] for r in tables.files_of(spark, str(tmp_path), "r").collect()] == ["r.csv"]


def test_graphml_and_runs(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 7.5), ("b", "c", 1.0)], "src string, dst string, weight double")
    named = spark.createDataFrame([("a", "x"), ("b", None), ("alone", "y")], "node string, colour string")
    tables.write_graphml(edges, str(tmp_path / "g"), named)
    nodes, back = tables.read_graphml(spark, str(tmp_path / "g"), ("colour",))
    assert sorted(map(tuple, back.collect())) == [("a", "b", 7.5), ("b", "c", 1.0)]
    assert sorted(map(tuple, nodes.collect())) == [("a", "x"), ("alone", "y"), ("b", None)]
    (tmp_path / "one.graphml").write_text(
        '<graphml><graph edgedefault="directed"><node id="x"/><node id="y"/>'
        '<edge source="y" target="x"/><edge source="x" target="y"/></graph></graphml>'
    )
    nodes, loaded = tables.read_graphml(spark, str(tmp_path / "one.graphml"))
    assert sorted(r[0] for r in nodes.collect()) == ["x", "y"]
    assert [tuple(r) for r in loaded.collect()] == [("x", "y", 1.0)]
    for k in (1, 15):
        tables.write_run(edges, str(tmp_path / "runs"), dataset="base", k=k)
    assert tables.read_run(spark, str(tmp_path / "runs"), dataset="base", k=1).count() == 2
    with pytest.raises(ValueError):
        tables.write_run(edges, str(tmp_path / "runs"), k=1)


def test_graphml_in_one_document(spark, tmp_path):
    """One file is one graph for any reader: declared keys, nodes before edges, marked characters."""
    edges = spark.createDataFrame([("a&b", 'c"d', 2.0), ('c"d', "<e>", 1.0)], "src string, dst string, weight double").repartition(3)
    named = spark.createDataFrame([("a&b", 1, "x > y"), ('c"d', None, None), ("<e>", 3, ""), ("alone", 4, "\n")], "node string, size int, `my name` string")
    tables.write_graphml(edges, str(tmp_path / "g"), named, documents=1)
    (file,) = (tmp_path / "g").glob("part-*")
    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ElementTree.parse(file).getroot()
    assert {(k.get("id"), k.get("for"), k.get("attr.type")) for k in root.iter(f"{space}key")} == {("weight", "edge", "double"), ("size", "node", "int"), ("my name", "node", "string")}
    (graph,) = root.findall(f"{space}graph")
    assert [e.tag for e in graph] == [f"{space}node"] * 4 + [f"{space}edge"] * 2
    assert {n.get("id"): {d.get("key"): d.text for d in n} for n in graph.iter(f"{space}node")} == {
        "a&b": {"size": "1", "my name": "x > y"}, 'c"d': {}, "<e>": {"size": "3", "my name": None}, "alone": {"size": "4", "my name": "\n"},
    }
    nodes, back = tables.read_graphml(spark, str(tmp_path / "g"), ("size",))
    assert sorted(map(tuple, back.collect())) == [("<e>", 'c"d', 1.0), ("a&b", 'c"d', 2.0)]
    assert dict(map(tuple, nodes.collect())) == {"a&b": "1", 'c"d': None, "<e>": "3", "alone": "4"}


def test_result_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 0, 0.123456)], "node string, community int, cent_degree double")
    tables.write_node_table(nodes, str(tmp_path / "nodes"))
    assert spark.read.option("header", True).csv(str(tmp_path / "nodes")).first()["cent_degree"] == "0.1235"
    tables.write_medoids(spark.createDataFrame([(0, "a", 1.0)], "cluster int, case_id string, total double"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["case", "community"]


def test_ocel_json_parts_are_compressed_and_name_an_object_once(spark, tmp_path):
    events = spark.createDataFrame([("e1", "a", "2024-01-01 00:00:00"), ("e2", "b", "2024-01-02 00:00:00")], "eid string, activity string, at string")
    events = events.selectExpr("eid", "activity", "CAST(at AS timestamp_ntz) AS ts")
    objects = spark.createDataFrame([("o1", "x"), ("o2", None)], "oid string, type string")
    relations = spark.createDataFrame([("e1", "o1", "p"), ("e1", "o1", "q"), ("e1", "o2", None), ("e1", "o1", "p")], "eid string, oid string, qualifier string")
    logs.write_ocel2_json(logs.ObjectLog(events, objects, relations), str(tmp_path / "log.json"))
    assert list((tmp_path / "log.json").glob("part-*")) == list((tmp_path / "log.json").glob("part-*.json.gz")) != []
    found = logs.read_ocel2_json(spark, str(tmp_path / "log.json"))
    assert sorted(map(repr, found.relations.collect())) == sorted(map(repr, relations.collect()))
    assert sorted(map(repr, found.objects.collect())) == sorted(map(repr, objects.collect()))
    assert sorted(r["eid"] for r in found.events.collect()) == ["e1", "e2"]
    listed = spark.read.json(str(tmp_path / "log.json")).selectExpr("events[0].id AS id", "size(objects) AS n").collect()
    assert {r["id"]: r["n"] for r in listed} == {"e1": 2, "e2": 0}
