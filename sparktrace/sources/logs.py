"""Event log files: XES and object-centric logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import normalize_label
from ..operators.eventlog import PART_EVENTS, flatten_ocel, positioned

# Attribute keys of the XES standard extensions.
XES_NAME = "concept:name"
XES_TIME = "time:timestamp"
# Attribute of a trace element that goes on with a case: the position of its first event.
XES_FIRST = "part:first"

_ATTRIBUTE = "array<struct<_key: string, _value: string>>"
_TRACE = f"string {_ATTRIBUTE}, int {_ATTRIBUTE}, event array<struct<string: {_ATTRIBUTE}, date: {_ATTRIBUTE}>>"
_OCEL2_JSON = (
    "objects array<struct<id: string, type: string>>, "
    "events array<struct<id: string, type: string, time: string, "
    "relationships: array<struct<objectId: string, qualifier: string>>>>"
)


@dataclass(frozen=True)
class ObjectLog:
    """Object-centric log: events (eid, activity, ts), objects (oid, type), relations (eid, oid, qualifier)."""

    events: DataFrame
    objects: DataFrame
    relations: DataFrame

    def flatten(self, notion: str, case_key: str = "object") -> DataFrame:
        return flatten_ocel(self.events, self.objects, self.relations, notion, case_key)


def _attribute(column: str, key: str):
    return F.get(F.filter(column, lambda a: a["_key"] == key), F.lit(0))["_value"]


def read_xes(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """Event log from XES, also compressed. Files are split at trace tags; ``seq`` is the position in the trace (of several elements of a
    long case, as ``write_xes`` makes them, the position in all of them)."""
    traces = spark.read.format("xml").option("rowTag", "trace").schema(_TRACE).load(path)
    case = F.coalesce(_attribute("string", XES_NAME), _attribute("int", XES_NAME)).cast("string")
    first = F.coalesce(_attribute("int", XES_FIRST).cast("bigint"), F.lit(0))
    events = traces.select(case.alias("case_id"), first.alias("first"), F.posexplode("event").alias("at", "e"))
    label = F.get(F.filter("e.string", lambda a: a["_key"] == XES_NAME), F.lit(0))["_value"]
    time = F.get(F.filter("e.date", lambda a: a["_key"] == XES_TIME), F.lit(0))["_value"]
    return events.select(
        "case_id",
        (normalize_label(label) if normalize else label).alias("activity"),
        F.to_timestamp(time).cast("timestamp_ntz").alias("ts"),
        (F.col("first") + F.col("at")).alias("seq"),
    )


def write_xes(log: DataFrame, path: str, part_events: int = PART_EVENTS) -> None:
    """A log as XES part files: a trace element for every ``part_events`` events of a case, in order. Elements after the first say
    at which position they begin."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")

    def one(key: str, value):
        return F.array(F.struct(F.lit(key).alias("_key"), value.alias("_value")))

    event = F.struct("pos", F.struct(one(XES_NAME, F.col("activity")).alias("string"), one(XES_TIME, stamp).alias("date")).alias("event"))
    traces = positioned(log).groupBy("case_id", F.expr(f"pos - pos % {part_events}").alias("first")).agg(F.sort_array(F.collect_list(event)).alias("events"))
    traces.select(
        one(XES_NAME, F.col("case_id")).alias("string"),
        F.when(F.col("first") > 0, one(XES_FIRST, F.col("first").cast("string"))).alias("int"),
        F.transform("events", lambda e: e["event"]).alias("event"),
    ).write.format("xml").options(rootTag="log", rowTag="trace").save(path)


def write_ocel2_json(log: ObjectLog, path: str, compression: str = "gzip") -> None:
    """An object-centric log as OCEL 2.0 JSON, one document per line: an event with its objects, so that lines stay small.

    Parts are compressed (``compression="none"`` for plain text); readers of one document take either. Every relation travels to its
    event once, with its object's type.
    """
    related = log.relations.join(log.objects, "oid").groupBy("eid").agg(F.collect_list(F.struct("oid", "qualifier", "type")).alias("related"))
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    relationships = F.transform("related", lambda r: F.struct(r["oid"].alias("objectId"), r["qualifier"].alias("qualifier")))
    objects = F.array_distinct(F.transform("related", lambda r: F.struct(r["oid"].alias("id"), r["type"].alias("type"))))
    event = F.struct(F.col("eid").cast("string").alias("id"), F.col("activity").alias("type"), time.alias("time"), F.coalesce(relationships, F.array()).alias("relationships"))
    log.events.join(related, "eid", "left").select(F.coalesce(objects, F.array()).alias("objects"), F.array(event).alias("events")).write.json(path, compression=compression)


def read_ocel2_json(spark: SparkSession, path: str, lines: bool = True) -> ObjectLog:
    """OCEL 2.0 JSON, one document per line; a document that spans lines (``lines=False``) is read by one task, which suits small files.

    An object named in several documents is one object.
    """
    docs = spark.read.schema(_OCEL2_JSON).option("multiLine", not lines).json(path)
    events = docs.select(F.explode("events").alias("e"))
    return ObjectLog(
        events.select(
            F.col("e.id").alias("eid"), F.col("e.type").alias("activity"),
            F.to_timestamp("e.time").cast("timestamp_ntz").alias("ts"),
        ),
        docs.select(F.explode("objects").alias("o")).select(F.col("o.id").alias("oid"), F.col("o.type").alias("type")).distinct(),
        events.select(F.col("e.id").alias("eid"), F.explode("e.relationships").alias("r")).select(
            "eid", F.col("r.objectId").alias("oid"), F.col("r.qualifier").alias("qualifier")
        ),
    )


Loader = Callable[[str], DataFrame]


def jdbc_loader(spark: SparkSession, url: str, driver: str = "org.sqlite.JDBC", partitions: int = 1, rows: int = 0) -> Loader:
    """Table loader for a SQLite file; the session needs a SQLite JDBC driver on its class path.

    With ``partitions`` above 1 tables are read by that many tasks, cut by ``rowid`` up to ``rows``.
    """
    cut_by = {"partitionColumn": "rowid", "lowerBound": "0", "upperBound": str(max(rows, 1)), "numPartitions": str(partitions)} if partitions > 1 else {}

    def load(table: str) -> DataFrame:
        source = f'(SELECT rowid, * FROM "{table}") AS t' if cut_by else f'"{table}"'
        found = spark.read.format("jdbc").options(url=url, driver=driver, dbtable=source, **cut_by).load()
        return found.drop("rowid") if cut_by else found

    return load


def read_ocel2_tables(load: Loader) -> ObjectLog:
    """OCEL 2.0 relational layout: event, object, event_object, and one event_<type> table per type with the times."""
    kinds = load("event_map_type").select("ocel_type", "ocel_type_map").collect()
    if not kinds:
        raise ValueError("the log has no event types")
    timed = None
    for kind in kinds:
        part = load(f"event_{kind['ocel_type_map']}").select(
            F.col("ocel_id").alias("eid"), F.lit(kind["ocel_type"]).alias("activity"),
            F.col("ocel_time").cast("timestamp").cast("timestamp_ntz").alias("ts"),
        )
        timed = part if timed is None else timed.unionByName(part)
    return ObjectLog(
        timed,
        load("object").select(F.col("ocel_id").alias("oid"), F.col("ocel_type").alias("type")),
        load("event_object").select(
            F.col("ocel_event_id").alias("eid"), F.col("ocel_object_id").alias("oid"),
            F.col("ocel_qualifier").alias("qualifier"),
        ),
    )


def read_ocel1_tables(load: Loader) -> ObjectLog:
    """OCEL 1.0 relational layout: EVENTS, OBJECTS and RELATIONS with ``ocel:`` columns."""
    return ObjectLog(
        load("EVENTS").select(
            F.col("`ocel:eid`").cast("string").alias("eid"), F.col("`ocel:activity`").alias("activity"),
            F.col("`ocel:timestamp`").cast("timestamp").cast("timestamp_ntz").alias("ts"),
        ),
        load("OBJECTS").select(F.col("`ocel:oid`").alias("oid"), F.col("`ocel:type`").alias("type")),
        load("RELATIONS").select(
            F.col("`ocel:eid`").cast("string").alias("eid"), F.col("`ocel:oid`").alias("oid"),
            F.lit(None).cast("string").alias("qualifier"),
        ),
    )


FORMATS = ("xes", "ocel2_sqlite", "ocel_sqlite", "ocel2_json")


def detect_format(path: str) -> str:
    """Format by name: the ``.xes`` suffix, then the words sqlite2 and sqlite anywhere in the path, else JSON."""
    if path.endswith((".xes", ".xes.gz")):
        return "xes"
    if "sqlite2" in path:
        return "ocel2_sqlite"
    return "ocel_sqlite" if "sqlite" in path else "ocel2_json"


def read_log(spark: SparkSession, path: str, notion: str | None = None, format: str | None = None, lines: bool = False) -> DataFrame:
    """Flat event log from any supported file; object-centric ones need the object type that makes a case."""
    format = format or detect_format(path)
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if format == "xes":
        return read_xes(spark, path)
    if not notion:
        raise ValueError("an object-centric log needs a case notion")
    if format == "ocel2_json":
        return read_ocel2_json(spark, path, lines).flatten(notion)
    load = jdbc_loader(spark, f"jdbc:sqlite:{path}")
    log = read_ocel2_tables(load) if format == "ocel2_sqlite" else read_ocel1_tables(load)
    return log.flatten(notion)
