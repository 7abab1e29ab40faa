"""Flat event logs: (case_id, activity, ts, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import normalize_label
from ..functions.timefeatures import CALENDAR, calendar_part, epoch_us, scaled
from ..session import cut

# Events of a case that one row of a text or one trace element of a file holds.
PART_EVENTS = 10_000


def event_log(
    df: DataFrame, case: str, activity: str, ts: str, seq: str, normalize: bool = False
) -> DataFrame:
    """Select and rename the log columns; ids become strings, time becomes zone-free."""
    label = F.col(activity).cast("string")
    return df.select(
        F.col(case).cast("string").alias("case_id"),
        (normalize_label(label) if normalize else label).alias("activity"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        F.col(seq).cast("bigint").alias("seq"),
    )


def explode_cases(df: DataFrame, case: str) -> DataFrame:
    """One row per case id when the case column is a list; scalar columns stay as they are."""
    if dict(df.dtypes)[case].startswith("array"):
        return df.withColumn(case, F.explode(case))
    return df


def filter_ocel(events: DataFrame, objects: DataFrame, relations: DataFrame, notion: str):
    """Keep the objects of one type, their relations, and the events that touch one of them."""
    kept = objects.filter(F.col("type") == notion)
    links = relations.join(kept.select("oid"), "oid", "left_semi")
    return events.join(links.select("eid"), "eid", "left_semi"), kept, links


def extended_table(events: DataFrame, objects: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per (event, object) with the object's type; repeated relations count once."""
    return (
        relations.select("eid", "oid").dropDuplicates(["eid", "oid"])
        .join(objects.select("oid", "type"), "oid")
        .join(events, "eid")
        .select("eid", "activity", "ts", "oid", "type")
    )


def flatten_ocel(
    events: DataFrame, objects: DataFrame, relations: DataFrame, notion: str, case_key: str = "object"
) -> DataFrame:
    """Flatten an object-centric log: the case is the object of the notion, or the event (``case_key='event'``)."""
    if case_key not in ("object", "event"):
        raise ValueError("case_key must be 'object' or 'event'")
    _, kept, links = filter_ocel(events, objects, relations, notion)
    flat = extended_table(events, kept, links)  # its inner join leaves the events without such an object out
    case = F.col("oid") if case_key == "object" else F.col("eid")
    return flat.select(
        case.cast("string").alias("case_id"),
        "activity",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("eid").alias("seq"),
    )


_PLACED = (("__part", T.IntegerType()), ("__at", T.LongType()), ("pos", T.LongType()), ("prev_activity", T.StringType()), ("prev_ts", T.TimestampNTZType()), ("start_ts", T.TimestampNTZType()))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the events of each case and put the one before beside each, inside one sorted partition."""
    part, seen = TaskContext.get().partitionId(), 0
    case = activity = ts = start = None
    pos = -1  # of the last event of the batch before; -1 before the first one
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, activities, times = (batch.column(batch.schema.get_field_index(c)) for c in ("case_id", "activity", "ts"))
        before = pa.concat_arrays([pa.array([case], ids.type), ids.slice(0, n - 1)])
        differs = pc.not_equal(ids, before)
        # A missing case id is a case of its own.
        differs = pc.if_else(pc.is_null(differs), pc.xor(pc.is_null(ids), pc.is_null(before)), differs).to_numpy(zero_copy_only=False).copy()
        differs[0] |= pos < 0
        at, first = np.arange(n), np.maximum.accumulate(np.where(differs, np.arange(n), -1))
        inside = at - first
        lead = int((first < 0).sum())  # events that go on with the case of the batch before
        inside[:lead] = at[:lead] + pos + 1
        new = pa.array(differs)
        prev_activity = pc.if_else(new, pa.scalar(None, activities.type), pa.concat_arrays([pa.array([activity], activities.type), activities.slice(0, n - 1)]))
        prev_ts = pc.if_else(new, pa.scalar(None, times.type), pa.concat_arrays([pa.array([ts], times.type), times.slice(0, n - 1)]))
        starts = pa.concat_arrays([pa.array([start] * lead, times.type), times.take(pa.array(first[lead:]))])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(at + seen), pa.array(inside), prev_activity, prev_ts, starts],
            names=[*batch.schema.names, *(name for name, _ in _PLACED)],
        )
        case, activity, ts, start = ids[n - 1].as_py(), activities[n - 1].as_py(), times[n - 1].as_py(), starts[n - 1].as_py()
        pos, seen = int(inside[-1]), seen + n


def positioned(log: DataFrame, order: tuple[str, ...] = ("ts", "seq"), partitions: int | None = None) -> DataFrame:
    """Add to every event its position in its case (``pos``, from 0), the one before (``prev_activity``, ``prev_ts``) and the time of
    the first (``start_ts``).

    The log is range partitioned by case, order and, among equal events, a number of its own, so a case of any length, also one whose events
    all share a time, lies in as many partitions as it needs. Each partition is read once in order. What goes over a border is known
    from one row per partition: the events of its last case in all partitions before (prefix sums), its last event and its start.
    """
    if "pos" in log.columns:
        return log
    keys = ["case_id", *order, "activity", "__own"]
    fields = T.StructType([*log.schema.fields, *(T.StructField(name, kind) for name, kind in _PLACED)])
    ranged = log.withColumn("__own", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(partitions, *keys) if partitions else ranged.repartitionByRange(*keys)
    placed = cut(ranged.sortWithinPartitions(*keys).drop("__own").mapInArrow(_follow, fields))
    borders = placed.groupBy("__part").agg(
        F.min(F.struct("__at", "case_id")).alias("first"), F.max(F.struct("__at", "case_id", "activity", "ts", "pos", "start_ts")).alias("last")
    )
    # One row per partition: bounded by their number, not by the data.
    of_case, all_before = Window.partitionBy("last.case_id").orderBy("__part"), Window.orderBy("__part")
    summed = borders.withColumn("events", F.sum(F.col("last.pos") + 1).over(of_case)).withColumn("began", F.first("last.start_ts").over(of_case))
    over = (
        summed.withColumn("before", F.lag(F.struct("last", "events", "began")).over(all_before))
        .filter(F.col("before").isNotNull() & F.col("before.last.case_id").eqNullSafe(F.col("first.case_id")))
        .select("__part", F.col("first.case_id").alias("__case"), "before")
    )
    goes_on = F.col("before").isNotNull() & F.col("case_id").eqNullSafe(F.col("__case"))
    first = goes_on & (F.col("pos") == 0)
    return placed.join(F.broadcast(over), "__part", "left").select(
        *log.columns,
        (F.col("pos") + F.when(goes_on, F.col("before.events")).otherwise(0)).alias("pos"),
        F.when(first, F.col("before.last.activity")).otherwise(F.col("prev_activity")).alias("prev_activity"),
        F.when(first, F.col("before.last.ts")).otherwise(F.col("prev_ts")).alias("prev_ts"),
        F.when(goes_on, F.col("before.began")).otherwise(F.col("start_ts")).alias("start_ts"),
    )


def event_time_features(log: DataFrame) -> DataFrame:
    """Time features of every event: seconds since case start and previous event, and calendar parts."""
    ts = F.col("ts")
    second = F.lit(1e6)
    day = F.pmod(epoch_us(ts), F.lit(86_400_000_000))
    return positioned(log).select(
        "case_id",
        "seq",
        (F.timestamp_diff("MICROSECOND", F.col("start_ts"), ts) / second).alias("accumulated_time"),
        (F.coalesce(F.timestamp_diff("MICROSECOND", F.col("prev_ts"), ts), F.lit(0)) / second).alias("execution_time"),
        (day / second).alias("within_day"),
        *[scaled(calendar_part(name, ts), low, high).alias(name) for name, low, high in CALENDAR],
    )


def trace_corpus(log: DataFrame, part_events: int = PART_EVENTS) -> DataFrame:
    """Activities of each case as one space-joined text in log order; inner spaces are dropped.

    Every ``part_events`` events of a case are one row, at any size of log and case; a case's text is its parts joined by a space.
    """
    by_position = dict(log.dtypes)["seq"] in ("bigint", "int")
    word = F.replace("activity", F.lit(" "), F.lit("")).alias("word")
    return (
        positioned(log, ("seq", "ts") if by_position else ("ts", "seq"))
        .groupBy("case_id", F.expr(f"CAST(pos div {part_events} AS int)").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", word))).alias("events"))
        .select("case_id", "part", F.array_join(F.transform("events", lambda e: e["word"]), " ").alias("trace"))
    )
