import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktrace.functions.labels import clean_case_id, normalize_label
from sparktrace.operators import eventlog, profile
from sparktrace.plans.variants import profile_log


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_labels(spark):
    cases = {"4-NOT SPECIFIED": "4NOT_SPECIFIED", "A - x (1)": "A__x_1", "0_Start": "Start", "0-_End": "End"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert dict(rows(df.select("raw", normalize_label(F.col("raw"))), "raw")) == cases


def test_case_ids(spark):
    df = spark.createDataFrame([("1093.0",), ("S_20",), ("1.05",)], "raw string")
    assert [r[0] for r in df.select(clean_case_id(F.col("raw"))).collect()] == ["1093", "S_20", "1.05"]


def test_profile(spark, small_log):
    made = profile_log(small_log)
    text = profile.profile_strings(made.profiles, made.alphabet.size)
    got = rows(text.select("case_id", "act_text", "tra_text", F.col("time")[0], F.col("time")[1]), "case_id")
    assert got == [
        ("c1", "110", "010010000", 3600.0, 2400.0),
        ("c2", "101", "001000000", 30.0, 30.0),
        ("c3", "010", "000000000", 0.0, 0.0),
    ]
    assert rows(profile.directly_follows(small_log), "act_from", "act_to") == [
        ("A", "B", 1), ("A", "C", 1), ("B", "B", 1)
    ]
    matrix = profile.directly_follows_matrix(small_log)
    assert rows(matrix.select("activity", "A", "B", "C"), "activity") == [
        ("A", 0, 1, 1), ("B", 0, 1, 0), ("C", 0, 0, 0)
    ]


def test_orders_of_activities(small_log):
    assert dict(map(tuple, profile.activity_dict(small_log).table.collect())) == {"A": 0, "B": 1, "C": 2}
    with pytest.raises(ValueError):
        profile.activity_dict(small_log, "random")


def test_wide_and_sparse_agree(small_log):
    made = profile_log(small_log)
    wide = profile.wide_profile(made.profiles, made.alphabet)
    back, alphabet = profile.sparse_profile(wide)
    assert alphabet.size == 3
    columns = ["case_id", "acts", "trans", "time"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, made.profiles.select(columns).collect()))


@pytest.fixture(scope="module")
def skewed_log(spark):
    """One case holds most events; some share a timestamp."""
    hot = spark.range(600).selectExpr("'hot' AS case_id", "chr(65 + cast(id * 7 % 5 AS int)) AS activity", "id div 2 AS s", "id AS seq")
    cold = spark.range(300).selectExpr("concat('c', id % 30) AS case_id", "chr(65 + cast(id * 3 % 4 AS int)) AS activity", "id AS s", "id + 1000 AS seq")
    return hot.union(cold).selectExpr(
        "case_id", "activity", "timestampadd(SECOND, cast(s AS int), timestamp_ntz'2024-01-01 00:00:00') AS ts", "seq"
    )


def test_borders_change_nothing(skewed_log):
    """Whatever the number of partitions, positions and neighbours are those of a window over each case."""
    case = Window.partitionBy("case_id").orderBy("ts", "seq")
    plain = skewed_log.select(
        "*", (F.row_number().over(case) - 1).cast("bigint").alias("pos"), F.lag("activity").over(case).alias("prev_activity"),
        F.lag("ts").over(case).alias("prev_ts"), F.min("ts").over(Window.partitionBy("case_id")).alias("start_ts"),
    )
    expected = sorted(map(str, plain.collect()))
    for partitions in (None, 1, 3, 40):
        made = eventlog.positioned(skewed_log, partitions=partitions)
        assert sorted(map(str, made.collect())) == expected


def test_one_case_with_one_timestamp_is_spread(spark):
    log = spark.range(4000).selectExpr("'hot' AS case_id", "chr(65 + cast(id % 5 AS int)) AS activity", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "CAST(NULL AS bigint) AS seq")
    made = eventlog.positioned(log, partitions=8)
    assert sorted(r["pos"] for r in made.select("pos").collect()) == list(range(4000))
    # Equal events are told apart by a number of their own, so they fill all partitions.
    files = [r["n"] for r in spark.read.parquet(*made.inputFiles()).groupBy("__part").agg(F.count("*").alias("n")).collect()]
    assert len(files) == 8 and max(files) < 1000


def test_log_of_missing_values(spark):
    rows = [(None, "A", None, 1), (None, None, None, 2), ("a", None, None, None), ("a", "B", None, None), ("", "C", None, 0)]
    log = spark.createDataFrame(rows, "case_id string, activity string, ts timestamp_ntz, seq bigint")
    for partitions in (1, 5):
        made = {(r["case_id"], r["activity"]): (r["pos"], r["prev_activity"]) for r in eventlog.positioned(log, partitions=partitions).collect()}
        assert made == {(None, "A"): (0, None), (None, None): (1, "A"), ("a", None): (0, None), ("a", "B"): (1, None), ("", "C"): (0, None)}
    assert eventlog.positioned(log.limit(0)).count() == 0 and eventlog.trace_corpus(log.limit(0)).count() == 0


def test_parts_of_a_text(skewed_log):
    whole = eventlog.trace_corpus(skewed_log)
    assert whole.filter("part > 0").count() == 0
    pieces = eventlog.trace_corpus(skewed_log, part_events=40)
    assert pieces.filter("case_id = 'hot'").count() == 15 and pieces.filter("size(split(trace, ' ')) > 40").count() == 0
    joined = pieces.groupBy("case_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "trace"))), lambda p: p["trace"]), " ").alias("trace")
    )
    assert rows(joined, "case_id") == rows(whole.select("case_id", "trace"), "case_id")


def test_transitions_add_up(skewed_log):
    events, cases = skewed_log.count(), skewed_log.select("case_id").distinct().count()
    assert profile.transition_counts(skewed_log).agg(F.sum("n")).first()[0] == events - cases


def test_time_profile_equals_event_means(skewed_log):
    means = eventlog.event_time_features(skewed_log).groupBy("case_id").agg(
        *[F.avg(c).alias(c) for c in ("accumulated_time", "execution_time", "within_day", "min_of_hour")]
    )
    exact = {r["case_id"]: r for r in profile.time_profile(skewed_log).collect()}
    for row in means.collect():
        for name in ("accumulated_time", "execution_time", "within_day", "min_of_hour"):
            assert row[name] == pytest.approx(exact[row["case_id"]][name], abs=1e-4)


def test_flatten(spark):
    events = spark.createDataFrame([(1, "pay", 0), (2, "ship", 60)], "eid bigint, activity string, s int").selectExpr(
        "eid", "activity", "timestampadd(SECOND, s, timestamp_ntz'2024-01-01 00:00:00') AS ts"
    )
    objects = spark.createDataFrame([("o1", "order"), ("o2", "order"), ("i1", "item")], "oid string, type string")
    links = spark.createDataFrame(
        [(1, "o1", "a"), (1, "o1", "b"), (2, "o1", "a"), (2, "o2", "a"), (1, "i1", "a")],
        "eid bigint, oid string, qualifier string",
    )
    flat = eventlog.flatten_ocel(events, objects, links, "order")
    assert rows(flat.select("case_id", "activity"), "case_id", "activity") == [("o1", "pay"), ("o1", "ship"), ("o2", "ship")]
    by_event = eventlog.flatten_ocel(events, objects, links, "order", case_key="event")
    assert rows(by_event.select("case_id"), "case_id") == [("1",), ("2",), ("2",)]
    lists = spark.createDataFrame([(["a", "b"], 1)], "case_id array<string>, x int")
    assert eventlog.explode_cases(lists, "case_id").count() == 2
