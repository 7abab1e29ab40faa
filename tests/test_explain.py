import pytest
from pyspark.sql import functions as F

from sparktrace.operators import explain
from sparktrace.plans.variants import explain_representatives, profile_log


@pytest.fixture(scope="module")
def made(small_log):
    return profile_log(small_log)


def values(df):
    return {(r["case_id"], r["feature"]): r["value"] for r in df.collect()}


def test_global(spark, made):
    reps = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "degree_rep string")
    got = explain_representatives(made, {"run": reps}).persist()
    value = values(got)
    assert value["c1", "A"] == pytest.approx(0.333333) and value["c3", "A"] == pytest.approx(-0.666667)
    names = {seg: {r["feature"] for r in got.filter(f"segment = {seg}").collect()} for seg in (2, 3)}
    assert names == {2: {"B->B", "others"}, 3: {"A->B", "A->C", "others"}}
    assert value["c1", "accumulated_time"] == pytest.approx(0.6639, abs=1e-4)
    assert not got.filter("feature = 'within_day'").count()
    assert [r["case_id"] for r in got.select("case_id", "case_pos").distinct().orderBy("case_pos").collect()] == ["c1", "c2", "c3"]
    legend = got.filter("segment = 4").select("title", "unit", "vmin", "vmax").distinct().collect()
    assert len(legend) == 1 and legend[0]["unit"] == "hours" and legend[0]["vmax"] == -legend[0]["vmin"]


def test_all_zero_segment(spark, made):
    reps = spark.createDataFrame([("c2",)], "case string")
    only = explain.only_representatives(made.profiles, reps)
    short = explain.reduce_zero_features(explain.difference_from_mean(only, made.alphabet))
    assert {r["feature"] for r in short.collect()} == {"all"}
    assert short.count() == 5


def test_local(made):
    got = explain.explain_case(made.profiles, made.alphabet, "c1", "c2")
    value = {f: v for (_, f), v in values(got).items()}
    assert [value[f] for f in ("A", "B", "C", "A->B", "A->C", "B->B")] == [0, 1, -1, 1, -1, 1]
    assert value["accumulated_time"] == pytest.approx(0.9917, abs=1e-4)
    with pytest.raises(ValueError, match="nobody"):
        explain.explain_case(made.profiles, made.alphabet, "c1", "nobody")


def test_order(spark):
    cases = spark.createDataFrame([("S_10",), ("S_9",), ("x",), ("2",)], "case_id string")
    ordered = explain.case_order(cases).orderBy("case_pos").collect()
    assert [r["case_id"] for r in ordered] == ["2", "S_9", "S_10", "x"]


def test_missing_column(spark, made):
    with pytest.raises(ValueError):
        explain.only_representatives(made.profiles, spark.createDataFrame([("a",)], "other string"), "degree_rep")


def test_support_gives_the_rows_of_the_dense_way(spark, made):
    for cases in (["c1", "c2", "c3"], ["c1"], ["c1", "c3"]):
        some = made.profiles.filter(F.col("case_id").isin(cases))
        dense = explain.with_legend(explain.reduce_zero_features(explain.difference_from_mean(some, made.alphabet))).join(explain.case_order(some), "case_id")
        sparse = explain.explain_variants(some, made.alphabet)
        columns = sorted(dense.columns)
        assert sorted(map(str, sparse.select(columns).collect())) == sorted(map(str, dense.select(columns).collect()))


def test_runs_are_explained_by_themselves(spark, made):
    runs = {"both": spark.createDataFrame([("c1.0",), ("c2",)], "case string"), "other": spark.createDataFrame([("c3",), ("c1",), ("nobody",)], "case string")}
    together = explain_representatives(made, runs, "case")
    for run, cases in (("both", ["c1", "c2"]), ("other", ["c1", "c3"])):
        alone = explain.explain_variants(made.profiles.filter(F.col("case_id").isin(cases)), made.alphabet)
        mine = together.filter(F.col("run") == run).select(alone.columns)
        assert sorted(map(str, mine.collect())) == sorted(map(str, alone.collect()))


def test_many_activities(spark):
    """50,000 activities have 2.5 billion transitions; only those that occur make rows."""
    log = spark.range(50_000).selectExpr("concat('c', id % 4) AS case_id", "concat('a', id) AS activity", "timestampadd(SECOND, CAST(id AS int), timestamp_ntz'2024-01-01 00:00:00') AS ts", "id AS seq")
    made = profile_log(log)
    some = made.profiles.filter(F.col("case_id").isin("c0", "c1"))
    long = explain.explain_variants(some, made.alphabet)
    counts = {r["segment"]: r["features"] for r in long.groupBy("segment").agg(F.countDistinct("feature").alias("features")).collect()}
    # Each case has 12,500 activities of its own and the transitions between them; no loops; equal case times.
    assert counts[1] == 25_000 + 1 and counts[2] == 1 and counts[3] == 2 * 12_499 + 1 and counts[4] == 1
    assert {r["feature"] for r in long.filter("segment = 2").collect()} == {"all"}
    pairs = spark.createDataFrame([("r", "c0", "c1"), ("r", "c0", "nobody")], "run string, case_id string, variant_id string")
    assert explain.explain_pairs(made.profiles, made.alphabet, pairs).filter("segment = 3 AND value = 1").count() == 12_499


def test_pairs_equal_single_explanations(spark, made):
    pairs = spark.createDataFrame([("r", "c1", "c2"), ("q", "c3", "c1")], "run string, case_id string, variant_id string")
    together = explain.explain_pairs(made.profiles, made.alphabet, pairs)
    columns = ["case_id", "variant_id", "segment", "feature", "value", "title", "unit", "vmin", "vmax"]
    for _, case, variant in pairs.collect():
        alone = {r["feature"]: tuple(r) for r in explain.explain_case(made.profiles, made.alphabet, case, variant).select(columns).collect()}
        mine = {r["feature"]: tuple(r) for r in together.filter((F.col("case_id") == case) & (F.col("variant_id") == variant)).select(columns).collect()}
        assert mine and all(alone[f] == row for f, row in mine.items())
        assert all(row[4] == 0 for f, row in alone.items() if f not in mine)
