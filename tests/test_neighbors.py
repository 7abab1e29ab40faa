import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktrace.operators import neighbors, profile
from sparktrace.plans.variants import knn_graph, profile_log


def brute(points, metric, k):
    a = points.select(F.col("id").alias("src"), F.struct(*metric.columns).alias("a"))
    b = points.select(F.col("id").alias("dst"), F.struct(*metric.columns).alias("b"))
    dist = metric.distance(lambda c: F.col("a")[c], lambda c: F.col("b")[c])
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return (
        a.join(b, F.col("src") != F.col("dst")).select("src", "dst", dist.alias("dist"))
        .withColumn("rank", rank).filter(F.col("rank") <= k)
    )


def same(left, right):
    columns = ["src", "dst", "dist", "rank"]
    assert sorted(map(tuple, left.select(columns).collect())) == sorted(map(tuple, right.select(columns).collect()))


@pytest.fixture(scope="module")
def points(spark):
    """120 cases of differing shape; a third of them are copies of one case."""
    log = spark.range(120).selectExpr("id", "explode(sequence(0L, 2 + id % 5)) AS j").selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0L ELSE id END AS shape", "id", "j"
    ).filter("j <= 2 + shape % 5").selectExpr(
        "cast(id AS string) AS case_id", "chr(65 + cast((shape * 7 + j * (shape % 4 + 1)) % 4 AS int)) AS activity",
        "timestampadd(SECOND, cast(shape * shape % 97 * 50 + j * (shape % 11) * 30 AS int), timestamp_ntz'2024-01-01 00:00:00') AS ts",
        "id * 10 + j AS seq",
    )
    made = profile_log(log)
    return neighbors.mixed_points(profile.profile_strings(made.profiles, made.alphabet.size)).persist()


@pytest.mark.parametrize("w_time", [0.5, 0.001])
def test_knn_equals_brute_force(points, w_time):
    metric = neighbors.mixed_metric(1, 1, w_time)
    same(neighbors.knn(points, metric, 3), brute(points, metric, 3))


def test_split_units_change_nothing(points, monkeypatch):
    metric = neighbors.mixed_metric(1, 1, 0.01)
    monkeypatch.setattr(neighbors, "UNIT", 5)
    same(neighbors.knn(points, metric, 4, pivots=2), brute(points, metric, 4))


def test_euclidean(spark, monkeypatch):
    df = spark.range(90).selectExpr("id", "array(cast(id % 9 AS double), sqrt(id % 30), cast(id % 2 AS double)) AS v")
    points = neighbors.vector_points(df, "id", "v")
    metric = neighbors.euclidean_metric()
    same(neighbors.knn(points, metric, 3), brute(points, metric, 3))
    monkeypatch.setattr(neighbors, "UNIT", 7)
    same(neighbors.knn(points, metric, 3), brute(points, metric, 3))
    own = neighbors.knn(points, metric, 3, include_self=True)
    assert own.filter("rank = 1 AND src = dst AND dist = 0").count() == 90
    assert own.count() == 270


def test_small_log(small_log):
    made = profile_log(small_log)
    near = {r["src"]: r["dst"] for r in knn_graph(made, k=1).collect()}
    assert near == {"c1": "c2", "c2": "c3", "c3": "c2"}
    edges = neighbors.knn_edges(knn_graph(made, k=1))
    assert sorted(map(tuple, edges.select("src", "dst").collect())) == [("c1", "c2"), ("c2", "c3")]


def test_time_scales(small_log):
    made = profile_log(small_log)
    unit = neighbors.scale_time(made.profiles, "unit")
    assert unit.agg(F.max(F.col("time")[0]), F.min(F.col("time")[0])).first() == (1.0, 0.0)
    scored = neighbors.scale_time(made.profiles, "zscore").agg(F.avg(F.col("time")[0]), F.stddev_pop(F.col("time")[0])).first()
    assert scored[0] == pytest.approx(0, abs=1e-9) and scored[1] == pytest.approx(1)
    with pytest.raises(ValueError):
        neighbors.scale_time(made.profiles, "other")


def brute_pairs(points, metric, radius):
    a = points.select(F.col("id").alias("src"), F.struct(*metric.columns).alias("a"))
    b = points.select(F.col("id").alias("dst"), F.struct(*metric.columns).alias("b"))
    dist = metric.distance(lambda c: F.col("a")[c], lambda c: F.col("b")[c])
    return sorted(map(tuple, a.join(b, F.col("src") < F.col("dst")).select("src", "dst", dist.alias("dist")).filter(F.col("dist") <= radius).collect()))


@pytest.mark.parametrize("radius, weights", [(0.0, (1, 1, 0.5)), (3.0, (1, 1, 0.001)), (60.0, (1, 2, 0.5)), (5.0, (0, 1, 0.01)), (1e9, (1, 1, 1))])
def test_radius_join_equals_brute_force(points, radius, weights, monkeypatch):
    monkeypatch.setattr(neighbors, "UNIT", 16)
    metric = neighbors.mixed_metric(*weights)
    near = neighbors.radius_join(points, metric, radius, pivots=7)
    assert sorted(map(tuple, neighbors.all_pairs(near).collect())) == brute_pairs(points, metric, radius)
    first = {r["id"]: r["representative"] for r in near.members.collect()}
    assert len(first) == points.count() and all(first[r] == r for r in first.values())
    # Equal points are not written out among each other.
    assert near.pairs.count() == near.pairs.select("src", "dst").distinct().count()
    assert near.pairs.filter("src >= dst").count() == 0


@pytest.mark.parametrize("radius", [0.0, 2.0, 9.0])
def test_radius_join_of_vectors(spark, radius):
    rows = [(i, [float(i * 7 % 11), float(i * i % 5), 0.0 if i % 4 else 3.0]) for i in range(60)]
    points = neighbors.vector_points(spark.createDataFrame(rows, "id bigint, v array<float>"), "id", "v")
    metric = neighbors.euclidean_metric()
    assert sorted(map(tuple, neighbors.all_pairs(neighbors.radius_join(points, metric, radius)).collect())) == brute_pairs(points, metric, radius)
    assert neighbors.radius_join(points.limit(0), metric, radius).pairs.count() == 0


def test_thresholded_distance_equals_distance(points):
    """Within the limit the distance itself, beyond it null, whatever the limit."""
    metric = neighbors.mixed_metric(1, 1, 0.5)
    rows = points.limit(25).select(F.struct(*metric.columns).alias("a")).crossJoin(points.select(F.struct(*metric.columns).alias("b")))
    left, right = (lambda c: F.col("a")[c]), (lambda c: F.col("b")[c])
    both = rows.withColumn("limit", F.explode(F.array(F.lit(0.0), F.lit(2.0), F.lit(40.5), F.lit(float("inf"))))).select(
        "limit", metric.distance(left, right).alias("dist"), metric.within(left, right, F.col("limit") + neighbors.SLACK).alias("within")
    )
    assert both.filter("dist <= limit AND NOT (within <=> dist)").count() == 0
    assert both.filter("dist > limit + 0.001 AND within IS NOT NULL").count() == 0


def test_vectors_are_compared_block_with_block(spark, monkeypatch):
    """Without structure rings exclude nothing, so vectors are not dealt to them; ties, copies, other lengths and missing numbers."""
    def dealt(*_):
        raise AssertionError("vectors were dealt to rings")

    monkeypatch.setattr(neighbors, "_cells", dealt)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 9)
    rows = [(i, [float(i * 7 % 13 % 5), float(i * i % 4), float(i % 3)]) for i in range(120)] + [(i, [float(i), 1.0]) for i in range(120, 130)]
    points = neighbors.vector_points(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v")
    metric = neighbors.euclidean_metric()
    lengths = [points.filter(F.size("vec") == n) for n in (2, 3)]
    odd = neighbors.vector_points(spark.createDataFrame([(900, None), (901, [1.0, None, 0.0]), (902, [float("nan"), 1.0, 1.0])], "id bigint, v array<double>"), "id", "v")
    found = neighbors.knn(points.unionByName(odd), metric, 4)
    same(found, brute(lengths[0], metric, 4).unionByName(brute(lengths[1], metric, 4)))
    pairs = neighbors.all_pairs(neighbors.radius_join(points.unionByName(odd), metric, 1.5)).collect()
    assert sorted(map(tuple, pairs)) == sorted(x for part in lengths for x in brute_pairs(part, metric, 1.5))


def test_coordinates_alone_exclude(spark, points, monkeypatch):
    """Where seconds outweigh edits, pivots are not measured by edit distance; ties, copies, split cells, a case without times."""
    def dealt(*_):
        raise AssertionError("edit distances to pivots")

    monkeypatch.setattr(neighbors, "_cells", dealt)
    monkeypatch.setattr(neighbors, "UNIT", 6)
    metric = neighbors.mixed_metric(1, 2, 0.5)
    untimed = points.limit(1).withColumns({"id": F.lit("untimed"), "time": F.transform("time", lambda x: F.lit(None).cast("double"))})
    found = neighbors.knn(points.unionByName(untimed), metric, 4, pivots=5)
    same(found, brute(points, metric, 4))
    near = neighbors.radius_join(points.unionByName(untimed), metric, 90.0, pivots=5)
    assert sorted(map(tuple, neighbors.all_pairs(near).collect())) == brute_pairs(points, metric, 90.0)


@pytest.mark.parametrize("radius", [0.0, 40.0, 300.0, 1500.0, 1e9])
def test_neighbours_are_counted_without_pairs(spark, points, radius, monkeypatch):
    """Counts within a radius are those of the pairs, also where whole blocks are settled by their boxes, and no pair is listed for them."""
    metric = neighbors.mixed_metric(1, 2, 0.5)
    untimed = points.limit(1).withColumns({"id": F.lit("untimed"), "time": F.transform("time", lambda x: F.lit(None).cast("double"))})
    monkeypatch.setattr(neighbors, "COUNT_BLOCK", 4)
    near = neighbors.radius_join(points.unionByName(untimed), metric, radius, pivots=5)
    found = {r["representative"]: r["near"] for r in near.degrees().collect()}
    first = {r["id"]: r["representative"] for r in near.members.collect()}
    listed = {(first[a], first[b]) for a, b, _ in brute_pairs(points, metric, radius)}
    expected = {}
    for a, b in {(min(p), max(p)) for p in listed if p[0] != p[1]}:
        expected[a], expected[b] = expected.get(a, 0) + 1, expected.get(b, 0) + 1
    assert {k: v for k, v in found.items() if v} == expected
    if radius == 300.0:  # a case without a name: both ends of its pairs are the other one
        last = points.groupBy().agg(F.max("id")).first()[0]
        near = neighbors.radius_join(points.withColumn("id", F.when(F.col("id") != last, F.col("id"))), metric, radius, pivots=5)
        ends = near.pairs.select(F.col("src").alias("r")).unionAll(near.pairs.select("dst")).groupBy("r").count().collect()
        assert {r["representative"]: r["near"] for r in near.degrees().collect() if r["representative"]} == {r["r"]: r["count"] for r in ends if r["r"]}
