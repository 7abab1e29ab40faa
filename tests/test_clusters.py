import math

import pytest
from pyspark.sql import functions as F

from sparktrace.operators import clustering, scoring
from sparktrace.operators.eventlog import event_log
from sparktrace.plans import variants

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def profiled(spark):
    log = event_log(spark.read.parquet(f"{DATA}/events.parquet"), "user_id", "event_type", "ts", "event_id")
    made = variants.profile_log(log)
    return variants.Profiled(made.profiles.persist(), made.alphabet)


@pytest.fixture(scope="module")
def line(spark):
    rows = [("a", [0.0], 0), ("b", [1.0], 0), ("c", [10.0], 1), ("d", [11.0], 1)]
    return spark.createDataFrame(rows, "id string, vec array<double>, label int")


@pytest.mark.parametrize("block", [2, 8192])
def test_scores(line, block):
    assert tuple(scoring.cluster_scores(line, 4, block).first()) == (0.8997, 0.1, 200.0)


def test_score_runs(line):
    scored, skipped = scoring.score_runs({"good": line, "one": line.withColumn("label", F.lit(0))})
    assert [tuple(r) for r in scored.collect()] == [("good", 0.9, 0.1, 200.0)]
    assert list(skipped) == ["one"]


def test_kprototypes_is_settled(profiled):
    points = clustering.cluster_points(profiled.profiles, profiled.alphabet.size)
    clustered, centroids = clustering.kprototypes(points, 3)
    assert clustered.count() == points.count()
    again = clustering.assign_clusters(points, centroids)
    assert sorted(map(tuple, again.select("case_id", "cluster").collect())) == sorted(
        map(tuple, clustered.select("case_id", "cluster").collect())
    )
    assert clustering.update_centroids(again, 3) == centroids
    with pytest.raises(ValueError):
        clustering.kprototypes(points.limit(2), 3)


def test_sweep_goes_the_way_of_single_runs(profiled):
    points = clustering.cluster_points(profiled.profiles, profiled.alphabet.size)
    made = clustering.sweep_kprototypes(points, [2, 4, 3])
    assert made.moving == [] and set(made.rounds) == {2, 3, 4}
    got = {(r["k"], r["case_id"]): (r["cluster"], r["dist"]) for r in made.clustered.collect()}
    assert len(got) == 3 * points.count()
    for k in (2, 3, 4):
        alone, centroids = clustering.kprototypes(points, k)
        assert made.centroids[k] == centroids
        for row in alone.collect():
            assert got[k, row["case_id"]] == (row["cluster"], row["dist"])


def test_sweep_tells_what_still_moves(profiled):
    points = clustering.cluster_points(profiled.profiles, profiled.alphabet.size)
    with pytest.warns(UserWarning, match="still moved"):
        made = clustering.sweep_kprototypes(points, [2, 3], max_rounds=1)
    assert made.moving == [2, 3] and made.rounds == {2: 1, 3: 1}


def test_modes_and_means_of_a_sweep_equal_single_operators(profiled):
    points = clustering.cluster_points(profiled.profiles, profiled.alphabet.size)
    assigned = clustering.assign_clusters(points, clustering.sample_centroids(points, 4))
    made = {c.cluster: c for c in clustering.update_centroids(assigned, 4) if c}
    modes = {(r["cluster"], r["pos"]): r["n"] for r in clustering.cluster_modes(assigned).collect()}
    assert modes == {(c.cluster, pos): n for c in made.values() for pos, n in c.cells.items()}
    assert {r["cluster"]: list(r["num"]) for r in clustering.cluster_means(assigned).collect()} == {i: c.num for i, c in made.items()}


@pytest.mark.parametrize("block", [3, 8192])
def test_labelings_are_scored_as_single_runs(spark, line, block):
    runs = {"good": [0, 0, 1, 1], "poor": [0, 1, 0, 1], "three": [0, 1, 2, 2], "one": [5, 5, 5, 5]}
    labels = spark.createDataFrame([(i, run, label) for run, some in runs.items() for i, label in zip("abcd", some)], "id string, run string, label int")
    got = {r["run"]: tuple(r)[1:] for r in scoring.score_labelings(line.drop("label"), labels, 4, block).collect()}
    assert got.pop("one") == (1, None, None, None)
    for run, values in got.items():
        single = line.drop("label").join(labels.filter(F.col("run") == run).drop("run"), "id")
        assert values[1:] == tuple(scoring.cluster_scores(single, 4).first()) and values[0] == len(set(runs[run]))


@pytest.mark.parametrize("tokens", ["cell", "value"])
def test_medoids_equal_brute_force(profiled, tokens, monkeypatch):
    monkeypatch.setattr(clustering, "MEDOID_BATCH", 4)
    size = profiled.alphabet.size
    clustered = profiled.profiles.withColumn(
        "cluster", F.when(F.col("case_id") == "7", 2).otherwise(F.when(F.col("case_id").cast("int") % 3 == 0, 0).otherwise(1))
    )
    points = clustering.cluster_points(clustered, size, scaled=False)
    signed = clustering.signatures(points, size, tokens).collect()
    expected = {}
    for me in signed:
        total = sum(
            1 - sum(x == y for x, y in zip(me["sig"], other["sig"])) / 128 + round(math.dist(me["num"], other["num"]), 6)
            for other in signed
            if other["cluster"] == me["cluster"] and other["case_id"] != me["case_id"]
        )
        option = (round(total, 6), me["case_id"])
        expected[me["cluster"]] = min(expected.get(me["cluster"], option), option)
    got = {r["cluster"]: r["case_id"] for r in clustering.medoids(points, size, tokens).collect()}
    assert got == {cluster: case for cluster, (_, case) in expected.items()}


def test_empty_cluster_is_reseeded(spark):
    """All cases equal but one: two of three first centroids coincide."""
    rows = [(str(i), {0: 1}, [0.0] * 10) for i in range(9)] + [("9", {0: 1, 5: 3}, [9.0] * 10)]
    points = spark.createDataFrame(rows, "case_id string, cells map<int,int>, num array<double>")
    clustered, _ = clustering.kprototypes(points, 3, max_rounds=5)
    assert clustered.count() == 10
    far = {r["case_id"]: r["cluster"] for r in clustered.collect()}
    assert far["9"] != far["0"]


def test_rounds_in_numpy_give_the_numbers_of_the_expressions(spark):
    """Values of several digits, cells that no centroid has, points without cells or numbers, equal distances."""
    rows = [(str(i), {j: (i * 7 + j * 13) % 120 for j in range(i % 5, 9)}, [((i * 31 + d * 17) % 23) / 7.0 - 1.5 for d in range(10)]) for i in range(60)]
    rows += [("none", {}, [0.0] * 10), ("far", {9_000_000_000: 12}, [1e6] * 10), ("unknown", {1: 1}, [None] + [0.0] * 9), (None, {1: 1}, [0.0] * 10), ("gone", None, [0.0] * 10)]
    points = spark.createDataFrame(rows, "case_id string, cells map<bigint,int>, num array<double>")
    centroids = [clustering.Centroid(i, rows[at][1], rows[at][2]) for i, at in enumerate((0, 7, 7, 33))]
    expected = clustering.assign_clusters(points, centroids).select("case_id", "cluster", "dist")
    found = clustering.assign_all(points, {4: centroids}).drop("k")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    made = clustering.update_all(clustering._tallies(points, {4: centroids}), [4])[4]
    assert made == clustering.update_centroids(expected.join(points, expected["case_id"].eqNullSafe(points["case_id"])).drop("case_id"), 4)


def test_few_candidates_of_medoids_are_summed(spark, monkeypatch):
    """Points spread over a square: without groups around places hundreds of sums come close enough to the best to be worked out."""
    rows = [(str(i), {0: 1}, [(i * 7919 % 1999) * 10.0, (i * 104729 % 2003) * 10.0] + [0.0] * 8, 0) for i in range(1000)]
    points = spark.createDataFrame(rows, "case_id string, cells map<bigint,int>, num array<double>, cluster int")
    written = []
    cut = clustering.cut
    monkeypatch.setattr(clustering, "cut", lambda df: written.append(1) or cut(df))
    monkeypatch.setattr(clustering, "MEDOID_BATCH", 4)
    totals = [(round(sum(math.dist(a[2], b[2]) for b in rows), 2), a[0]) for a in rows]
    found = clustering.medoids(points, 1).first()
    assert found["case_id"] == min(totals)[1]
    assert len(written) < 16


def test_matches_are_the_same_by_join_and_by_shipped_counts(profiled, monkeypatch):
    size = profiled.alphabet.size
    clustered = profiled.profiles.withColumn("cluster", (F.col("case_id").cast("int") % 3).cast("int"))
    signed = clustering.signatures(clustering.cluster_points(clustered, size, scaled=False), size).persist()
    shipped = sorted(map(tuple, clustering.similarity_sums(signed).collect()))
    monkeypatch.setattr(clustering, "SHIPPED_VALUES", 0)
    assert shipped == sorted(map(tuple, clustering.similarity_sums(signed).collect()))
