"""Mixed-type k-prototypes clustering of profiles, and medoids."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.minhash import PERMUTATIONS, minhash, token
from ..functions.mixed import Batch, Centers, nearest
from ..functions.numbers import cell_edit_distance, euclid, round_half_even
from ..functions.timefeatures import TIME_FEATURES
from ..session import cut, spread
from .neighbors import scale_time

DIGITS = 6
MAX_ROUNDS = 200
# Candidates whose exact distance sums are computed per round and cluster.
MEDOID_BATCH = 32
# Members of a cluster around which its members are gathered to bound distance sums, and of all clusters together.
MEDOID_PLACES = 1000
ALL_PLACES = 20_000
# Counts of signature values that go to every task; more are joined.
SHIPPED_VALUES = 1_000_000

_CENTROID = "cluster: int, cells: map<bigint,int>, num: array<double>"


@dataclass(frozen=True)
class Centroid:
    """Most common value per cell (zero cells left out) and mean of each number."""

    cluster: int
    cells: dict[int, int]
    num: list[float]


def cluster_points(profiles: DataFrame, size: int, scaled: bool = True) -> DataFrame:
    """(case_id, cells, num): presence and transition cells in one sparse map, time features standardised or raw."""
    source = scale_time(profiles, "zscore") if scaled else profiles
    acts = F.transform("acts", lambda pos: F.struct(pos.cast("bigint").alias("key"), F.lit(1).alias("value")))
    trans = F.transform(
        F.map_entries("trans"), lambda e: F.struct((e["key"] + size).alias("key"), e["value"].alias("value"))
    )
    keep = [c for c in ("cluster",) if c in profiles.columns]
    return source.select("case_id", F.map_from_entries(F.concat(acts, trans)).alias("cells"), F.col("time").alias("num"), *keep)


def hash_order(seed: int, draw: int = 0) -> list[Column]:
    """Seeded shuffle order of the cases."""
    return [F.md5(F.concat(F.lit(f"{seed}|{draw}|"), F.col("case_id"))), F.col("case_id")]


def sample_cases(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` random cases; the same seed draws the same ones."""
    return points.orderBy(*hash_order(seed)).limit(k)


def sample_centroids(points: DataFrame, k: int, seed: int = 0) -> list[Centroid]:
    """Random cases as first centroids, numbered in drawing order."""
    rows = sample_cases(points, k, seed).collect()
    return [Centroid(i, dict(row["cells"]), list(row["num"])) for i, row in enumerate(rows)]


def mixed_distance(a: Column, b: Column) -> Column:
    """Per-cell edit distance plus Euclidean distance of two points given as structs with ``cells`` and ``num``."""
    return round_half_even(
        cell_edit_distance(a["cells"], b["cells"]) + euclid(a["num"], b["num"], len(TIME_FEATURES)), DIGITS
    )


def assign_clusters(points: DataFrame, centroids: list[Centroid]) -> DataFrame:
    """Add the nearest centroid (``cluster``) and its distance; the lowest number wins ties.

    The centroids travel as one list of k entries, compared inside each row.
    """
    spark = points.sparkSession
    table = spark.createDataFrame([(c.cluster, c.cells, c.num) for c in centroids], _CENTROID)
    listed = table.agg(F.collect_list(F.struct("cluster", "cells", "num"))).scalar()
    here = F.struct("cells", "num")
    options = F.transform(
        "centroids", lambda c: F.struct(mixed_distance(here, c).alias("dist"), c["cluster"].alias("cluster"))
    )
    columns = [c for c in points.columns if c not in ("cluster", "dist")]
    return (
        points.withColumn("centroids", listed)
        .select(*columns, F.array_min(options).alias("best"))
        .select(*columns, F.col("best.cluster").alias("cluster"), F.col("best.dist").alias("dist"))
    )


def cluster_modes(assigned: DataFrame) -> DataFrame:
    """(cluster, pos, n): most common value of each cell where it is not zero; the smaller value wins ties."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("members"))
    values = (
        assigned.select("cluster", F.explode("cells").alias("pos", "n"))
        .groupBy("cluster", "pos", "n").agg(F.count("*").alias("count"))
    )
    return (
        values.groupBy("cluster", "pos")
        .agg(F.min(F.struct((-F.col("count")).alias("order"), "n")).alias("top"), F.sum("count").alias("filled"))
        # One row per cluster on the right.
        .join(sizes, "cluster")
        .filter(-F.col("top.order") > F.col("members") - F.col("filled"))
        .select("cluster", "pos", F.col("top.n").alias("n"))
    )


def cluster_means(assigned: DataFrame) -> DataFrame:
    """(cluster, num, members): mean of each number, rounded so that the summing order leaves no trace."""
    means = [round_half_even(F.avg(F.col("num")[i]), 9) for i in range(len(TIME_FEATURES))]
    return assigned.groupBy("cluster").agg(F.array(*means).alias("num"), F.count("*").alias("members"))


@dataclass(frozen=True)
class Sweep:
    """Clusterings of one set of points into several numbers of clusters."""

    clustered: DataFrame  # (k, case_id, cluster, dist)
    centroids: dict[int, list[Centroid]]
    rounds: dict[int, int]
    moving: list[int]  # numbers of clusters whose centroids still moved when the rounds ended


def _assign(batch: pa.RecordBatch, centroids: dict[int, list[Centroid]], centers: Centers) -> Iterator[tuple[int, Batch, np.ndarray, np.ndarray, np.ndarray]]:
    """For every k the points of a batch with the place of their nearest centroid, its distance, and where that is missing."""
    points = Batch.of(batch.column("cells"), batch.column("num"), len(TIME_FEATURES))
    dist, none = centers.distances(points, DIGITS)
    at, rows = 0, np.arange(len(dist))
    for k, some in sorted(centroids.items()):
        best = nearest(dist[:, at : at + len(some)], none[:, at : at + len(some)])
        yield k, points, best, dist[rows, at + best], none[rows, at + best]
        at += len(some)


def _centers(centroids: dict[int, list[Centroid]]) -> Centers:
    listed = [c for _, some in sorted(centroids.items()) for c in some]
    return Centers([c.cells for c in listed], [c.num for c in listed], len(TIME_FEATURES))


def assign_all(points: DataFrame, centroids: dict[int, list[Centroid]]) -> DataFrame:
    """(k, case_id, cluster, dist): for every number of clusters k the nearest of its centroids; the lowest number wins ties."""
    schema = T.StructType([T.StructField("k", T.IntegerType()), points.schema["case_id"], T.StructField("cluster", T.IntegerType()), T.StructField("dist", T.DoubleType())])

    def run(batches):
        centers = _centers(centroids)
        for batch in batches:
            for k, _, best, dist, none in _assign(batch, centroids, centers):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), k, dtype=np.int32)), batch.column("case_id"), pa.array(best.astype(np.int32)), pa.array(dist, mask=none)], names=schema.names
                )

    return points.select("case_id", "cells", "num").mapInArrow(run, schema)


_TALLY = "k int, cluster int, pos bigint, n int, count bigint, total double"


def _tallies(points: DataFrame, centroids: dict[int, list[Centroid]]) -> DataFrame:
    """Each point is assigned for every k; of every batch come the counts by k, cluster, cell and value. The sums of the numbers are
    the totals of cells of their own (-1, -2, ...)."""
    dims = len(TIME_FEATURES)

    def run(batches):
        centers = _centers(centroids)
        for batch in batches:
            for k, points, best, _, _ in _assign(batch, centroids, centers):
                codes, size = max(1, len(points.pos)), len(centroids[k])
                table = np.bincount(np.repeat(best, np.diff(points.begin)) * codes + points.code, minlength=size * codes)
                filled = np.flatnonzero(table)
                members = np.bincount(best[~points.unknown], minlength=size)
                found = np.flatnonzero(members)
                have = ~points.lacks & ~points.unknown[:, None]
                sums = [np.bincount(best, np.where(have[:, i], points.num[:, i], 0.0), minlength=size)[found] for i in range(dims)]
                none = [np.bincount(best[have[:, i]], minlength=size)[found] == 0 for i in range(dims)]
                columns = (
                    np.full(len(filled) + dims * len(found), k),
                    np.concatenate([filled // codes, np.tile(found, dims)]),
                    np.concatenate([points.pos[filled % codes], -1 - np.repeat(np.arange(dims), len(found))]),
                    np.concatenate([points.n[filled % codes], np.zeros(dims * len(found), dtype=np.int64)]),
                    np.concatenate([table[filled], np.tile(members[found], dims)]),
                )
                totals = pa.array(np.concatenate([np.zeros(len(filled)), *sums]), mask=np.concatenate([np.ones(len(filled), dtype=bool), *none]))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c).cast(t) for c, t in zip(columns, kinds)), totals], names=["k", "cluster", "pos", "n", "count", "total"])

    return points.select("cells", "num").mapInArrow(run, _TALLY)


def update_all(tallies: DataFrame, sizes: list[int]) -> dict[int, list[Centroid | None]]:
    """New centroids of every k in ``sizes`` from the tallies of an assignment of them all, ``None`` where a cluster has no member.

    Tallies are added up by k, cluster, cell and value, of each cell the most common value is taken, and a cluster's cells are
    gathered. Only the centroids are collected.
    """
    dims = len(TIME_FEATURES)
    counted = tallies.repartition("k", "cluster", "pos").groupBy("k", "cluster", "pos", "n").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    topped = counted.groupBy("k", "cluster", "pos").agg(
        F.min(F.struct((-F.col("count")).alias("order"), "n")).alias("top"), F.sum("count").alias("filled"), F.first("total").alias("total")
    )
    gathered = topped.groupBy("k", "cluster").agg(
        F.max(F.when(F.col("pos") == -1, F.col("filled"))).alias("members"), F.collect_list(F.struct("pos", "top.n", (-F.col("top.order")).alias("most"), "filled", "total")).alias("modes")
    )
    # A cell that is zero for as many members is zero in the centroid.
    stay = F.filter("modes", lambda m: (m["pos"] < 0) | (m["most"] > F.col("members") - m["filled"]))
    found: dict[int, list[Centroid | None]] = {k: [None] * k for k in sizes}
    for row in gathered.select("k", "cluster", "members", stay.alias("modes")).collect():
        totals = {-1 - m["pos"]: m["total"] for m in row["modes"] if m["pos"] < 0}
        means = [None if totals[i] is None else float(np.rint(totals[i] / row["members"] * 1e9) / 1e9 + 0.0) for i in range(dims)]
        found[row["k"]][row["cluster"]] = Centroid(row["cluster"], {m["pos"]: m["n"] for m in row["modes"] if m["pos"] >= 0}, means)
    return found


def update_centroids(assigned: DataFrame, k: int) -> list[Centroid | None]:
    """New centroids from an assignment to ``k`` clusters; ``None`` where a cluster has no member."""
    missing = F.lit(None).cast("double")
    cells = F.transform(F.map_entries("cells"), lambda e: F.struct(e["key"].cast("bigint").alias("pos"), e["value"].alias("n"), missing.alias("total")))
    numbers = [F.struct(F.lit(-1 - i).cast("bigint").alias("pos"), F.lit(0).alias("n"), F.col("num")[i].alias("total")) for i in range(len(TIME_FEATURES))]
    rows = assigned.select("cluster", F.explode(F.concat(cells, F.array(*numbers))).alias("cell"))
    return update_all(rows.select(F.lit(k).alias("k"), "cluster", "cell.*", F.lit(1).alias("count")), [k])[k]


def _redrawn(points: DataFrame, draws: dict[tuple[int, int], int], seed: int) -> dict[tuple[int, int], Centroid]:
    """For every (k, cluster) without members the first case in the seeded order of its draw, all in one pass."""
    firsts = [F.min_by(F.struct("cells", "num"), F.struct(*hash_order(seed, draw))).alias(f"c{i}") for i, draw in enumerate(draws.values())]
    row = points.agg(*firsts).first()
    return {key: Centroid(key[1], dict(found["cells"]), list(found["num"])) for key, found in zip(draws, row, strict=True)}


def sweep_kprototypes(points: DataFrame, sizes: list[int], seed: int = 0, max_rounds: int = MAX_ROUNDS) -> Sweep:
    """Cluster mixed points into every number of clusters in ``sizes`` at once.

    All advance in one loop: a round assigns the points to the centroids of every open k in one pass, in numpy, and updates them in
    one aggregation of the batches' counts and sums; a k whose centroids stand still leaves. Each k goes the way it would go alone. Only centroids pass from
    round to round, so plans do not grow. What still moves after ``max_rounds`` is reported.
    """
    points = cut(spread(points))
    first = sample_centroids(points, max(sizes), seed)
    if len(first) < max(sizes):
        raise ValueError(f"{max(sizes)} clusters need at least {max(sizes)} cases")
    open_ = {k: first[:k] for k in sizes}
    done, rounds = {}, dict.fromkeys(sizes, 0)
    for number in range(1, max_rounds + 1):
        fresh = update_all(_tallies(points, open_), list(open_))
        empty = {(k, i): number * k + i for k, some in fresh.items() for i, c in enumerate(some) if c is None}
        if empty:
            for (k, i), centroid in _redrawn(points, empty, seed).items():
                fresh[k][i] = centroid
        rounds.update(dict.fromkeys(open_, number))
        done |= {k: some for k, some in fresh.items() if some == open_[k]}
        open_ = {k: some for k, some in fresh.items() if k not in done}
        if not open_:
            break
    if open_:
        warnings.warn(f"centroids of {sorted(open_)} clusters still moved after {max_rounds} rounds", stacklevel=2)
    centroids = {k: (done | open_)[k] for k in sizes}
    return Sweep(cut(assign_all(points, centroids)), centroids, rounds, sorted(open_))


def kprototypes(
    points: DataFrame, k: int, seed: int = 0, max_rounds: int = MAX_ROUNDS
) -> tuple[DataFrame, list[Centroid]]:
    """Cluster mixed points: assign, recompute modes and means, stop when no centroid changes."""
    centroids = sweep_kprototypes(points, [k], seed, max_rounds).centroids[k]
    return cut(assign_clusters(points, centroids)), centroids


def signatures(points: DataFrame, size: int, tokens: str = "cell", permutations: int = PERMUTATIONS) -> DataFrame:
    """Add the MinHash signature ``sig`` of each point's cells.

    Tokens are (cell, value) pairs of the non-zero cells, or with ``tokens='value'`` just the distinct values,
    zero included when any cell is zero.
    """
    if tokens == "cell":
        listed = F.transform(F.map_entries("cells"), lambda e: token(e["key"] + 1, e["value"]))
    elif tokens == "value":
        zero = F.when(F.size("cells") < size + size * size, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        values = F.array_distinct(F.concat(zero, F.map_values("cells")))
        listed = F.transform(values, lambda v: token(F.lit(0), v))
    else:
        raise ValueError("tokens must be 'cell' or 'value'")
    return points.withColumn("tokens", listed).withColumn("sig", minhash(F.col("tokens"), permutations)).drop("tokens")


def similarity_sums(signed: DataFrame) -> DataFrame:
    """(case_id, matches): per case the number of equal signature positions, summed over its cluster, itself included.

    Counting the values of each position replaces comparing the members with each other. Values are counted in each batch first; at
    most ``SHIPPED_VALUES`` counts go to every task, more are joined.
    """
    schema = f"cluster {dict(signed.dtypes)['cluster']}, at int, value bigint, count bigint"
    own = signed.filter(F.col("cluster").isNotNull())

    def count(batches):
        for batch in batches:
            found = [(cluster, at, value, some) for cluster, at, value, some, _, _ in _by_position(batch)]
            if found:
                clusters, places, values, counts = zip(*found)
                sizes = [len(v) for v in values]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(clusters, sizes)).cast(batch.schema.field("cluster").type), pa.array(np.repeat(places, sizes).astype(np.int32)),
                        pa.array(np.concatenate(values)), pa.array(np.concatenate(counts)),
                    ],
                    names=["cluster", "at", "value", "count"],
                )

    counts = cut(own.select("cluster", "sig").mapInArrow(count, schema).groupBy("cluster", "at", "value").agg(F.sum("count").alias("count")))
    if counts.count() > SHIPPED_VALUES:
        rows = own.select("case_id", "cluster", F.posexplode("sig").alias("at", "value"))
        return rows.join(counts, ["cluster", "at", "value"]).groupBy("case_id").agg(F.sum("count").alias("matches"))
    known = counts.orderBy("cluster", "at", "value").toArrow()
    places = [known.column(c).to_pylist() for c in ("cluster", "at")]
    values, numbers = (known.column(c).to_numpy() for c in ("value", "count"))
    begins = [i for i in range(len(values)) if not i or any(p[i] != p[i - 1] for p in places)]
    slices = {(places[0][i], places[1][i]): slice(i, j) for i, j in zip(begins, [*begins[1:], len(values)])}
    shipped = signed.sparkSession.sparkContext.broadcast((slices, values, numbers))

    def add_up(batches):
        slices, values, numbers = shipped.value
        for batch in batches:
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for cluster, at, value, _, back, rows in _by_position(batch):
                here = slices[cluster, at]
                total[rows] += numbers[here][np.searchsorted(values[here], value)][back]
            some = pa.array(total > 0)
            yield pa.RecordBatch.from_arrays([batch.column("case_id").filter(some), pa.array(total).filter(some)], names=["case_id", "matches"])

    schema = T.StructType([signed.schema["case_id"], T.StructField("matches", T.LongType())])
    return own.select("cluster", "sig", "case_id").mapInArrow(add_up, schema).groupBy("case_id").agg(F.sum("matches").alias("matches"))


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For every cluster and signature position of a batch: the different values, their counts, the place of each row's value, and the rows."""
    clusters, sigs = batch.column("cluster").to_numpy(zero_copy_only=False), batch.column("sig")
    for cluster in np.unique(clusters).tolist():
        rows = np.flatnonzero(clusters == cluster)
        found = sigs.take(pa.array(rows))
        flat = found.flatten()
        table = flat.fill_null(-1).to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        full = table[:, 0] >= 0 if table.shape[1] else np.zeros(len(rows), dtype=bool)
        if full.any():
            for at in range(table.shape[1]):
                value, back, some = np.unique(table[full, at], return_inverse=True, return_counts=True)
                yield cluster, at, value, some, back, rows[full]


def _raised_by_places(members: DataFrame, options: DataFrame, caps: dict[int, float]) -> DataFrame:
    """The options (cluster, case_id, num, m, apart, low) with their lower bounds raised.

    Some members of each cluster are places, and every member belongs to the nearest. The summed distance of a point to the members of
    a place is at least their number times the distance to their mean (distance is convex), so these add up to a bound, the closer the
    narrower the places are. Points times places are compared, inside the rows' batches.
    """
    dims = len(TIME_FEATURES)
    each = max(1, min(MEDOID_PLACES, ALL_PLACES // max(1, len(caps))))
    drawn = F.row_number().over(Window.partitionBy("cluster").orderBy(*hash_order(0)))
    listed = members.select("cluster", "case_id", "num").withColumn("rank", drawn).filter(F.col("rank") <= each).collect()
    places: dict[int, np.ndarray] = {}
    for cluster in caps:
        places[cluster] = np.array([r["num"][:dims] for r in listed if r["cluster"] == cluster and _whole(r["num"])], dtype=np.float64).reshape(-1, dims)

    def gather(batches):
        for batch in batches:
            for cluster, rows, table in _numbers(batch, dims):
                if len(places[cluster]):
                    at = np.concatenate([_apart(part, places[cluster]).argmin(axis=1) for part in _parts(table, len(places[cluster]))])
                    count = np.bincount(at, minlength=len(places[cluster]))
                    found = np.flatnonzero(count)
                    sums = np.stack([np.bincount(at, table[:, i], minlength=len(count))[found] for i in range(dims)], axis=1)
                    yield pa.RecordBatch.from_pydict(
                        {"cluster": [cluster] * len(found), "place": found, "count": count[found], "sums": list(sums)}, schema=pa.schema(
                            [("cluster", batch.schema.field("cluster").type), ("place", pa.int64()), ("count", pa.int64()), ("sums", pa.list_(pa.float64()))]
                        )
                    )

    kind = dict(members.dtypes)["cluster"]
    gathered = members.select("cluster", "num").mapInArrow(gather, f"cluster {kind}, place bigint, count bigint, sums array<double>")
    total = gathered.groupBy("cluster", "place").agg(F.sum("count").alias("count"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
    groups: dict[int, list] = {}
    for row in total.collect():  # at most ALL_PLACES rows
        groups.setdefault(row["cluster"], []).append((row["count"], [x / row["count"] for x in row["sums"]]))
    bounds = {c: (np.array([n for n, _ in some], dtype=np.float64), np.array([mean for _, mean in some])) for c, some in groups.items()}

    def raise_(batches):
        for batch in batches:
            low = batch.column("low").to_numpy(zero_copy_only=False).copy()
            apart = batch.column("apart").to_numpy(zero_copy_only=False)
            for cluster, rows, table in _numbers(batch, dims):
                if cluster in bounds:
                    counts, means = bounds[cluster]
                    far = np.concatenate([np.sqrt(_apart(part, means)) @ counts for part in _parts(table, len(means))])
                    low[rows] = np.fmax(low[rows], apart[rows] + far)
            yield batch.set_column(batch.schema.get_field_index("low"), "low", pa.array(low, mask=batch.column("low").is_null().to_numpy(zero_copy_only=False)))

    limits = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return spread(options.filter(F.col("low") <= limits[F.col("cluster")] + F.col("m") * 1e-5)).mapInArrow(raise_, options.schema)


def _whole(num: list[float | None]) -> bool:
    return all(x is not None and np.isfinite(x) for x in num)


def _numbers(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every cluster of a batch its rows that have all numbers, with these."""
    points = Batch.numbers(batch.column("num"), dims)
    clusters = batch.column("cluster").to_numpy(zero_copy_only=False)
    for cluster in np.unique(clusters).tolist():
        rows = np.flatnonzero((clusters == cluster) & np.isfinite(points).all(axis=1))
        if len(rows):
            yield cluster, rows, points[rows]


def _parts(table: np.ndarray, others: int) -> list[np.ndarray]:
    """Rows in parts that meet so many others in a bounded table."""
    step = max(1, 500_000 // others)
    return [table[i : i + step] for i in range(0, len(table), step)]


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances, from the differences: no digits are lost among large numbers."""
    squares = np.zeros((len(left), len(right)))
    for i in range(left.shape[1]):
        step = left[:, i, None] - right[None, :, i]
        squares += step * step
    return squares


def medoids(
    clustered: DataFrame, size: int, tokens: str = "cell", permutations: int = PERMUTATIONS
) -> DataFrame:
    """Per cluster the case with the smallest summed distance to its members: (cluster, case_id, total).

    Distance is one minus the signature similarity plus the Euclidean distance of the (unscaled) numbers. The first
    part of every sum comes from value counts. For the second, members are gathered around some of them, and every candidate has a
    lower bound from the means and sizes of these groups. Only some candidates are summed over all members, best lower
    bound first; the triangle inequality turns each exact sum into bounds for the others, and candidates whose bound exceeds the
    best sum are out. The search ends when none is left, so the result is exact.
    """
    signed = cut(signatures(clustered, size, tokens, permutations))
    stats = signed.groupBy("cluster").agg(
        F.count("*").alias("m"), F.array(*[F.avg(F.col("num")[i]) for i in range(len(TIME_FEATURES))]).alias("mean")
    )
    # One row per cluster on the right.
    centred = signed.join(F.broadcast(stats), "cluster").join(similarity_sums(signed), "case_id").select(
        "cluster", "case_id", "num", "m",
        (F.col("m") - F.col("matches") / F.lit(float(permutations))).alias("apart"),
        euclid(F.col("num"), F.col("mean"), len(TIME_FEATURES)).alias("off"),
    )
    members = cut(centred)
    spread_out = members.groupBy("cluster").agg(F.sum("off").alias("spread"))
    least = F.col("apart") + F.col("m") * F.col("off")
    caps = {
        row["cluster"]: row["cap"]
        for row in members.join(F.broadcast(spread_out), "cluster").groupBy("cluster")
        .agg(F.min(least + F.col("spread")).alias("cap")).collect()
    }
    best: dict[int, tuple[float, str]] = {}
    open_ = _raised_by_places(members, members.select("cluster", "case_id", "num", "m", "apart", least.alias("low")), caps)
    spark = clustered.sparkSession
    while True:
        limits = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
        slack = F.col("m") * 1e-5
        open_ = cut(open_.filter(F.col("low") <= limits[F.col("cluster")] + slack))
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy("low", "case_id"))
        batch = (
            open_.withColumn("rank", rank).filter(F.col("rank") <= MEDOID_BATCH)
            .select("cluster", "case_id", "num", "apart").collect()
        )
        if not batch:
            break
        tried = spark.createDataFrame(
            [(r["cluster"], r["case_id"], r["num"]) for r in batch], "cluster int, tried string, at array<double>"
        )
        # At most MEDOID_BATCH rows per cluster.
        exact = F.round(euclid(F.col("num"), F.col("at"), len(TIME_FEATURES)), DIGITS).cast("decimal(28,6)")
        sums = {
            r["tried"]: float(r["far"])
            for r in members.join(F.broadcast(tried), "cluster").groupBy("cluster", "tried")
            .agg(F.sum(exact).alias("far")).collect()
        }
        for r in batch:
            option = (round(r["apart"] + sums[r["case_id"]], DIGITS), r["case_id"])
            best[r["cluster"]] = min(best.get(r["cluster"], option), option)
            caps[r["cluster"]] = min(caps[r["cluster"]], option[0])
        known = spark.createDataFrame(
            [(r["cluster"], r["case_id"], r["num"], sums[r["case_id"]]) for r in batch],
            "cluster int, tried string, at array<double>, far double",
        )
        listed = known.groupBy("cluster").agg(F.collect_list(F.struct("tried", "at", "far")).alias("known"))
        raised = F.array_max(
            F.transform(
                "known", lambda t: F.abs(F.col("m") * euclid(F.col("num"), t["at"], len(TIME_FEATURES)) - t["far"])
            )
        )
        open_ = (
            open_.join(F.broadcast(listed), "cluster")
            .filter(~F.exists("known", lambda t: t["tried"] == F.col("case_id")))
            .select("cluster", "case_id", "num", "m", "apart", F.greatest("low", F.col("apart") + raised).alias("low"))
        )
    return spark.createDataFrame(
        [(cluster, case, total) for cluster, (total, case) in sorted(best.items())],
        "cluster int, case_id string, total double",
    )
