"""Mixed distances and exact k-nearest neighbours without an all-pairs matrix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import euclid, round_half_even
from ..functions.timefeatures import TIME_FEATURES
from ..session import cut, dense_index, spread

DIGITS = 6
# Distances are rounded before ranking; bounds are widened by more than the rounding error.
SLACK = 1e-5
MAX_PIVOTS = 8192
RINGS = 16
# A ring with more classes than this is searched in parts, so that a unit of work compares at most this many by this many.
UNIT = 4096
# Vectors are compared block with block: in at least so many blocks, and in blocks of about at most so many rows.
BLOCKS = 8
BLOCK_ROWS = 16384
# Classes with at most this many coordinates in all go to every task as numbers when neighbours within a radius are counted,
# in blocks of at most so many near classes.
COUNT_NUMBERS = 16_000_000
COUNT_BLOCK = 128

Row = Callable[[str], Column]


@dataclass(frozen=True)
class Metric:
    """A metric on payload columns: the distance and cheap bounds of it, all built-in expressions."""

    columns: tuple[str, ...]
    distance: Callable[[Row, Row], Column]
    lower_bound: Callable[[Row, Row], Column]
    # Upper bound for metrics whose distance is dear.
    upper_bound: Callable[[Row, Row], Column] | None = None
    # Vector column whose distances are computed by numpy instead, block with block: without structure rings exclude nothing.
    vector: str | None = None
    # The distance if it is at most a limit, else null: for metrics that can stop early.
    within: Callable[[Row, Row, Column], Column] | None = None
    # For metrics that add a rest to a Euclidean distance: the coordinates of the latter, and a row's bound of the rest.
    coordinates: Callable[[Row], list[Column]] | None = None
    rest: tuple[Callable[[Row], Column], ...] = ()


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def mixed_metric(w_act: float = 1.0, w_tra: float = 1.0, w_time: float = 1.0) -> Metric:
    """Weighted sum of the edit distances of both strings and the Euclidean distance of the time features."""
    def time_part(a: Row, b: Row) -> Column:
        return F.lit(float(w_time)) * euclid(a("time"), b("time"), len(TIME_FEATURES))

    def distance(a: Row, b: Row) -> Column:
        act = F.lit(float(w_act)) * F.levenshtein(a("act_text"), b("act_text"))
        tra = F.lit(float(w_tra)) * F.levenshtein(a("tra_text"), b("tra_text"))
        return round_half_even(act + tra + time_part(a, b), DIGITS)

    def lower_bound(a: Row, b: Row) -> Column:
        # An edit changes the length, and the number of any one character, by at most one.
        lengths = F.abs(F.length(a("tra_text")) - F.length(b("tra_text")))
        zeros = F.abs(a("tra_zeros") - b("tra_zeros"))
        ones = F.abs(a("act_ones") - b("act_ones"))
        return time_part(a, b) + F.lit(float(w_tra)) * F.greatest(lengths, zeros) + F.lit(float(w_act)) * ones

    def upper_bound(a: Row, b: Row) -> Column:
        # No more edits than characters of the longer string.
        act = F.greatest(F.length(a("act_text")), F.length(b("act_text")))
        tra = F.greatest(F.length(a("tra_text")), F.length(b("tra_text")))
        return time_part(a, b) + F.lit(float(w_tra)) * tra + F.lit(float(w_act)) * act

    def edits(left: Column, right: Column, weight: float, rest: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of the weighted edit distance, or null if that is above ``rest``; the table of edits is not filled beyond it."""
        if weight <= 0:
            return then(F.lit(0.0))
        most = F.least(rest / F.lit(weight), F.lit(1e9))
        found = F.when(most >= 0, F.call_function("levenshtein", left, right, F.floor(F.greatest(most, F.lit(0.0))).cast("int"))).otherwise(-1)
        return _let(found, lambda n: F.when(n >= 0, then(F.lit(weight) * n)))

    def within(a: Row, b: Row, limit: Column) -> Column:
        # Time first, then the short string, then the long one with what is left of the limit.
        return _let(limit - time_part(a, b), lambda rest: edits(
            a("act_text"), b("act_text"), float(w_act), rest,
            lambda act: edits(
                a("tra_text"), b("tra_text"), float(w_tra), rest - act,
                lambda tra: F.when(rest >= 0, round_half_even(act + tra + time_part(a, b), DIGITS)),
            ),
        ))

    return Metric(
        ("act_text", "tra_text", "time", "act_ones", "tra_zeros"), distance, lower_bound, upper_bound, within=within,
        coordinates=(lambda a: [F.lit(float(w_time)) * a("time")[i] for i in range(len(TIME_FEATURES))]) if w_time > 0 else None,
        # No more edits than characters of the longer string.
        rest=(lambda a: F.lit(float(w_act)) * F.length(a("act_text")), lambda a: F.lit(float(w_tra)) * F.length(a("tra_text"))),
    )


def euclidean_metric(column: str = "vec") -> Metric:
    def distance(a: Row, b: Row) -> Column:
        return round_half_even(euclid(a(column), b(column)), DIGITS)

    def lower_bound(a: Row, b: Row) -> Column:
        # Difference of the norms; the norm is carried along.
        return F.abs(a("norm") - b("norm"))

    return Metric((column, "norm"), distance, lower_bound, vector=column)


def mixed_points(profiles: DataFrame) -> DataFrame:
    """Payload of the mixed metric from a profile with strings: ``id`` plus the metric's columns."""
    zeros = F.length("tra_text") - F.length(F.replace("tra_text", F.lit("0"), F.lit("")))
    return profiles.select(
        F.col("case_id").alias("id"), "act_text", "tra_text", "time", F.size("acts").alias("act_ones"),
        zeros.alias("tra_zeros"),
    )


def vector_points(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Payload of the Euclidean metric: ``id``, ``vec`` and its norm."""
    vec = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x))
    return df.select(F.col(id_col).alias("id"), vec.alias("vec"), norm.alias("norm"))


def scale_time(profiles: DataFrame, mode: str = "none") -> DataFrame:
    """Rescale the time features over all cases: ``none``, ``zscore`` (population) or ``unit`` (to [0, 1])."""
    if mode == "none":
        return profiles
    if mode not in ("zscore", "unit"):
        raise ValueError("time_scale must be 'none', 'zscore' or 'unit'")
    columns = [F.col("time")[i] for i in range(len(TIME_FEATURES))]
    if mode == "zscore":
        stats = [F.struct(F.avg(c).alias("shift"), F.stddev_pop(c).alias("scale")) for c in columns]
    else:
        stats = [F.struct(F.min(c).alias("shift"), (F.max(c) - F.min(c)).alias("scale")) for c in columns]
    summary = profiles.agg(F.array(*stats).alias("stats")).scalar()
    scaled = F.zip_with(
        "time", "summary", lambda x, s: (x - s["shift"]) / F.coalesce(F.nullif(s["scale"], F.lit(0.0)), F.lit(1.0))
    )
    return profiles.withColumn("summary", summary).withColumn("time", scaled).drop("summary")


def pair_distances(points: DataFrame, pairs: DataFrame, metric: Metric) -> DataFrame:
    """Distance of each listed pair (``src``, ``dst``)."""
    left = points.select(F.col("id").alias("src"), F.struct(*metric.columns).alias("a"))
    right = points.select(F.col("id").alias("dst"), F.struct(*metric.columns).alias("b"))
    return (
        pairs.join(left, "src").join(right, "dst")
        .select(*pairs.columns, metric.distance(lambda c: F.col("a")[c], lambda c: F.col("b")[c]).alias("dist"))
    )


def _first_ids(members: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` smallest ids of every class; the limit is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    return (
        members.select("class", "id").withColumn("rank", rank).filter(F.col("rank") <= keep)
        .groupBy("class").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )


def knn(points: DataFrame, metric: Metric, k: int, include_self: bool = False, pivots: int | None = None) -> DataFrame:
    """Exact k nearest neighbours of every point: (src, dst, dist, rank), ties broken by id.

    Equal points form one class that is compared once; a class needs only its k+1 smallest ids to answer any query.
    Classes are searched with pivots: every class belongs to its nearest pivot's cell and to a ring by its distance
    from it. A class looks only into the rings that the triangle inequality cannot exclude, given an upper bound of
    its k-th distance, and exact distances are computed for what the cheap bound leaves. If coordinates dominate the
    distance, pivots and rings go by them alone (``_spatial_pairs``). Vectors are compared block
    with block; each block gives only its k nearest classes.
    """
    # A hash of the payload as text keys the class; to_json keeps every digit of the numbers.
    key = F.sha2(F.to_json(F.struct(*metric.columns)), 256)
    members = cut(points.withColumn("class", key))
    payload = members.groupBy("class").agg(*[F.first(c).alias(c) for c in metric.columns])
    classes = cut(payload.join(_first_ids(members, k + 1), "class"))
    n = classes.count()
    if metric.vector:
        near = _compare_vectors(classes.withColumn("first", F.get("ids", F.lit(0))), metric.vector, n, k=k)
    else:
        pivots = pivots or min(MAX_PIVOTS, max(1, isqrt(n)))
        rest = _small_rest(classes, metric)
        near = _class_neighbors(classes, metric, k, pivots) if rest is None else _spatial_pairs(classes, metric, pivots, rest, k=k)

    own = classes.select(F.col("class").alias("src"), F.lit(0.0).alias("dist"), F.explode("ids").alias("dst"))
    other = near.join(classes.select(F.col("class").alias("dst_class"), "ids"), "dst_class").select(
        "src", "dist", F.explode("ids").alias("dst")
    )
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    lists = (
        own.unionByName(other).withColumn("rank", rank).filter(F.col("rank") <= k + 1)
        .groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near"))
    )
    # One list of at most k+1 entries per class; a large class meets it in a skew join that adaptive execution splits.
    mine = F.filter("near", lambda e: e["dst"] != F.col("id"))
    if include_self:
        me = F.array(F.struct(F.lit(0.0).alias("dist"), F.col("id").alias("dst")))
        mine = F.concat(me, F.slice(mine, 1, k - 1)) if k > 1 else me
    else:
        mine = F.slice(mine, 1, k)
    return (
        members.select("id", "class")
        .join(lists, F.col("class") == F.col("src"))
        .select(F.col("id").alias("src"), F.posexplode(mine).alias("pos", "e"))
        .select("src", F.col("e.dst").alias("dst"), F.col("e.dist").alias("dist"), (F.col("pos") + 1).alias("rank"))
    )


@dataclass(frozen=True)
class _Cells:
    """Classes dealt to pivots: each lies in its nearest pivot's cell, in a ring by its distance from it."""

    columns: list[str]
    with_pivot_distances: Callable[[DataFrame], DataFrame]
    disks: Column  # a list of (home, radius, holds), one for each pivot
    ringed: DataFrame
    units: DataFrame  # (home, ring, parts): in how many parts a ring is searched


def _cells(classes: DataFrame, metric: Metric, pivots: int, k: int = 0) -> _Cells:
    """Deal classes to pivots; ``holds`` is the distance from a pivot that has ``k`` + 1 classes of its cell."""
    here: Row = F.col
    columns = ["class", *metric.columns]
    chosen = classes.orderBy(F.xxhash64("class"), "class").limit(pivots).select(F.struct(*columns).alias("p"))
    centers = chosen.agg(F.array_sort(F.collect_list("p"))).scalar()

    def with_pivot_distances(df: DataFrame) -> DataFrame:
        """Add ``d``: the distances to all pivots. Rows are partitioned by class, so the regrouping does not shuffle."""
        rows = df.withColumn("pivots", centers).select(*df.columns, F.posexplode("pivots").alias("at", "p"))
        reached = rows.select(*df.columns, "at", metric.distance(here, lambda c: F.col("p")[c]).alias("to"))
        listed = F.array_sort(F.collect_list(F.struct("at", "to")))
        rest = [F.first(c).alias(c) for c in df.columns if c != "class"]
        return reached.groupBy("class").agg(*rest, listed.alias("d")).withColumn("d", F.col("d")["to"])

    located = cut(
        with_pivot_distances(spread(classes.select(*columns), "class")).select(
            *columns, F.array_min("d").alias("near"),
            (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("home"), F.col("d")[0].alias("anchor"),
        )
    )
    # Per cell: radius, and the distance from the pivot that holds k+1 of its classes. One row per pivot.
    order = F.row_number().over(Window.partitionBy("home").orderBy("near"))
    holds = (
        located.select("home", "near").withColumn("rank", order).filter(F.col("rank") <= k + 1)
        .filter(F.col("rank") == k + 1).select("home", F.col("near").alias("holds"))
    )
    cells = located.groupBy("home").agg(F.max("near").alias("radius")).join(holds, "home", "left")
    dense = classes.sparkSession.range(pivots).select(F.col("id").cast("int").alias("home")).join(cells, "home", "left")
    disks = dense.agg(F.array_sort(F.collect_list(F.struct("home", "radius", "holds"))).alias("disks")).scalar()

    radius = F.element_at("disks", F.col("home") + 1)["radius"]
    ring = F.when(radius > 0, F.least(F.lit(RINGS - 1), F.floor(F.col("near") * RINGS / radius))).otherwise(0)
    ringed = located.withColumn("disks", disks).withColumn("ring", ring.cast("int")).drop("disks")
    # One row per pivot and ring: at most MAX_PIVOTS * RINGS rows.
    units = F.broadcast(
        ringed.groupBy("home", "ring").agg(F.ceil(F.count("*") / F.lit(UNIT)).cast("int").alias("parts"))
    )
    return _Cells(columns, with_pivot_distances, disks, ringed, units)


def _part() -> Column:
    return F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")


def _class_neighbors(classes: DataFrame, metric: Metric, k: int, pivots: int) -> DataFrame:
    """(src, dst_class, dist) for the pairs of distinct classes within each class's k-th distance bound."""
    here: Row = F.col
    cells = _cells(classes, metric, pivots, k)
    columns = cells.columns

    # Upper bounds of the k-th distance: real distances to ring mates, cheap bounds to cell mates, and through pivots.
    parted = cells.ringed.join(cells.units, ["home", "ring"]).withColumn("part", _part())
    mates = F.collect_list(F.struct(*columns)).over(
        Window.partitionBy("home", "ring", "part").orderBy("anchor", "class").rowsBetween(-k, k)
    )
    to_mates = F.array_sort(
        F.transform(
            F.filter(mates, lambda m: m["class"] != F.col("class")), lambda m: metric.distance(here, lambda c: m[c])
        )
    )
    searching = (
        spread(parted, "home", "ring", "part")
        .select(*columns, "home", F.get(to_mates, F.lit(k - 1)).alias("by_mates"))
    )
    if metric.upper_bound:
        searching = _cell_bound(searching, metric, k)
    else:
        searching = searching.withColumn("by_cell", F.lit(None).cast("double"))
    through = F.array_min(
        F.transform(
            F.filter("disks", lambda c: c["holds"].isNotNull()), lambda c: F.get("d", c["home"]) + c["holds"]
        )
    )
    tau = F.coalesce(F.least(through, "by_mates", "by_cell"), F.lit(float("inf")))
    searching = (
        cells.with_pivot_distances(spread(searching.drop("home"), "class")).withColumn("disks", cells.disks)
        .select(*columns, "d", "disks", (tau + SLACK).alias("tau"))
    )
    return _near_pairs(searching, cells, metric)


def _near_pairs(searching: DataFrame, cells: _Cells, metric: Metric, one_way: bool = False) -> DataFrame:
    """(src, dst_class, dist) for the other classes within ``tau`` of each searching class; each pair once, if ``one_way``.

    A class looks only into the rings that the triangle inequality cannot exclude. A ring of many classes is searched in parts.
    """
    def ring_range(cell: Column) -> Column:
        d, tau = F.get(F.col("d"), cell["home"]), F.col("tau")
        flat = F.coalesce(F.nullif(cell["radius"], F.lit(0.0)), F.lit(1.0))
        low = F.greatest(F.lit(0.0), F.least(F.lit(RINGS - 1.0), F.floor((d - tau) * RINGS / flat).cast("double")))
        high = F.greatest(F.lit(0.0), F.least(F.lit(RINGS - 1.0), F.floor((d + tau) * RINGS / flat).cast("double")))
        return F.struct(cell["home"].alias("home"), low.cast("int").alias("low"), high.cast("int").alias("high"))

    reachable = F.filter(
        "disks", lambda c: c["radius"].isNotNull() & (F.get(F.col("d"), c["home"]) - c["radius"] <= F.col("tau"))
    )
    cell = F.transform(reachable, ring_range)
    spans = searching.select("class", *metric.columns, "tau", F.explode(cell).alias("cell")).select("class", *metric.columns, "tau", "cell.*")
    return _compare_units(spans, cells.ringed, cells.units, metric, one_way)


def _compare_units(spans: DataFrame, ringed: DataFrame, units: DataFrame, metric: Metric, one_way: bool) -> DataFrame:
    """(src, dst_class, dist) within ``tau`` of classes (class, payload, tau) that search the rings ``low`` to ``high`` of a home."""
    a, b = F.struct(*metric.columns).alias("a"), F.struct(*metric.columns).alias("b")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    keys = ["home", "ring", "mine", "other"]
    probes = (
        spans.select("class", a, "tau", "home", F.explode(F.sequence("low", "high")).alias("ring"))
        .join(units, ["home", "ring"])
        .select(
            "home", "ring", _part().alias("mine"), F.explode(every).alias("other"), F.col("class").alias("src"), "a", "tau"
        )
    )
    targets = ringed.join(units, ["home", "ring"]).select(
        "home", "ring", F.explode(every).alias("mine"), _part().alias("other"), F.col("class").alias("dst_class"), b
    )
    ordered = F.col("src") < F.col("dst_class") if one_way else F.col("src") != F.col("dst_class")
    left: Row = lambda c: F.col("a")[c]
    right: Row = lambda c: F.col("b")[c]
    exact = metric.within(left, right, F.col("tau")) if metric.within else metric.distance(left, right)
    return (
        spread(probes, *keys).join(spread(targets, *keys), keys)
        .filter(ordered)
        .filter(metric.lower_bound(left, right) <= F.col("tau"))
        # Filtering a one-element list evaluates the distance once; filtering rows would evaluate it twice.
        .select("src", "dst_class", F.filter(F.array(exact), lambda d: d <= F.col("tau")).alias("found"))
        .select("src", "dst_class", F.explode("found").alias("dist"))
    )


def _small_rest(classes: DataFrame, metric: Metric) -> float | None:
    """The largest rest a distance can have, if the coordinates vary by more than that, so that they alone can exclude; else None."""
    if metric.coordinates is None:
        return None
    spreads = [F.coalesce(F.var_pop(c), F.lit(0.0)) for c in metric.coordinates(F.col)]
    row = classes.agg(F.array(*[F.coalesce(F.max(part(F.col)), F.lit(0.0)) for part in metric.rest]).alias("rest"), F.array(*spreads).alias("var")).first()
    rest = float(sum(row["rest"]))
    return rest if sum(row["var"]) > rest * rest else None


def _to_centers(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    total = np.zeros((len(rows), len(centers)))
    for i in range(rows.shape[1]):
        step = rows[:, i, None] - centers[None, :, i]
        total += step * step
    return np.sqrt(total)


def _spatial_pairs(
    classes: DataFrame, metric: Metric, pivots: int, rest: float, k: int | None = None, radius: float | None = None
) -> DataFrame:
    """(src, dst_class, dist) for the pairs within each class's k-th distance bound, or within a radius, each pair once then.

    Cells and rings are made of the coordinates alone: their distance is a lower bound of the metric, and with ``rest`` added an upper
    one. So distances from pivots are plain arithmetic on vectors, in numpy, and the dear rest is computed only for what is left.
    Classes with a missing value have no distance from others.
    """
    columns = ["class", *metric.columns]
    whole = [F.col(c).isNotNull() for c in metric.columns]
    points = cut(
        spread(classes.select(*columns, F.array(*metric.coordinates(F.col)).alias("at")), "class")
        .filter(reduce(lambda a, b: a & b, whole) & ~F.exists("at", lambda x: x.isNull()))
    )
    # One row per pivot here and below: at most MAX_PIVOTS.
    chosen = points.orderBy(F.xxhash64("class"), "class").limit(pivots).select("at").collect()
    if not chosen:
        return points.select(F.col("class").alias("src"), F.col("class").alias("dst_class"), F.lit(0.0).alias("dist")).limit(0)
    centers = np.array([r["at"] for r in chosen])

    @F.pandas_udf("home int, near double")
    def nearest(at: pd.Series) -> pd.DataFrame:
        home, near = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for i in range(0, len(at), 256):
            d = _to_centers(np.stack(at.iloc[i : i + 256].to_numpy()), centers)
            home.append(d.argmin(axis=1))
            near.append(d.min(axis=1))
        return pd.DataFrame({"home": np.concatenate(home), "near": np.concatenate(near)})

    located = cut(spread(points, "class").withColumn("place", nearest("at")).select(*columns, "at", "place.*"))
    kept = F.slice(F.array_sort(F.collect_list("near")), (k or 0) + 1, 1)
    first = located.withColumn("rank", F.row_number().over(Window.partitionBy("home").orderBy("near"))).filter(F.col("rank") <= (k or 0) + 1)
    disks = located.groupBy("home").agg(F.max("near").alias("radius"), F.count("*").alias("n")).join(
        first.groupBy("home").agg(F.get(kept, F.lit(0)).alias("holds")), "home"
    ).collect()
    radii, holds = np.full(len(centers), np.nan), np.full(len(centers), np.inf)
    for row in disks:
        radii[row["home"]] = row["radius"]
        holds[row["home"]] = np.inf if row["holds"] is None else row["holds"]
    spark = classes.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(r["home"], r["radius"], -(-r["n"] // UNIT)) for r in disks], "home int, radius double, groups int"))
    ring = F.when(F.col("radius") > 0, F.least(F.lit(RINGS - 1), F.floor(F.col("near") * RINGS / F.col("radius")))).otherwise(0).cast("int")
    ringed = located.join(sizes, "home").withColumn("ring", ring)
    units = F.broadcast(ringed.groupBy("home", "ring").agg(F.ceil(F.count("*") / F.lit(UNIT)).cast("int").alias("parts")))
    if radius is None:
        # The k-th distance by coordinates among mates of the cell, at most about UNIT of them.
        def among_mates(mates: pa.Table) -> pa.Table:
            at, kth = np.stack(mates["at"].to_pandas().to_numpy()), []
            for i in range(0, len(at), 256):
                d = _to_centers(at[i : i + 256], at)
                d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
                kth.append(np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(at) else np.full(len(d), np.inf))
            return pa.table({"class": mates["class"], "bound": np.concatenate(kth) + rest})

        grouped = ringed.select("class", "at", "home", F.pmod(F.xxhash64("class"), F.col("groups")).alias("group"))
        bounds = spread(grouped, "home", "group").groupBy("home", "group").applyInArrow(
            lambda mates: among_mates(mates.select(["class", "at"])), "class string, bound double"
        )
        searching = spread(points, "class").join(spread(bounds, "class"), "class")
    else:
        searching = points.withColumn("bound", F.lit(radius))
    flat = np.where(radii > 0, radii, 1.0)

    @F.pandas_udf("tau double, spans array<bigint>")
    def reach(at: pd.Series, bound: pd.Series) -> pd.DataFrame:
        taus, spans = [np.zeros(0)], []
        for i in range(0, len(at), 256):
            d = _to_centers(np.stack(at.iloc[i : i + 256].to_numpy()), centers)
            tau = bound.iloc[i : i + 256].to_numpy(dtype=np.float64)
            if radius is None:
                tau = np.minimum(tau, (d + holds).min(axis=1) + rest)
            tau = tau + SLACK
            row, home = np.nonzero(d - radii <= tau[:, None])
            low, high = (np.clip(np.floor((d[row, home] + way * tau[row]) * RINGS / flat[home]), 0, RINGS - 1).astype(np.int64) for way in (-1, 1))
            codes = (home * RINGS + low) * RINGS + high
            spans += np.split(codes, np.cumsum(np.bincount(row, minlength=len(d)))[:-1])
            taus.append(tau)
        return pd.DataFrame({"tau": np.concatenate(taus), "spans": spans})

    found = searching.withColumn("r", reach("at", "bound")).select(*columns, "r.tau", F.explode("r.spans").alias("span")).select(
        *columns, "tau", F.expr(f"CAST(span div {RINGS * RINGS} AS int)").alias("home"),
        F.expr(f"CAST(span div {RINGS} % {RINGS} AS int)").alias("low"), F.expr(f"CAST(span % {RINGS} AS int)").alias("high"),
    )
    return _compare_units(found, ringed.select(*columns, "home", "ring"), units, metric, radius is not None)


@dataclass(frozen=True)
class Near:
    """Pairs within a radius: between one representative of each class of equal points, and who belongs to it."""

    pairs: DataFrame  # (src, dst, dist), src < dst
    members: DataFrame  # (id, representative)
    counts: Callable[[], DataFrame]

    def degrees(self) -> DataFrame:
        """(representative, near): in how many of the pairs each representative is; those in none may be left out."""
        return self.counts()


def radius_join(points: DataFrame, metric: Metric, radius: float, pivots: int | None = None) -> Near:
    """All pairs of points at most ``radius`` apart, exactly.

    Equal points form one class, named by its smallest id; its own pairs, all at distance 0, are not written out (``all_pairs`` does). Classes are
    dealt to pivots, and each looks only into rings within the radius by the triangle inequality; what the cheap bounds
    leave is measured, with edit distances that stop beyond the radius. Each pair is met from one side. Vectors are compared block
    with block.
    """
    key = F.sha2(F.to_json(F.struct(*metric.columns)), 256)
    members = cut(points.withColumn("class", key))
    classes = cut(members.groupBy("class").agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in metric.columns]))
    n = classes.count()
    rest = None if metric.vector else _small_rest(classes, metric)
    if metric.vector:
        found = _compare_vectors(classes, metric.vector, n, radius=float(radius))
    elif rest is not None:
        near = _spatial_pairs(classes, metric, pivots or min(MAX_PIVOTS, max(1, isqrt(n))), rest, radius=float(radius))
        found = near.filter(F.col("dist") <= radius)
    else:
        cells = _cells(classes, metric, pivots or min(MAX_PIVOTS, max(1, isqrt(n))))
        searching = (
            cells.with_pivot_distances(spread(classes.select(*cells.columns), "class")).withColumn("disks", cells.disks)
            .select(*cells.columns, "d", "disks", F.lit(float(radius) + SLACK).alias("tau"))
        )
        found = _near_pairs(searching, cells, metric, one_way=True).filter(F.col("dist") <= radius)
    named = classes.select("class", "first")

    def counts() -> DataFrame:
        if not metric.vector and rest is not None and n * len(metric.coordinates(F.col)) <= COUNT_NUMBERS:
            counted = _spatial_counts(classes, metric, rest, float(radius))
            return counted.join(named, "class").select(F.col("first").alias("representative"), "near")
        ends = pairs.select(F.col("src").alias("representative")).unionAll(pairs.select("dst"))
        return ends.groupBy("representative").agg(F.count("*").alias("near"))

    pairs = (
        found.join(named.withColumnsRenamed({"class": "src", "first": "one"}), "src")
        .join(named.withColumnsRenamed({"class": "dst_class", "first": "two"}), "dst_class")
        .select(F.least("one", "two").alias("src"), F.greatest("one", "two").alias("dst"), "dist")
    )
    return Near(pairs, members.select("id", "class").join(named, "class").select("id", F.col("first").alias("representative")), counts)


def _blocks(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in an order that has near ones together, and the borders of blocks of at most ``size``: halves along the widest coordinate."""
    order, borders = np.arange(len(at)), np.array([0, len(at)])
    while (wide := np.diff(borders)).max() > size:
        sorted_ = at[order]
        axis = (np.maximum.reduceat(sorted_, borders[:-1]) - np.minimum.reduceat(sorted_, borders[:-1])).argmax(axis=1)
        of = np.repeat(np.arange(len(wide)), wide)
        order = order[np.lexsort((sorted_[np.arange(len(at)), axis[of]], of))]
        borders = np.unique(np.concatenate([borders, (borders[:-1] + (wide + 1) // 2)[wide > size]]))
    return order, borders


def _spatial_counts(classes: DataFrame, metric: Metric, rest: float, radius: float) -> DataFrame:
    """(class, near): how many other classes are within the radius, without a row per pair; classes with none are left out.

    The distance lies between that of the coordinates and ``rest`` more. So pairs, and whole pairs of blocks, are settled by
    coordinates alone, in numpy; only pairs in the shell between are measured. Each pair of blocks is met once. As a pair
    with a class without a name has the other one at both ends (least and greatest skip nulls), such a class counts twice.
    """
    weight = F.when(F.col("first").isNull(), 2).otherwise(1).cast("bigint").alias("weight")
    columns = ["class", weight, *metric.columns]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in metric.columns])
    points = classes.select(*columns, F.array(*metric.coordinates(F.col)).alias("at")).filter(whole & ~F.exists("at", lambda x: x.isNull() | F.isnan(x)))
    points = cut(dense_index(points, ["class"], "number"))
    table = points.select("number", "at", "weight").toArrow().sort_by("number")
    spark, n = classes.sparkSession, table.num_rows
    if not n:
        return points.select("class", F.lit(0).cast("bigint").alias("near")).limit(0)
    at = np.asarray(table["at"].combine_chunks().flatten(), dtype=np.float64).reshape(n, -1)
    order, borders = _blocks(at, COUNT_BLOCK)
    shipped = spark.sparkContext.broadcast((at[order], table["weight"].to_numpy()[order], order, borders))
    tasks = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), len(borders) - 1))

    def run(batches):
        at, weights, order, borders = shipped.value
        low, high = np.minimum.reduceat(at, borders[:-1]), np.maximum.reduceat(at, borders[:-1])
        near, sizes = np.zeros(n, dtype=np.int64), np.add.reduceat(weights, borders[:-1])
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for one in range(task, len(sizes), tasks):
                    # Boxes of this block and those from it on: the least and the greatest distance.
                    gap = np.maximum(0.0, np.maximum(low[one:] - high[one], low[one] - high[one:]))
                    span = np.maximum(high[one:] - low[one], high[one] - low[one:])
                    sure = np.sqrt((span * span).sum(axis=1)) + rest + SLACK <= radius
                    some = ~sure & (np.sqrt((gap * gap).sum(axis=1)) <= radius + SLACK)
                    here = slice(borders[one], borders[one + 1])
                    for two in (np.flatnonzero(sure) + one).tolist():
                        if two == one:
                            near[here] += sizes[one] - weights[here]
                        else:
                            near[here] += sizes[two]
                            near[borders[two] : borders[two + 1]] += sizes[one]
                    blocks = np.flatnonzero(some) + one
                    for i in range(0, len(blocks), COUNT_BLOCK):
                        others = np.concatenate([np.arange(borders[b], borders[b + 1]) for b in blocks[i : i + COUNT_BLOCK].tolist()])
                        d = _to_centers(at[here], at[others])
                        d[others[None, :] <= np.arange(here.start, here.stop)[:, None]] = np.inf  # each pair once
                        inside = d + rest + SLACK <= radius
                        near[here] += inside @ weights[others]
                        near[others] += weights[here] @ inside
                        left, right = np.nonzero(~inside & (d <= radius + SLACK))
                        if len(left):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(order[here][left]), pa.array(order[others[right]]), pa.array(np.zeros(len(left), dtype=np.int64))], names=names
                            )
        got = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(order[got]), pa.nulls(len(got), pa.int64()), pa.array(near[got])], names=names)

    names = ["one", "two", "near"]
    found = cut(spark.range(0, tasks, 1, tasks).mapInArrow(run, "one bigint, two bigint, near bigint"))
    a = points.select(F.col("number").alias("one"), F.struct("weight", *metric.columns).alias("a"))
    b = points.select(F.col("number").alias("two"), F.struct("weight", *metric.columns).alias("b"))
    left, right = (lambda c: F.col("a")[c]), (lambda c: F.col("b")[c])
    exact = metric.within(left, right, F.lit(radius + SLACK)) if metric.within else metric.distance(left, right)
    shell = spread(found.filter("two IS NOT NULL").select("one", "two"), "one", "two").join(a, "one").join(b, "two").filter(exact <= radius)
    both = F.array(F.struct(F.col("one").alias("number"), F.col("b.weight").alias("near")), F.struct(F.col("two").alias("number"), F.col("a.weight").alias("near")))
    ends = shell.select(F.inline(both))
    counted = found.filter("two IS NULL").select(F.col("one").alias("number"), "near").unionByName(ends).groupBy("number").agg(F.sum("near").alias("near"))
    return points.select("class", "number").join(counted, "number").select("class", "near")


def all_pairs(near: Near) -> DataFrame:
    """(src, dst, dist) for the single points: grows with the product of class sizes, so for results known to be small."""
    one = near.members.withColumnsRenamed({"id": "one", "representative": "src"})
    two = near.members.withColumnsRenamed({"id": "two", "representative": "dst"})
    apart = near.pairs.join(one, "src").join(two, "dst").select("one", "two", "dist")
    equal = one.join(two, F.col("src") == F.col("dst")).filter(F.col("one") < F.col("two")).select("one", "two", F.lit(0.0).alias("dist"))
    return apart.unionByName(equal).select(F.least("one", "two").alias("src"), F.greatest("one", "two").alias("dst"), "dist")


def _cell_bound(searching: DataFrame, metric: Metric, k: int) -> DataFrame:
    """Add ``by_cell``: the k-th smallest upper bound among mates of the same cell, at most about UNIT of them."""
    groups = F.broadcast(
        searching.groupBy("home").agg(F.ceil(F.count("*") / F.lit(UNIT)).cast("int").alias("groups"))
    )
    grouped = searching.join(groups, "home").withColumn("group", F.pmod(F.xxhash64("class"), F.col("groups")))
    a = grouped.select("home", "group", F.col("class").alias("src"), F.struct(*metric.columns).alias("a"))
    b = grouped.select("home", "group", F.col("class").alias("dst"), F.struct(*metric.columns).alias("b"))
    bound = metric.upper_bound(lambda c: F.col("a")[c], lambda c: F.col("b")[c])
    rank = F.row_number().over(Window.partitionBy("src").orderBy("bound"))
    kth = (
        spread(a, "home", "group").join(spread(b, "home", "group"), ["home", "group"])
        .filter(F.col("src") != F.col("dst"))
        .select("src", bound.alias("bound"))
        .withColumn("rank", rank).filter(F.col("rank") <= k).filter(F.col("rank") == k)
        .select(F.col("src").alias("class"), F.col("bound").alias("by_cell"))
    )
    return spread(searching, "class").join(kth, "class", "left")


def _compare_vectors(classes: DataFrame, vector: str, n: int, k: int | None = None, radius: float | None = None) -> DataFrame:
    """(src, dst_class, dist) of ``n`` classes (class, first, vector), compared block with block in numpy, every two blocks once.

    With ``k``, for each class the ``k`` nearest classes of every block, ties to the smaller ``first``; so the ``k`` nearest of all are among
    them. With ``radius``, the pairs no farther apart, each once. A vector is sent to as many units as there are blocks, and a unit holds
    two blocks. Only vectors of the same length, without missing numbers, have a distance.
    """
    blocks = max(BLOCKS, -(-n // BLOCK_ROWS))
    whole = classes.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(
        F.size(vector).alias("dims"), F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("block"), "class", "first", F.col(vector).alias("vec")
    )
    keys, last = ["dims", "one", "two"], F.lit(blocks - 1)
    left = whole.withColumn("one", F.col("block")).withColumn("two", F.explode(F.sequence("block", last)))
    right = whole.withColumn("two", F.col("block")).withColumn("one", F.explode(F.sequence(F.lit(0), "block")))

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        same, found = key[1].as_py() == key[2].as_py(), []
        if left.num_rows and right.num_rows:
            sides = [t.take(pc.sort_indices(t["first"])).select(["class", "vec"]) for t in (left, right)]
            for back in ([False] if same or radius is not None else [False, True]):
                a, b = reversed(sides) if back else sides
                found += _near_rows(a, b, same, k, radius)
        return pa.concat_tables(found) if found else pa.schema([("src", pa.string()), ("dst_class", pa.string()), ("dist", pa.float64())]).empty_table()

    return (
        spread(left.select(*keys, "class", "first", "vec"), *keys).groupBy(*keys)
        .cogroup(spread(right.select(*keys, "class", "first", "vec"), *keys).groupBy(*keys))
        .applyInArrow(compare, "src string, dst_class string, dist double")
    )


def _near_rows(one: pa.Table, two: pa.Table, same: bool, k: int | None, radius: float | None) -> list[pa.Table]:
    """Neighbours of the rows of ``one`` (class, vec) among those of ``two``, both in the order that settles ties."""
    x, y = (np.asarray(pc.list_flatten(t["vec"]).to_numpy(), dtype=np.float64).reshape(t.num_rows, -1) for t in (one, two))
    squares, found = (y * y).sum(axis=1), []
    for at in range(0, len(x), 256):
        rows = x[at : at + 256]
        sizes = (rows * rows).sum(axis=1)[:, None]
        rough = sizes + squares[None, :] - 2.0 * rows @ y.T
        if same:  # a class is not its own neighbour; a pair within the radius is met once
            rough[np.arange(len(rows)), at + np.arange(len(rows))] = np.nan
        if radius is None:
            limit = np.sqrt(np.maximum(np.partition(rough, k - 1, axis=1)[:, k - 1], 0.0)) if k < len(y) else np.full(len(rows), np.inf)
        else:
            limit = np.full(len(rows), radius)
        limit = (np.where(np.isnan(limit), np.inf, limit) + 2 * SLACK) ** 2
        i, j = np.nonzero(rough <= (limit + 1e-12 * (sizes[:, 0] + limit))[:, None])
        if same and radius is not None:
            i, j = i[j > at + i], j[j > at + i]
        dist = np.round(np.sqrt(((rows[i] - y[j]) ** 2).sum(axis=1)), DIGITS)
        if radius is None:
            order = np.lexsort((j, dist, i))
            i, j, dist = i[order], j[order], dist[order]
            keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(dist)
        else:
            keep = dist <= radius
        i, j, dist = i[keep], j[keep], dist[keep]
        found.append(pa.table({"src": one["class"].take(pa.array(at + i)), "dst_class": two["class"].take(pa.array(j)), "dist": dist}))
    return found


def knn_edges(neighbors: DataFrame) -> DataFrame:
    """Undirected k-NN graph: one row per edge with ``src < dst`` and weight 1."""
    return (
        neighbors.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
        .withColumn("weight", F.lit(1.0))
    )
