"""Cluster quality: silhouette, Davies-Bouldin and Calinski-Harabasz on points (id, vec, label)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import euclid
from ..session import cut, lookup

# Rows per block of the silhouette's block pairs.
BLOCK = 8192


def profile_vectors(profiles: DataFrame, label: str = "cluster") -> DataFrame:
    """Dense points from sparse profiles: activities and transitions seen anywhere, then the time features.

    Columns that are zero for every case have no effect after standardising and are left out.
    """
    acts = profiles.select(F.explode("acts").alias("pos")).distinct().agg(F.array_sort(F.collect_list("pos"))).scalar()
    trans = (
        profiles.select(F.explode(F.map_keys("trans")).alias("pos")).distinct()
        .agg(F.array_sort(F.collect_list("pos"))).scalar()
    )
    bits = F.transform("all_acts", lambda p: F.array_contains("acts", p).cast("double"))
    counts = F.transform("all_trans", lambda p: F.coalesce(F.element_at("trans", p), F.lit(0)).cast("double"))
    return (
        profiles.withColumn("all_acts", acts).withColumn("all_trans", trans)
        .select(F.col("case_id").alias("id"), F.concat(bits, counts, "time").alias("vec"), F.col(label).alias("label"))
    )


def column_stats(points: DataFrame) -> DataFrame:
    """(pos, mean, scale) per vector position: population deviation, 1 where it is zero."""
    return (
        points.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
        .select("pos", "mean", F.when(F.col("std") > 1e-12, F.col("std")).otherwise(F.lit(1.0)).alias("scale"))
    )


def standardize(points: DataFrame) -> DataFrame:
    """Shift and scale every position of ``vec`` to mean 0 and population deviation 1."""
    summary = column_stats(points).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "scale")))).scalar()
    scaled = F.zip_with("vec", "summary", lambda x, s: (x - s["mean"]) / s["scale"])
    return points.withColumn("summary", summary).withColumn("vec", scaled).drop("summary")


def centroids(points: DataFrame) -> DataFrame:
    """(label, center, members)."""
    sizes = points.groupBy("label").agg(F.count("*").alias("members"))
    center = (
        points.select("label", F.posexplode("vec").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("listed"))
    )
    return center.join(sizes, "label").select(
        "label", F.transform("listed", lambda e: e["x"]).alias("center"), "members"
    )


def check_labels(points: DataFrame) -> int:
    """Number of clusters; an error when there are fewer than two."""
    if "label" not in points.columns:
        raise ValueError("points need a label column")
    k = points.select("label").distinct().count()
    if k < 2:
        raise ValueError("at least two clusters are needed")
    return k


def davies_bouldin(points: DataFrame, k: int) -> DataFrame:
    """One row: mean over clusters of the worst (spread + spread) / centre distance."""
    around = centroids(points)
    spreads = (
        lookup(points, around.select("label", "center"), "label", k)
        .groupBy("label").agg(F.avg(euclid(F.col("vec"), F.col("center"))).alias("spread"))
    )
    disks = around.join(spreads, "label").select("label", "center", "spread")
    # The k disks as one list, compared inside each of the k rows.
    listed = disks.agg(F.collect_list(F.struct("label", "center", "spread"))).scalar()
    worst = F.array_max(
        F.transform(
            F.filter("all", lambda d: d["label"] != F.col("label")),
            lambda d: (F.col("spread") + d["spread"]) / F.nullif(euclid(F.col("center"), d["center"]), F.lit(0.0)),
        )
    )
    return disks.withColumn("all", listed).agg(F.avg(F.coalesce(worst, F.lit(0.0))).alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame, k: int) -> DataFrame:
    """One row: between-cluster over within-cluster dispersion, each per degree of freedom."""
    around = centroids(points)
    total = points.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    middle = total.agg(F.array_sort(F.collect_list(F.struct("pos", "x")))).scalar()["x"]
    between = around.withColumn("middle", middle).agg(
        F.sum(F.col("members") * F.pow(euclid(F.col("center"), F.col("middle")), 2)).alias("between")
    )
    within = lookup(points, around.select("label", "center"), "label", k).agg(
        F.sum(F.pow(euclid(F.col("vec"), F.col("center")), 2)).alias("within"), F.count("*").alias("n")
    )
    b = between.scalar()
    return within.withColumn("between", b).select(
        F.when(F.col("within") == 0, F.lit(1.0))
        .otherwise(F.col("between") * (F.col("n") - k) / (F.col("within") * (k - 1))).alias("calinski_harabasz")
    )


def _distance_sums(fixed: DataFrame, block: int) -> DataFrame:
    """(id, run, other, total): for points with labels of several runs (``labels``, an array) the summed distance from every point
    to the members of every cluster of every run.

    Points fall into hash blocks of bounded size; each unordered pair of blocks is one unit of work, in which numpy
    takes every distance once and adds them up per label of each run. Only the sums leave a unit, never the pairs. The definition
    needs every distance, so the work is quadratic; rows moved are points times blocks.
    """
    blocks = max(1, -(-fixed.count() // block))
    rows = fixed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    low = rows.withColumn("p", F.col("block")).withColumn("q", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))))
    high = rows.withColumn("q", F.col("block")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("block"))))
    id_type, label_type = dict(fixed.dtypes)["id"], dict(fixed.dtypes)["labels"].removeprefix("array<").removesuffix(">")

    def hot_columns(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One 0/1 column for each label of each run, with the run and the label of each column."""
        hot, runs, names = [], [], []
        for run in range(labels.shape[1]):
            codes, found = pd.factorize(labels[:, run])
            hot.append(np.eye(len(found))[codes])
            runs += [run] * len(found)
            names += list(found)
        return np.hstack(hot), np.array(runs), np.array(names)

    def add_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": [], "run": [], "other": [], "total": []})
        if not len(left) or not len(right):
            return empty
        x, y = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        x_hot, *x_names = hot_columns(np.stack(left["labels"].to_numpy()))
        y_hot, *y_names = hot_columns(np.stack(right["labels"].to_numpy()))
        same = left["block"].iloc[0] == right["block"].iloc[0]
        forth, back = [], np.zeros((len(y), x_hot.shape[1]))
        squares = (y * y).sum(axis=1)
        for at in range(0, len(x), 256):
            part = x[at: at + 256]
            near = (part * part).sum(axis=1)[:, None] + squares[None, :] - 2.0 * part @ y.T
            # Distances this small suffer from cancellation: take them from the differences.
            i, j = np.nonzero(near < 1e-6 * (1.0 + squares[None, :]))
            near[i, j] = ((part[i] - y[j]) ** 2).sum(axis=1)
            dist = np.sqrt(np.maximum(near, 0.0))
            forth.append(dist @ y_hot)
            if not same:
                back += dist.T @ x_hot[at: at + 256]

        def table(ids, sums, runs, names):
            return pd.DataFrame(
                {"id": np.repeat(np.asarray(ids), len(names)), "run": np.tile(runs, len(ids)), "other": np.tile(names, len(ids)), "total": sums.ravel()}
            )

        result = [table(left["id"], np.vstack(forth), *y_names)]
        if not same:
            result.append(table(right["id"], back, *x_names))
        return pd.concat(result)

    return (
        low.groupBy("p", "q").cogroup(high.groupBy("p", "q"))
        .applyInPandas(add_up, f"id {id_type}, run int, other {label_type}, total double")
        .groupBy("id", "run", "other").agg(F.sum("total").alias("total"))
    )


def _silhouettes(fixed: DataFrame, block: int) -> DataFrame:
    """(run, silhouette) of points with an array of labels, one for each run."""
    labelled = fixed.select("id", F.posexplode("labels").alias("run", "label"))
    sizes = labelled.groupBy("run", F.col("label").alias("other")).agg(F.count("*").alias("members"))
    own = F.col("label") == F.col("other")
    per_point = labelled.join(_distance_sums(fixed, block), ["id", "run"]).join(sizes, ["run", "other"]).groupBy("id", "run").agg(
        F.max(F.when(own, F.col("total") / F.nullif(F.col("members") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("members"))).alias("b"),
    )
    value = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per_point.groupBy("run").agg(F.avg(value).alias("silhouette"))


def silhouette(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row: mean over points of (b - a) / max(a, b); a point alone in its cluster counts 0."""
    return _silhouettes(cut(points.select("id", "vec", F.array("label").alias("labels"))), block).select("silhouette")


def score_labelings(points: DataFrame, labels: DataFrame, digits: int = 2, block: int = BLOCK) -> DataFrame:
    """(run, clusters, silhouette, davies_bouldin, calinski_harabasz) of several labelings (id, run, label) of the same points, null
    for a run with fewer than two clusters.

    Every step is keyed by run: distances are taken once for all runs, and centres, spreads and dispersions are single
    aggregations. Every run has a label for every point.
    """
    scaled = standardize(points)
    listed = labels.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("of"))
    fixed = cut(scaled.join(listed, "id").select("id", "vec", F.transform("of", lambda e: e["label"]).alias("labels")))
    # Runs have numbers in the order of their names: one row per run.
    names = labels.select("run").distinct().agg(F.array_sort(F.collect_list("run")).alias("names")).select(F.posexplode("names").alias("at", "run"))
    keyed = fixed.select("vec", F.posexplode("labels").alias("at", "label"))
    around = cut(
        keyed.select("at", "label", F.posexplode("vec").alias("pos", "x")).groupBy("at", "label", "pos").agg(F.avg("x").alias("x"))
        .groupBy("at", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("center"))
    )
    distance = euclid(F.col("vec"), F.col("center"))
    disks = cut(
        lookup(keyed, around, ["at", "label"], around.count()).groupBy("at", "label")
        .agg(F.count("*").alias("members"), F.avg(distance).alias("spread"), F.sum(distance * distance).alias("within"))
        .join(around, ["at", "label"])
    )
    # Standardised points have their centre at zero.
    between = F.col("members") * F.aggregate("center", F.lit(0.0), lambda total, x: total + x * x)
    dispersion = disks.groupBy("at").agg(
        F.count("*").alias("clusters"), F.sum("members").alias("n"), F.sum("within").alias("within"), F.sum(between).alias("between")
    )
    a, b = disks.alias("a"), disks.alias("b")
    apart = F.nullif(euclid(F.col("a.center"), F.col("b.center")), F.lit(0.0))
    worst = (
        a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.label") != F.col("b.label")))
        .groupBy(F.col("a.at").alias("at"), F.col("a.label").alias("label")).agg(F.coalesce(F.max((F.col("a.spread") + F.col("b.spread")) / apart), F.lit(0.0)).alias("worst"))
        .groupBy("at").agg(F.avg("worst").alias("davies_bouldin"))
    )
    ratio = F.when(F.col("within") == 0, 1.0).otherwise(F.col("between") * (F.col("n") - F.col("clusters")) / (F.col("within") * (F.col("clusters") - 1)))
    several = F.col("clusters") > 1
    return (
        dispersion.join(names, "at").join(worst, "at", "left").join(_silhouettes(fixed, block).withColumnRenamed("run", "at"), "at", "left")
        .select(
            "run", F.col("clusters").cast("int").alias("clusters"), F.when(several, F.round("silhouette", digits)).alias("silhouette"),
            F.when(several, F.round("davies_bouldin", digits)).alias("davies_bouldin"), F.when(several, F.round(ratio, digits)).alias("calinski_harabasz"),
        )
    )


def cluster_scores(points: DataFrame, digits: int = 2, block: int = BLOCK) -> DataFrame:
    """One row with the three scores of the standardised points, rounded."""
    k = check_labels(points)
    scaled = standardize(points)
    one = silhouette(scaled, block)
    return one.select(
        F.round("silhouette", digits).alias("silhouette"),
        F.round(davies_bouldin(scaled, k).scalar(), digits).alias("davies_bouldin"),
        F.round(calinski_harabasz(scaled, k).scalar(), digits).alias("calinski_harabasz"),
    )


def score_runs(runs: dict[str, DataFrame], digits: int = 2) -> tuple[DataFrame, dict[str, str]]:
    """Scores of several clusterings, one row each, and the reason for every run that cannot be scored."""
    scored, skipped = None, {}
    for run, points in runs.items():
        try:
            row = cluster_scores(points, digits).withColumn("file", F.lit(run))
        except ValueError as reason:
            skipped[run] = str(reason)
            continue
        row = row.select("file", "silhouette", "davies_bouldin", "calinski_harabasz")
        scored = row if scored is None else scored.unionByName(row)
    if scored is None:
        raise ValueError(f"no run could be scored: {skipped}")
    return scored, skipped
