"""Explanations: differences of representatives from their mean, or of one case from another, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import FIRST_DIGITS, clean_case_id, id_order
from ..functions.timefeatures import CASE_TIME, TIME_FEATURES
from ..session import cut, dense_index, lookup
from .profile import Alphabet, features

DIGITS = 6

# Segment titles in order, the names of merged all-zero features, and the smallest colour range.
SEGMENT_TITLES = ("Activities", "Self-loops", "Transitions", "Time (Case)", "Time (Avg. Event)")
LABEL_ALL = "all"
LABEL_OTHERS = "others"
MIN_RANGE = 1e-6
LOCAL_RANGE = 0.5


def only_representatives(profiles: DataFrame, reps: DataFrame, metric: str = "case") -> DataFrame:
    """Profiles of the cases named in one column of a representatives table."""
    if metric not in reps.columns:
        raise ValueError(f"representatives need a column {metric!r}")
    ids = reps.select(clean_case_id(F.col(metric)).alias("case_id")).distinct()
    return profiles.join(ids, "case_id", "left_semi")


def case_order(profiles: DataFrame) -> DataFrame:
    """(case_id, case_number, case_pos): cases by the first number in their id, then by id."""
    digits = F.regexp_extract("case_id", FIRST_DIGITS, 1)
    numbered = profiles.select("case_id", F.when(digits != "", digits.cast("double")).alias("case_number"))
    return dense_index(numbered, id_order(F.col("case_id")), "case_pos")


def _cells(size: int) -> Column:
    """All non-zero features of a profile as one ``map<pos, value>`` over the feature positions."""
    acts = F.transform("acts", lambda p: F.struct(p.cast("bigint").alias("key"), F.lit(1.0).alias("value")))
    trans = F.transform(
        F.map_entries("trans"),
        lambda e: F.struct((e["key"].cast("bigint") + size).alias("key"), e["value"].cast("double").alias("value")),
    )
    start = size + size * size
    time = F.transform(
        "time", lambda x, i: F.struct((i.cast("bigint") + start).alias("key"), x.alias("value"))
    )
    return F.map_from_entries(F.concat(acts, trans, time))


def _dense(profiles: DataFrame, size: int) -> DataFrame:
    """(case_id, pos, value) with a row for every feature, zeros included."""
    width = size + size * size + len(TIME_FEATURES)
    return (
        profiles.select("case_id", _cells(size).alias("cells"))
        .select("case_id", "cells", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))).alias("pos"))
        .select("case_id", "pos", F.coalesce(F.element_at("cells", F.col("pos")), F.lit(0.0)).alias("value"))
    )


def segment_table(alphabet: Alphabet) -> DataFrame:
    """(pos, feature, segment): 1 activities, 2 self-loops, 3 other transitions, 4 case time, 5 event time.

    One time feature, the third, is not shown.
    """
    size = alphabet.size
    cell = F.col("pos") - size
    loop = F.floor(cell / size) == cell % size
    time = F.col("pos") - (size + size * size)
    segment = (
        F.when(F.col("kind") == "activity", 1)
        .when((F.col("kind") == "transition") & loop, 2)
        .when(F.col("kind") == "transition", 3)
        .when(time < len(CASE_TIME), 4)
        .when(time > len(CASE_TIME), 5)
    )
    return (
        features(alphabet).select("pos", F.col("name").alias("feature"), segment.alias("segment"))
        .filter(F.col("segment").isNotNull())
    )


def _segmented(diff: DataFrame, alphabet: Alphabet) -> DataFrame:
    width = alphabet.size + alphabet.size**2 + len(TIME_FEATURES)
    hours = F.when(F.col("segment") == 4, F.col("value") / 3600.0).otherwise(F.col("value"))
    return lookup(diff, segment_table(alphabet), "pos", width).select(
        "case_id", "segment", F.col("pos").alias("feature_pos"), "feature", F.round(hours, DIGITS).alias("value")
    )


def difference_from_mean(profiles: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(case_id, segment, feature_pos, feature, value): every feature minus its mean over the given cases."""
    cases = profiles.agg(F.count("*").cast("double")).scalar()
    means = (
        profiles.select(F.explode(_cells(alphabet.size)).alias("pos", "x"))
        .groupBy("pos").agg(F.sum("x").alias("sum")).select("pos", (F.col("sum") / cases).alias("mean"))
    )
    width = alphabet.size + alphabet.size**2 + len(TIME_FEATURES)
    diff = lookup(_dense(profiles, alphabet.size), means, "pos", width, "left").select(
        "case_id", "pos", (F.col("value") - F.coalesce("mean", F.lit(0.0))).alias("value")
    )
    return _segmented(diff, alphabet)


def feature_names(cells: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Add ``segment`` and ``feature`` to rows with a feature position ``pos``; positions that are not shown go.

    The name of a transition comes from two joins with the alphabet, so nothing of the size of all transitions is made.
    """
    size, names = alphabet.size, alphabet.table
    cell, time = F.col("pos") - size, F.col("pos") - (size + size * size)
    activity, transition = F.col("pos") < size, (F.col("pos") >= size) & (time < 0)
    placed = cells.withColumns({
        "__from": F.when(activity, F.col("pos")).when(transition, F.floor(cell / size)), "__to": F.when(transition, cell % size),
        "segment": F.when(activity, 1).when(transition & (F.floor(cell / size) == cell % size), 2).when(transition, 3)
        .when(time < len(CASE_TIME), 4).when(time > len(CASE_TIME), 5),
    }).filter(F.col("segment").isNotNull())
    for at in ("__from", "__to"):
        placed = lookup(placed, names.select(F.col("idx").cast("bigint").alias(at), F.col("activity").alias(f"{at}_name")), at, size, "left")
    times = F.array(*[F.lit(name) for name in TIME_FEATURES])
    name = F.when(activity, F.col("__from_name")).when(transition, F.concat("__from_name", F.lit("->"), "__to_name")).otherwise(
        F.get(times, time.cast("int"))
    )
    return placed.withColumn("feature", name).drop("__from", "__to", "__from_name", "__to_name")


def _shown(diff: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Differences with their segment and name, case times in hours."""
    hours = F.when(F.col("segment") == 4, F.col("value") / 3600.0).otherwise(F.col("value"))
    return feature_names(diff, alphabet).withColumn("value", F.round(hours, DIGITS)).withColumnRenamed("pos", "feature_pos")


def support_differences(profiles: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(run, case_id, segment, feature_pos, feature, value): differences from the mean of the run's cases, of the features that any of
    them has. All other features are zero in all cases: they are known by their number, not by rows."""
    cells = profiles.select("run", "case_id", F.explode(_cells(alphabet.size)).alias("pos", "x"))
    cases = profiles.groupBy("run").agg(F.count("*").cast("double").alias("cases"))
    means = cells.groupBy("run", "pos").agg(F.sum("x").alias("sum")).join(F.broadcast(cases), "run").select("run", "pos", (F.col("sum") / F.col("cases")).alias("mean"))
    # Every case of a run with every feature of its support: the rows that are asked for.
    every = profiles.select("run", "case_id").join(means, "run")
    diff = every.join(cells, ["run", "case_id", "pos"], "left").select("run", "case_id", "pos", (F.coalesce("x", F.lit(0.0)) - F.col("mean")).alias("value"))
    return _shown(diff, alphabet)


def reduce_support(long: DataFrame, profiles: DataFrame, alphabet: Alphabet, label_all: str = LABEL_ALL, label_others: str = LABEL_OTHERS) -> DataFrame:
    """``reduce_zero_features`` for differences on the support, run by run: the features without a row count as zero ones."""
    size = alphabet.size
    ends = (size, size + size * size, size + size * size, size + size * size + len(CASE_TIME), size + size * size + len(TIME_FEATURES))
    numbers = (size, size, size * size - size, len(CASE_TIME), len(TIME_FEATURES) - len(CASE_TIME) - 1)
    # The last of the transitions is a loop.
    last = (ends[0] - 1, ends[1] - 1, ends[2] - 2, ends[3] - 1, ends[4] - 1)
    segments = long.sparkSession.createDataFrame([(i + 1, n, at) for i, (n, at) in enumerate(zip(numbers, last)) if n], "segment int, features bigint, last_pos bigint")
    per_feature = long.groupBy("run", "segment", "feature_pos").agg(F.bool_and(F.col("value") == 0).alias("zero"))
    stay = long.join(per_feature.filter("NOT zero"), ["run", "segment", "feature_pos"], "left_semi")
    # Five rows per run.
    filled = per_feature.filter("NOT zero").groupBy("run", "segment").agg(F.count("*").alias("filled"))
    merged = (
        profiles.select("run").distinct().join(F.broadcast(segments)).join(filled, ["run", "segment"], "left")
        .filter(F.coalesce("filled", F.lit(0)) < F.col("features"))
        .select("run", "segment", (F.col("last_pos") + 1).alias("feature_pos"), F.when(F.col("filled").isNull(), label_all).otherwise(label_others).alias("feature"))
    )
    zeros = profiles.select("run", "case_id").join(F.broadcast(merged), "run").withColumn("value", F.lit(0.0))
    return stay.unionByName(zeros)


def reduce_zero_features(
    long: DataFrame, label_all: str = LABEL_ALL, label_others: str = LABEL_OTHERS
) -> DataFrame:
    """Merge the features of a segment that are zero for every case into one, named by whether any other is left."""
    per_feature = long.groupBy("segment", "feature_pos").agg(F.bool_and(F.col("value") == 0).alias("zero"))
    per_segment = per_feature.groupBy("segment").agg(
        F.bool_and("zero").alias("all_zero"), F.max("feature_pos").alias("last_pos")
    )
    flags = per_feature.join(F.broadcast(per_segment), "segment")
    merged = F.when(F.col("all_zero"), F.lit(label_all)).otherwise(F.lit(label_others))
    joined = long.join(flags, ["segment", "feature_pos"])
    kept = joined.filter(~F.col("zero")).select("case_id", "segment", "feature_pos", "feature", "value")
    # The merged feature comes after the segment's own ones.
    zeros = joined.filter("zero").select(
        "case_id", "segment", (F.col("last_pos") + 1).alias("feature_pos"), merged.alias("feature"), F.lit(0.0).alias("value")
    ).distinct()
    return kept.unionByName(zeros)


def with_legend(long: DataFrame, local: bool = False) -> DataFrame:
    """Add ``title``, ``unit`` and the colour limits ``vmin`` and ``vmax`` of each segment (of each run)."""
    keys = ["run", "segment"] if "run" in long.columns else ["segment"]
    ranges = long.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    flat = (F.col("low") == 0) & (F.col("high") == 0)
    if local:
        flat = flat | (F.col("segment") <= 2)
        low, high = F.lit(-LOCAL_RANGE), F.lit(LOCAL_RANGE)
    else:
        low, high = F.col("low"), -F.col("low")
    titles = F.array(*[F.lit(t) for t in SEGMENT_TITLES])
    legend = ranges.select(
        *keys,
        F.element_at(titles, F.col("segment")).alias("title"),
        F.when(F.col("segment") == 4, "hours").otherwise("difference").alias("unit"),
        F.when(flat, 0.0).otherwise(low).alias("vmin"),
        F.when(flat, MIN_RANGE).otherwise(high).alias("vmax"),
    )
    return long.join(F.broadcast(legend), keys)


def explain_runs(profiles: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Explanations of the cases of several runs, from profiles with a column ``run``: differences from the run's mean, all-zero features
    merged, legend and case order. One pass over all runs; its rows grow with the features that the cases have."""
    profiles = cut(profiles)
    long = with_legend(reduce_support(cut(support_differences(profiles, alphabet)), profiles, alphabet))
    digits = F.regexp_extract("case_id", FIRST_DIGITS, 1)
    numbered = profiles.select("run", "case_id", F.when(digits != "", digits.cast("double")).alias("case_number"))
    ranked = dense_index(numbered, [F.col("run"), *id_order(F.col("case_id"))], "at")
    # The cases of a run are numbered among themselves.
    firsts = ranked.groupBy("run").agg(F.min("at").alias("first"))
    ranked = ranked.join(F.broadcast(firsts), "run").select("run", "case_id", "case_number", (F.col("at") - F.col("first")).alias("case_pos"))
    return long.join(ranked, ["run", "case_id"])


def explain_variants(profiles: DataFrame, alphabet: Alphabet, compact: bool = True) -> DataFrame:
    """Difference from the mean with legend and case order; all-zero features merged when ``compact``."""
    if compact:
        return explain_runs(profiles.withColumn("run", F.lit("")), alphabet).drop("run")
    return with_legend(difference_from_mean(profiles, alphabet)).join(case_order(profiles), "case_id")


def explain_pairs(profiles: DataFrame, alphabet: Alphabet, pairs: DataFrame) -> DataFrame:
    """Differences of ``case_id`` from ``variant_id`` for every listed pair (run, case_id, variant_id), with legend, of the features
    that one of the two has. Pairs with a case that has no profile are left out."""
    cells = profiles.select("case_id", F.explode(_cells(alphabet.size)).alias("pos", "x"))
    pairs = cut(
        pairs.select("run", "case_id", "variant_id").distinct().join(profiles.select("case_id"), "case_id", "left_semi")
        .join(profiles.select(F.col("case_id").alias("variant_id")), "variant_id", "left_semi")
    )
    ours = pairs.join(cells, "case_id").select("run", "case_id", "variant_id", "pos", "x")
    theirs = pairs.join(cells.withColumnRenamed("case_id", "variant_id"), "variant_id").select("run", "case_id", "variant_id", "pos", (-F.col("x")).alias("x"))
    diff = ours.unionByName(theirs).groupBy("run", "case_id", "variant_id", "pos").agg(F.sum("x").alias("value"))
    # Limits are those of one pair's own rows.
    named = _shown(diff, alphabet).withColumn("pair", F.struct("run", "case_id", "variant_id")).withColumn("__run", F.col("run")).drop("run")
    legend = with_legend(named.withColumnRenamed("pair", "run"), local=True)
    return legend.drop("run").withColumnRenamed("__run", "run")


def explain_case(profiles: DataFrame, alphabet: Alphabet, case: str, variant: str) -> DataFrame:
    """Feature differences of one case from another, with legend."""
    pair = profiles.filter(F.col("case_id").isin(case, variant))
    found = {row[0] for row in pair.select("case_id").collect()}
    for name in (case, variant):
        if name not in found:
            raise ValueError(f"case {name!r} is not in the profile")
    dense = _dense(pair, alphabet.size)
    diff = dense.groupBy("pos").agg(
        (F.sum(F.when(F.col("case_id") == case, F.col("value")))
         - F.sum(F.when(F.col("case_id") == variant, F.col("value")))).alias("value")
    ).withColumn("case_id", F.lit(case))
    return with_legend(_segmented(diff, alphabet), local=True).withColumn("variant_id", F.lit(variant))
