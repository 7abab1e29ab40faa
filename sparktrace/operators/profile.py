"""Case profiles: presence, directly-follows counts and time features in one sparse row per case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dense_cells, round_half_even
from ..functions.timefeatures import CALENDAR, DAY_US, TIME_FEATURES, calendar_part, epoch_us, scaled
from ..session import BROADCAST_ROWS, cut, dense_index, lookup
from .eventlog import positioned

# A wide table is only written when its columns are known to be few.
MAX_WIDE_COLUMNS = 10_000


@dataclass(frozen=True)
class Alphabet:
    """Activities with their position; ``size`` is the row count of ``table``."""

    table: DataFrame
    size: int


def activity_dict(log: DataFrame, order: str = "first_seen") -> Alphabet:
    """Number the activities by first appearance in (ts, seq) order, or alphabetically (``order='alpha'``)."""
    if order not in ("first_seen", "alpha"):
        raise ValueError("order must be 'first_seen' or 'alpha'")
    firsts = cut(log.groupBy("activity").agg(F.min(F.struct("ts", "seq")).alias("first")))
    size = firsts.count()
    keys = ["first", "activity"] if order == "first_seen" else ["activity"]
    if size <= BROADCAST_ROWS:
        position = F.row_number().over(Window.orderBy(*keys)) - 1
        numbered = firsts.select("activity", position.cast("int").alias("idx"))
    else:
        numbered = dense_index(firsts, keys, "idx").select("activity", F.col("idx").cast("int").alias("idx"))
    return Alphabet(numbered, size)


def transition_counts(log: DataFrame) -> DataFrame:
    """Directly-follows counts per case: (case_id, act_from, act_to, n), non-zero cells only."""
    return (
        positioned(log)
        .filter(F.col("prev_activity").isNotNull())
        .groupBy("case_id", F.col("prev_activity").alias("act_from"), F.col("activity").alias("act_to"))
        .agg(F.count("*").cast("int").alias("n"))
    )


def directly_follows(log: DataFrame) -> DataFrame:
    """Directly-follows counts of the whole log: (act_from, act_to, n)."""
    return (
        positioned(log)
        .filter(F.col("prev_activity").isNotNull())
        .groupBy(F.col("prev_activity").alias("act_from"), F.col("activity").alias("act_to"))
        .agg(F.count("*").alias("n"))
    )


def directly_follows_matrix(log: DataFrame) -> DataFrame:
    """The same as a square matrix, one row and column per activity of any pair, 0 where there is none."""
    pairs = cut(directly_follows(log))
    names = pairs.select(F.col("act_from").alias("activity")).union(pairs.select("act_to")).distinct()
    columns = [row[0] for row in names.orderBy("activity").limit(MAX_WIDE_COLUMNS + 1).collect()]
    _check_width(len(columns))
    wide = pairs.groupBy(F.col("act_from").alias("activity")).pivot("act_to", columns).agg(F.first("n"))
    return names.join(wide, "activity", "left").na.fill(0)


def _event_sums() -> list[Column]:
    """Additive parts of the time features, as integers so that every summing order gives the same result."""
    us = epoch_us(F.col("ts"))
    in_day = F.pmod(us, F.lit(DAY_US))
    second = F.lit(1_000_000)
    return [
        F.sum(((us - in_day) / F.lit(DAY_US)).cast("bigint")).alias("days"),
        F.sum(((in_day - F.pmod(in_day, second)) / second).cast("bigint")).alias("secs"),
        F.sum(F.pmod(in_day, second)).alias("micros"),
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
        *[F.sum(calendar_part(name, F.col("ts")).cast("bigint")).alias(name) for name, _, _ in CALENDAR],
    ]


_SUMMED = ["days", "secs", "micros", *[name for name, _, _ in CALENDAR]]


def _merge_sums() -> list[Column]:
    return [
        *[F.sum(name).alias(name) for name in _SUMMED],
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    ]


def _time_means(count: Column) -> list[Column]:
    """Mean of every time feature over the case's events, rounded to 4 digits.

    The mean time since case start follows from the sums and the first timestamp; the times between events add up to
    the case's duration. Neither needs the events in order.
    """
    def exact(column: Column) -> Column:
        return column.cast("decimal(20,0)")

    n = count.cast("double")
    first = F.col("first_us")
    since_epoch = exact(F.col("days")) * DAY_US + exact(F.col("secs")) * 1_000_000 + exact(F.col("micros"))
    accumulated = (since_epoch - exact(first) * exact(count)).cast("double") / F.lit(1e6) / n
    execution = (F.col("last_us") - first).cast("double") / F.lit(1e6) / n
    within_day = (F.col("secs") + F.col("micros") / F.lit(1e6)) / n
    calendar = [scaled(F.col(name).cast("double") / n, low, high) for name, low, high in CALENDAR]
    return [round_half_even(value, 4) for value in (accumulated, execution, within_day, *calendar)]


def time_profile(log: DataFrame) -> DataFrame:
    """Mean time features per case, one column each; one partial aggregation, no window."""
    sums = log.groupBy("case_id").agg(F.count("*").alias("events"), *_event_sums())
    means = _time_means(F.col("events"))
    return sums.select("case_id", *[value.alias(name) for name, value in zip(TIME_FEATURES, means)])


def profile(log: DataFrame, alphabet: Alphabet) -> DataFrame:
    """One sparse row per case.

    ``acts`` holds positions of the activities that occur, ``trans`` the non-zero directly-follows counts keyed by
    ``from * size + to``, ``time`` the mean time features.
    """
    cells = (
        positioned(log)
        .groupBy("case_id", "activity", "prev_activity")
        .agg(F.count("*").alias("n"), *_event_sums())
    )
    to = alphabet.table.select("activity", F.col("idx").alias("to"))
    from_ = alphabet.table.select(F.col("activity").alias("prev_activity"), F.col("idx").alias("from"))
    placed = lookup(cells, to, "activity", alphabet.size)
    placed = lookup(placed, from_, "prev_activity", alphabet.size, "left")
    cell = F.when(
        F.col("from").isNotNull(),
        F.struct((F.col("from").cast("bigint") * alphabet.size + F.col("to")).alias("pos"), F.col("n").cast("int").alias("n")),
    )
    # At most size * (size + 1) rows per case are gathered here, however long the case is.
    gathered = placed.groupBy("case_id").agg(
        F.sum("n").alias("events"),
        F.array_sort(F.collect_set("to")).alias("acts"),
        F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("trans"),
        *_merge_sums(),
    )
    return gathered.select("case_id", "events", "acts", "trans", F.array(*_time_means(F.col("events"))).alias("time"))


def profile_strings(profiles: DataFrame, size: int) -> DataFrame:
    """Add the dense presence and transition strings (``act_text``, ``tra_text``) that edit distance compares."""
    presence = F.transform("acts", lambda pos: F.struct(pos.cast("bigint").alias("pos"), F.lit(1).alias("n")))
    counts = F.transform(
        F.array_sort(F.map_entries("trans")), lambda e: F.struct(e["key"].alias("pos"), e["value"].alias("n"))
    )
    return profiles.withColumn("act_text", dense_cells(presence, F.lit(size))).withColumn(
        "tra_text", dense_cells(counts, F.lit(size * size))
    )


def presence(log: DataFrame) -> DataFrame:
    """(case_id, activity) for every activity that occurs in the case: the ones of the one-hot encoding."""
    return log.select("case_id", "activity").distinct()


def features(alphabet: Alphabet) -> DataFrame:
    """Feature table in column order: activities, transitions in row-major order, time features."""
    names = alphabet.table
    size = alphabet.size
    acts = names.select(
        F.col("idx").cast("bigint").alias("pos"), F.lit("activity").alias("kind"), F.col("activity").alias("name")
    )
    listed = F.array_sort(F.collect_list(F.struct("idx", "activity")))
    to = names.agg(listed.alias("all")).scalar() if size <= BROADCAST_ROWS else None
    if to is None:
        raise ValueError(f"a dense feature table needs at most {BROADCAST_ROWS} activities, got {size}")
    trans = names.select("idx", "activity", F.explode(to).alias("to")).select(
        (F.lit(size) + F.col("idx").cast("bigint") * size + F.col("to.idx")).alias("pos"),
        F.lit("transition").alias("kind"),
        F.concat("activity", F.lit("->"), "to.activity").alias("name"),
    )
    time = names.sparkSession.createDataFrame(
        [(size + size * size + i, "time", name) for i, name in enumerate(TIME_FEATURES)],
        "pos bigint, kind string, name string",
    )
    return acts.unionByName(trans).unionByName(time)


def _check_width(columns: int) -> None:
    if columns > MAX_WIDE_COLUMNS:
        raise ValueError(f"a wide table would need more than {MAX_WIDE_COLUMNS} columns; use the sparse profile")


def wide_profile(profiles: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Dense profile: ``case``, one 0/1 column per activity, one count per ``a->b``, the time features."""
    _check_width(alphabet.size + alphabet.size**2 + len(TIME_FEATURES))
    names = [row[0] for row in alphabet.table.orderBy("idx").select("activity").collect()]
    size = len(names)
    acts = [F.array_contains("acts", i).cast("int").alias(name) for i, name in enumerate(names)]
    trans = [
        F.coalesce(F.element_at("trans", F.lit(i * size + j)), F.lit(0)).alias(f"{a}->{b}")
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    time = [F.col("time")[i].alias(name) for i, name in enumerate(TIME_FEATURES)]
    return profiles.select(F.col("case_id").alias("case"), *acts, *trans, *time)


def sparse_profile(wide: DataFrame) -> tuple[DataFrame, Alphabet]:
    """Turn a wide profile (for instance one read from CSV) back into the sparse form and its alphabet."""
    columns = [name for name in wide.columns if name not in ("case", "cluster")]
    arrows = [name for name in columns if "->" in name]
    if not arrows:
        raise ValueError("the profile has no transition columns")
    names = columns[: columns.index(arrows[0])]
    times = columns[columns.index(arrows[-1]) + 1:]
    bits = F.array(*[F.when(F.col(f"`{name}`") != 0, F.lit(i)) for i, name in enumerate(names)])
    counts = F.array(*[
        F.when(F.col(f"`{name}`") != 0, F.struct(F.lit(i).alias("key"), F.col(f"`{name}`").cast("int").alias("value")))
        for i, name in enumerate(arrows)
    ])
    keep = ["cluster"] if "cluster" in wide.columns else []
    sparse = wide.select(
        F.col("case").cast("string").alias("case_id"),
        F.array_compact(bits).alias("acts"),
        F.map_from_entries(F.array_compact(counts)).alias("trans"),
        F.array(*[F.col(f"`{name}`").cast("double") for name in times]).alias("time"),
        *keep,
    )
    table = wide.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "activity string, idx int")
    return sparse, Alphabet(table, len(names))
