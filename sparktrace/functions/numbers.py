"""Rounding, vectors and edit distances as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 16


def round_half_even(value: Column, digits: int) -> Column:
    """Round like numpy: scale, round half to even, scale back. Adding zero turns -0.0 into 0.0."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale + F.lit(0.0)


def to_number(value: Column) -> Column:
    """Invalid numbers become NULL."""
    return value.try_cast("double")


def euclid(left: Column, right: Column, dims: int | None = None) -> Column:
    """Euclidean distance of two double arrays; short ones are unrolled so that they stay in generated code."""
    if dims is not None and dims <= UNROLL:
        squares = [(left[i] - right[i]) * (left[i] - right[i]) for i in range(dims)]
        return F.sqrt(reduce(lambda a, b: a + b, squares))
    squared = F.zip_with(left, right, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squared, F.lit(0.0), lambda total, x: total + x))


def euclid_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def dense_cells(entries: Column, width: Column) -> Column:
    """Concatenate ``width`` cells without separator, given sorted ``(pos, n)`` structs of the non-zero ones. A string holds 2**31 cells."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("next"))

    def add(state: Column, entry: Column) -> Column:
        return F.struct(
            F.concat(
                state["text"], F.repeat(F.lit("0"), (entry["pos"] - state["next"]).cast("int")), entry["n"].cast("string")
            ).alias("text"),
            (entry["pos"] + 1).alias("next"),
        )

    return F.aggregate(
        entries, start, add, lambda s: F.concat(s["text"], F.repeat(F.lit("0"), (width.cast("bigint") - s["next"]).cast("int")))
    )


def cell_edit_distance(left: Column, right: Column) -> Column:
    """Sum of per-cell Levenshtein distances of two sparse ``map<pos, count>`` rows; a missing cell reads ``0``."""
    zero = F.lit("0")
    per_cell = F.map_zip_with(
        left,
        right,
        lambda _, x, y: F.levenshtein(
            F.coalesce(x.cast("string"), zero), F.coalesce(y.cast("string"), zero)
        ),
    )
    return F.aggregate(F.map_values(per_cell), F.lit(0), lambda total, x: total + x)
