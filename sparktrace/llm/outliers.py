"""Operator 9: quality rules as robust multivariate outliers.

Statistics of each whole text: words ``[^\\x20\\x09-\\x0D]+``, their code points, symbols, repeated lines, words in repeated
three-word windows. ``base_failed``: fewer than 50 words, or over half of the words in repeated windows.

The others are judged within their language and source by a minimum covariance determinant estimate of five transformed
statistics: mean word length, square roots of symbols a word, of repeated lines a line and of repeated words a word, and the
share of capitals among ASCII letters. Concentration steps run on the whole groups: with the present centre and covariance every
row gets its distance, the nearest h = (n + 5 + 1) / 2 of a group of n (by an approximate quantile, in hundredths) give the next centre
and covariance, until the determinants stand still; so nearly half of a group may be bad. One reweighting step follows: the rows within
the 0.975 quantile give the final centre and covariance. The start is medians and median absolute deviations. A row is rejected if its squared Mahalanobis distance is over the 0.9999 quantile
of chi-square. Most texts have no symbol and no repeated line, so the covariance of the nearest would be singular: a fixed
variance (``FLOORS``, in the statistics' units) is added to each statistic. Groups are one row of sums each and are never held by
a task, so a group may have any part of all rows.

Groups of fewer than ``LEAST`` rows are judged together with the other small ones of their language, those that are still small
with each other; fewer than ``FEWEST`` rows in all: no verdict, kept. Null language or source is a value like others. Null text: no
words, ``base_failed``. Repeated rows count each; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrace.llm.common import ASCII_SPACE, pairs, table
from sparktrace.session import cut

SYMBOLS = "#*$%&|<>"
WINDOW = 3
STATISTICS = ("word_length", "symbol_share", "line_share", "repeat_share", "capital_share")
FLOORS = (0.5, 0.1, 0.2, 0.15, 0.08)
LEAST = 50
FEWEST = 12
#: Rows within this quantile count in the reweighting step.
REWEIGHT = 0.975
CUTOFF = 0.9999
#: A group whose log determinant falls by less than this part of it stands still.
LEAST_FALL = 1e-6
_SPACE = ASCII_SPACE.encode()
_DIM = len(STATISTICS)


def chi_square_share(x: float, dim: int) -> float:
    """Distribution function of chi-square, by the series of the lower incomplete gamma function."""
    a, x = dim / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    for n in count(1):
        term *= x / (a + n)
        total += term
        if term < 1e-16 * total:
            return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi_square_quantile(share: float, dim: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, dim) < share else (low, middle)
    return high


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows found twice or more."""
    if len(words) <= window:
        return 0
    number = defaultdict(count().__next__)
    ids = np.array(list(map(number.__getitem__, words)), dtype=np.int64)
    codes = ids[: len(ids) - window + 1]
    for i in range(1, window):  # dense numbers of the windows so far, so that the codes never overflow
        codes = np.unique(codes, return_inverse=True)[1] if i > 1 else codes
        codes = codes * len(number) + ids[i : len(ids) - window + 1 + i]
    _, at, n = np.unique(codes, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for i in range(window):
        covered[i : len(twice) + i] |= twice
    return int(covered.sum())


def statistics_of(text: str | None) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capitals, ASCII letters."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    codes = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    return (
        len(words), len(text) - int(codes[list(_SPACE)].sum()), int(codes[list(SYMBOLS.encode())].sum()), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), int(codes[65:91].sum()), int(codes[65:91].sum() + codes[97:123].sum()),
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source and the counts."""

    def run(batches):
        for batch in pairs(batches):
            rows = np.array([statistics_of(t) for t in batch.column(3).to_pylist()], dtype=np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(rows[:, i]) for i in range(len(_COUNTS)))], names=["doc_id", "lang", "source", *_COUNTS])

    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col(text).cast("string"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def _whitening(rows: pd.DataFrame) -> pd.DataFrame:
    """For each group the inverse Cholesky factor of its covariance (row by row) and the determinant's logarithm."""
    out = []
    for r in rows.itertuples(index=False):
        covariance = np.array(r.covariance, dtype=np.float64).reshape(_DIM, _DIM)
        lower = np.linalg.cholesky(covariance)
        out.append((r.judged, list(r.centre), np.linalg.inv(lower).ravel().tolist(), float(2 * np.log(np.diag(lower)).sum())))
    return pd.DataFrame(out, columns=["judged", "centre", "factor", "volume"])


_ESTIMATE = "judged string, centre array<double>, factor array<double>, volume double"


def _distance():
    """SQL: squared Mahalanobis distance of x0, x1, ... by centre and factor."""
    parts = [
        "pow(" + " + ".join(f"factor[{i * _DIM + j}] * (x{j} - centre[{j}])" for j in range(i + 1)) + ", 2)"
        for i in range(_DIM)
    ]
    return F.expr(" + ".join(parts))


def consistency_of(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by."""
    return share / chi_square_share(chi_square_quantile(share, _DIM), _DIM + 2) if share < 1 else 1.0


def estimates(points: DataFrame) -> DataFrame:
    """(judged, centre, factor, volume) by concentration steps. ``points``: judged, x0, x1, ...

    Each group steps until its own determinant falls no more and then leaves; there is no limit of steps, since determinants
    are bounded from below by the floors.
    """
    xs = [f"x{i}" for i in range(_DIM)]
    floors = [f * f for f in FLOORS]
    # Hundredths of a group that are its nearest h rows: from 50 for large groups to 100.
    shares = [i / 100 for i in range(50, 101)]
    sizes = points.groupBy("judged").agg(F.count("*").alias("n")).select(
        "judged", F.greatest(F.lit(0), F.least(F.lit(50), F.expr(f"cast(ceil(50.0 * (n + {_DIM + 1}) / n) AS int) - 50"))).alias("h")
    )
    sizes = cut(sizes)
    consistency = F.element_at(F.array(*(F.lit(consistency_of(q)) for q in shares)), F.col("h") + 1)

    def with_factor(sums: DataFrame) -> DataFrame:
        def run(batches):
            for pdf in batches:
                yield _whitening(pdf)

        return cut(sums.mapInPandas(run, _ESTIMATE))

    middle = points.groupBy("judged").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m{x}") for x in xs))
    spread = points.join(middle, "judged").groupBy("judged").agg(
        *(F.first(f"m{x}").alias(f"m{x}") for x in xs), *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{x}")), 0.5, 1000).alias(f"s{x}") for x in xs)
    )
    start = spread.select(
        "judged", F.array(*(F.col(f"m{x}") for x in xs)).alias("centre"),
        F.array(*(F.pow(1.4826 * F.col(f"s{xs[i]}"), 2) + floors[i] if i == j else F.lit(0.0) for i in range(_DIM) for j in range(_DIM))).alias("covariance"),
    )
    def distances(now: DataFrame) -> DataFrame:
        return points.join(now, "judged").withColumn("d", _distance()).select("judged", "d", *xs)

    def shape_of(near: DataFrame, factor) -> DataFrame:
        """``near``: judged, h, x0, x1, ...; ``factor`` makes up for the rows left out."""
        sums = near.groupBy("judged").agg(
            F.first("h").alias("h"),
            *(F.avg(x).alias(f"m{x}") for x in xs),
            *(F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i in range(_DIM) for j in range(i + 1)),
        )
        return with_factor(sums.select(
            "judged", F.array(*(F.col(f"m{x}") for x in xs)).alias("centre"),
            F.array(*(factor * F.col(f"c{max(i, j)}_{min(i, j)}") + (floors[i] if i == j else 0.0) for i in range(_DIM) for j in range(_DIM))).alias("covariance"),
        ))

    now, settled, first = with_factor(start), [], True
    while True:
        placed = distances(now)
        borders = placed.groupBy("judged").agg(F.percentile_approx("d", shares, 10_000).alias("borders"))
        borders = borders.join(sizes, "judged").select("judged", "h", F.element_at("borders", F.col("h") + 1).alias("border"))
        after = shape_of(placed.join(borders, "judged").filter("d <= border"), consistency)
        # The start is no estimate of the same kind, so every group makes a second step.
        falls = F.lit(True) if first else F.col("volume") < F.col("old") - LEAST_FALL * F.abs("old")
        after = cut(after.join(now.select("judged", F.col("volume").alias("old")), "judged").withColumn("falls", falls))
        settled.append(after.filter("NOT falls").drop("old", "falls"))
        now, first = after.filter("falls").drop("old", "falls"), False
        if now.isEmpty():
            break
    now = reduce(DataFrame.unionByName, settled)
    within = chi_square_quantile(REWEIGHT, _DIM)
    return shape_of(distances(now).filter(F.col("d") <= within).withColumn("h", F.lit(0)), F.lit(consistency_of(REWEIGHT)))


def outliers(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, distance (null without a verdict) and kept, for every row."""
    words = F.greatest("n_words", F.lit(1))
    made = statistics(docs, text).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    made = made.withColumns(
        {
            "x0": F.col("word_chars") / words, "x1": F.sqrt(F.col("n_symbols") / words), "x2": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "x3": F.sqrt(F.col("n_repeat_words") / words), "x4": F.col("n_capitals") / F.greatest("n_letters", F.lit(1)),
            "own": F.to_json(F.struct("lang", "source")), "wider": F.to_json(F.struct("lang")),
        }
    )
    made = cut(made)
    good = made.filter("NOT base_failed")
    large = cut(good.groupBy("own").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("own", F.lit(True).alias("own_large")))
    wide = good.join(large, "own", "left_anti").groupBy("wider").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("wider", F.lit(True).alias("wider_large"))
    grouped = made.join(large, "own", "left").join(cut(wide), "wider", "left").withColumn(
        "judged", F.when(F.col("own_large"), F.col("own")).when(F.col("wider_large"), F.concat(F.lit("rest of "), "wider")).otherwise(F.lit("rest"))
    )
    grouped = cut(grouped.drop("own", "wider", "own_large", "wider_large"))
    points = grouped.filter("NOT base_failed").select("judged", *(f"x{i}" for i in range(_DIM)))
    enough = points.groupBy("judged").agg(F.count("*").alias("n")).filter(F.col("n") >= FEWEST).select("judged")
    found = estimates(points.join(cut(enough), "judged", "left_semi"))
    judged = grouped.join(found, "judged", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    border = chi_square_quantile(CUTOFF, _DIM)
    return judged.select(
        "doc_id", "lang", "source", *_COUNTS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= border, F.lit(True))).alias("kept")
    )


def op9_outliers(spark, sf_dir: str) -> DataFrame:
    found = outliers(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
