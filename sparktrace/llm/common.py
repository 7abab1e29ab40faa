"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Digits, letters (A to Z lower-cased) and bytes of characters beyond ASCII; all others become blanks.
_FOLDED = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def folded_words(text: str | None) -> list[bytes]:
    """UTF-8 of the maximal runs of digits, letters and characters beyond ASCII, only A to Z lower-cased."""
    return (text or "").encode().translate(_FOLDED).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores in front until no column of ``df`` has it (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def pairs(batches: Iterator[pa.RecordBatch], texts: int = 2048, chars: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of each Arrow batch of at most ``texts`` rows, so that Python holds few texts at a time."""
    for batch in batches:
        step = max(1, min(texts, int(batch.num_rows * chars / max(1, batch.nbytes)) or 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def text_key(*parts: Column) -> Column:
    """128-bit key of the parts' content; null parts differ from empty ones."""
    said = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.unhex(F.md5(F.concat_ws("\x00", *said)))


def tasks_for(df: DataFrame, weight: Column, per_task: int, least: int = 1) -> int:
    """Number of groups such that each holds about ``per_task`` of the total weight: one number goes to the driver."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    return max(least, -(-int(total) // per_task))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a per-batch function that each task makes once (tables and caches live in the task)."""

    def run(batches):
        apply = make()
        for batch in pairs(batches):
            yield apply(batch)

    return df.mapInArrow(run, schema)


class Remembered(dict):
    """Results of a function of a string, for strings of up to 64 characters.

    Two generations: when the young one is full it becomes the old one, and what is asked again moves back, so frequent strings
    stay and memory is bounded.
    """

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, text: str) -> bytes:
        made = self.old.get(text)
        if made is None:
            made = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[text] = made
        return made
