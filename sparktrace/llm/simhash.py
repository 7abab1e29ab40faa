"""Operator 2: near duplicates by SimHash and multi-index hashing.

Fingerprint: ASCII letters lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words (repeats count; fewer words: the
whole sequence), XXH64 with seed 42; a bit is set if it is set in over half of the hashes. A text without words has fingerprint
zero and is linked like any other.

Links are pairs that differ in 2 bits or fewer. The 64 bits are two segments of 32. Either the upper halves differ in one bit at
most, or both bits are there and the lower halves are equal: so each fingerprint asks the table for the 33 values of the ball of
radius 1 around its upper half and for its own lower half, and complete distances are verified. Copies share one fingerprint and
are asked for once.

A segment value that more than ``HOT`` different fingerprints share would make all their pairs. Every fingerprint that asks for
such a value is put under the 65 keys of the ball of radius 1 around the whole fingerprint instead: two of them differ in 2 bits
or fewer exactly if they have a key in common. A key has 65 fingerprints at most, all linked, so one star joins them. Both ways
are exact, so no link is lost, and neither makes more than a fixed number of rows for each fingerprint.

Null text: no words. Null ids: such rows get a component like others; a component without any id has a null id. Repeated rows are
kept. Extra columns are not read by the query; ``fingerprints`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrace.llm.common import pairs, table
from sparktrace.llm.components import components
from sparktrace.session import cut

SHINGLE = 3
RADIUS = 2
HOT = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.array([h(join(g), 42) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """The rows without their text, with the fingerprint as a signed 64-bit number."""
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(name, T.LongType(), False)])

    def run(batches):
        for batch in pairs(batches):
            made = np.array([fingerprint(t, shingle) for t in batch.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(made)], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _flips(column: str, bits: int) -> list[str]:
    """SQL: the value and those that differ from it in one bit."""
    return [column, *(f"{column} ^ shiftleft(1L, {i})" for i in range(bits))]


def links(prints: DataFrame, name: str = "fingerprint", hot: int = HOT) -> DataFrame:
    """(a, b): pairs of different fingerprints that join exactly those within two bits of each other."""
    each = cut(prints.select(F.col(name).alias("p")).distinct())
    upper, lower = "shiftrightunsigned(p, 32)", "p & 4294967295"
    # Numbers of segment values: the upper half as it is, the lower half negative.
    entries = each.selectExpr("p", f"explode(array({upper}, -1 - ({lower}))) AS value")
    upper_ball = ", ".join(f"{upper} ^ {1 << i}L" for i in range(32))
    probes = each.selectExpr("p", f"explode(array({upper}, {upper_ball}, -1 - ({lower}))) AS value")
    sizes = entries.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = cut(sizes.filter(F.col("n") > hot).select("value"))
    quiet = entries.join(crowded, "value", "left_anti")
    near = (
        probes.join(quiet.withColumnRenamed("p", "q"), "value")
        .filter(f"p <> q AND bit_count(p ^ q) <= {RADIUS}")
        .selectExpr("greatest(p, q) AS a", "least(p, q) AS b")
    )
    balls = (
        probes.join(crowded, "value", "left_semi").select("p").distinct()
        .selectExpr("p", f"explode(array({', '.join(_flips('p', 64))})) AS key")
        .groupBy("key").agg(F.collect_list("p").alias("members"))  # 65 at most
        .filter("size(members) > 1")
        .selectExpr("explode(members) AS a", "array_min(members) AS b").filter("a <> b")
    )
    return near.unionByName(balls).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print, component_id) for every row; ``print`` is the signed fingerprint."""
    prints = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), name="print", shingle=shingle))
    roots = components(links(prints, "print"))
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    placed = cut(firsts.join(roots, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root")))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(ids, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
