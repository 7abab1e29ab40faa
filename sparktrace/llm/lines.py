"""Operator 4: drop lines that many documents share, by sharded minimal perfect hashing.

A text is split at \\n; a line's key is the line without ASCII white space at its ends, ASCII letters lower-cased. Keys that are
long enough and found in at least ``min_docs`` documents lose all their lines; the other lines stay, joined by \\n.

1. Every batch of documents counts, for each key's 128-bit hash, the documents that have it; the counts are summed by hash.
2. Hashes found in two documents or more are cut into shards. A shard is a minimal perfect hash (levels of bits: a hash whose
   bit no other shares is placed, the others go on to the next level) with two arrays by its numbers: 64-bit fingerprints, which
   tell hashes that are not in the shard, and document counts.
3. Documents send the hashes of their lines to the shards. A task reads a shard's arrays, then the probes as a stream, so it holds
   one shard whatever the number of probes. Only hits come back, by the documents' content.

Some keys may be in a large part of all documents. A hash counted in over 1/4096 of all (document, key) pairs belongs to one more
shard, of 4,096 hashes at most, that is sent to the documents instead, so no task gets all probes of a very common line.

Null or empty text: one empty line. Repeated rows are documents of their own (a text in ten rows is in ten documents) and get the
same result. Extra columns are kept. Ids are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrace.llm.common import ASCII_SPACE, fresh, pairs, table, text_key
from sparktrace.session import cut

MIN_DOCS = 10
MIN_CHARS = 1
COMMON = 4096
#: Hashes of one shard, about.
SHARD = 50_000
#: Probes of one shard, about: known from the counts.
PROBES = 200_000
GAMMA = 1.5
_STRIP = ASCII_SPACE.encode()


def hashes_of(text: str | None, min_chars: int) -> list[bytes]:
    """The 128-bit hash of every line's key; an empty one for keys that are too short."""
    keys = [line.strip(_STRIP).lower() for line in (text or "").encode().split(b"\n")]
    digest = xxhash.xxh3_128_digest
    if min_chars <= 1:
        return [digest(k) if len(k) >= min_chars else b"" for k in keys]
    return [digest(k) if len(k.decode()) >= min_chars else b"" for k in keys]


def _halves(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)


def _mixed(values: np.ndarray, level: int) -> np.ndarray:
    x = values.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit numbers with arrays of fingerprints and counts."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts = sizes, bits, prints, counts
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        set_bits = np.unpackbits(bits, count=int(self.starts[-1]), bitorder="little")
        self.set_bits, self.before = set_bits.astype(bool), np.cumsum(set_bits, dtype=np.int64) - set_bits

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> PerfectHash:
        """``keys`` distinct but for pairs (key, print) whose keys collide: those go on until their prints part them."""
        left, sizes, bits, order, level = np.arange(len(keys)), [], [], [], 0
        mix = keys.copy()
        while len(left):
            size = max(64, int(len(left) * GAMMA))
            at = (_mixed(mix[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            placed = alone[at]
            sizes.append(size)
            bits.append(alone)
            order.append(left[placed][np.argsort(at[placed])])
            left, level = left[~placed], level + 1
            if level == 8:  # equal keys never part; from here on the fingerprints take part
                mix = mix ^ prints
        order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        all_bits = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, dtype=np.uint8)
        return cls(np.array(sizes, dtype=np.int64), all_bits, prints[order], counts[order])

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each (key, print); 0 for those that are not there."""
        found, left, mix = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), keys
        for level, size in enumerate(self.sizes.tolist()):
            if level == 8:
                mix = keys ^ prints
            at = (_mixed(mix[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            placed = self.set_bits[at]
            number = self.before[at[placed]]
            found[left[placed]] = np.where(self.prints[number] == prints[left[placed]], self.counts[number], 0)
            left = left[~placed]
            if not len(left):
                break
        return found

    def to_row(self) -> tuple[bytes, ...]:
        return tuple(a.tobytes() for a in (self.sizes, self.bits, self.prints, self.counts))

    @classmethod
    def from_row(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes) -> PerfectHash:
        return cls(*(np.frombuffer(b, dtype=d) for b, d in ((sizes, "<i8"), (bits, np.uint8), (prints, "<i8"), (counts, "<i8"))))


_ARRAYS = ("sizes", "bits", "prints", "counts")


def _counted(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, print, n): documents of each key's hash, summed within batches first."""

    def run(batches):
        for batch in pairs(batches):
            found = [h for t in batch.column(0).to_pylist() for h in set(hashes_of(t, min_chars)) if h]
            distinct, n = np.unique(np.frombuffer(b"".join(found), dtype="S16"), return_counts=True) if found else (np.zeros(0, dtype="S16"), np.zeros(0, dtype=np.int64))
            halves = np.frombuffer(distinct.tobytes(), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(n)], names=["key", "print", "n"])

    return docs.mapInArrow(run, "key bigint, print bigint, n bigint").groupBy("key", "print").agg(F.sum("n").alias("n"))


def index(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, sizes, bits, prints, counts): one row per shard."""

    def build(group: pa.Table) -> pa.Table:
        made = PerfectHash.build(*(group.column(c).to_numpy() for c in ("key", "print", "n")))
        row = {"shard": pa.array([group.column("shard")[0].as_py()], pa.int64())}
        return pa.table(row | {k: pa.array([v], pa.binary()) for k, v in zip(_ARRAYS, made.to_row(), strict=True)})

    return (
        counts.withColumn("shard", F.expr(f"pmod(key, {shards})"))
        .groupBy("shard")
        .applyInArrow(build, "shard bigint, sizes binary, bits binary, prints binary, counts binary")
    )


def drop_common_lines(
    docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, n_lines: str = "n_lines", n_dropped: str = "n_dropped"
) -> DataFrame:
    """The rows with the kept text in place of the text, and the numbers of lines before and dropped."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    counts = cut(_counted(texts, min_chars).filter(F.col("n") >= min(2, min_docs)))
    total = counts.agg(F.count("*"), F.sum("n")).first()
    shards = max(1, -(-total[0] // SHARD), -(-(total[1] or 0) // PROBES))
    common_at = max(min_docs, (total[1] or 0) // COMMON + 1)
    # Counts of over 1/4096 of their sum: 4,096 rows at most.
    common = np.array(counts.filter(F.col("n") >= common_at).select("key", "print", "n").collect(), dtype=np.int64).reshape(-1, 3)
    shipped = docs.sparkSession.sparkContext.broadcast(PerfectHash.build(*(common[:, i].copy() for i in range(3))).to_row())
    arrays = cut(index(counts.filter(F.col("n") < common_at), shards))

    def probes(batches):
        shared = PerfectHash.from_row(*shipped.value)
        for batch in pairs(batches):
            keys, rows = batch.column(0).to_pylist(), [hashes_of(t, min_chars) for t in batch.column(1).to_pylist()]
            rows = [[h for h in set(r) if h] for r in rows]
            halves = _halves([h for r in rows for h in r])
            key, print_ = halves[:, 0].copy(), halves[:, 1].copy()
            rest = np.flatnonzero(shared.count(key, print_) == 0)
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[rest]), pa.array(print_[rest]), pa.array(keys, pa.binary()).take(pa.array(owner[rest]))], names=["key", "print", "doc"]
            )

    asked = (
        texts.select(text_key(F.col("text")).alias("doc"), "text")
        .mapInArrow(probes, "key bigint, print bigint, doc binary")
        .withColumn("shard", F.expr(f"pmod(key, {shards})"))
    )
    both = arrays.withColumns({"key": F.lit(0).cast("bigint"), "print": F.lit(0).cast("bigint"), "doc": F.lit(None).cast("binary")}).withColumn("probe", F.lit(False))
    both = both.unionByName(asked.withColumn("probe", F.lit(True)), allowMissingColumns=True)
    placed = both.repartition(max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "probe")

    def answer(batches):
        at, held = None, None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            borders = np.flatnonzero(np.diff(shard)) + 1
            for start, end in zip([0, *borders.tolist()], [*borders.tolist(), len(shard)], strict=True):
                part = batch.slice(start, end - start)
                if not part.column("probe")[0].as_py():
                    at, held = shard[start], PerfectHash.from_row(*(part.column(c)[0].as_py() for c in _ARRAYS))
                    part = part.slice(1)
                if at != shard[start] or not part.num_rows:  # a shard without arrays has no hits
                    continue
                hit = held.count(part.column("key").to_numpy(), part.column("print").to_numpy()) >= min_docs
                if hit.any():
                    yield part.select(["key", "print", "doc"]).filter(pa.array(hit))

    hits = (
        placed.select("shard", "probe", "key", "print", "doc", *_ARRAYS)
        .mapInArrow(answer, "key bigint, print bigint, doc binary")
        .groupBy("doc").agg(F.collect_set(F.struct("key", "print")).alias("hits"))
    )
    key, hit = fresh(docs, "doc_key", "line_hits")
    asked_docs = docs.withColumn(key, text_key(F.col(text).cast("string")))
    joined = asked_docs.join(hits.select(F.col("doc").alias(key), F.col("hits").alias(hit)), key, "left").select(*docs.columns, hit)
    schema = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == text else f.dataType, True) for f in docs.schema.fields]
        + [T.StructField(n_lines, T.LongType(), False), T.StructField(n_dropped, T.LongType(), False)]
    )

    names = docs.columns

    def keep(batches):
        shared = PerfectHash.from_row(*shipped.value)
        for batch in pairs(batches):
            kept, lines, dropped = [], [], []
            for t, found in zip(batch.column(text).to_pylist(), batch.column(hit).to_pylist(), strict=True):
                hashes = hashes_of(t, min_chars)
                some = [h for h in hashes if h]
                halves = _halves(some)
                gone = {h for h, n in zip(some, shared.count(halves[:, 0].copy(), halves[:, 1].copy()), strict=True) if n}
                gone |= {np.array([f["key"], f["print"]], dtype="<i8").tobytes() for f in found or ()}
                stay = [line for line, h in zip((t or "").split("\n"), hashes, strict=True) if not h or h not in gone]
                kept.append("\n".join(stay))
                lines.append(len(hashes))
                dropped.append(len(hashes) - len(stay))
            columns = [pa.array(kept, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[f.name for f in schema.fields])

    return joined.mapInArrow(keep, schema)


def op4_lines(spark, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key
GROUP BY doc_id
"""
