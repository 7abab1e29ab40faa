"""Operator 1: quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of order 4 over the characters themselves: every code point is a symbol of its own and the alphabet is open (orders
end in 1 / ``POINTS`` for each). All trusted text is counted: tasks sum their own n-grams, sums are added by n-gram. Continuation counts,
contexts and the three discounts of each order come from these counts by grouping and joining on context and suffix, sharded by key,
and give one probability for each seen n-gram and one back-off weight for each seen context.

Documents meet the shards by joins: rows are grouped as they lie by bytes, a group asks once for each of its different n-grams, each
different n-gram of all groups is looked up once, order by order, and the answers go back to the groups that asked. Documents are written
once as a table bucketed by group (as in op8), so the answers meet them without a shuffle of text, and no table of the model is held by a
task or the driver.

``fit``, ``score`` and ``dense`` are the model over 48 classes of characters, bounded by 48**4 n-grams, for callers who want a table
to broadcast; ``judge`` does not use them.

A document's perplexity is exp of the mean negative log probability of its characters. It is kept if its log perplexity is
above the median of its language's trusted documents by ``SPREAD`` times the distance of their 95 % quantile at most (short clean
texts vary more than most, so the border is well beyond the quantile itself). Languages with fewer than ``LEAST`` trusted documents take the quantiles of all trusted ones.

Null and empty texts have no perplexity and are not kept. Without trusted text nothing has a perplexity and all else is kept.
Null languages are a group of their own. Repeated rows count each, whole texts are read whatever their length; extra columns are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrace.llm.common import fresh, pairs, table, tasks_for
from sparktrace.session import cut

ORDER = 4
CLASSES = 48
SPREAD = 8.0
LEAST = 30
#: Ids of trusted documents that may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Code points of Unicode, bytes of one in a key (raised by one; 0 stands before a text), bytes of text in a group of documents.
POINTS = 0x110000
POINT_BYTES = 3
GROUP_BYTES = 8_000_000
BUCKET_BYTES = 32_000_000
#: Pairs of pairs that are told apart by a table of this size; more by sorting.
TABLE = 1 << 25


def _classes() -> np.ndarray:
    """Class of each ASCII character. 0 stands before a text."""
    of = np.full(128, 42)
    of[[9, 10, 11, 12, 13]] = 2
    of[32] = 1
    of[97:123] = 3 + np.arange(26)
    of[65:91] = 29
    of[48:58] = 30
    for k, marks in enumerate((".", ",", "!", "?", "'\"-;:()", "#", "*", "$", "%", "&", "|")):
        of[[ord(c) for c in marks]] = 31 + k
    return of


_ASCII = _classes()


def symbols(text: str) -> np.ndarray:
    """Classes of the characters: letters beyond ASCII by code point modulo 4, capitals and other characters as such."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = _ASCII[np.minimum(points, 127)]
    beyond = np.flatnonzero(points > 127)
    if len(beyond):
        some, back = np.unique(points[beyond], return_inverse=True)
        kinds = [29 if chr(p).isupper() else 44 + p % 4 if chr(p).isalpha() else 43 for p in some.tolist()]
        found[beyond] = np.array(kinds)[back]
    return found


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram numbers of every character of the texts, and the texts' sizes."""
    found = [np.concatenate([np.zeros(ORDER - 1, dtype=np.int64), symbols(t)]) for t in texts]
    sizes = np.array([len(f) for f in found], dtype=np.int64) - ORDER + 1
    if not len(found):
        return np.zeros(0, dtype=np.int64), sizes
    joined = np.concatenate(found)
    code = joined[: len(joined) - ORDER + 1].copy()
    for i in range(1, ORDER):
        code = code * CLASSES + joined[i : len(joined) - ORDER + 1 + i]
    ends = np.cumsum(sizes + ORDER - 1)
    inside = np.ones(len(joined), dtype=bool)
    for back in range(1, ORDER):
        inside[ends - back] = False
    return code[inside[: len(code)]], sizes


def counted(texts: DataFrame) -> DataFrame:
    """(code, n): n-grams of the trusted text, summed in each task first."""

    def run(batches):
        total = np.zeros(CLASSES**ORDER, dtype=np.int64)
        for batch in pairs(batches, chars=4_000_000):
            code, _ = codes([t for t in batch.column(0).to_pylist() if t])
            total += np.bincount(code, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    return texts.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def class_context(order: int) -> Column:
    return F.expr(f"code div {CLASSES}")


def class_suffix(order: int) -> Column:
    return F.col("code") % CLASSES ** (order - 1)


def point_context(order: int) -> Column:
    return F.substring("code", 1, POINT_BYTES * (order - 1))


def point_suffix(order: int) -> Column:
    return F.substring("code", POINT_BYTES + 1, POINT_BYTES * (order - 1))


def probabilities(
    counts: DataFrame, context: Callable[[int], Column] = class_context, suffix: Callable[[int], Column] = class_suffix, size: int = CLASSES
) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 up: (code, p) of the seen n-grams and (context, weight) of the back-off.

    ``context`` and ``suffix`` give the code of an n-gram of an order without its last or first symbol, ``size`` is that of the alphabet.
    """
    levels = [counts]
    for order in range(ORDER, 1, -1):  # continuation counts: different letters before the n-gram
        longer = levels[0]
        levels.insert(0, cut(longer.groupBy(suffix(order).alias("code")).agg(F.count("*").alias("n"))))
    lower, out = None, []
    for order, level in enumerate(levels, 1):
        row = level.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
        n1, n2, n3, n4 = (float(x) for x in row)
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        steps = (n2 / n1 if n1 else 0, n3 / n2 if n2 else 0, n4 / n3 if n3 else 0)
        d = [min(max((k + 1) - (k + 2) * y * r, 0.1), k + 0.9) for k, r in enumerate(steps)]  # small corpora give odd discounts
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        level = level.withColumns({"context": context(order), "suffix": suffix(order)})
        contexts = level.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("weight"))
        joined = level.join(contexts, "context").withColumn("own", (F.col("n") - discount) / F.col("total"))
        below = joined.withColumn("lower", F.lit(1.0 / size)) if lower is None else joined.join(lower.select(F.col("code").alias("suffix"), F.col("p").alias("lower")), "suffix")
        lower = cut(below.select("code", (F.col("own") + F.col("weight") * F.col("lower")).alias("p")))
        out.append((lower, cut(contexts.select("context", "weight"))))
    return out


def dense(tables: list[tuple[tuple, tuple]]) -> np.ndarray:
    """Log probability of every n-gram, seen or not, from the seen ones and the back-off weights."""
    p = np.full(1, 1.0 / CLASSES)
    for order, ((code, seen), (context, weight)) in enumerate(tables, 1):
        back = np.ones(CLASSES ** (order - 1))
        back[context] = weight
        below = np.full((1, CLASSES), p[0]) if order == 1 else p.reshape(-1, CLASSES)
        # The lower order's context is this one's without its first letter.
        p = (back.reshape(-1, len(below), 1) * below[None]).reshape(-1)
        p[code] = seen
    return np.log(p).astype(np.float32)


def fit(trusted: DataFrame, text: str = "text") -> list | None:
    """The model: for each order numbers and probabilities, contexts and weights. At most 48**4 numbers in all orders' tables."""
    counts = cut(counted(trusted.select(F.col(text).cast("string").alias("text"))))
    if not counts.head(1):
        return None

    def columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        made = df.toArrow()
        return made.column(0).to_numpy(), made.column(1).to_numpy()

    return [(columns(seen), columns(back)) for seen, back in probabilities(counts)]


def score(docs: DataFrame, model: list | None, text: str = "text", name: str = "perplexity") -> DataFrame:
    """The rows without their text, with the perplexity."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType(), True)])

    def run(batches):
        logs = dense(shipped.value) if shipped.value else None
        for batch in pairs(batches, chars=4_000_000):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            if logs is None:
                made = pa.nulls(len(texts), pa.float64())
            else:
                code, sizes = codes(texts)
                sums = np.add.reduceat(np.append(logs[code].astype(np.float64), 0), np.minimum(np.cumsum(sizes) - sizes, len(code))) if len(texts) else np.zeros(0)
                made = pa.array(np.exp(-sums / np.maximum(sizes, 1)), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), made], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _numbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes (below ``size``) in order, and each code's number among them."""
    if size > TABLE:
        return np.unique(codes, return_inverse=True)
    at = np.zeros(size, dtype=np.int32)
    at[codes] = 1
    some = np.flatnonzero(at)
    at[some] = np.arange(len(some))
    return some, at[codes]


def point_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the different n-grams of characters in order (one row of bytes each), the number of every character's n-gram among
    them, and the texts' sizes. A character's n-gram ends with it."""
    parts = [np.frombuffer(("\x00" * (ORDER - 1) + t).encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    if not sizes.sum() > len(sizes) * (ORDER - 1):
        return np.zeros((0, ORDER * POINT_BYTES), dtype=np.uint8), np.zeros(0, dtype=np.int64), sizes - (ORDER - 1)
    points = np.concatenate(parts) + np.uint32(1)
    ends = np.cumsum(sizes)
    first = (ends - sizes)[:, None] + np.arange(ORDER - 1)
    points[first.ravel()] = 0
    used, symbol = _numbered(points, POINTS + 1)
    pairs_seen, pair = _numbered(symbol[:-1].astype(np.int64) * len(used) + symbol[1:], len(used) ** 2)
    inside = np.ones(len(points), dtype=bool)
    inside[first.ravel()] = False
    last = np.flatnonzero(inside)
    seen, number = _numbered(pair[last - 3].astype(np.int64) * len(pairs_seen) + pair[last - 1], len(pairs_seen) ** 2)
    key = np.stack([pairs_seen[seen // len(pairs_seen)], pairs_seen[seen % len(pairs_seen)]], axis=1)
    key = used[np.stack([key // len(used), key % len(used)], axis=2)].reshape(-1, ORDER)
    spelt = np.stack([key >> 16, key >> 8, key], axis=2).astype(np.uint8)
    return spelt.reshape(-1, ORDER * POINT_BYTES), number, sizes - (ORDER - 1)


def _binary(keys: np.ndarray) -> pa.Array:
    fixed = pa.Array.from_buffers(pa.binary(keys.shape[1]), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))])
    return fixed.cast(pa.binary())


def counted_points(texts: DataFrame) -> DataFrame:
    """(code, n): n-grams of characters of the trusted text, summed in each task first."""

    def run(batches):
        for batch in pairs(batches, texts=1 << 20, chars=GROUP_BYTES):
            keys, number, _ = point_grams([t for t in batch.column(0).to_pylist() if t])
            yield pa.RecordBatch.from_arrays([_binary(keys), pa.array(np.bincount(number, minlength=len(keys)))], names=["code", "n"])

    return texts.mapInArrow(run, "code binary, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def grouped(docs: DataFrame, text: str, group: str, asks: str) -> DataFrame:
    """The rows with the number of their group, and in its first row the keys of all its n-grams, as a table bucketed by group.
    Rows are grouped as they lie, by bytes, so they are written without a shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(group, T.LongType()), T.StructField(asks, T.BinaryType())])
    at = docs.columns.index(text)

    def run(batches):
        held, size, made = [], 0, TaskContext.get().partitionId() << 32

        def closed():
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = point_grams([t or "" for t in rows.column(at).to_pylist()])[0].tobytes()
            added = [pa.array(np.full(rows.num_rows, made)), pa.array([keys, *[None] * (rows.num_rows - 1)], pa.binary())]
            return pa.Table.from_arrays([*rows.columns, *added], names=schema.names).to_batches()

        for batch in pairs(batches, texts=256, chars=GROUP_BYTES // 4):
            held.append(batch)
            size += batch.get_total_buffer_size() if batch.num_rows == 1 else batch.nbytes
            if size >= GROUP_BYTES:
                yield from closed()
                held, size, made = [], 0, made + 1
        if size:
            yield from closed()

    spark = docs.sparkSession
    buckets = tasks_for(docs, F.octet_length(text), BUCKET_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"documents_{uuid.uuid4().hex}"
    docs.mapInArrow(run, schema).write.format("parquet").option("compression", "zstd").bucketBy(min(buckets, 10_000), group).saveAsTable(name)
    return spark.table(name)


def looked_up(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(code, log): the log probability of each different n-gram, seen or not, by joins with the shards of every order."""
    found = asked.select("code").distinct().withColumn("gram", F.col("code"))
    value, share = F.lit(None).cast("double"), F.lit(1.0)
    for order in range(ORDER, 0, -1):
        seen, back = model[order - 1]
        rest = F.expr(f"substring(gram, {POINT_BYTES * (ORDER - order) + 1}, {POINT_BYTES * order})")
        found = found.withColumns({"_rest": rest, "_before": F.expr(f"substring(gram, {POINT_BYTES * (ORDER - order) + 1}, {POINT_BYTES * (order - 1)})")})
        found = found.join(seen.select(F.col("code").alias("_rest"), F.col("p").alias(f"p{order}")), "_rest", "left")
        found = found.join(back.select(F.col("context").alias("_before"), F.col("weight").alias(f"w{order}")), "_before", "left").drop("_rest", "_before")
        # The longest part that was seen has the probability; what is longer gives its back-off weight.
        value = F.coalesce(value, share * F.col(f"p{order}"))
        share = share * F.coalesce(f"w{order}", F.lit(1.0))
    return found.select("code", F.log(F.coalesce(value, share * F.lit(1.0 / POINTS))).alias("log"))


def perplexities(docs: DataFrame, trusted: str, text: str = "text", name: str = "perplexity") -> DataFrame:
    """The rows without their text, with the perplexity under the model of the rows whose column ``trusted`` is true."""
    group, asks = fresh(docs, "_group", "_asks")
    rows = grouped(docs.withColumn(text, F.col(text).cast("string")), text, group, asks)
    counts = cut(counted_points(rows.filter(F.col(trusted)).select(text)))
    if counts.isEmpty():
        return rows.drop(text, group, asks).withColumn(name, F.lit(None).cast("double"))
    width = ORDER * POINT_BYTES

    def spelt(batches):
        for batch in batches:
            for number, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(keys) // width
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), _binary(np.frombuffer(keys, dtype=np.uint8).reshape(n, width))], names=["of", "at", "code"])

    asked = rows.select(group, asks).filter(F.col(asks).isNotNull()).mapInArrow(spelt, "of bigint, at int, code binary")
    answers = asked.join(looked_up(asked, probabilities(counts, point_context, point_suffix, POINTS)), "code").select("of", "at", "log")
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType(), True)])

    def rate(rows: pa.Table, told: pa.Table) -> pa.Table:
        _, number, sizes = point_grams([t or "" for t in rows.column(text).to_pylist()])
        logs = np.zeros(told.num_rows)
        logs[told.column("at").to_numpy()] = told.column("log").to_numpy()
        sums = np.add.reduceat(np.append(logs[number], 0), np.minimum(np.cumsum(sizes) - sizes, len(number))) if len(sizes) else np.zeros(0)
        made = pa.array(np.exp(-sums / np.maximum(sizes, 1)), mask=sizes == 0)
        return pa.table([*(rows.column(f.name) for f in kept), made], names=schema.names)

    return rows.drop(asks).groupBy(group).cogroup(answers.groupBy("of")).applyInArrow(rate, schema)


def mark_trusted(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", name: str = "trusted") -> DataFrame:
    ids = cut(trusted_ids.select(doc_id).filter(F.col(doc_id).isNotNull()).distinct()).withColumn(name, F.lit(True))
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, doc_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def judge(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", spread: float = SPREAD) -> DataFrame:
    """The rows without their text, with trusted, perplexity and kept (underscores in front of names that are taken)."""
    trusted, perplexity, kept, log, of, border = fresh(docs.drop(text), "trusted", "perplexity", "kept", "_log", "_lang", "_border")
    marked = mark_trusted(docs, trusted_ids, doc_id, trusted)
    scored = cut(perplexities(marked, trusted, text, perplexity)).withColumn(log, F.log(perplexity)).withColumn(of, F.to_json(F.struct(F.col(lang).alias("l"))))
    good = scored.filter(F.col(trusted) & F.col(log).isNotNull())
    middle, high = (F.percentile_approx(log, q, 10_000) for q in (0.5, 0.95))
    highest = middle + spread * (high - middle)
    own = good.groupBy(of).agg(highest.alias(border), F.count("*").alias("n")).filter(F.col("n") >= LEAST).drop("n")
    every = good.agg(highest.alias("border")).first()
    judged = scored.join(own, of, "left")
    learned = every["border"] is not None
    inside = F.col(log) <= F.coalesce(border, F.lit(every["border"])) if learned else F.lit(True)
    has_text = F.col(log).isNotNull() if learned else F.lit(True)
    return judged.select(*scored.drop(log, of).columns, F.coalesce(inside & has_text, F.lit(False)).alias(kept))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, trusted)
