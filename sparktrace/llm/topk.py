"""Operator 7: exact maximum inner products by norm-sorted blocks, rotated partial sums and Cauchy-Schwarz bounds.

1. Components become ``floor(256 * x)``; scores are inner products of these integers.
2. Vectors are numbered by descending length and packed into blocks; queries are packed into blocks too.
3. The Gram matrix of all vectors (its side is the dimension) gives a rotation that puts most of the length into the first
   components. A block holds integers, rotated components and the lengths of what the rotated head leaves out.
4. The block of the longest vectors goes to all queries first and sets each query's threshold, its k-th best score so far.
5. A query block meets the other blocks, longest first, as far as its length times theirs reaches its threshold. In a meeting the
   products of the heads plus the products of the left-out lengths bound every score; only pairs whose bound reaches the threshold
   are multiplied in integers. Each meeting returns k rows a query at most.

The rotated sums only decide what is multiplied exactly, with a margin for rounding, so results are exact.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Shorter vectors count as filled
up with zeros; empty vectors have score 0. Rows that agree in id and vector count once. Tables without queries give no rows.
Ties go to the smaller id. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrace.llm.common import table
from sparktrace.session import cut

K = 5
SCALE = 256
BLOCK = 4096
QUERY_BLOCK = 512
HEAD = 0.3
EVERY = 50

_BLOCK = "block bigint, longest double, ids binary, vectors binary"


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in a global order: range partitions, numbered inside, shifted by the sizes of those before."""
    made = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    made = made.withColumns({"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = made.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    # One row per partition of the range shuffle.
    return made.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_pos")).drop("_at", "_part", "_pos", "_before")


def _packed(rows: DataFrame, index: str, size: int) -> DataFrame:
    """Blocks of consecutive rows: ids and integer vectors as bytes."""

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column(index).to_numpy(), kind="stable")
        ids = group.column("id").to_numpy()[order].astype("<i8")
        flat = group.column("vec").combine_chunks()
        vectors = np.asarray(flat.flatten()).reshape(len(ids), -1)[order].astype("<i8")
        longest = float(group.column("length").to_numpy().max())
        return pa.table({"block": group.column("block").slice(0, 1), "longest": [longest], "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())})

    return rows.withColumn("block", F.expr(f"{index} div {size}")).groupBy("block").applyInArrow(pack, _BLOCK)


def _read(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype="<i8")
    return ids, np.frombuffer(vectors, dtype="<i8").reshape(len(ids), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id)."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.lexsort((ids, -scores))[:k]


class Head:
    """Rotated heads and left-out lengths of vectors."""

    def __init__(self, rotation: np.ndarray, head: int):
        self.rotation, self.head = rotation, head

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = vectors.astype(np.float64) @ self.rotation
        return turned[:, : self.head], np.sqrt((turned[:, self.head :] ** 2).sum(axis=1))


def meet(queries, thresholds, candidates, head: Head, k: int) -> list[tuple[int, int, int]]:
    """(query position, candidate position, score): at least the k best of each query that reach its threshold."""
    (q_ids, q), (c_ids, c) = queries, candidates
    (q_head, q_rest), (c_head, c_rest) = head.of(q), head.of(c)
    margin = 1e-9 * (1 + np.linalg.norm(q.astype(np.float64), axis=1) * np.linalg.norm(c.astype(np.float64), axis=1).max(initial=0))
    out = []
    for i in range(len(q_ids)):
        bound = c_head @ q_head[i] + q_rest[i] * c_rest
        at = np.flatnonzero(bound >= thresholds[i] - margin[i])
        scores = c[at] @ q[i]
        own = (c_ids[at] == q_ids[i]) & (c[at] == q[i]).all(axis=1) if len(at) else np.zeros(0, dtype=bool)
        at, scores = at[~own & (scores >= thresholds[i])], scores[~own & (scores >= thresholds[i])]
        chosen = best(scores, c_ids[at], k)
        out += zip([i] * len(chosen), at[chosen].tolist(), scores[chosen].tolist())
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    valid = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & valid).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale)))
    rows = cut(rows.distinct())
    dim = rows.agg(F.max(F.size("vec"))).first()[0]
    if dim is None:
        return nothing
    dim = max(dim, 1)
    rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size("vec"))))
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("length", F.sqrt(squares))

    def gram(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    # dim * dim numbers for each task, summed before they go to the driver.
    sums = rows.select("vec").mapInArrow(gram, "i bigint, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    matrix = np.zeros((dim, dim))
    for r in sums.collect():
        matrix[r["i"], r["j"]] = r["x"]
    rotation = np.linalg.eigh(matrix)[1][:, ::-1].copy()
    head = Head(rotation, max(1, int(dim * HEAD)))

    longest_first = [F.desc("length"), F.asc("id"), F.asc("vec")]
    blocks = cut(_packed(_numbered(rows.drop("asks"), longest_first, "n"), "n", BLOCK))
    first = blocks.filter("block = 0").first()
    asked = _packed(_numbered(rows.filter("asks").drop("asks"), [F.asc("id"), F.asc("vec")], "n"), "n", QUERY_BLOCK)
    shipped = spark.sparkContext.broadcast((first["ids"], first["vectors"]))  # one block
    found = "query_block bigint, query_n int, query_id bigint, vec_id bigint, score bigint"

    def meet_first(batches):
        top = _read(*shipped.value)
        for batch in batches:
            for row in batch.to_pylist():
                queries = _read(row["ids"], row["vectors"])
                made = meet(queries, np.full(len(queries[0]), -np.inf), top, head, k)
                scores = [[] for _ in queries[0]]
                for i, _, score in made:
                    scores[i].append(score)
                thresholds = np.array([float(s[k - 1]) if len(s) >= k else -np.inf for s in scores])
                length = np.linalg.norm(queries[1].astype(np.float64), axis=1)
                # A negative or missing threshold, or a query of no length, can be reached by vectors of any length.
                need = float(np.where((thresholds > 0) & (length > 0), thresholds / np.maximum(length, 1e-300), 0).min())
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [row["block"]], "ids": pa.array([row["ids"]], pa.binary()), "vectors": pa.array([row["vectors"]], pa.binary()),
                        "thresholds": pa.array([thresholds.tobytes()], pa.binary()), "need": [need * (1 - 1e-9)],
                        "found": pa.array([[{"n": i, "query_id": int(queries[0][i]), "vec_id": int(top[0][j]), "score": s} for i, j, s in made]],
                                          pa.list_(pa.struct([("n", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))),
                    }
                )

    begun = cut(
        asked.mapInArrow(
            meet_first,
            "block bigint, ids binary, vectors binary, thresholds binary, need double, found array<struct<n int, query_id bigint, vec_id bigint, score bigint>>",
        )
    )
    # How far down the blocks each query block goes: block numbers only, the longest vector of each.
    reach = begun.select("block", "need").join(blocks.select(F.col("block").alias("other"), "longest"), F.col("longest") >= F.col("need")).filter("other > 0")
    meetings = reach.select("block", "other").join(begun.select("block", "ids", "vectors", "thresholds"), "block")
    to_meet = (
        blocks.filter("block > 0").select(F.col("block").alias("other"), F.lit(0).alias("asks"), F.lit(-1).cast("bigint").alias("block"), "ids", "vectors", F.lit(None).cast("binary").alias("thresholds"))
        .unionByName(meetings.select("other", F.lit(1).alias("asks"), "block", "ids", "vectors", "thresholds"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "other").sortWithinPartitions("other", "asks")
    )

    def meet_others(batches):
        at, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["asks"]:
                    at, held = row["other"], _read(row["ids"], row["vectors"])
                    continue
                assert at == row["other"]
                queries = _read(row["ids"], row["vectors"])
                made = meet(queries, np.frombuffer(row["thresholds"], dtype="<f8"), held, head, k)
                columns = list(zip(*((row["block"], i, int(queries[0][i]), int(held[0][j]), s) for i, j, s in made))) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_block", "query_n", "query_id", "vec_id", "score"])

    near = begun.select(F.col("block").alias("query_block"), F.explode("found").alias("f")).select("query_block", F.col("f.n").alias("query_n"), "f.query_id", "f.vec_id", "f.score")
    every = near.unionByName(to_meet.mapInArrow(meet_others, found))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_block", "query_n").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP7_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND (a.vec_id <> b.vec_id OR a.q <> b.q)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""
