"""Operator 12: ranked lexical search by K2-treaps over the term-document grid.

Terms are maximal runs of digits, letters A to Z (lower-cased) and characters beyond ASCII. The documents are dealt into shards of
consecutive rows; a shard's grid has a row for each term (frequent ones first), a column for each document (by id) and in a cell the
term's impact ``(10^9 tf) div (1000 tf + 20 m)``. The grid is kept as a K2-treap: a quadtree whose levels are one bit string (four bits a
cell, set where a quadrant is not empty), walked by rank, with the greatest impact below each cell, stored as its drop from the cell
above in as few bytes as the level needs. Rows stand ``2^SPREAD`` apart, so cells of that many documents hold one term each.

A query's state is a range of documents with the cells that the rows of its terms have there; its bound is the sum of weight times
greatest impact. The states with the highest bounds are opened together: each row path steps to the quadrants of its row, the range
halves, and paths whose quadrant is empty end. A range of one document has its exact score for a bound. Ranges that can't pass the
k-th best pair of score and id, over all shards of the task so far, are left. What a task keeps, k rows a query, meets in a ranking
over all tasks, so the rows are exact.

Bounds of memory: a shard has at most ``SHARD_DOCS`` documents and ``SHARD_POSTINGS`` cells (or one document). The vocabulary of the
items is sent to the tasks, so that other rows are not kept, while it has at most ``MAX_TERMS`` terms; beyond, the whole grid is kept.
Items are sent in blocks of ``BLOCK_TERMS`` terms (or one item), each block against all shards.

Null, empty and wordless texts are no documents and no queries. Null ids lose ties. Repeated rows are ranked each for itself, documents
and items alike. Empty tables give no rows. Extra columns are not read, so their names can't clash.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktrace.llm.common import folded_words, pairs, table
from sparktrace.session import cut, lookup

TOP = 50
SHARD_DOCS = 8192
SHARD_POSTINGS = 1_000_000
SPREAD = 6
#: Weighted terms of items that one search job sends to every task.
BLOCK_TERMS = 200_000
#: Terms that may be sent to the tasks that read the documents.
MAX_TERMS = 500_000
#: States opened together.
TOGETHER = 256

_LAST = np.iinfo(np.int64).max


# --- the treap of one shard ---------------------------------------------------------------------------------------------


def _interleaved(x: np.ndarray) -> np.ndarray:
    """The bits of 31-bit numbers, moved to the even places."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & mask
    return x


def build_treap(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, spread: int = SPREAD) -> tuple[int, bytes, list[bytes], list[int], int]:
    """(depth, bits, drops per level, cells per level, greatest impact) of a grid's distinct non-empty cells."""
    depth = max(1, int(rows.max(initial=0)).bit_length() + spread, int(cols.max(initial=0)).bit_length())
    codes = _interleaved(cols) | (_interleaved(rows.astype(np.int64) << spread) << 1)
    order = np.argsort(codes, kind="stable")
    codes, best = codes[order], impacts[order].astype(np.int64)
    bits, drops, counts = [], [], []
    for _ in range(depth):
        above = codes >> 2
        first = np.flatnonzero(np.diff(above, prepend=-1))
        parent = np.cumsum(np.diff(above, prepend=-1) != 0) - 1
        level = np.zeros(4 * len(first), dtype=np.uint8)
        level[4 * parent + (codes & 3)] = 1
        highest = np.maximum.reduceat(best, first) if len(first) else best
        drop = highest[parent] - best
        width = "<u1" if drop.max(initial=0) < 256 else "<u2" if drop.max() < 65_536 else "<u4"
        bits.append(level), drops.append(drop.astype(width).tobytes()), counts.append(len(codes))
        codes, best = above[first], highest
    flat = np.concatenate(bits[::-1])
    padded = np.zeros(-(-len(flat) // 64) * 64, dtype=np.uint8)
    padded[: len(flat)] = flat
    return depth, np.packbits(padded, bitorder="little").tobytes(), drops[::-1], counts[::-1], int(best[0]) if len(best) else 0


class Treap:
    """A treap that is walked: cell 0 is the whole grid, cell i the i-th set bit; its quadrants are the bits 4i to 4i + 3."""

    def __init__(self, depth: int, bits: bytes, drops: list[bytes], counts: list[int], greatest: int):
        self.depth = depth
        self.words = np.frombuffer(bits, dtype="<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)
        quadrants = np.bitwise_count(np.frombuffer(bits, dtype=np.uint8)[:, None] >> np.array([0, 4], dtype=np.uint8) & 15).ravel()
        best, at = [np.array([greatest], dtype=np.int64)], 0
        for drop, count in zip(drops, counts, strict=True):
            above = best[-1]
            down = np.frombuffer(drop, dtype=f"<u{max(1, len(drop) // max(1, count))}").astype(np.int64)
            best.append(np.repeat(above, quadrants[at : at + len(above)]) - down)
            at += len(above)
        self.best = np.concatenate(best)

    def halves(self, cells: np.ndarray, row_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each cell the quadrants of its row in the lower and the upper half of its documents; 0 where empty."""
        at = 4 * cells + 2 * row_bits
        word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
        here = (word >> bit).astype(np.int64)
        rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        lower, upper = here & 1, (here >> 1) & 1
        return lower * (rank + 1), upper * (rank + lower + 1)


def search(treap: Treap, ids: np.ndarray, rows: np.ndarray, weights: np.ndarray, k: int, floor: tuple[int, int] = (0, _LAST), spread: int = SPREAD, together: int = TOGETHER):
    """(score, id) of the documents that may be among the k best of one query, best first: above ``floor``, the k-th so far.

    ``ids`` ascend by column. The result has the k best of this shard that pass the floor.
    """
    rows = rows.astype(np.int64) << spread
    score, last = floor
    found_scores, found_ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # Open states: bound, level, first column, and their row paths (term, cell) as one slice of the two path arrays each.
    bound, level, column = np.array([int((weights * treap.best[0]).sum())]), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    start, size = np.zeros(1, dtype=np.int64), np.array([len(rows)])
    path_terms, path_cells, used = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64), len(rows)
    while True:
        passes = (bound > score) | ((bound == score) & (ids[np.minimum(column, len(ids) - 1)] < last)) if score else bound > 0
        if not passes.all():
            bound, level, column, start, size = (x[passes] for x in (bound, level, column, start, size))
        if not len(bound):
            break
        if len(bound) > together:
            # The highest bounds; among equal ones the smallest ids.
            edge = np.partition(bound, len(bound) - together)[len(bound) - together]
            sure, level_with = np.flatnonzero(bound > edge), np.flatnonzero(bound == edge)
            taken = np.concatenate([sure, level_with[np.argsort(column[level_with], kind="stable")[: together - len(sure)]]])
            rest = np.ones(len(bound), dtype=bool)
            rest[taken] = False
        else:
            taken, rest = np.arange(len(bound)), np.zeros(len(bound), dtype=bool)
        sizes = size[taken]
        of = np.repeat(np.arange(len(taken)), sizes)
        at = np.arange(len(of)) + (start[taken] - np.cumsum(sizes) + sizes)[of]
        term = path_terms[at]
        lower_levels = treap.depth - 1 - level[taken]
        row_bits = (rows[term] >> lower_levels[of]) & 1
        opened = [(bound[rest], level[rest], column[rest], start[rest], size[rest])]
        for half, cells in enumerate(treap.halves(path_cells[at], row_bits)):
            there = np.flatnonzero(cells)
            if not len(there):
                continue
            state, cell, own = of[there], cells[there], term[there]
            first = np.flatnonzero(np.diff(state, prepend=-1))
            sums = np.add.reduceat(weights[own] * treap.best[cell], first)
            state = state[first]
            below = lower_levels[state]
            columns = column[taken][state] + (half << below)
            leaf = below == 0
            if leaf.any():
                found_scores = np.concatenate([found_scores, sums[leaf]])
                found_ids = np.concatenate([found_ids, ids[columns[leaf]]])
            lengths = np.diff(first, append=len(there))
            inner = ~leaf & (sums >= max(1, score))
            if inner.any():
                need = used + len(there)
                if need > len(path_terms):
                    path_terms, path_cells = np.resize(path_terms, 2 * need), np.resize(path_cells, 2 * need)
                path_terms[used:need], path_cells[used:need] = own, cell
                opened.append((sums[inner], level[taken][state][inner] + 1, columns[inner], used + first[inner], lengths[inner]))
                used = need
        bound, level, column, start, size = (np.concatenate(x) for x in zip(*opened))
        if len(found_scores) >= k:
            order = np.lexsort((found_ids, -found_scores))[:k]
            found_scores, found_ids = found_scores[order], found_ids[order]
            if (found_scores[-1], -found_ids[-1]) > (score, -last):
                score, last = int(found_scores[-1]), int(found_ids[-1])
    order = np.lexsort((found_ids, -found_scores))[:k]
    return found_scores[order], found_ids[order]


# --- shards, index, search ----------------------------------------------------------------------------------------------

_POSTINGS = "ids array<bigint>, lengths array<bigint>, terms array<string>, dfs array<int>, `rows` binary, cols binary, tfs binary, n_docs bigint, n_terms bigint"
_INDEX = "ids array<bigint>, terms array<string>, depth int, bits binary, drops array<binary>, counts array<int>, greatest bigint"


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {
        "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
        "array<binary>": pa.list_(pa.binary()), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(),
    }
    fields = [part.strip().replace("`", "").split(" ") for part in schema.split(",")]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(name, kinds[kind]) for name, kind in fields]))


class _Shard:
    """Documents and cells of a shard that is being filled."""

    def __init__(self, wanted: dict[bytes, int] | None):
        self.wanted, self.known = wanted, {}
        self.ids, self.lengths, self.n_docs, self.n_terms = [], [], 0, 0
        self.row, self.col, self.tf = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        if not words:
            return
        self.n_docs, self.n_terms = self.n_docs + 1, self.n_terms + len(words)
        found, known = Counter(words), self.known
        if self.wanted is not None:
            found = {w: n for w, n in found.items() if w in self.wanted}
        if not found:
            return
        for word in found:
            if word not in known:
                known[word] = len(known)
        self.row.extend([known[w] for w in found])
        self.col.extend([len(self.ids)] * len(found))
        self.tf.extend(found.values())
        self.ids.append(doc_id), self.lengths.append(len(words))

    def done(self) -> dict:
        """Rows by falling frequency, columns by rising id."""
        row, col, tf = (np.frombuffer(x, dtype=np.int32) if x else np.zeros(0, dtype=np.int32) for x in (self.row, self.col, self.tf))
        words, ids = list(self.known), self.ids
        dfs = np.bincount(row, minlength=len(words))
        by_df = np.argsort(-dfs, kind="stable")
        place = np.empty(len(words), dtype=np.int32)
        place[by_df] = np.arange(len(words), dtype=np.int32)
        by_id = np.argsort(np.array([_LAST if i is None else i for i in ids], dtype=np.int64), kind="stable")
        seat = np.empty(len(ids), dtype=np.int32)
        seat[by_id] = np.arange(len(ids), dtype=np.int32)
        return {
            "ids": [ids[i] for i in by_id], "lengths": [self.lengths[i] for i in by_id], "terms": [words[i].decode() for i in by_df],
            "dfs": dfs[by_df].tolist(), "rows": place[row].tobytes(), "cols": seat[col].tobytes(), "tfs": tf.tobytes(),
            "n_docs": self.n_docs, "n_terms": self.n_terms,
        }


def postings(docs: DataFrame, wanted: list[str] | None = None, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row per shard of (doc_id, text): its documents, terms and cells; of ``wanted`` terms only, if given."""
    context = docs.sparkSession.sparkContext
    sent = None if wanted is None else context.broadcast({w.encode(): 0 for w in wanted})

    def run(batches: Iterator[pa.RecordBatch]):
        only = None if sent is None else sent.value
        shard = _Shard(only)
        for batch in pairs(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, folded_words(text))
                if shard.n_docs >= shard_docs or len(shard.row) >= shard_postings:
                    yield _batch(_POSTINGS, [shard.done()])
                    shard = _Shard(only)
        if shard.n_docs:
            yield _batch(_POSTINGS, [shard.done()])

    return docs.mapInArrow(run, _POSTINGS)


def build_index(shards: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The treaps of shards, with impacts from the numbers of documents and terms of the whole table."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if not row["ids"]:
                    continue
                lengths, cols, tf = np.array(row["lengths"], dtype=np.int64), np.frombuffer(row["cols"], dtype=np.int32), np.frombuffer(row["tfs"], dtype=np.int32).astype(np.int64)
                m = 100 - 50 + (50 * lengths * n_docs) // n_terms
                impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[cols])
                depth, bits, drops, counts, greatest = build_treap(np.frombuffer(row["rows"], dtype=np.int32), cols, impacts)
                yield _batch(_INDEX, [{"ids": row["ids"], "terms": row["terms"], "depth": depth, "bits": bits, "drops": drops, "counts": counts, "greatest": greatest}])

    return shards.mapInArrow(run, _INDEX)


def _found(index: DataFrame, block: list[tuple[int, list[tuple[str, int]]]], k: int) -> DataFrame:
    """(item, doc_id, score): what each task keeps for the items of a block."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                treap = Treap(row["depth"], row["bits"], row["drops"], row["counts"], row["greatest"])
                ids = np.array([_LAST if i is None else i for i in row["ids"]], dtype=np.int64)
                place = {term: i for i, term in enumerate(row["terms"])}
                for item, weighted in sent.value:
                    here = [(place[term], weight) for term, weight in weighted if term in place]
                    if not here:
                        continue
                    kept = best.get(item, [])
                    floor = (-kept[-1][0], kept[-1][1]) if len(kept) == k else (0, _LAST)
                    rows, weights = np.array(here, dtype=np.int64).T
                    scores, docs = search(treap, ids, rows, np.ascontiguousarray(weights), k, floor)
                    best[item] = sorted([*kept, *zip((-scores).tolist(), docs.tolist(), strict=True)])[:k]
        for item, kept in best.items():
            yield pa.RecordBatch.from_pydict({
                "item": pa.array([item] * len(kept), pa.int64()),
                "doc_id": pa.array([None if d == _LAST else d for _, d in kept], pa.int64()),
                "score": pa.array([-s for s, _ in kept], pa.int64()),
            })

    return index.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    block, held = [], 0
    for row in rows:
        if block and held + len(row["weighted"]) > size:
            yield block
            block, held = [], 0
        block.append((row["item"], [(t["term"], t["weight"]) for t in row["weighted"]]))
        held += len(row["weighted"])
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
         max_terms: int = MAX_TERMS, block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents with a score above 0 of every item."""

    def split(batches):
        for batch in pairs(batches):
            listed = [sorted({w.decode() for w in folded_words(t)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed, pa.list_(pa.string()))], names=["item_id", "terms"])

    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string"))
    kind = asked.schema[0].dataType.simpleString()
    # Numbers of items are fixed by writing them.
    asked = cut(cut(asked.mapInArrow(split, f"item_id {kind}, terms array<string>")).withColumn("item", F.monotonically_increasing_id()))
    vocabulary = cut(asked.select(F.explode("terms").alias("term")).distinct())
    size = vocabulary.count()
    wanted = [row[0] for row in vocabulary.collect()] if size <= max_terms else None
    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    shards = cut(postings(rows, wanted, shard_docs, shard_postings))
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    index = cut(build_index(shards, n_docs, n_terms))
    # Documents per term: shards send one number for each of their terms that an item has.
    counts = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    frequent = lookup(counts, vocabulary, "term", size, "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("bigint")
    weighted = cut(
        asked.select("item", F.explode("terms").alias("term")).join(frequent.select("term", weight.alias("weight")).filter("weight > 0"), "term")
        .groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("weighted"))
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    made = None
    for block in _blocks(weighted.toLocalIterator(), block_terms):
        best = cut(_found(index, block, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        made = best if made is None else made.unionByName(best)
    if made is None:
        made = docs.sparkSession.createDataFrame([], "item bigint, doc_id bigint, score bigint, rank int")
    return made.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_treap(spark, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Terms, statistics and scores by plain joins.
OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), docs AS (SELECT r, doc_id, len(ws) AS n, ws FROM words WHERE len(ws) > 0),
stats AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
tfs AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS t FROM docs) GROUP BY r, doc_id, n, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, stats GROUP BY t, nd),
asked AS (
  SELECT DISTINCT i, item_id, t FROM (
    SELECT row_number() OVER () AS i, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark)
), scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // l))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN tfs USING (t), stats GROUP BY i, item_id, r, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
