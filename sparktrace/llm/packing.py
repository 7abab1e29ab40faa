"""Operator 3: best-fit packing of token sequences by hierarchical residual packing.

Every partition of the documents packs its own pieces by best-fit decreasing and emits its nearly full bins around a piece of over half
the capacity. All others are opened again and go up: also full ones of smaller pieces, which another partition's gaps may need. On the way they are merged as counts per length, which are at most ``capacity`` numbers however many pieces there
are, so the tree needs no cap and its levels are the partial sums of one aggregation. Its root runs best-fit decreasing on the counts,
exactly as on the single pieces: a step puts a range of equal pieces into a range of bins of equal free space. Pieces find their place
by their length and their number among those of that length (partitions' counts summed up, then the place in the partition). So
underfull bins of all partitions fill each other, and what the driver holds is bounded by the capacity.

Null and empty texts are documents of one token (the end token). A document over the capacity gives full pieces and a last shorter
one. Repeated rows are packed each for itself. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktrace.llm.common import Remembered, pairs, table
from sparktrace.session import cut

CAPACITY = 4096
END = 1
#: A bin that lacks less than this part of the capacity is nearly full.
NEARLY = 1 / 256
REMEMBERED = 200_000
MARKS = {".", ",", ";", ":", "!", "?"}

#: A mark that ends a part, after a letter (but the one whose lower case ends with a combining sign) or number.
_LAST_MARK = re.compile(r"(?<=[^\W_\u0130])([.,;:!?])(?= |$)")

#: Letters of the first 256 characters in lower case.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
#: Words of letters that no normalisation changes, which are one piece.
_WORD = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on, in order.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = dict(zip(sorted(set(range(256)) - _PRINTED), range(0x100, 0x200)))

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordIds(Remembered):
    """Ids of the white-space-separated parts of a text, as little-endian 32-bit integers.

    The vocabulary drops white space and the case of letters, and no token reaches over white space or from a letter to a mark, so
    parts are encoded each for itself, without a mark at their end, and the ids of frequent ones are remembered.
    """

    def __init__(self, path: str, size: int = REMEMBERED):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model = tokenizer.model

        def ids(part: str) -> bytes:
            if _WORD.fullmatch(part):  # nothing to normalise or to cut: the model alone gives the same ids
                found = model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS))
                return array("I", [token.id for token in found]).tobytes()
            return array("I", tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

        super().__init__(ids, size)

    def __missing__(self, part: str) -> bytes:
        # What stands before the mark counts as the vocabulary sees it, in lower case: that of a letter may end with a combining sign.
        if part[-1:] in MARKS and part[-2:-1].lower()[-1:].isalnum():
            return self[part[:-1]] + self[part[-1]]
        if part.isascii() and part.isalpha() and not part.islower():
            return self[part.lower()]
        return super().__missing__(part)

    def encode(self, text: str) -> bytes:
        # Letters may be lower-cased early where the vocabulary's composition of characters has nothing to do before and after.
        try:
            lowered = text.encode("latin-1").translate(_LOWER).decode("latin-1")  # characters up to U+00FF are never composed
        except UnicodeEncodeError:
            lowered = text.encode().lower().decode()
            if not (is_normalized("NFC", text) and is_normalized("NFC", lowered)):
                lowered = None
        if lowered is not None:
            text = _LAST_MARK.sub(r" \1", lowered.replace("\n", " "))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin and its offset there; for each bin its fill.

    Open bins are kept by free space, at most one list for each of the ``capacity`` values.
    """
    bins, offsets, fill = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), []
    open_bins: dict[int, list[int]] = {}
    frees: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(frees, size)
        if at == len(frees):
            chosen, free = len(fill), capacity
            fill.append(0)
        else:
            free = frees[at]
            chosen = open_bins[free].pop()
            if not open_bins[free]:
                del open_bins[free], frees[at]
        bins[i], offsets[i] = chosen, fill[chosen]
        fill[chosen] += size
        left = free - size
        if left:
            if left not in open_bins:
                open_bins[left] = []
                insort(frees, left)
            open_bins[left].append(chosen)
    return bins, offsets, np.array(fill, dtype=np.int64)


def best_fit_counts(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing of so many items of each length, as steps: columns length, first item, items, items a bin, first bin, offset.

    Item ``first + j`` of a step is in bin ``first bin + j div (items a bin)``. A bin takes items of one length until the next doesn't
    fit, since it is then the one with the least space that does; so equal bins fill up range by range.
    """
    steps, free_bins, frees, bins = [], {}, [], 0

    def keep(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in free_bins:
                free_bins[free] = []
                insort(frees, free)
            free_bins[free].append((first, n))

    for size in sorted(counts, reverse=True):
        at, left = 0, counts[size]
        while left:
            place = bisect_left(frees, size)
            if place < len(frees):
                free = frees[place]
                first, n = free_bins[free].pop()
                if not free_bins[free]:
                    del free_bins[free], frees[place]
            else:
                free, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            each = min(free // size, left)
            some = min(n, left // each)
            steps.append((size, at, some * each, each, first, capacity - free))
            keep(free - each * size, first, some)
            if free < capacity:
                keep(free, first + some, n - some)
            elif some < n:  # the last new bin takes what is left
                bins -= n - some
            at, left = at + some * each, left - some * each
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END):
    """A function from Arrow batches to the pieces of their documents: lists of doc_id, piece, start, length, checksum."""
    docs.sparkSession.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rpartition("/")[2]

    def pieces(batches):
        words, last = _words(SparkFiles.get(name)), np.array([end], dtype="<u4").tobytes()
        for batch in pairs(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(text or "") + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    yield doc, k, k * capacity, len(part) // 4, zlib.crc32(part)

    return pieces


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenized(docs, tokenizer_path, capacity, end)

    def leaf(batches):
        rows = list(zip(*pieces(batches)))
        if not rows:
            return
        node = TaskContext.get().partitionId()
        docs, piece, start, length, crc = rows
        length = np.array(length)
        bins, offsets, fill = best_fit(length, capacity)
        # A piece of over half the capacity is the first of its bin. Bins of smaller pieces only go up too, full or not: other
        # partitions may have gaps for them.
        large = np.zeros(len(fill), dtype=bool)
        large[bins[2 * length > capacity]] = True
        up = ((fill <= capacity * (1 - NEARLY)) | ~large)[bins]
        # The number of a piece among those of its length that go up.
        going = np.flatnonzero(up)
        by_length = going[np.argsort(length[going], kind="stable")]
        firsts = np.flatnonzero(np.diff(length[by_length], prepend=-1))
        nth = np.zeros(len(length), dtype=np.int64)
        nth[by_length] = np.arange(len(by_length)) - np.repeat(firsts, np.diff(firsts, append=len(by_length)))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(docs, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                "bin": pa.array((node << 32) + bins), "offset": pa.array(offsets), "up": pa.array(up), "nth": pa.array(nth),
            }
        )

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    placed = cut(rows.mapInArrow(leaf, f"{PIECE}, bin bigint, `offset` bigint, up boolean, nth bigint"))
    node = F.shiftright("bin", 32).alias("node")
    sums = cut(placed.filter("up").groupBy(node, "length").agg(F.count("*").alias("n")))
    # At most one row for each length up to the capacity.
    steps = best_fit_counts({r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("node")) - F.col("n")
    numbered = placed.filter("up").withColumn("node", node).join(sums.select("node", "length", before.alias("before")), ["node", "length"])

    def settle(batches):
        # Steps in order of length and first item, as one number each.
        keys = steps[:, 0] << 48 | steps[:, 1]
        for batch in batches:
            length, item = batch.column("length").to_numpy(), batch.column("item").to_numpy()
            step = steps[np.searchsorted(keys, length << 48 | item, side="right") - 1]
            nth = item - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array((1 << 62) + step[:, 4] + nth // step[:, 3]), pa.array(step[:, 5] + nth % step[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    go = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("item"))
    stay = placed.filter("NOT up").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    return stay.unionByName(go.mapInArrow(settle, f"{PIECE}, sequence_id bigint, `offset` bigint"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
