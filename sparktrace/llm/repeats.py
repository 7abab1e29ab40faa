"""Operator 8: remove repeated byte strings, by merging Burrows-Wheeler transforms of shards.

Every byte covered by a string of ``length`` (50) bytes that also starts in a document with a smaller id is removed.

1. Documents are written once as a table bucketed by groups of rows, so that all later answers meet them without a shuffle. Of
   rows with one text only those of the smallest id go on: later copies lose all their bytes.
2. Every start of a 50-byte string has an anchor: the 32-byte gram of least hash inside it, leftmost of equal ones. Equal strings have
   equal anchors, and consecutive starts with one anchor form a run. Groups send 32 bits of each anchor, with the bucket
   that the other bits choose, and learn which of them other documents have too. (Equal bits of different anchors only
   make more candidates.)
3. Runs with shared anchors are the candidate strings. A group sends a hash of each distinct one with its smallest and greatest
   document and keeps where it stands. An anchor with one distinct string is settled: all who have it have all of it.
4. The distinct strings of other anchors are fetched from a group that has them and dealt into buckets by anchor, and buckets into
   shards. Each shard is sorted by itself and gives its Burrows-Wheeler transform. The transforms are merged by refining an
   interleave: the sequence that says which shard the next suffix comes from, sorted by h first bytes, becomes the one by
   h + 1 by stably sorting it by the transforms' bytes. Suffixes are not sorted again. Borders of blocks that open at
   step h have common prefixes of h - 1 bytes; blocks after 50 steps are the repeated intervals, and each start learns the
   smallest document of its interval.
5. Each group's documents compare these with their own ids and remove what the losing starts cover.

An anchor with over ``CROWDED`` distinct strings (the border of a very common passage) would fill one task: its strings are cut
into their single 50-byte strings, whose smallest documents are aggregated before they are shuffled. Both ways are exact.

Null text counts as empty. Ids that are null come after all others; rows with equal ids never count against each other. Texts of
any length are read in pieces that overlap. Repeated rows are judged each for itself; extra columns are kept.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrace.llm.common import fresh, table, tasks_for, text_key
from sparktrace.session import cut

LENGTH = 50
GRAM = 32
LAST = (1 << 63) - 1
#: Rows of a group, bytes of a piece of text that is scanned at once, bytes of text for each anchor bucket.
GROUP_ROWS = 1024
PIECE_BYTES = 1 << 18
BUCKET_BYTES = 8_000_000
#: Bytes of strings in a bucket and in a shard.
STRINGS_BYTES = 1_000_000
SHARD_BYTES = 250_000
CROWDED = 20_000
#: Distinct pairs of letters up to which a step of the merge may take four letters (a table of its square).
FOUR_LETTERS = 4096
#: A place is a row's number in its group and a start.
PLACE_BITS = 44

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-byte grams, by doubling."""
    h, factor, width = (data.astype(np.uint64) + np.uint64(1)) * _MIX2, _MIX, 1
    while width < GRAM:
        with np.errstate(over="ignore"):
            h = h[:-width] * factor + h[width:]
            factor = factor * factor
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX2
    h ^= h >> np.uint64(29)
    return h


def runs_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first start, number of starts) of every run of consecutive starts with one anchor.

    ``ends``: for each byte the end of the text that it belongs to; no string reaches over it.
    """
    starts = len(data) - length + 1
    if starts <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hashes = gram_hashes(data)
    at = np.uint64(21)  # a piece has fewer than 2**21 bytes
    least = (hashes & ~np.uint64((1 << 21) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    width, window = 1, length - GRAM + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: starts], least[window - width : window - width + starts])
    anchor = (least & np.uint64((1 << int(at)) - 1)).astype(np.int64)
    valid = np.arange(starts) + length <= ends[:starts]
    new = np.ones(starts, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, starts))
    keep = valid[first]
    first, size = first[keep], size[keep]
    return hashes[anchor[first]], first, size


def scanned(texts: list[bytes], length: int = LENGTH):
    """Runs of many texts: (text number, hash, start in the text, number of starts, bytes of the piece, start in the piece)."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), PIECE_BYTES):
            piece = text[at : at + PIECE_BYTES + length - 1]
            if size and size + len(piece) > PIECE_BYTES:
                yield _scan(held, length)
                held, size = [], 0
            held.append((number, at, piece))
            size += len(piece)
    if held:
        yield _scan(held, length)


def _scan(held: list[tuple[int, int, bytes]], length: int):
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    joined = b"".join(p for _, _, p in held)
    h, first, n = runs_of(np.frombuffer(joined, dtype=np.uint8), np.repeat(ends, sizes), length)
    owner = np.searchsorted(ends, first, side="right")
    numbers, offsets = np.array([x for x, _, _ in held]), np.array([a for _, a, _ in held]) - (ends - sizes)
    return numbers[owner], h, first + offsets[owner], n, joined, first


def shard_transform(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes (positions in the strings put together, each with an end mark) and their transform.

    Bytes are raised by one, so that 0 is free for the end marks (UTF-8 has no 255). Each end mark is a letter of its own.
    """
    text = np.frombuffer(b"\x00".join(strings) + b"\x00", dtype=np.uint8).copy()
    marks = np.cumsum([len(s) + 1 for s in strings]) - 1
    letters = text + np.uint8(1)
    letters[marks] = 0
    rank = letters.astype(np.int64) + len(marks)
    rank[marks] = np.arange(len(marks))
    width = 1
    while width < length:
        size = int(rank.max()) + 1
        code, ways = rank, min(62 // size.bit_length(), -(-length // width))  # as many ranks in a row as fit into a number
        for i in range(1, ways):
            after = np.zeros_like(rank)
            after[: -i * width] = rank[i * width :]
            code = code * size + after
        rank = np.unique(code, return_inverse=True)[1]
        width *= ways
    order = np.argsort(rank, kind="stable")
    return order, letters[order - 1]  # the letter before position 0 is the last end mark


def _ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of numbers below ``size`` among the distinct ones, and those."""
    there = np.zeros(size, dtype=bool)
    there[codes] = True
    distinct = np.flatnonzero(there)
    ranks = np.zeros(size, dtype=np.uint16 if len(distinct) <= 1 << 16 else np.int32)
    ranks[distinct] = np.arange(len(distinct))
    return ranks[codes], distinct


def repeated_intervals(transforms: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms by interleave refinement: for each suffix of the merged order its shard and its block of equal prefixes.

    A step sorts by the four letters before each suffix at once, so it refines by four bytes, as long as their ranks fit into 16 bits
    (by two otherwise); the rest of the length takes a step of one letter and of two first.
    """
    sizes = [len(t) for t in transforms]
    letters = np.concatenate(transforms)
    after = np.empty(len(letters), dtype=np.int64)  # where each letter's suffix stands
    for end, size, t in zip(np.cumsum(sizes), sizes, transforms, strict=True):
        after[end - size : end][np.argsort(t, kind="stable")] = np.arange(end - size, end)
    pair, pairs = _ranked(letters[after].astype(np.uint16) << np.uint16(8) | letters, 1 << 16)
    marked = (pairs < 256) | ((pairs & 255) == 0)  # which pairs hold an end mark
    steps = [(letters, np.arange(256) == 0)] * (length % 2) + [(pair, marked)] * (length // 2)
    if len(pairs) <= FOUR_LETTERS:
        four, fours = _ranked(pair[after[after]].astype(np.int64) * len(pairs) + pair, len(pairs) ** 2)
        if len(fours) <= 1 << 16:
            steps[length % 2 + length // 2 % 2 :] = [(four, marked[fours // len(pairs)] | marked[fours % len(pairs)])] * (length // 4)
    source = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)
    block = np.zeros(len(source), dtype=np.int32)
    blocks, known = 1, None
    for given, holds_mark in steps:
        if known is not given:
            known, placed = given, np.sort(given, kind="stable")
            # The letters in order are the same in every step; what holds an end mark is a block of its own.
            borders = (placed[1:] != placed[:-1]) | holds_mark[placed[1:]]
        here = np.empty_like(given)
        here[np.argsort(source, kind="stable")] = given
        order = np.argsort(here, kind="stable")
        block, source = block[order], source[order]
        opens = np.zeros(len(order), dtype=bool)
        np.not_equal(block[1:], block[:-1], out=opens[1:])
        opens[1:] |= borders
        block = np.cumsum(opens, dtype=np.int32)
        if block[-1] + 1 == blocks:  # no block was split, so none will be
            break
        blocks = block[-1] + 1
    return source, block


def smallest_documents(strings: list[bytes], documents: np.ndarray, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For every start in every string the smallest document that has its 50 bytes."""
    shards, held = [[]], 0
    shard_bytes = max(shard_bytes, -(-sum(map(len, strings)) // 250))  # shard numbers are bytes
    for i, s in enumerate(strings):
        if held and held + len(s) > shard_bytes:
            shards.append([])
            held = 0
        shards[-1].append(i)
        held += len(s)
    made = [shard_transform([strings[i] for i in shard], length) for shard in shards]
    source, block = repeated_intervals([t for _, t in made], length)
    owners, places, sorted_by_source = [], [], np.argsort(source, kind="stable")
    for shard, (order, _) in zip(shards, made, strict=True):
        sizes = np.array([len(strings[i]) + 1 for i in shard])
        ends = np.cumsum(sizes)
        local = np.searchsorted(ends, order, side="right")
        owners.append(np.array(shard)[local])
        places.append(order - (ends - sizes)[local])
    owner, place = np.empty(len(source), dtype=np.int64), np.empty(len(source), dtype=np.int64)
    owner[sorted_by_source], place[sorted_by_source] = np.concatenate(owners), np.concatenate(places)
    starts = np.array([len(s) - length + 1 for s in strings])
    valid = place < starts[owner]
    document = np.where(valid, documents[owner], LAST)
    borders = np.flatnonzero(np.diff(block, prepend=-1))
    least = np.minimum.reduceat(document, borders)[block]
    flat, at = np.full(int(starts.sum()), LAST, dtype=np.int64), np.cumsum(starts) - starts
    flat[at[owner[valid]] + place[valid]] = least[valid]
    return np.split(flat, np.cumsum(starts)[:-1])


def one_if_equal(found: list[np.ndarray]) -> pa.ListArray:
    """The lists, none of them empty; those of equal numbers have one of them."""
    sizes, every = np.array([len(f) for f in found]), np.concatenate(found)
    begin = np.cumsum(sizes) - sizes
    equal = np.minimum.reduceat(every, begin) == np.maximum.reduceat(every, begin)
    stay = np.repeat(~equal, sizes)
    stay[begin] = True
    borders = np.append(0, np.cumsum(np.where(equal, 1, sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(every[stay]))


def losing_spans(lost: pa.Table, documents: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number, begin, end) of the bytes that go, in order. ``lost``: runs with their places and the smallest documents of their
    starts (one number if it holds for all); ``documents``: the id of each row number."""
    if not lost.num_rows:
        return (np.zeros(0, dtype=np.int64),) * 3
    lost = lost.combine_chunks()
    places, leasts = lost.column("places").combine_chunks(), lost.column("leasts").combine_chunks()
    n_places, n_leasts = pc.list_value_length(places).to_numpy(), pc.list_value_length(leasts).to_numpy()
    run = np.repeat(np.arange(len(n_places)), n_places)  # the run of each place
    place, least = places.flatten().to_numpy(), leasts.flatten().to_numpy()
    n = lost.column("n").to_numpy().astype(np.int64)[run]
    at = np.repeat(np.arange(len(run)), n)  # the place of each start
    offset = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(n_leasts) - n_leasts)[run]
    smallest = least[first[at] + np.where(n_leasts[run] == 1, 0, 1)[at] * offset]
    owner = place >> PLACE_BITS
    goes = smallest < documents[owner][at]
    at, offset = at[goes], offset[goes]
    owner, start = owner[at], (place & ((1 << PLACE_BITS) - 1))[at] + offset
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + length)
    begin = np.flatnonzero(new)
    return owner[begin], start[begin], start[np.append(begin[1:], len(start)) - 1] + length if len(start) else start


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """The documents as a table bucketed by group, written without a shuffle: rows are grouped as they lie."""
    name = f"documents_{uuid.uuid4().hex}"
    at = F.monotonically_increasing_id()
    row, group = fresh(docs, "_row", "_group")
    rows = docs.withColumn(row, at).withColumn(group, F.expr(f"shiftright({row}, 33) * {1 << 23} + (({row} & {(1 << 33) - 1}) div {GROUP_ROWS})"))
    rows.write.format("parquet").option("compression", "zstd").bucketBy(buckets, group).saveAsTable(name)
    return docs.sparkSession.table(name)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, n_bytes: str = "n_bytes", n_removed: str = "n_removed", n_spans: str = "n_spans",
    kept: str = "kept", as_text: bool = False,
) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans and the remaining bytes (``kept``, binary) added; ``as_text``: as a string, without what
    is left of characters that were cut."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    anchor_buckets = max(1, -(-int(total) // BUCKET_BYTES))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = _bucketed(docs, max(parallel, min(10_000, -(-int(total) // 32_000_000))))

    row_name, group_name = fresh(docs, "_row", "_group")
    texts = held.select(
        F.col(row_name).alias("_row"), F.col(group_name).alias("_group"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("document"), F.col(text).cast("string").alias("text")
    )
    # Rows whose text a smaller id has: (group, row).
    same = texts.filter(F.octet_length("text") >= length).select("_group", "_row", "document", text_key(F.col("text")).alias("key"))
    first = same.groupBy("key").agg(F.min("document").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copies = cut(same.join(first, "key").filter("document > least").groupBy("_group").agg(F.collect_list(F.col("_row") % GROUP_ROWS).alias("copies")))

    # Lists that a row has not are empty, not null: Spark measures a batch after every row that it sends to Python, and for that
    # Arrow writes the borders of all null lists since the last one that is not null again.
    no_list = F.array().cast("array<bigint>")

    def bytes_of(column) -> list[bytes]:
        return [(t or "").encode() for t in column.to_pylist()]

    def originals(rows: pa.Table, gone: pa.Table) -> tuple[list[int], list[int], list[bytes]]:
        """Row numbers in the group, documents and texts; texts that count elsewhere are empty."""
        dropped = set(gone.column("copies")[0].as_py()) if gone.num_rows else set()
        numbers = (rows.column("_row").to_numpy() % GROUP_ROWS).tolist()
        return numbers, rows.column("document").to_pylist(), [b"" if i in dropped else t for i, t in zip(numbers, bytes_of(rows.column("text")), strict=True)]

    def send_anchors(rows: pa.Table, gone: pa.Table) -> pa.Table:
        found = []
        for number, h, *_ in scanned(originals(rows, gone)[2] if rows.num_rows else [], length):
            # Once for each document, and twice at most: two documents are enough to share it.
            order = np.lexsort((number, h))
            h, number = h[order], number[order]
            found.append(h[np.r_[True, (h[1:] != h[:-1]) | (number[1:] != number[:-1])][: len(h)]])
        h = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
        h = h[np.r_[True, True, h[2:] != h[:-2]][: len(h)]]
        bucket = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(anchor_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, bits = bucket[order], (h[order] >> np.uint64(32)).astype("<u4")
        borders = np.flatnonzero(np.diff(bucket, prepend=-1))
        sent = [x.tobytes() for x in np.split(bits, borders[1:])] if len(bits) else []
        group = rows.column("_group")[0].as_py() if rows.num_rows else 0
        return pa.table([pa.array(bucket[borders]), pa.array(np.full(len(borders), group, dtype=np.int64)), pa.array(sent, pa.binary())], names=["bucket", "_group", "bits"])

    def find_shared(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, dtype="<u4") for b in group.column("bits").to_pylist()]
        every, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        equal = every[1:] == every[:-1]
        shared = np.r_[False, equal] | np.r_[equal, False]
        every, owner = every[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        every, owner = every[order], owner[order]
        some, begin = np.unique(owner, return_index=True)
        answers = group.select(["bucket", "_group"]).take(pa.array(some))
        return answers.append_column("bits", pa.array([x.tobytes() for x in np.split(every, begin[1:])] if len(some) else [], pa.binary()))

    packed = "bucket bigint, _group bigint, bits binary"
    shared = texts.groupBy("_group").cogroup(copies.groupBy("_group")).applyInArrow(send_anchors, packed).groupBy("bucket").applyInArrow(find_shared, packed)
    answers_of = shared.select("_group", "bucket", "bits", no_list.alias("copies"))
    told = answers_of.unionByName(copies.select("_group", F.lit(-1).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "copies"))

    def send_runs(rows: pa.Table, told: pa.Table) -> pa.Table:
        names = ["h", "s", "_group", "least", "most", "n", "places"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        is_copies = pc.equal(told.column("bucket"), -1)
        answers, gone = told.filter(pc.invert(is_copies)), told.filter(is_copies)
        found = []
        if rows.num_rows and answers.num_rows:
            known = np.sort(np.concatenate([np.frombuffer(b, dtype="<u4").astype(np.int64) * anchor_buckets + k for k, b in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True)]))
            numbers, documents, data = originals(rows, gone)
            numbers, documents, digest = np.array(numbers, dtype=np.int64), np.array(documents, dtype=np.int64), xxhash.xxh3_64_intdigest
            for number, h, start, n, joined, first in scanned(data, length):
                code = (h >> np.uint64(32)).astype(np.int64) * anchor_buckets + ((h & np.uint64(0xFFFFFFFF)) % np.uint64(anchor_buckets)).astype(np.int64)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code)
                number, begin, n = number[hit], first[hit], n[hit]
                strings = zip(begin.tolist(), (begin + n + (length - 1)).tolist(), strict=True)
                s = np.fromiter((digest(joined[i:j]) for i, j in strings), dtype=np.uint64, count=len(hit))
                found.append((h[hit].view(np.int64), (s ^ np.uint64(1 << 63)).view(np.int64), documents[number], n, numbers[number] << PLACE_BITS | start[hit]))
        group = rows.column("_group")[0].as_py() if rows.num_rows else 0
        h, s, document, n, place = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, dtype=np.int64)] * 5
        order = np.lexsort((s, h))
        h, s, document = h[order], s[order], document[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])[: len(h)])
        least, most = (f.reduceat(document, first) if len(first) else document for f in (np.minimum, np.maximum))
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(place[order]))
        seen = np.argsort(order[first])  # as they come in the texts, which packs better
        columns = [c[seen] for c in (h[first], s[first], np.full(len(first), group), least, most, n[order][first])]
        return pa.table([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), places.take(pa.array(seen))], names=names)

    runs = cut(
        texts.groupBy("_group").cogroup(told.groupBy("_group")).applyInArrow(
            send_runs, "h bigint, s bigint, _group bigint, least bigint, most bigint, n int, places array<bigint>"
        )
    )
    variants = runs.groupBy("h", "s").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min(F.struct("_group", F.col("places")[0].alias("place"), "n")).alias("at"))
    sizes = variants.groupBy("h").agg(F.count("*").alias("strings"), F.min("least").alias("first"), F.max("most").alias("last"))
    # Anchors that only one document has after all need no more work.
    sized = cut(variants.join(sizes.filter("first < last").select("h", "strings"), "h").select("h", "s", "least", F.when(F.col("strings") > 1, F.col("at")).alias("at"), "strings"))
    settled = sized.filter("strings = 1").select("h", "s", F.array("least").alias("leasts"))

    def fetch(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        data = dict(zip((rows.column("_row").to_numpy() % GROUP_ROWS).tolist(), bytes_of(rows.column("text")), strict=True)) if wanted.num_rows else {}
        strings = []
        for place, n in zip(wanted.column("place").to_pylist(), wanted.column("n").to_pylist(), strict=True):
            start = place & ((1 << PLACE_BITS) - 1)
            strings.append(data[place >> PLACE_BITS][start : start + n + length - 1])
        return wanted.select(["h", "s", "least", "strings"]).append_column("string", pa.array(strings, pa.binary()))

    answer = "h bigint, s bigint, leasts array<bigint>"

    def fetched(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select("h", "s", "least", "strings", "at._group", "at.place", "at.n")
        return texts.groupBy("_group").cogroup(wanted.groupBy("_group")).applyInArrow(fetch, "h bigint, s bigint, least bigint, strings bigint, string binary")

    def merge(group: pa.Table) -> pa.Table:
        found = smallest_documents(group.column("string").to_pylist(), group.column("least").to_numpy(), length)
        return pa.table({"h": group.column("h"), "s": group.column("s"), "leasts": one_if_equal(found)})

    several = sized.filter(F.col("strings").between(2, CROWDED))
    buckets = tasks_for(several, F.col("at.n") + (length - 1), STRINGS_BYTES)
    merged = fetched(several).withColumn("bucket", F.expr(f"pmod(h, {buckets})")).groupBy("bucket").applyInArrow(merge, answer)
    answers = settled.unionByName(merged)
    crowded = sized.filter(F.col("strings") > CROWDED)
    if not crowded.isEmpty():
        single = fetched(crowded).select("h", "s", "least", "string", F.posexplode(F.expr(f"sequence(1, octet_length(string) - {length - 1})")).alias("place", "at"))
        single = cut(single.select("h", "s", "least", "place", F.expr(f"substring(string, at, {length})").alias("string")))
        least = single.groupBy("string").agg(F.min("least").alias("smallest"))
        placed = single.join(least, "string").groupBy("h", "s").agg(F.array_sort(F.collect_list(F.struct("place", "smallest"))).alias("found"))
        answers = answers.unionByName(placed.select("h", "s", F.transform("found", lambda x: x["smallest"]).alias("leasts")))
    lost = runs.select("h", "s", "_group", "n", "most", "places").join(answers, ["h", "s"])
    lost = lost.filter(F.array_min("leasts") < F.col("most")).select("_group", "n", "places", "leasts", no_list.alias("copies"))
    lost = lost.unionByName(copies.select("_group", F.lit(0).alias("n"), *(no_list.alias(c) for c in ("places", "leasts")), "copies"))
    out = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType(), False) for c in (n_bytes, n_removed, n_spans)), T.StructField(kept, T.StringType() if as_text else T.BinaryType(), False)])
    names = docs.columns

    def remove(rows: pa.Table, lost: pa.Table) -> pa.Table:
        data = bytes_of(rows.column(text))
        numbers = rows.column(row_name).to_numpy() % GROUP_ROWS
        documents = np.zeros(GROUP_ROWS, dtype=np.int64)
        documents[numbers] = [LAST if d is None else int(d) for d in rows.column(doc_id).to_pylist()]
        copies = set(pc.list_flatten(lost.column("copies")).to_pylist())
        lost = lost.filter(pc.greater(pc.list_value_length(lost.column("places")), 0))
        owner, low, high = losing_spans(lost, documents, length)
        result = []
        for number, whole in zip(numbers.tolist(), data, strict=True):
            if number in copies:
                result.append((len(whole), len(whole), 1, b""))
                continue
            a, b = np.searchsorted(owner, [number, number + 1])
            if a == b:
                result.append((len(whole), 0, 0, whole))
                continue
            edges = [0, *np.stack([low[a:b], high[a:b]], axis=1).ravel().tolist(), len(whole)]
            stay = b"".join(whole[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            result.append((len(whole), len(whole) - len(stay), int(b - a), stay))
        made = list(zip(*result)) or [()] * 4
        if as_text:
            made[3] = [stay.decode("utf-8", "ignore") for stay in made[3]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
        columns = [rows.column(c) for c in names] + [pa.array(m, k) for m, k in zip(made, kinds, strict=True)]
        return pa.table(columns, names=[f.name for f in out.fields])

    return held.groupBy(group_name).cogroup(lost.groupBy("_group")).applyInArrow(remove, out)


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
