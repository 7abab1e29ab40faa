"""Operator 11: fill-in-middle transformation, cut at units found eight bytes at a time.

A unit is a run of white space (blank, U+0009 to U+000D) with the run of other characters after it, or white space that ends the text.
The UTF-8 bytes of a whole batch are viewed as 64-bit words. Arithmetic on each word marks its white space bytes and from them the
bytes that end a unit: those before white space, and the last byte of a text. ``bitwise_count`` sums the marks of each word; the
k-th unit of a text is found by a search of the cumulative counts for its word, and in the word by sums of marks per byte. Code
points are counted the same way, by the bytes that begin one. White space is ASCII, so cuts never divide a character.

Where the cuts are and which form a document takes comes from the SHA-256 of ``42:`` and its id, so it can be repeated anywhere.
``transform`` keeps all columns of the documents and adds its own (underscores in front of names that are taken); ``restored`` is the
expression that rebuilds a text from output and form: texts that hold a mark stay plain, so the marks of the others are unambiguous.

Null and empty texts: no units, plain, empty output. A null id draws from ``42:`` alone. Repeated rows get equal results. Texts of any
length are handled whole; a batch has at least one text. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrace.llm.common import fresh, pairs, table

SEED = 42
#: Of 100 documents so many are rearranged, and of 100 of those so many with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_EACH = 0x0101010101010101
_LOW, _HIGH = np.uint64(0x7F * _EACH), np.uint64(0x80 * _EACH)
_U = np.uint64


def white_space(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a blank or U+0009 to U+000D. No sum passes 255, so bytes don't meet."""
    seven = words & _LOW
    blank = ~(((words ^ _U(0x20 * _EACH)) & _LOW) + _LOW)
    control = (seven + _U((0x80 - 0x09) * _EACH)) & ~(seven + _U((0x80 - 0x0E) * _EACH))
    return (blank | control) & ~words & _HIGH


def begins(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point."""
    return ~(words & ~(words << _U(1))) & _HIGH


class Marks:
    """Marked bytes (high bits of words) with the number of marks before each word."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks on the bytes before each position."""
        word, byte = at >> 3, at & 7
        inside = self.marks[word] & ((_U(1) << (8 * byte).astype(np.uint64)) - _U(1))
        return np.where(word > 0, self.upto[word - 1], 0) + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark, from 1."""
        word = np.searchsorted(self.upto, k)
        left = k - np.where(word > 0, self.upto[word - 1], 0)
        # Byte i of the product holds the marks on bytes 0 to i (8 at most); it has enough of them from the wanted byte on.
        sums = (self.marks[word] >> _U(7)) * _U(_EACH)
        enough = ((sums | _HIGH) - left.astype(np.uint64) * _U(_EACH)) & _HIGH
        return 8 * word + 8 - np.bitwise_count(enough).astype(np.int64)


def cuts(data: np.ndarray, first: np.ndarray, last: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """For texts in ``data`` (bytes ``first`` to ``last`` each): units, byte ends of prefix and middle, code points of both."""
    padded = np.full((len(data) // 8 + 2) * 8, 0x20, dtype=np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    space = white_space(words)
    after = (space >> _U(8)) | np.append(space[1:] << _U(56), _U(0))
    ends = ~space & _HIGH & after
    there = np.flatnonzero(last > first)
    np.bitwise_or.at(ends, (last[there] - 1) >> 3, _U(0x80) << (8 * ((last[there] - 1) & 7)).astype(np.uint64))
    units, starts = Marks(ends), Marks(begins(words))
    before = units.rank(first)
    n = units.rank(last) - before
    one, two = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))

    def end(count: np.ndarray) -> np.ndarray:
        out = first.copy()
        some = np.flatnonzero(count > 0)
        out[some] = units.select((before + count)[some]) + 1
        return out

    a, b = end(one), end(two)
    chars = starts.rank(first), starts.rank(a), starts.rank(b)
    return n, a, b, chars[1] - chars[0], chars[2] - chars[1]


def _draws(doc_id: str, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the document's hash, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, with the first and last byte of each text."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED,
              names: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """The documents with their units, form (plain, psm, spm), code points of prefix and middle (null if plain) and output."""
    import pyarrow.compute as pc

    added = fresh(docs, *names)
    drawn = fresh(docs, "h1", "h2", "h3", "h4")
    rows = docs.withColumns(dict(zip(drawn, _draws(doc_id, seed), strict=True)))
    kept = docs.schema.fields
    place = [f.name for f in kept].index(text)
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in zip(added, kinds, strict=True))])

    def run(batches):
        for batch in pairs(batches):
            h1, h2, h3, h4 = (batch.column(len(kept) + i).to_numpy() for i in range(4))
            texts = pc.fill_null(batch.column(place).cast(pa.large_string()), "")
            data, first, last = _bytes(texts)
            n, a, b, prefix, middle = cuts(data, first, last, h1, h2)
            marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}").to_numpy(zero_copy_only=False)
            plain = (first == last) | marked | (h3 % 100 >= rate)
            spm = h4 % 100 < suffix_first
            whole, out = data.tobytes(), []
            p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
            for i, (x, y, z, w) in enumerate(zip(first.tolist(), a.tolist(), b.tolist(), last.tolist(), strict=True)):
                if plain[i]:
                    out.append(whole[x:w])
                elif spm[i]:
                    out.append(b"".join((s, whole[z:w], p, whole[x:y], m, whole[y:z])))
                else:
                    out.append(b"".join((p, whole[x:y], s, whole[z:w], m, whole[y:z])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(kept)], pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
                    pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=[f.name for f in schema.fields],
            )

    return rows.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text from output and form. No mark can arise where parts meet, so the first one of each kind is the one written."""
    out = F.col(output)

    def between(opening: str, second: str) -> tuple[Column, Column, Column]:
        """The parts after the opening, the second mark and the middle mark."""
        one, two = F.position(F.lit(second), out), F.position(F.lit(MIDDLE), out)
        return (
            F.substr(out, F.lit(len(opening) + 1), one - F.lit(len(opening) + 1)),
            F.substr(out, one + len(second), two - one - len(second)),
            F.substr(out, two + len(MIDDLE)),
        )

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    suffix_first, prefix_after, middle_last = between(SUFFIX, PREFIX)
    return (
        F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
        .when(F.col(form) == "spm", F.concat(prefix_after, middle_last, suffix_first))
        .otherwise(out)
    )


def op11_middle(spark, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = [F.sha2(F.encode(c, "UTF-8"), 256) for c in (F.col("output"), restored())]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))


#: Units by a regular expression, cuts by lists of units.
OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), numbers AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM drawn
), cut AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, units,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s
  FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
