"""Operator 10: byte-level BPE as a lazily determinised transducer, and a streaming UTF-8 decoder.

The merges of a rank file are compiled into a transducer over bytes. Fact used: in the encoding of a piece, the tokens up to any
token border are the encoding of the bytes up to that border, and a token may follow another exactly if the two together encode
to themselves. So for each prefix there is one last token, found from the tokens that end there. A state holds the borders at
which a longer token may still start, each with the tokens since the last settled border and its node in the trie of tokens.
What all of them share is settled and emitted; no state looks further ahead than the longest token. States and transitions are
made when first met, up to a limit; a piece that would need more states is run through the undetermined machine, whose one last token
of each prefix is found from those of shorter prefixes, so memory is bounded by parameters. Short pieces' paths from start to end are
remembered whole.

Null text counts as empty: no ids, empty decoded text. Very long texts and pieces take time in proportion to their length.
Repeated rows are encoded each for itself; extra columns are kept; new columns get underscores in front if their names are taken.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrace.llm.common import Remembered, fresh, pairs

STATES = 30_000
REMEMBERED = 400_000
FOLLOWS = 300_000
NEVER = 1 << 60
#: A mark after a letter or number, before a cut or the end.
_LAST_MARK = regex.compile(r"(?<=[\p{L}\p{N}])([.,;:!?])(?=\x00|\Z)")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The trie: node -> byte -> node, and the token that ends at a node.
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                at = self.next[node].get(byte)
                if at is None:
                    at = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(None)
                node = at
            self.token[node] = rank
        # The same tokens for the undetermined machine: all that end at a byte, the longest first.
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()
        self.follows: dict[tuple, bool] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.start = self._state((None, (((), 0),)))

    def _state(self, state: tuple) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return at

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int) -> tuple[list, list]:
        """(part, rank of the merge that ends it) at the left and at the right edge of a token, from its first byte up to itself."""
        data = self.bytes_of[token]
        parts, left, right = [data[i : i + 1] for i in range(len(data))], [data[:1]], [data[-1:]]
        while len(parts) > 1:
            _, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left.append(parts[0])
            if at == len(parts) - 1:
                right.append(parts[-1])
        self.spines[token] = tuple(list(zip(side, [*(self.ranks[p] for p in side[1:]), NEVER])) for side in (left, right))
        return self.spines[token]

    def _may_follow(self, before: int | None, token: int) -> bool:
        """Whether no merge crosses the border while both tokens are being built.

        Parts x and y that meet at the border merge if the rank of xy comes before both the merge that ends x and the one that
        ends y; of equal ranks the leftmost goes first.
        """
        if before is None:
            return True
        known = self.follows.get((before, token))
        if known is None:
            known, rank_of = True, self.ranks.get
            xs, ys = iter((self.spines.get(before) or self._spine(before))[1]), iter((self.spines.get(token) or self._spine(token))[0])
            (x, x_ends), (y, y_ends) = next(xs), next(ys)
            while True:
                rank = rank_of(x + y)
                if rank is not None and rank < x_ends and rank <= y_ends:
                    known = False
                    break
                if x_ends <= y_ends:
                    if x_ends == NEVER:
                        break
                    x, x_ends = next(xs)
                else:
                    y, y_ends = next(ys)
            if len(self.follows) > FOLLOWS:
                self.follows.clear()
            self.follows[(before, token)] = known
        return known

    def _move(self, at: int, byte: int) -> tuple[int, tuple] | None:
        """The transition, made now; None if there are as many states as may be."""
        if len(self.states) >= self.limit:
            return None
        settled, live = self.states[at]
        entries, ended = [], None
        for chain, node in live:
            node = self.next[node].get(byte)
            if node is None:
                continue
            entries.append((chain, node))
            token = self.token[node]
            if ended is None and token is not None and self._may_follow(chain[-1] if chain else settled, token):
                ended = chain + (token,)
        if ended is None:
            raise ValueError("the ranks lack a byte or have a token that its own merges don't reach")
        # A node without children can't grow: its border is settled by those after it.
        entries = [e for e in entries if self.next[e[1]]] + [(ended, 0)]
        chains = [chain for chain, _ in entries]
        shared = 0
        for tokens in zip(*chains):
            if any(t != tokens[0] for t in tokens):
                break
            shared += 1
        emitted = ended[:shared]
        state = (emitted[-1] if emitted else settled, tuple((chain[shared:], node) for chain, node in entries))
        move = self.moves[at][byte] = (self._state(state), emitted)
        return move

    def _run_undetermined(self, piece: bytes) -> list[int]:
        """Border by border: of the tokens that end there, the one that may follow the last token of the border where it starts.
        There is exactly one, so nothing is tried again, and the piece is read off from its end."""
        may, follows, last, begun = self._may_follow, self.follows, [None] * (len(piece) + 1), [0] * (len(piece) + 1)
        for end, (token, size) in self.ending.iter(piece.decode("latin-1")):
            end += 1
            if last[end] is None:
                start = end - size
                before = last[start]
                valid = start == 0 or follows.get((before, token))
                if may(before, token) if valid is None else valid:
                    last[end], begun[end] = token, start
        out, at = [], len(piece)
        while at:
            if last[at] is None:
                raise ValueError("the ranks lack a byte or have a token that its own merges don't reach")
            out.append(last[at])
            at = begun[at]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of a piece. A piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        at, out, moves = self.start, [], self.moves
        for byte in piece:
            move = moves[at].get(byte) or self._move(at, byte)
            if move is None:
                return self._run_undetermined(piece)
            at = move[0]
            if move[1]:
                out += move[1]
        out += self.states[at][1][-1][0]
        return out


class Encoder(Remembered):
    """Texts to ids: the pattern cuts pieces, the transducer encodes each; ids are little-endian 32-bit integers.

    No piece reaches over a blank that follows a character other than white space, so texts are cut there first, and the ids of
    frequent parts (a blank and what follows it) are remembered. A mark after a letter or number is a piece of its own at the
    end of a part.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, size: int = REMEMBERED):
        self.find = regex.compile(pattern).findall
        self.blank_after_space = regex.compile(r"\s |\x00").search
        self.transducer = Transducer(ranks)
        super().__init__(self._part, size)

    def _part(self, part: str) -> bytes:
        if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):  # letters, after a blank or not: one piece
            return array("i", self.transducer.encode(part.encode())).tobytes()
        out = array("i")
        for piece in self.find(part):
            out.extend(self.transducer.encode(piece.encode()))
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        if self.blank_after_space(text):
            return b"".join(map(self.__getitem__, self.find(text)))
        return b"".join(map(self.__getitem__, _LAST_MARK.sub("\x00\\1", text.replace(" ", "\x00 ")).split("\x00")))


class Utf8Machine:
    """Incremental UTF-8: reads tokens, a run of ``RUN`` at a time, and gives the characters that are complete.

    The state is the bytes of an unfinished character (at most 3); only the end of a run is looked at for one. Bytes that can't
    be UTF-8 give U+FFFD, as Python's ``errors="replace"`` does.
    """

    RUN = 4096

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Length of the unfinished but so far correct character at the end."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte decides whether the character can still be one
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, tokens: list[int], pending: bytes = b"") -> tuple[list[str], bytes]:
        """Characters completed by the tokens, and the bytes that wait for the next call."""
        out, bytes_of = [], self.bytes_of.__getitem__
        for at in range(0, len(tokens), self.RUN):
            data = pending + b"".join(map(bytes_of, tokens[at : at + self.RUN]))
            end = len(data) - self.unfinished(data)
            out.append(data[:end].decode("utf-8", "replace"))
            pending = data[end:]
        return out, pending

    def decode(self, tokens: list[int]) -> str:
        out, pending = self.feed(tokens)
        return "".join(out) + pending.decode("utf-8", "replace")


def _ship(df: DataFrame, path: str) -> str:
    """Send the vocabulary file (bounded by the tokenizer, not by the data) to the executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rstrip("/").rpartition("/")[2]


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(_ranks(path), pattern)


@lru_cache(maxsize=4)
def _machine(path: str) -> Utf8Machine:
    return Utf8Machine({rank: token for token, rank in _ranks(path).items()})


def lists_of(column: pa.ListArray) -> list[list[int]]:
    """The numbers of each list, of a null one none; Arrow's own ``to_pylist`` makes an object for each number first."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.tolist()
    return [values[a:b].tolist() if valid else [] for a, b, valid in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with their token ids (array of int) in place of the text column; no special tokens."""
    name = _ship(docs, ranks_path)
    (ids,) = fresh(docs.drop(text), ids)
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        encoder = _encoder(SparkFiles.get(name), pattern)
        for batch in pairs(batches, chars=2_000_000):
            found = [encoder.encode(t or "") for t in batch.column(text).to_pylist()]
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(f) // 4 for f in found], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
            made = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), made], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the decoded text added; a null list decodes to the empty text."""
    name = _ship(encoded, ranks_path)
    (text,) = fresh(encoded, text)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches):
        machine = _machine(SparkFiles.get(name))
        for batch in pairs(batches, chars=2_000_000):
            made = [machine.decode(tokens) for tokens in lists_of(batch.column(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[f.name for f in schema.fields])

    return encoded.mapInArrow(run, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded bytes."""
    import public_tokenizers

    from sparktrace.llm.common import table

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
