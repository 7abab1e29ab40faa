"""Operators on whole texts: fingerprints, packing, language, byte-pair encoding."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktrace.llm import bpe, langid, packing, simhash
from sparktrace.llm.components import components

DOCS = "doc_id bigint, text string, lang string, _draw int"
ODD = [
    (1, None, "en", 0), (2, "", "en", 0), (3, "a", None, 0), (3, "a", None, 0), (None, "b c", "de", None), (4, "x " * 60_000, "en", 1),
    (5, " \t\n\x0b\x0c\r ", "fr", 1), (6, "été à la 日本 😀 don't  stop\n\n\nend ", "fr", 1), (7, "  x\u0085", "fr", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    random.Random(3).shuffle(chain)
    found = dict(components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1300)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), set()).add(prints[i])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("hot", [0, 3, 64])
def test_simhash_links_equal_brute_force(spark, hot):
    draw = random.Random(hot)
    prints = [draw.getrandbits(64) for _ in range(60)]
    for base in list(prints[:30]):
        for _ in range(8):
            other = base
            for _ in range(draw.randrange(1, 4)):
                other ^= 1 << draw.randrange(64)
            prints.append(other)
    prints = list(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = {}
    for node, root in components(simhash.links(spark.createDataFrame(signed, "fingerprint bigint"), hot=hot)).collect():
        found.setdefault(root, {root & (1 << 64) - 1}).add(node & (1 << 64) - 1)
    assert {frozenset(g) for g in found.values()} == brute_components(prints)


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_of_odd_rows(spark, odd, none):
    found = simhash.near_duplicates(odd).collect()
    assert sorted((str(r[0]), r[1] & (1 << 64) - 1) for r in found) == sorted((str(d), plain_fingerprint(t)) for d, t, *_ in ODD)
    of = {r["doc_id"]: r["component_id"] for r in found}
    assert of[1] == of[2] == of[5] == 1 and of[3] == 3 and of[None] is None
    assert simhash.near_duplicates(none).count() == 0


def plain_pieces(rows):
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 4096):
            out.append((str(doc), at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], dtype="<u4").tobytes())))
    return sorted(out)


def check_bins(rows, capacity=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_odd_rows(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(odd, path).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == plain_pieces(ODD)
    assert check_bins(rows) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack(none, path).count() == 0


def test_packing_joins_bins_of_many_partitions(spark):
    sizes = [random.Random(i).randrange(1, 120) for i in range(300)]
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(sizes)], "doc_id bigint, text string").repartition(40)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=128).collect()
    assert sorted(r["length"] for r in rows) == sorted(n + 1 for n in sizes)
    assert check_bins(rows, 128) <= -(-sum(n + 1 for n in sizes) // 128) * 1.05
    # Bins that are all above half can't be joined, whatever their number.
    wide = spark.createDataFrame([(i, "a " * 70) for i in range(400)], "doc_id bigint, text string").repartition(8)
    assert check_bins(packing.pack(wide, public_tokenizers.path("word_bpe_49k.json"), capacity=128).collect(), 128) == 400


def test_packing_of_partitions_with_different_lengths(spark):
    """Half the partitions have long documents, half short ones: as few sequences as one best-fit over all."""
    draw = random.Random(9)
    sizes = [draw.randrange(66, 112) if i < 600 else draw.randrange(9, 60) for i in range(1200)]
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(sizes)], "doc_id bigint, text string").repartitionByRange(16, "doc_id")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=128).collect()
    assert sorted(r["length"] for r in rows) == sorted(n + 1 for n in sizes)
    assert check_bins(rows, 128) <= len(packing.best_fit(np.array(sizes) + 1, 128)[2]) * 1.01


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_best_fit_of_counts_is_best_fit(capacity):
    draw = np.random.default_rng(capacity)
    for _ in range(40):
        lengths = np.minimum(draw.integers(1, capacity + 1, size=draw.integers(1, 400)), draw.integers(1, capacity + 1))
        fill = collections.Counter()
        sizes, counts = np.unique(lengths, return_counts=True)
        for size, first, n, each, start, offset in packing.best_fit_counts(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), capacity).tolist():
            for j in range(n):
                assert fill[start + j // each] == offset + j % each * size
                fill[start + j // each] += size
        assert sum(fill.values()) == lengths.sum() and max(fill.values()) <= capacity
        assert sorted(fill.values()) == sorted(packing.best_fit(lengths, capacity)[2].tolist())


@pytest.mark.parametrize("text", ["ADANA\u0130.", "\u0130. \u0130, \u0130!", "H\u0331 H\u0331. x", "\u0391\u03a3. \u03a3", "A\u0301B. E\u0301", "It's, A.B. c?! d", "\u2167. \ufb01; \u212a.", "x\n.\ty.", "...", "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(0xA0, 0x100))) + " A\u00c9\u00d7\u00de. \u00df\u00aa\u00ba\u00b5,"])
def test_word_ids_equal_library(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert np.frombuffer(packing.WordIds(path).encode(text), dtype="<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_best_fit_is_best_fit():
    bins, offsets, fill = packing.best_fit(np.array([50, 60, 40, 30, 20, 100]), 100)
    assert fill.tolist() == [100, 100, 100] and bins.tolist() == [2, 1, 1, 2, 2, 0] and offsets.tolist() == [0, 0, 60, 50, 80, 0]


def test_language_by_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.op5_langid(spark, sf_dir).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, odd, none):
    model = langid.fit(spark.createDataFrame([(1, "the cat the cat", "en", 0), (2, "le chat le chat", "fr", 0), (3, None, "xx", 0), (4, "the the", None, 0)], DOCS))
    assert model.langs == ["en", "fr"]
    texts = [(1, None), (2, "12 ½ ² _ !"), (3, "The cat"), (4, "chateau"), (5, "日本"), (6, ""), (None, "le"), (7, "le " * 300_000)]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect()}
    assert found[1] == found[2] == found[6] == ("und", 0.0)
    assert found[3][0] == "en" and found[4][0] == found[7][0] == found[None][0] == "fr" and found[5] == ("en", 0.5)
    assert all(0 <= s <= 1 for _, s in found.values())
    nothing = langid.fit(none)
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_long_words_are_scored_but_not_remembered():
    model = langid.Model(["a", "b"], [("x" * 80, 9, 1), ("no", 1, 9)], [("xx", 5, 1), ("yy", 1, 5), ("x", 2, 1), ("y", 1, 2)])
    scorer = langid.Scorer(model)
    known = len(scorer.rows)
    assert scorer.predict("y" * 300_000)[0] == "b" and scorer.predict("x" * 100 + " " + "x" * 80)[0] == "a"
    assert len(scorer.rows) == known


def test_language_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(langid, "REMEMBERED", 40)
    model = langid.Model(["en", "fr"], [("the", 5, 0), ("le", 0, 5)], [("c", 3, 1), ("a", 1, 3)])
    scorer = langid.Scorer(model)
    words = [f"{'ca'[i % 2]}{'x' * (i % 29)}" for i in range(39)] * 3 + ["the"]
    assert np.allclose(scorer.sums(words * 2), 2 * sum(model.word_scores[model.words[w]] if w in model.words else scorer.backed_off(w) for w in words))


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("states", [30_000, 50, 1])
def test_bpe_equals_tiktoken(ranks, states):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Encoder(ranks, public_tokenizers.PATTERN, 100)
    ours.transducer = bpe.Transducer(ranks, states)
    machine, draw = bpe.Utf8Machine({r: t for t, r in ranks.items()}), random.Random(states)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "日本", "😀", "1", "23", "!", "'s", "\t", " ", "zz", "aaaa", "́", "न", "====", "<|endoftext|>"]
    for _ in range(600):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(60)))
        want = theirs.encode_ordinary(text)
        assert np.frombuffer(ours.encode(text), "<i4").tolist() == want
        assert machine.decode(want) == text
    for _ in range(300):
        data = bytes(draw.randrange(256) for _ in range(draw.randrange(1, 25)))
        assert ours.transducer.encode(data) == ours.transducer.merge(data)
        assert machine.decode(ours.transducer.merge(data)) == data.decode("utf-8", "replace")
    long = "ab" * 20_000 + " " * 5_000 + "x"
    assert np.frombuffer(ours.encode(long), "<i4").tolist() == theirs.encode_ordinary(long)


@pytest.mark.parametrize("mark", ["'", " '", ".", "\n'"])
def test_bpe_of_a_mark_and_every_word(ranks, mark):
    theirs, mine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for token in ranks:
        text = mark + token.decode("utf-8", "ignore")
        assert np.frombuffer(mine.encode(text), dtype="<i4").tolist() == theirs.encode_ordinary(text), text


def test_bpe_names_that_are_taken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "a b", 5, "d")], "doc_id bigint, text string, ids int, decoded string")
    made = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, ids="_ids")
    assert made.columns == ["doc_id", "ids", "decoded", "_ids", "_decoded"] and made.first()["_decoded"] == "a b"


def test_decoding_in_any_cuts(ranks):
    machine = bpe.Utf8Machine({r: t for t, r in ranks.items()})
    ids = [ranks[bytes([b])] for b in "é日😀x".encode()]
    for cut in range(len(ids)):
        first, pending = machine.feed(ids[:cut])
        rest, end = machine.feed(ids[cut:], pending)
        assert "".join(first + rest) == "é日😀x" and end == b""


def test_lists_of_a_slice():
    lists = pa.array([[1], None, [], [2, 3], [4, 5, 6], None, [7]], pa.list_(pa.int32()))
    for at in range(8):
        assert bpe.lists_of(lists.slice(at, 4)) == [x or [] for x in lists.slice(at, 4).to_pylist()]
    hidden = pa.ListArray.from_arrays(pa.array([0, 2, 3], pa.int32()), pa.array([8, 9, 1], pa.int32()), mask=pa.array([True, False]))
    assert bpe.lists_of(hidden) == [[], [1]]


def test_bpe_of_odd_rows(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path)
    assert sorted(map(str, back.select("doc_id", "decoded", "_draw").collect())) == sorted(
        map(str, odd.select("doc_id", F.coalesce("text", F.lit("")).alias("decoded"), "_draw").collect())
    )
    assert bpe.decode(bpe.encode(none, path, public_tokenizers.PATTERN), path).count() == 0
