"""Fill-in-middle, ranked lexical search and licence scans, against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktrace.llm import lexical, licenses, middle

DOCS = "doc_id bigint, text string"


# --- fill in middle -----------------------------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


PARTS = [" ", "\t", "\n", "\x0b", "\x0d", "\x1f", "\x85", " ", "a", "Zz", "é", "漢字", "😀", "<", "<P", "P>", "\x00", "word", "\x7f", "̠"]


def middle_rows():
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(0, 40))) for _ in range(600)]
    texts += [None, "", " ", "\n\n", "x", " x ", "<P> a b c", "a <S> b", "a <M>", "a\x20" * 70_000, "é" * 9000 + " b c", "same text here"] + ["same text here"] * 3
    return list(enumerate(texts)) + [(None, "no id at all"), (7, "twice the id")] * 2


def test_middle_equals_brute_force(spark):
    made = middle.transform(spark.createDataFrame(middle_rows(), DOCS).repartition(3))
    rows = made.withColumn("back", middle.restored()).collect()
    assert len(rows) == len(middle_rows())
    forms = collections.Counter()
    for row in rows:
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == plain_middle(row["doc_id"], row["text"])
        assert row["back"] == (row["text"] or "")
        forms[row["form"]] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 30


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \t\n\x0b\x0c\r\x08\x0e\x1f!aé漢😀\x7f \x85\x00"), max_size=30), min_size=1, max_size=6), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_equal_regular_expression(texts, h1, h2):
    data = [t.encode() for t in texts]
    last = np.cumsum([len(d) for d in data])
    first = last - [len(d) for d in data]
    found = middle.cuts(np.frombuffer(b"".join(data), dtype=np.uint8), first, last, np.full(len(data), h1), np.full(len(data), h2))
    for text, at, n, a, b, prefix, between in zip(texts, first, *found, strict=True):
        units = UNIT.findall(text)
        one, two = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m = "".join(units[:one]), "".join(units[one:two])
        assert (n, a - at, b - at, prefix, between) == (len(units), len(p.encode()), len((p + m).encode()), len(p), len(m))


def test_middle_empty_and_clashing_names(spark):
    schema = "doc_id bigint, text string, n int, form string, h1 string, output int"
    assert middle.transform(spark.createDataFrame([], schema)).collect() == []
    made = middle.transform(spark.createDataFrame([(1, "a b c", 9, "f", "h", 3)], schema))
    assert made.columns == ["doc_id", "text", "n", "form", "h1", "output", "_n", "_form", "prefix_chars", "middle_chars", "_output"]
    row = made.withColumn("back", middle.restored("_output", "_form")).first()
    assert (row["n"], row["form"], row["h1"], row["output"], row["_n"], row["back"]) == (9, "f", "h", 3, 3, "a b c")


# --- ranked lexical search ----------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, k):
    split = [(d, collections.Counter(plain_terms(t))) for d, t in docs]
    split = [(d, c) for d, c in split if c]
    n_docs, n_terms = len(split), sum(sum(c.values()) for _, c in split)
    df = collections.Counter(t for _, c in split for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for d, c in split:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    pool = [f"w{int(draw.paretovariate(0.7)) % 400}" for _ in range(600)] + ["É", "ß", "naïve", "漢字", "A1", "x_y", "don't"]
    texts = [" ".join(draw.choice(pool) for _ in range(int(draw.paretovariate(0.8)) % 300)) for _ in range(n)]
    return texts + ["w1 w2 W3."] * 90 + [None, "", "?! _", "w1 " * 30_000, "a1 É"]


@pytest.mark.parametrize("options", [{}, {"shard_docs": 17}, {"shard_postings": 300, "block_terms": 40}, {"max_terms": 3}, {"k": 3, "shard_docs": 50}])
def test_ranks_equal_brute_force(spark, options):
    docs = [(i, t) for i, t in enumerate(corpus(3, 400))]
    docs += [(None, "w1 w2 w3"), (5, "w7 w8 twice"), (5, "w7 w8 twice")]
    items = [(i, t) for i, t in enumerate(corpus(8, 25)[:30])] + [(90, "W3 w3 w1"), (91, None), (92, "nowhere"), (93, "naïve 漢字"), (None, "w2 w9"), (94, "w7 w8 w7")]
    made = lexical.rank(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id bigint, text string"), item_text="text", **options)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in made.collect()), key=str) == plain_ranks(docs, items, options.get("k", 50))


def test_ranks_of_repeated_items_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (2, "b c", 5, 6), (3, "d", 5, 6), (4, "e", 5, 6)], "doc_id bigint, text string, rank int, item int")
    items = spark.createDataFrame([("x", "B", 1), ("x", "b", 1)], "item_id string, text string, term int")
    made = lexical.rank(docs, items)
    assert sorted(made.select("item_id", "rank", "doc_id").collect()) == [("x", 1, 1), ("x", 1, 1), ("x", 2, 2), ("x", 2, 2)]
    assert lexical.rank(docs.limit(0), items).collect() == []
    assert lexical.rank(docs, items.limit(0)).collect() == []


def test_treap_keeps_every_cell():
    draw = np.random.default_rng(4)
    for rows, cols, spread in ((1, 1, 0), (1, 500, 6), (300, 7, 2), (200, 300, 0), (90, 1000, 12)):
        codes = np.unique(draw.integers(0, rows * cols, size=rows * cols // 3 + 1))
        row, col, impact = codes // cols, codes % cols, draw.integers(1, 10**6, size=len(codes))
        treap = lexical.Treap(*lexical.build_treap(row, col, impact, spread))
        ids = np.arange(cols) * 3
        asked = np.unique(draw.integers(0, rows, size=5))
        weights = draw.integers(1, 9000, size=len(asked))
        scores = np.zeros(cols, dtype=np.int64)
        for r, w in zip(asked, weights, strict=True):
            np.add.at(scores, col[row == r], w * impact[row == r])
        best = sorted(((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s > 0))[:20]
        for together in (1, 8, 256):
            found = lexical.search(treap, ids, asked, weights, 20, spread=spread, together=together)
            assert list(zip((-found[0]).tolist(), found[1].tolist(), strict=True)) == best


def test_search_opens_few_ranges(monkeypatch):
    """A document that stands out is found without opening most of the grid."""
    draw = np.random.default_rng(1)
    row, col = (x.ravel() for x in np.meshgrid(np.arange(8), np.arange(4096), indexing="ij"))
    impact = draw.integers(1, 1000, size=len(row))
    impact[col == 1234] = 10**6
    treap, opened = lexical.Treap(*lexical.build_treap(row, col, impact)), []
    monkeypatch.setattr(treap, "halves", lambda cells, bits, halves=treap.halves: opened.append(len(cells)) or halves(cells, bits))
    scores, ids = lexical.search(treap, np.arange(4096), np.arange(8), np.ones(8, dtype=np.int64), 1, together=1)
    assert ids.tolist() == [1234] and scores.tolist() == [8 * 10**6]
    assert sum(opened) < 0.02 * len(row)


# --- licence scans ------------------------------------------------------------------------------------------------------

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, name) for i in range(len(words)) for phrase, name in BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({n for _, n in places}))


def test_base_equals_brute_force(spark):
    draw = random.Random(2)
    pool = ["under", "the", "MIT", "license", "Apache", "license,", "version", "2", "2.0", "CC", "BY-NC", "by", "nc", "under the MIT license", "é", "_", "\x85", "x"]
    texts = [draw.choice(" \n-").join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(500)]
    texts += [None, "", "...", "cc by nc " * 50_000, "under the mit licenseé", "Under The Mit License"] + ["cc-by-nc cc by nc"] * 2
    made = licenses.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert len(made) == len(texts)
    for row in made:
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == plain_base(texts[row["doc_id"]])
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) | {""}
        assert row["labels"] == ",".join(sorted(set(row["labels"].split(",")))) and 0 <= row["score"] <= 1


@pytest.mark.parametrize("text, labels, score", [
    ("MIT", "mit", 0.2),
    ("mit OR gpl-2.0-only", "gpl-2,mit", 0.2),
    ("MIT AND GPL-3.0-or-later */", "gpl-3,mit", 0.8),
    ("MIT OR GPL-2.0 AND AGPL-3.0+", "agpl-3,gpl-2,mit", 0.2),
    ("(MIT OR GPL-2.0) AND AGPL-3.0", "agpl-3,gpl-2,mit", 0.9),
    ("GPL-2.0 WITH Classpath-exception-2.0", "gpl-2-with-classpath-exception", 0.5),
    ("(GPL-2.0 WITH x-1.0 OR MPL-2.0) AND ISC", "gpl-2-with-x,isc,mpl-2", 0.5),
    ("Apache-2.0 is fine", "apache-2", 0.2),
    ("MIT OR", "mit", 0.2),
    ("MIT OR unknown-9", "mit", 0.2),
    ("((MIT))", "mit", 0.2),
    ("LicenseRef-Acme.1", "licenseref-acme.1", 1.0),
    ("CC-BY-NC-SA-4.0 or CC0-1.0", "cc-by-nc-sa,cc0", 0.1),
])
def test_expressions(text, labels, score):
    found, strict = licenses.evaluate(text)
    assert (",".join(sorted(found)), strict) == (labels, score)


@pytest.mark.parametrize("text", ["", "unknown", "OR MIT", "(MIT", "MIT)", "with x", ")", "my own terms", "(MIT OR (GPL-2.0 AND ISC)", "(mit or isc) with x"])
def test_what_is_no_whole_expression(text):
    """Brackets that stay open hide what they hold; what came before them, or a closed part, stands."""
    found = licenses.evaluate(text)
    assert found is None or text in ("MIT)", "(mit or isc) with x")


def _value(tree):
    """Strictness and text of a random expression tree."""
    if isinstance(tree, str):
        return licenses.strictness(licenses.label(tree)), tree
    operator, left, right = tree
    (a, left), (b, right) = _value(left), _value(right)
    return (max if operator == "and" else min)(a, b), f"({left} {operator} {right})"


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.sampled_from(["MIT", "GPL-2.0", "MPL-2.0", "AGPL-3.0", "CC0-1.0", "CC-BY-NC-4.0"]), lambda t: st.tuples(st.sampled_from(["and", "or"]), t, t), max_leaves=12))
def test_bracketed_trees_keep_their_value(tree):
    value, text = _value(tree)
    assert licenses.evaluate(text)[1] == value


@pytest.mark.parametrize("text, labels, score", [
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "apache-2,mit", 0.2),
    ('{"license": "GPL-3.0-only"}', "gpl-3", 0.8),
    ("License: see the file\nnothing", "", 0.0),
    ("the license mit", "", 0.0),
    ("GNU General Public License, version 3", "gpl-3", 0.8),
    ("GNU General Public License.", "gpl", 0.8),
    ("Licensed under the Apache License, Version 2.0.", "apache-2", 0.2),
    ("license: MIT\nLicence = ISC\n", "isc,mit", 0.2),
    ("Released under the MIT License.", "mit", 0.2),
    ("plain prose", "", 0.0),
])
def test_labels(text, labels, score):
    assert licenses.scan_text(text)[-2:] == (labels, score)


def test_licenses_of_empty_tables_and_clashing_names(spark):
    schema = "doc_id bigint, text string, labels int, SCORE string"
    assert licenses.scan(spark.createDataFrame([], schema)).collect() == []
    made = licenses.scan(spark.createDataFrame([(1, "cc by nc", 5, "s")], schema))
    assert made.columns == ["doc_id", "labels", "SCORE", "n_words", "n_base", "first_word", "last_word", "base_labels", "_labels", "_score"]
    assert tuple(made.first()) == (1, 5, "s", 3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0)
