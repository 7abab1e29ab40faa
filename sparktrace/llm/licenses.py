"""Operator 13: licence scans.

Notice phrases are sequences of words (digits, letters and characters beyond ASCII; A to Z lower-cased). A text's words are joined by
one blank and an Aho-Corasick automaton over all phrases finds every place where the words of one stand consecutively. A second automaton finds
identifier tags (``SPDX-License-Identifier:``, ``License:`` and the like) in the text itself; what follows on the line is read as an
expression of licence ids with ``and``, ``or``, ``with`` and brackets by a shunting-yard parser, which takes the longest expression
of known licences (``LicenseRef-...`` is known) and evaluates it.

Every licence has a strictness from 0 to 1. ``and`` takes the greater, ``or`` the smaller one of its sides, an exception after
``with`` halves what is asked beyond the mention of the authors. ``score`` is the greatest strictness of all notices and expressions
of the document, 0 without any. Base phrases count at every place and always give their label. Of other phrases that begin at one
place the longest counts.

Null, empty and wordless texts: no words, no labels (empty strings), score 0. Texts of any length are scanned whole. Repeated rows get
equal results. Other columns are kept, the text is not; new columns get underscores in front if their names are taken. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparktrace.llm.common import folded_words, fresh, pairs, table

#: Strictness of what a licence asks for.
FREE, NOTICE, WEAK, STRONG, NETWORK, CLOSED = 0.1, 0.2, 0.5, 0.8, 0.9, 1.0

#: Phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Phrases of this operator.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mit license": "mit",
    "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}

#: Licence families by the beginning of an id; the longest that fits counts.
FAMILIES = {
    "0bsd": FREE, "cc0": FREE, "unlicense": FREE, "wtfpl": FREE, "apache": NOTICE, "artistic": NOTICE, "bsd": NOTICE, "bsl": NOTICE,
    "cc-by": NOTICE, "isc": NOTICE, "mit": NOTICE, "postgresql": NOTICE, "python": NOTICE, "zlib": NOTICE, "cddl": WEAK, "epl": WEAK,
    "lgpl": WEAK, "mpl": WEAK, "ofl": WEAK, "cc-by-sa": STRONG, "eupl": STRONG, "gpl": STRONG, "odbl": STRONG, "agpl": NETWORK,
    "sspl": NETWORK, "all-rights-reserved": CLOSED, "cc-by-nc": CLOSED, "cc-by-nc-nd": CLOSED, "cc-by-nc-sa": CLOSED, "cc-by-nd": CLOSED,
    "licenseref": CLOSED,
}

#: Tags before an expression. All hold ``licen``.
TAGS = ("spdx-license-identifier", "license-identifier", "license", "licence")

_AFTER_TAG = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
_STRENGTH = {"with": 3, "and": 2, "or": 1}


def label(name: str) -> str | None:
    """Label of a licence id: its family and version without ``.0`` and without only/later, or None if no family is known.

    Creative Commons licences have no version in their labels.
    """
    name = re.sub(r"(\+|-only|-or-later)$", "", name.lower())
    if name.startswith("licenseref-"):
        return name
    if name.startswith("cc"):
        name = re.sub(r"-\d[\d.]*(-[a-z]+)?$", "", name)
        return name if name in FAMILIES else None
    return re.sub(r"(\.0)+$", "", name) if family(name) else None


@lru_cache(maxsize=4096)
def family(name: str) -> str | None:
    """The longest family that is the id or its beginning up to a hyphen."""
    parts = name.split("-")
    return next((head for n in range(len(parts), 0, -1) if (head := "-".join(parts[:n])) in FAMILIES), None)


def strictness(of: str) -> float:
    if "-with-" in of:
        return excepted(strictness(of.partition("-with-")[0]))
    return FAMILIES[family(of)]


def excepted(value: float) -> float:
    """What is left of a strictness when an exception is granted."""
    return NOTICE + (value - NOTICE) / 2 if value > NOTICE else value


def evaluate(text: str) -> tuple[frozenset[str], float] | None:
    """(labels, strictness) of the longest licence expression at the beginning of a line, or None without a known licence.

    Shunting-yard: operands and operators wait on two stacks; an operator first applies those that bind as strongly or more.
    Whenever the tokens so far can end an expression outside all brackets, that is the longest one yet.
    """
    values: list[tuple[frozenset[str], float, str]] = []
    operators: list[str] = []
    found, at, operand_next = None, 0, True

    def apply(values: list, operator: str) -> None:
        right, left = values.pop(), values.pop()
        if operator == "with":
            named = f"{left[2]}-with-{right[2]}"
            values.append((left[0] - {left[2]} | {named}, excepted(left[1]), named))
        else:
            values.append((left[0] | right[0], max(left[1], right[1]) if operator == "and" else min(left[1], right[1]), ""))

    text = text.lower()
    while token := _TOKEN.match(text, at):
        word, at = token[1], token.end()
        if word == "(":
            if not operand_next:
                break
            operators.append(word)
            continue
        if word == ")":
            if operand_next or "(" not in operators:
                break
            while operators[-1] != "(":
                apply(values, operators.pop())
            operators.pop()
        elif word in _STRENGTH:
            # An exception belongs to one licence.
            if operand_next or (word == "with" and not values[-1][2]):
                break
            while operators and operators[-1] != "(" and _STRENGTH[operators[-1]] >= _STRENGTH[word]:
                apply(values, operators.pop())
            operators.append(word)
            operand_next = True
            continue
        else:
            if not operand_next:
                break
            word = word.rstrip(".-")
            if operators and operators[-1] == "with":
                values.append((frozenset(), 0.0, re.sub(r"(\.0|-\d[\d.]*)+$", "", word)))
            else:
                known = label(word)
                if known is None:
                    break
                values.append((frozenset([known]), strictness(known), known))
            operand_next = False
        if "(" not in operators:
            ended = list(values)
            for operator in reversed(operators):
                apply(ended, operator)
            found = ended[0][0], ended[0][1]
    return found


@lru_cache(maxsize=1)
def _phrases() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase, name in {**NOTICES, **BASE}.items():
        made.add_word(f" {phrase} ", (len(phrase) + 2, name, phrase in BASE))
    made.make_automaton()
    return made


@lru_cache(maxsize=1)
def _tags() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for tag in TAGS:
        made.add_word(tag, len(tag))
    made.make_automaton()
    return made


def expressions(text: str) -> list[tuple[frozenset[str], float]]:
    """Values of all licence expressions behind a tag. A tag that ends another one is read once."""
    found = []
    lowered = text.encode().lower()
    if b"licen" not in lowered:
        return found
    lowered = lowered.decode("latin-1")
    for end in sorted({end for end, _ in _tags().iter(lowered)}):
        if sign := _AFTER_TAG.match(lowered, end + 1):
            line = lowered.find("\n", sign.end())
            value = evaluate(lowered[sign.end() : line if line >= 0 else len(lowered)])
            if value:
                found.append(value)
    return found


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = folded_words(text)
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    base, places, longest = set(), [], {}
    word, counted = 0, 0
    for end, (length, name, is_base) in sorted(_phrases().iter(joined), key=lambda found: found[0] - found[1][0]):
        start = end - length + 1
        word, counted = word + joined.count(" ", counted, start), start
        if is_base:
            base.add(name)
            places.append(word)
        longest[start] = max(longest.get(start, (0, "")), (length, name))
    values = [(frozenset([name]), strictness(name)) for name in base | {name for _, name in longest.values()}]
    values += expressions(text or "")
    labels = set().union(*(v[0] for v in values))
    return (
        len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)),
        ",".join(sorted(labels)), max((v[1] for v in values), default=0.0),
    )


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
_KINDS = (T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.DoubleType())
_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def scan(docs: DataFrame, text: str = "text", names: tuple[str, ...] = NAMES) -> DataFrame:
    """The rows without their text, with the counts of words and base places, the labels and the score of each document."""
    kept = [f for f in docs.schema.fields if f.name != text]
    added = fresh(docs.drop(text), *names)
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in zip(added, _KINDS, strict=True))])

    def run(batches):
        for batch in pairs(batches):
            made = zip(*(scan_text(t) for t in batch.column(text).to_pylist()))
            columns = [pa.array(list(values), kind) for values, kind in zip(made, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
