"""Operator 5: language identification by words first, then by ever shorter character n-grams.

A word known from the labelled rows scores its log frequency in each language. An unknown word backs off: its character n-grams
of the greatest length of which any is known score their mean log frequency; lengths go down to single characters, and a word of
unknown characters says nothing. A document's scores are the sums over its words (runs of letters, lower case); the language is
the greatest sum, ties to the smaller name, and the score its share after exponentiation (0 to 1).

The classifier is fitted on a sample of the labelled rows: about ``TRAIN_ROWS`` documents of each language, those with the
smallest hashes of their ids. The model keeps the ``MAX_WORDS`` most frequent words and ``MAX_GRAMS`` most frequent n-grams (that
bounds what is broadcast); everything else covers all rows.

``und`` with score 0: null text, text without a letter, and all texts if nothing was learned. A null id is never learned from and
not held out. Repeated rows are predicted each for itself; whole texts are read whatever their length; extra columns are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrace.llm.common import pairs, table

TRAIN_ROWS = 4_000
MAX_WORDS = 150_000
MAX_GRAMS = 150_000
LONGEST = 5
UNKNOWN = "und"
SMOOTHING = 0.5
REMEMBERED = 150_000
#: Unknown words of more letters are scored each time.
LONG = 64

words_of = regex.compile(r"\p{L}+").findall


def grams_of(word: str, length: int) -> list[str]:
    """N-grams of a word with its borders marked; single characters without the marks."""
    if length == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + length] for i in range(len(marked) - length + 1)]


class Model:
    """Log frequencies of words and n-grams: ``index`` gives a row of ``scores`` (one column per language)."""

    def __init__(self, langs: list[str], words: list[tuple], grams: list[tuple]):
        """``words`` and ``grams``: (text, count in each language)."""
        self.langs = langs
        self.words, self.word_scores = self._table(words)
        self.grams, self.gram_scores = self._table(grams)

    @staticmethod
    def _table(rows: list[tuple]) -> tuple[dict[str, int], np.ndarray]:
        if not rows:
            return {}, np.zeros((0, 0))
        counts = np.array([r[1:] for r in rows], dtype=np.float64) + SMOOTHING
        return {r[0]: i for i, r in enumerate(rows)}, np.log(counts / counts.sum(axis=0))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known = len(model.words)
        self.room = self.known + REMEMBERED
        self.scores = np.zeros((self.room + 1, len(model.langs)))
        self.scores[: self.known] = model.word_scores
        scorer = self

        class Rows(dict):
            def __missing__(self, word: str) -> int:
                at = scorer.used
                scorer.scores[at] = scorer.backed_off(word)
                self[word] = at
                scorer.used += 1
                if scorer.used == scorer.room:
                    raise OverflowError
                return at

        self.rows_type = Rows
        self._start()

    def _start(self) -> None:
        self.rows, self.used = self.rows_type(self.model.words), self.known

    def backed_off(self, word: str) -> np.ndarray:
        grams = self.model.grams
        for length in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [grams[g] for g in grams_of(word, length) if g in grams]
            if found:
                return self.model.gram_scores[found].mean(axis=0)
        return np.zeros(len(self.model.langs))

    def sums(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(self.model.langs))
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            if max(map(len, some)) > LONG:  # a script without blanks gives words of any length: they are not remembered
                for word in some:
                    if len(word) > LONG:
                        known = self.rows.get(word)
                        total += self.backed_off(word) if known is None else self.scores[known]
                some = [word for word in some if len(word) <= LONG]
            for _ in range(2):
                try:
                    rows = list(map(self.rows.__getitem__, some))
                    break
                except OverflowError:  # the memory of unknown words is full: it starts anew
                    self._start()
            total += self.scores[rows].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of((text or "").lower())
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        total = self.sums(words)
        share = np.exp(total - total.max())
        return self.model.langs[int(total.argmax())], float(1 / share.sum())


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from the rows with a language; ``by`` decides which of them belong to the sample."""
    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(by).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(by).alias("draw")
    )
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], [])
    share = reduce(lambda when, l: when.when(F.col("lang") == l, F.lit(min(1.0, train_rows / sizes[l]))), langs, F.when(F.lit(False), F.lit(0.0)))
    sample = labelled.filter((F.col("draw").cast("double") / 2.0**64 + 0.5) <= share).select("lang", "text")

    def count_words(batches):
        from collections import Counter

        for batch in pairs(batches):
            counts: dict[str, Counter] = {}
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(l, Counter()).update(words_of(t.lower()))
            rows = [(l, w, n) for l, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    def count_grams(batches):
        from collections import Counter

        for batch in batches:
            counts: Counter = Counter()
            for l, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for length in range(1, min(LONGEST, len(w) + 2) + 1):
                    for g in grams_of(w, length):
                        counts[(l, g)] += n
            rows = [(*k, n) for k, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    def most_frequent(counts: DataFrame, most: int, least: int) -> list[tuple]:
        wide = counts.groupBy("word").agg(F.sum("n").alias("all_n"), *(F.coalesce(F.sum(F.when(F.col("lang") == l, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, l in enumerate(langs)))
        best = wide.filter(F.col("all_n") >= least).orderBy(F.desc("all_n"), "word").limit(most)
        return [tuple(r) for r in best.drop("all_n").collect()]

    counts = sample.mapInArrow(count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = counts.mapInArrow(count_grams, "lang string, word string, n bigint")
    return Model(langs, most_frequent(counts, MAX_WORDS, 2), most_frequent(grams, MAX_GRAMS, 2))


def identify(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with predicted language and score added."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_WORDS and MAX_GRAMS
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType(), False), T.StructField(score, T.DoubleType(), False)])

    def run(batches):
        scorer = Scorer(shipped.value)
        for batch in pairs(batches):
            found = [scorer.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[f.name for f in schema.fields],
            )

    return docs.mapInArrow(run, schema)


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.filter(remainder != 2))
    rows = docs.select("doc_id", "text", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"))
    return identify(rows, model).drop("text")
