"""The corpus pipeline: language ID, line dedup, near-duplicate removal, repeat removal, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the columns of the documents they get.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm import langid, lines, packing, repeats, simhash
from sparktrace.llm.common import table
from sparktrace.session import cut

#: Documents whose language is less certain than this are rejected.
CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a certain language go; the others get the predicted language. The classifier is
    fitted on the documents that say their language."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit(docs.filter(remainder != 2))
    found = langid.identify(docs, model, lang_pred="_lang_pred", score="_lang_score")
    sure = found.filter((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_score") >= CERTAIN))
    return sure.withColumn("lang", F.col("_lang_pred")).select(*docs.columns)


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents share go; what is left of a document stays."""
    return _resized(lines.drop_common_lines(docs, n_lines="_n_lines", n_dropped="_n_dropped").select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (fingerprints of three-word shingles that differ in two bits or fewer) the document with the
    smallest id stays; of repeated rows of it, one. Rows without an id stay only where their whole group has none, one for each text."""
    groups = simhash.near_duplicates(docs).select("doc_id", "component_id")
    first = cut(groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())
    stay = docs.join(first.withColumnRenamed("doc_id", "_first"), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    return stay.dropDuplicates(["doc_id", "text"])


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go. A cut through a character leaves no part of it."""
    kept = repeats.remove_repeats(docs, n_bytes="_n_bytes", n_removed="_n_removed", n_spans="_n_spans", kept="_kept", as_text=True)
    return _resized(kept.withColumn("text", F.col("_kept")).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("near-duplicate removal", near_dedup),
    ("repeat removal", repeat_removal),
    ("packing", pack),
]

#: XXH64 numbers, the language model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
