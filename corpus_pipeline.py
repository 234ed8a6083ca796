"""A corpus pipeline over ``documents``.

``STAGES`` lists (name, function) pairs.  A function takes (spark, docs, sf_dir)
and returns a DataFrame; what it returns is written as Parquet and read again as
the next one's ``docs``.  All stages but the last return the columns of
``documents``, whatever further columns came in; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunder.llm import line_dedup, mixing, ngram_join, quality_rules, sentencepiece
from sunder.plans.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Near copies: documents that share this percentage of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of ``documents``, from an operator's text and what it carried."""
    return rows.select("doc_id", "text", "carry.lang", "carry.source", F.length("text").cast("long").alias("n_chars"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that the rules reject, null and empty texts among them; rows are judged one by one, whatever their ids."""
    return _documents(quality_rules.line_first_quality(docs, with_text=True, carry=("lang", "source")).where("kept"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; every row stays, a null text null.  Rows that share an id or have none are documents of their own."""
    return _documents(line_dedup.dedup_lines(docs, carry=("lang", "source")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, that with the smallest id (rows without an id come last); rows without a word all stay."""
    return _documents(ngram_join.first_of_components(docs, NEAR_WORDS, NEAR_PERCENT, carry=("lang", "source")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, null sources as one source; rows without a word are not taken."""
    return _documents(mixing.mixed_rows(docs, carry=("lang",)))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row's text, null for a null one."""
    return sentencepiece.encode_texts(docs)


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_copies),
    ("mix_sources", mix),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, out = out, stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = scratch.keep(out)
            if k:
                scratch.drop(before)
    return out


#: The rounding of the mix and the pieces are not for SQL; tests compare with brute force.
ORACLE_SQL = None
