"""The corpus pipeline: five stages from documents to packed sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and is given all that the
stage before it kept. All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty table; further columns pass through, whatever their names; a null
doc_id or other null stays; rows that repeat are treated alike. A null or empty text is not toxic unless its shape says so, has
no lines to drop, is nobody's duplicate, is mixed by its posterior and has no tokens to pack (one row without a sequence).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import entries, line_dedup, mixing, near_dedup, packing, token_counts, toxicity
from larkspur.llm.common import lean, named, read, written


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The function, begun with what earlier stages left in the executors collected."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lean(spark)
        return function(spark, docs, sf_dir)

    return run


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like; n_chars follows the text."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else named(c) for c in like.columns])


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; so do documents that had lines dropped and have no word left."""
    kept = line_dedup.keep_lines(docs)
    kept = kept.where((F.col(kept.columns[-1]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _measured(kept, docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more over five-word shingles) stays."""
    return near_dedup.keep_one(docs, percent=80)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    return mixing.mixed(docs, read(spark, sf_dir, "labels"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence, in tokens of the model's vocabulary."""
    return packing.packed(docs, counter=token_counts.counter(spark, entries.token_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifiers and the packing cannot be written in SQL. Tests hold line_dedup and near_dedup against brute force, toxicity on
#: held-out labels, the rates of mixing against an independent solver, and packing against the library's token counts and a plain best fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
