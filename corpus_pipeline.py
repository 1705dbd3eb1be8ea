"""Corpus pipeline: each stage works on all that its predecessor kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All
but the last return the columns of ``documents``, and further columns of ``docs`` if it
has some, whatever their names; the last returns bins of tokens. Every stage takes an
empty table and gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import decontaminate, lines, packing, quality, simhash
from tidepanel.llm.common import cut, discard, table, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule or host verdict rejects.

    NULL, empty and wordless texts go; rows without an id are judged like any other, rows
    without a source as one host; repeated rows are judged and counted each.
    """
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the recurring lines of other documents.

    A document of which no line is left goes; rows without id or text stay as they are;
    repeated rows and ids count as one document and are cut alike.
    """
    return lines.drop_recurring(docs).drop("n_dropped")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the lowest id, of each group of near duplicates.

    Rows without an id or without words stay; of a repeated row one stays; the texts of
    an id that has several are judged one by one.
    """
    return simhash.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Rows are judged by their text, with or without an id; NULL and empty texts stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins filled with the tokens of all documents' pieces, by planned slots.

    Rows without an id, or without tokens, get no slot; repeated rows are packed each.
    """
    return packing.sequences(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Templates of lines and best-fit packing are iterative: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a table in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with temporary() as made:  # a stage's own tables go with its input once its result is written
            docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.pop()
        if before is not None:
            discard(before)
        before = docs
