"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``: a lost executor costs a reread, and no stage's plan holds
another's.  All but the last keep the columns of ``documents``.

In every stage, other columns may have any names, dots, quotes and those of the
operators' own columns included, and come through unchanged; an empty table
gives an empty table; rows without an id are documents like any other.  Texts
are taken whole, however long.  What a stage does with null and empty texts,
ties and repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import common, langid, neardup, packing, pii, repeats


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lie far from every language, or have no letter, go.

    Null and empty texts have no letter.  Rows that repeat are judged alike;
    of languages equally near, the first by name is taken.  Without any labelled
    row, every document goes.
    """
    return langid.accepted(docs, langid.fit(langid.learnable(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Null, empty and blank texts are nobody's duplicates and stay.  Rows that
    repeat id and text are one document, and one of them stays; an id that
    repeats with several texts keeps all of them if it is the smallest of its
    group.  Rows without an id stay.
    """
    return neardup.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that occur more than once are cut out of the texts.

    All occurrences go, in rows that repeat an id and text too, and a row that
    loses its whole text stays with an empty one.  Null texts stay null; texts
    shorter than such a string stay as they are.
    """
    return _counted(repeats.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to a mark of its kind.

    Spans that overlap are one run with one mark, so nothing that any of them
    covers is left.  Null and empty texts stay as they are; rows that repeat
    come out alike.
    """
    return _counted(pii.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, each with its place in a sequence.

    A null or empty text is one piece, its end token.  Rows that repeat are each
    packed on their own; ties in the order of pieces change no length.
    """
    parts = packing.pieces(docs, keep_ids=True).withColumn("row", F.monotonically_increasing_id())
    parts = common.written(parts, "pieces")
    # Packing has few tasks, which see lengths only; the ids join their places in many.
    return packing.pack(parts.drop("ids")).join(parts.select("row", "ids"), "row").drop("row")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The stages' models and suffix order have no SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables of the stages before it are removed on the way."""
    docs, sweep = common.table(spark, sf_dir, "documents"), common.sweeper(spark)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep()
    return docs
