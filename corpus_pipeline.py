"""The corpus pipeline: quality rules, quality classifier, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Rows, in every stage: other columns, however they are called, are carried along and play no part; an empty table gives an
empty one; texts of any length are read whole. What a stage does with nulls, blank texts, ties and repeated rows, its
docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import crf, lines, packing, rules, simhash
from loomline.llm.common import reread, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity band reject go.

    Null, blank and short texts go. A null language is a language of its own. Rows that repeat language and text share a
    verdict and all stay or go; a measure on a band's edge is inside."""
    return rules.keep_good(spark, docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half go; trained on labelled rows of what is left.

    A null text is an empty one and is scored as such; a score of one half stays; repeated rows share a score. Labels of
    null ids or values are ignored; without labels of both kinds the share of good ones is everyone's score."""
    return crf.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; documents stay, with n_chars counted anew.

    The first occurrence is that of the smallest doc_id, of one id the smallest hash of the text, then the earliest line;
    null ids come last. A null text stays null, a text without three lines as it is; rows that repeat id and text are
    changed alike."""
    return lines.cleaned(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id.

    Of several rows of that id the one whose content hashes lowest stays; different texts of one id that are no near copies
    all stay. Rows equal in all columns are copies. Rows with a null id all stay. Null and blank texts are copies of one
    another; a text of fewer than five words is one shingle."""
    return simhash.keep_one(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: a row a piece.

    A null or empty text is the end id alone; rows that repeat an id, and null ids, are packed like any other."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packed)]

#: No SQL expresses a Kneser-Ney model, a trained field or a vocabulary's ids: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = reread(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
