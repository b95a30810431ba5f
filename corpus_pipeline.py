"""A training corpus from raw documents: quality rules, near duplicates, personal data, mixing, packing.

Every stage takes all that the one before kept.  Stages but the last return the columns of documents,
others that are there included, also where their names are those that an operator uses itself; the last returns
token pieces with their places in sequences.  In every stage a null text is empty, a very long text is taken as a
whole, and an empty table gives an empty one; what else is defined stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm.common import stored, table
from tarnfold.llm.mixing import mixed
from tarnfold.llm.neardup import one_of_each
from tarnfold.llm.packing import pack, pieces
from tarnfold.llm.pii import cleaned
from tarnfold.llm.quality import kept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the base rules or, on the strictness of their host, the others go.

    Null and empty texts have no words and go.  A null source is a host of its own.  Repeated rows and ties of
    doc_id are judged each, by their own text, and hosts with equal rates alike.
    """
    return kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least doc_id.

    A null doc_id comes after all others.  Null and empty texts are one class.  Of repeated rows one stays; of rows
    that tie in doc_id and text but differ elsewhere, the one whose hash is least.
    """
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become marks.

    A null text stays null; n_chars is counted again where the text is there.  Repeated rows and ties of doc_id are
    cleaned each.  No row goes.
    """
    return cleaned(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for: not at all, once or twice.

    A document that the mix takes in part stays if that is half of it or more.  A null source is a source of its own,
    sorted last.  Texts without a word are taken no time, as there is nothing to take.  Rows that are equal in all
    columns are interchangeable; rows that tie in doc_id, source and size only are ordered by a hash of the whole row.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset.

    A null or empty text is its end token alone.  Repeated rows and ties of doc_id are packed each; pieces that tie in
    all that orders them are interchangeable.
    """
    return pack(stored(pieces(docs), "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the signatures' stage or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
