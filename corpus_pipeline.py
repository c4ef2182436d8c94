"""The training-data pipeline: five stages over ``documents``, each written and read again as Parquet.

toxicity drops documents that the subword model calls toxic; near_duplicates keeps one
document of each component of the n-gram Jaccard join;
substring_dedup removes repeated windows of words (and documents that lose all); decontamination
drops documents that hold a benchmark item; tokens encodes what is left.

All stages: a null or empty text is a document like others, and never toxic unless the model's bias says so, a duplicate, or a
leak; very long texts are read whole; an empty table gives an empty one; columns of any other name pass through unread, whatever they
are called, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm import bpe, decontaminate, jaccard_join, substring_dedup, toxicity
from brontide.llm.shared import materialize, table


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``docs`` has such a column."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents under 0.5, by a model that learns from the labels of the documents it is given.

    Repeated rows share their fate; without labels of both classes every document stays.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "toxicity")
    return toxicity.score(docs, *model, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, the document of its least doc_id.

    Rows of one doc_id are one document: the one of least text stays, a null text only if there is no other. Rows without
    doc_id can't be told from each other and stay.
    """
    table(spark, sf_dir, "documents")
    verdict = jaccard_join.joined(docs).where("doc_id IS NOT NULL")
    # Ids alone, written before any text is read again: only one join passes whole texts, and nothing of the search runs beside it.
    marks = verdict.groupBy("doc_id").agg(F.bool_or(F.expr("component_id <> doc_id")).alias("gone"), F.count("*").alias("n"))
    marks = materialize(marks.where("gone OR n > 1").select("doc_id", "gone"), "marks")
    kept = docs.join(marks.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = marks.where("NOT gone").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = again.groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), "text")).alias("row")).select("row.*")
    return kept.unionAll(least)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of 50-word windows that start in a document of smaller doc_id too; drops a document that loses all its words.

    A text that loses words becomes its kept words joined by spaces; rows of one doc_id don't
    remove each other's words, and those of a null doc_id give way to all others.
    """
    table(spark, sf_dir, "documents")
    return substring_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item within its edit budget; an empty benchmark drops none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded bytes of each row; a null text has no token."""
    table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("tokens", encode),
]

#: SQL can't express the trained model, the merge order of BPE or edit budgets; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
