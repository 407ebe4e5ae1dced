"""A pipeline from raw documents to a training mix, in stages written and read in between."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.llm import decontaminate, jaccard_join, language, line_dedup, mixing
from tillworks.llm.common import table
from tillworks.session import settle

#: least confidence in a document's language
CONFIDENCE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carries_all(stage: Stage) -> Stage:
    """A stage that keeps columns of any name: those not of a document travel in one column."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in docs.columns if c in COLUMNS]
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        packed = docs.select(
            *own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried_columns"))
        done = stage(spark, packed, sf_dir)
        return done.select(*[
            F.col(f"`{c}`") if c in own else F.col("carried_columns").getField(c).alias(c)
            for c in docs.columns])

    return run_stage


@carries_all
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang becomes the language found.

    The model learns from the labelled documents that are not held out. Documents without a
    letter, or whose language is found with less than CONFIDENCE, go. Where no document that may
    be learned from has a lang, there is nothing to judge by, and all documents stay as they are.
    """
    model = language.train(docs.filter(~language.held_out()))
    if not model[0]:
        return docs
    found = language.predict(docs, model, keep=True)
    sure = found.filter(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= CONFIDENCE))
    return sure.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@carries_all
def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that much of their source repeats; n_chars follows."""
    cleaned = line_dedup.drop_site_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn(
            "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


@carries_all
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id."""
    return jaccard_join.one_of_each(docs)


@carries_all
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, numbered in a last column, copy."""
    return mixing.mixed_rows(docs, mixing.n_words(F.col("text")))


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
]

#: a trained model and an iterative grouping are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order.

    Columns beside those of a document are kept under any name; a column copy stays, and the copies
    are then numbered in copy_. NULL sources are one source; documents without a doc_id are kept
    like others. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
