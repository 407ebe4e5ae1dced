"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillworks.llm import (
    chat_format,
    decontaminate,
    exact_copies,
    filter_audit,
    fingerprint,
    jaccard_join,
    language,
    language_model,
    line_dedup,
    mixing,
    passages,
    periodic_runs,
    pseudonyms,
)
from tillworks.llm.common import table


def _documents(operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string")
    stored = table(spark, sf_dir, "conversations").select(*extra.columns)
    return chat_format.digest(stored.unionByName(extra))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents are turned into repeats first, then all are searched."""
    return periodic_runs.run_digests(
        periodic_runs.planted(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_fingerprint": _documents(fingerprint.fingerprint_all),
    "op3_jaccard_join": _documents(jaccard_join.join_all),
    "op4_language_model": _documents(language_model.score_all),
    "op5_language": _documents(language.identify),
    "op6_passages": _documents(passages.passages_of_documents),
    "op7_pseudonyms": _documents(pseudonyms.pseudonymise_all),
    "op8_line_dedup": _documents(line_dedup.clean_lines),
    "op9_mixing": _documents(mixing.taken_words),
    "op10_chat_format": op10_chat_format,
    "op11_filter_audit": filter_audit.audit,
    "op12_exact_copies": _documents(exact_copies.copy_groups),
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_mixing": mixing.SQL,
    "op10_chat_format": chat_format.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_exact_copies": exact_copies.SQL,
}
