"""The registered queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import oracles
from passagemill.llm.budget import BudgetState, update_budget
from passagemill.llm.encode import encode_corpus, reencode_edits
from passagemill.llm.language_id import document_languages, wrong_labels
from passagemill.llm.packing import pack
from passagemill.llm.pairs import broken_pairs
from passagemill.llm.quota import allocate, quota_sample, shortfalls, target_counts
from passagemill.llm.sentences import sentences
from passagemill.llm.stable import stable_sample
from passagemill.session import cut
from passagemill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "passages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "passages"), table(spark, sf_dir, "questions"))


def p3_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all passages, built from an empty state."""
    tables = (table(spark, sf_dir, t) for t in ("passages", "package", "dataset_catalog"))
    return update_budget(BudgetState.empty(spark), *tables).cube


def p3_token_budget_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals by signed deltas from another state, with additions, removals and another tokenizer in one step.

    The first state was counted by another tokenizer; of it remain the passages known by a day, while those loaded
    later stood at places that are gone since.
    """
    passages, packages, names = (table(spark, sf_dir, t) for t in ("passages", "package", "dataset_catalog"))
    late = F.col("loaded_at") >= F.lit("2025-10-01 00:00:00").cast("timestamp")
    moved = passages.withColumn("passage_idx", F.when(late, F.col("passage_idx") + (1 << 40)).otherwise(F.col("passage_idx")))
    first = update_budget(BudgetState.empty(spark), moved, packages, names, "byte_bpe_multi_50k")
    known = BudgetState(cut(first.counts), cut(first.docs), cut(first.cube))
    return update_budget(known, passages, packages, names).cube


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("questions", "package", "sample_targets"))
    return shortfalls(*tables).select("corpus_id", "question_type")


def p4_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("questions", "package", "sample_targets"))
    return allocate(target_counts(*tables)).drop("type_key")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("questions", "package", "sample_targets"))
    return quota_sample(*tables)


def p5_stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_sample(table(spark, sf_dir, "questions"), table(spark, sf_dir, "sample_specs"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_reencoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every document, encoded from what is known of it: how little of the text they encode."""
    return reencode_edits(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_labels(document_languages(table(spark, sf_dir, "documents")))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language or languages, with places and confidence."""
    return document_languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        p1_found, p2_found, p3_token_budget, p3_token_budget_update, p4_found, p4_quotas, p4_sample, p5_stable_sample, p6_ids, p6_reencoded, p7_containers, p8_found,
        p8_segments,
    )
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
