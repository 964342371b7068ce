"""Distinct questions of the packages, over all deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n "


def question_key(given: Column, position: Column) -> Column:
    """The identity of a question within its package: its id without surrounding spaces and case, else its position."""
    return F.lower(F.btrim(F.coalesce(given, position.cast("string")), F.lit(BLANKS)))


def type_key(kind: Column) -> Column:
    """Spellings of one type fall together: case, spaces, tabs, hyphens and underscores don't count."""
    return F.regexp_replace(F.lower(kind), r"[\s _-]+", "")


def distinct_questions(questions: DataFrame) -> DataFrame:
    """One row per (corpus_id, question_key): its type key, the first batch it came with and its smallest question_no.

    Deliveries of one question fall together by a plain aggregation, so a question delivered very often is reduced
    before the shuffle. Where spellings of several types were delivered, the smallest type key counts. A question
    whose type is null in all deliveries has a null type key; blank types count as null.
    """
    named = questions.select(
        "corpus_id",
        question_key(F.col("id"), F.col("source_index")).alias("question_key"),
        F.nullif(type_key(F.col("question_type")), F.lit("")).alias("type_key"),
        "batch_no",
        "question_no",
    )
    return named.groupBy("corpus_id", "question_key").agg(
        F.min("type_key").alias("type_key"),
        F.min("batch_no").alias("first_batch"),
        F.min("question_no").alias("question_no"),
    )


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts' texts only: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws("\u0001", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
