"""Input packages as folders: questions, passages, and a manifest of what they were made from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.text import word_count
from passagemill.sources.files import exists, read_text, write_text
from passagemill.sources.inputs import PackageError

#: What a package that is there already has to share with one that would be written in its place.
MUST_AGREE = ("source_dataset", "seed", "question_ids", "source_question_indices", "source_questions_mark", "source_chunks_mark", "corpus_scope")


def manifest_of(questions: DataFrame, passages: DataFrame, **stated: object) -> dict[str, object]:
    """What is stated about a package and what Spark counts in it."""
    found = passages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("passage").cast("bigint")), F.lit(0)).alias("chars"), F.coalesce(F.sum(word_count(F.col("passage"))), F.lit(0)).alias("words")).first()
    statistics = {"question_count": questions.count(), "passage_count": found["n"], "character_count": found["chars"], "word_count": found["words"]}
    return {**stated, "statistics": statistics}


def save_package(spark: SparkSession, folder: str, questions: DataFrame, passages: DataFrame, manifest: dict[str, object]) -> bool:
    """Writes a package, its manifest last, so that a folder with one is whole. True if it was written.

    A package that is there already is used again if it agrees in MUST_AGREE, and is an error otherwise.
    """
    record = f"{folder}/manifest.json"
    if exists(spark, record):
        there = json.loads(read_text(spark, record))
        differ = [k for k in MUST_AGREE if there.get(k) != json.loads(json.dumps(manifest.get(k)))]
        if differ:
            raise PackageError(f"{folder} holds another package: {', '.join(differ)}")
        return False
    questions.write.mode("overwrite").parquet(f"{folder}/questions")
    passages.write.mode("overwrite").parquet(f"{folder}/passages")
    write_text(spark, json.dumps(manifest, ensure_ascii=False, indent=1), record)
    return True


def open_package(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[str, object]]:
    """Questions, passages and manifest of a package; an error if what is there isn't what was counted."""
    if not exists(spark, f"{folder}/manifest.json"):
        raise PackageError(f"{folder} holds no whole package")
    manifest = json.loads(read_text(spark, f"{folder}/manifest.json"))
    questions, passages = spark.read.parquet(f"{folder}/questions"), spark.read.parquet(f"{folder}/passages")
    if manifest_of(questions, passages)["statistics"] != manifest.get("statistics"):
        raise PackageError(f"{folder} doesn't hold what its manifest counts")
    return questions, passages, manifest
