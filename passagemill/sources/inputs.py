"""Readers of package folders, checkpoints, logs and relations kept as files."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.text import numbered
from passagemill.sources.files import exists

QUESTION_SCHEMA = "id string, question string, answer string, question_type string, evidence array<string>"
FIXTURE_SCHEMA = "passages array<string>, question string, expected_answer string, adjustment_reason string"
USAGE_SCHEMA = "model string, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
EMBEDDING_SCHEMA = "hash_id string, text string, embedding array<float>"


class PackageError(ValueError):
    """A package that contradicts itself."""


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions with their source position; a null id becomes the position."""
    rows = _json_array(spark, path, f"array<struct<{_fields(QUESTION_SCHEMA)}>>")
    return rows.select(F.posexplode("rows").alias("source_index", "q")).select(
        F.coalesce("q.id", F.col("source_index").cast("string")).alias("question_id"), "source_index", "q.question", "q.answer", "q.question_type", "q.evidence"
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of texts as numbered passages: passage_idx, passage."""
    rows = _json_array(spark, path, "array<string>").select(F.posexplode("rows").alias("passage_idx", "chunk"))
    return rows.select("passage_idx", numbered(F.col("passage_idx"), F.col("chunk")).alias("passage"))


def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Questions and numbered passages of a folder with questions.json and chunks.json."""
    return read_questions(spark, f"{folder}/questions.json"), read_chunks(spark, f"{folder}/chunks.json")


def concat_chunks(parts: list[DataFrame]) -> DataFrame:
    """Several datasets' passages in the given order: dataset_no, passage_idx, passage."""
    named = [p.withColumn("dataset_no", F.lit(i)) for i, p in enumerate(parts)]
    return functools.reduce(DataFrame.unionByName, named)


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """A fixture of passages and one question: passage_idx, passage, question, expected_answer."""
    rows = spark.read.schema(FIXTURE_SCHEMA).json(path, multiLine=True)
    return rows.select(F.posexplode("passages").alias("passage_idx", "chunk"), "question", "expected_answer").select(
        "passage_idx", numbered(F.col("passage_idx"), F.col("chunk")).alias("passage"), "question", "expected_answer"
    )


def read_embeddings(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """An embedding store; ``namespace`` keeps ids that begin with it."""
    rows = spark.read.schema(EMBEDDING_SCHEMA).parquet(path)
    return rows if namespace is None else rows.filter(F.col("hash_id").startswith(f"{namespace}-"))


def usage_totals(spark: SparkSession, path: str) -> DataFrame:
    """Token sums of a JSON lines log; a missing file counts as zeros."""
    sums = [F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    if not exists(spark, path):
        return spark.range(0).select(F.lit(None).cast(USAGE_SCHEMA.split("usage ")[1]).alias("usage")).agg(*sums)
    return spark.read.schema(USAGE_SCHEMA).json(path).agg(*sums)


def usage_increment(before: DataFrame, after: DataFrame) -> DataFrame:
    """What two snapshots of totals, each one row, differ by."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    signed = after.select(*names).unionByName(before.select(*[(-F.col(c)).alias(c) for c in names]))
    return signed.agg(*[F.sum(c).alias(c) for c in names])


def pending(items: DataFrame, done: DataFrame, key: str, complete: F.Column) -> DataFrame:
    """Items without a complete result yet."""
    return items.join(done.filter(complete).select(key).distinct(), key, "left_anti")


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of each file of a folder: name, sha256, bytes."""
    rows = spark.read.format("binaryFile").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def check_package(passages: DataFrame, questions: DataFrame | None = None) -> None:
    """Raises PackageError if texts are empty, numbers repeat or are missing, or question ids repeat."""
    from passagemill.functions.text import leading_index

    index = leading_index(F.col("passage"))
    found = passages.agg(
        F.count("*").alias("n"), F.count_distinct(index).alias("numbers"), F.count_if(F.coalesce(F.trim("passage"), F.lit("")) == "").alias("empty")
    ).first()
    if found["empty"]:
        raise PackageError(f"{found['empty']} passages are empty")
    if found["numbers"] != found["n"]:
        raise PackageError("passage numbers repeat or are missing")
    if questions is not None:
        q = questions.agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("ids")).first()
        if q["n"] != q["ids"]:
            raise PackageError("question ids repeat")


def _fields(schema: str) -> str:
    return schema.replace(" string", ":string").replace(" array", ":array")


def _json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one bare JSON array, as an array column."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("rows"))
