"""New texts as a stream: each content is taken in once, and a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill.functions.text import content_id
from passagemill.sources.sinks import append_missing


def passage_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files that arrive in a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def upsert_texts(
    stream: DataFrame, store: str, checkpoint: str, namespace: str = "passage", text: str = "passage", derive: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Appends texts that the store lacks, by content; ``derive`` adds what is computed for new texts only.

    Batches that run again after a failure append nothing twice, since keys are looked up before each append.
    """

    def take(batch: DataFrame, _: int) -> None:
        rows = batch.filter(F.col(text).isNotNull()).select(content_id(namespace, F.col(text)).alias("hash_id"), F.col(text).alias("text"))
        append_missing(rows, store, "hash_id", derive)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_arrivals(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows of each package by hour of loading; rows later than the watermark are left out."""
    return stream.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", "1 hour"), "corpus_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "corpus_id", "n")
