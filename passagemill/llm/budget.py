"""How many tokens of text each source, language and domain holds, kept up to date by signed deltas."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.llm.languages import clean_code_column
from passagemill.llm.vocab import batch_encoder, tokenizer_hash

COUNTS = "content_hash string, tokenizer_hash string, n_tokens bigint"
DOCS = "corpus_id string, passage_idx bigint, content_hash string, source_dataset string, lang string, domain string, tokenizer_hash string"
CUBE = "source_dataset string, lang string, domain string, n_passages bigint, n_tokens bigint"
SLICE = ["source_dataset", "lang", "domain"]
#: What stands for a package without a source, a source that the catalogue lacks, and a passage without a language.
UNKNOWN, NO_LANGUAGE = "unknown", "und"


@dataclass(frozen=True)
class BudgetState:
    """What is known so far: token counts by content and tokenizer, the passages counted and under which tokenizer, and the totals."""

    counts: DataFrame
    docs: DataFrame
    cube: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> BudgetState:
        return BudgetState(*[spark.createDataFrame([], s) for s in (COUNTS, DOCS, CUBE)])

    @staticmethod
    def read(spark: SparkSession, folder: str) -> BudgetState:
        return BudgetState(*[spark.read.parquet(f"{folder}/{n}") for n in ("counts", "docs", "cube")])

    def write(self, folder: str) -> None:
        """Writes to a folder that doesn't exist yet; the state read so far stays as it is."""
        for name in ("counts", "docs", "cube"):
            getattr(self, name).write.mode("errorifexists").parquet(f"{folder}/{name}")


def name_key(name: F.Column | str):
    return F.regexp_replace(F.lower(F.col(name) if isinstance(name, str) else name), r"[\s _-]+", "")


def passage_rows(passages: DataFrame, packages: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per passage of a package, as delivered last: DOCS and no text.

    A package registered several times counts once, by its latest known source. Null passages hold no text and are
    left out; empty ones count with whatever tokens they have.
    """
    latest = F.struct("loaded_at", "passage_no")
    last = (
        passages.groupBy("corpus_id", "passage_idx")
        .agg(F.max_by(F.struct(F.md5(F.col("passage").cast("binary")).alias("content_hash"), "lang"), latest).alias("x"))
        .select("corpus_id", "passage_idx", "x.content_hash", clean_code_column(F.col("x.lang")).alias("lang"))
        .filter(F.col("content_hash").isNotNull())
    )
    names = catalog.groupBy(name_key("source_dataset").alias("key")).agg(
        F.min("source_dataset").alias("clean"), F.min("domain").alias("domain")
    )
    sources = (
        packages.groupBy("corpus_id")
        .agg(F.max_by("source_dataset", F.when(F.col("source_dataset").isNotNull(), F.coalesce("prepared_at", F.timestamp_seconds(F.lit(0))))).alias("given"))
        .withColumn("key", name_key("given"))
        .join(names, "key", "left")
        .select("corpus_id", F.coalesce("clean", "key", F.lit(UNKNOWN)).alias("source_dataset"), F.coalesce("domain", F.lit(UNKNOWN)).alias("domain"))
    )
    return last.join(sources, "corpus_id", "left").select(
        "corpus_id",
        "passage_idx",
        "content_hash",
        F.coalesce("source_dataset", F.lit(UNKNOWN)).alias("source_dataset"),
        F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce("domain", F.lit(UNKNOWN)).alias("domain"),
    )


def unseen_texts(passages: DataFrame, known: DataFrame) -> DataFrame:
    """content_hash and text of the contents whose hash ``known`` lacks, each once.

    Hashes are made in the scan and reduced before they are shuffled; only then is one row of each unseen content
    fetched, so a text that fills a third of all rows moves once, and known texts don't move at all.
    """
    row = F.coalesce("passage_no", F.lit(-1)).alias("row")
    hashed = passages.filter(F.col("passage").isNotNull()).select(F.md5(F.col("passage").cast("binary")).alias("content_hash"), row, F.col("passage").alias("text"))
    first = hashed.groupBy("content_hash").agg(F.min("row").alias("row")).join(known, "content_hash", "left_anti")
    return hashed.join(first, ["content_hash", "row"], "left_semi").dropDuplicates(["content_hash"]).select("content_hash", "text")


def count_unseen(passages: DataFrame, counts: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Token counts of the contents that ``counts`` lacks under this tokenizer; each is encoded once."""
    label = tokenizer_hash(tokenizer, folder)
    unseen = unseen_texts(passages, counts.filter(F.col("tokenizer_hash") == label).select("content_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(tokenizer, folder)
        for batch in batches:
            sizes = [len(x) for x in encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([label] * len(sizes), pa.string()), pa.array(sizes, pa.int64())],
                names=["content_hash", "tokenizer_hash", "n_tokens"],
            )

    return unseen.mapInArrow(run, T._parse_datatype_string(COUNTS))


def cube_deltas(before: DataFrame, after: DataFrame, counts: DataFrame) -> DataFrame:
    """Signed changes of the totals: passages that are new count +1, removed ones -1, changed ones both.

    What is taken off was counted under the tokenizer of then, what is added under that of now. A content without a
    count is an error, since totals would be wrong without a trace.
    """
    fields = after.columns
    signed = after.withColumn("sign", F.lit(1)).unionByName(before.select(*fields).withColumn("sign", F.lit(-1)))
    changed = signed.groupBy(*fields).agg(F.sum("sign").alias("sign")).filter(F.col("sign") != 0)
    counted = F.coalesce("n_tokens", F.raise_error(F.concat(F.lit("no token count of "), "content_hash")).cast("bigint"))
    return (
        changed.join(counts, ["content_hash", "tokenizer_hash"], "left")
        .groupBy(*SLICE)
        .agg(F.sum("sign").alias("n_passages"), F.sum(F.col("sign") * counted).alias("n_tokens"))
    )


def update_budget(
    state: BudgetState, passages: DataFrame, packages: DataFrame, catalog: DataFrame,
    tokenizer: str = "byte_bpe_50k", folder: str | None = None,
) -> BudgetState:
    """The state after the whole tables as they are now. Passages no longer there are taken off the totals.

    Only contents without a count under this tokenizer are encoded, each once, whatever passage holds them. With
    another tokenizer than before all passages change sides: the old counts go, the new ones come.
    """
    after = passage_rows(passages, packages, catalog).withColumn("tokenizer_hash", F.lit(tokenizer_hash(tokenizer, folder)))
    counts = state.counts.unionByName(count_unseen(passages, state.counts, tokenizer, folder))
    cube = (
        state.cube.unionByName(cube_deltas(state.docs, after, counts))
        .groupBy(*SLICE)
        .agg(F.sum("n_passages").alias("n_passages"), F.sum("n_tokens").alias("n_tokens"))
        .filter(F.col("n_passages") != 0)
    )
    return BudgetState(counts, after, cube)
