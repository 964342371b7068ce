"""Samples that stay the same in every rerun and keep their members as data grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.questions import distinct_questions, unit_interval

#: Sample definitions are parameters, not data; more than this is taken for a mistake.
MAX_SPECS = 1000


def stable_sample(questions: DataFrame, specs: DataFrame) -> DataFrame:
    """For each spec the distinct questions whose salted hash lies below its rate.

    A question's number depends on the spec's seed, its package and its own key alone, so the sample is the same in
    any order and partitioning, grows only by questions that are new, and with one seed a lower rate's sample lies in
    a higher rate's. ``first_batch`` is the batch in which the member entered: the sample after batch k is the rows
    with first_batch <= k. Specs (at most MAX_SPECS, checked) are read as parameters; a null rate or seed draws nothing.
    """
    rows = specs.select("spec_id", F.col("seed").cast("bigint"), F.col("sample_rate").cast("double")).take(MAX_SPECS + 1)
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} sample specs")
    drawn = [F.struct(F.lit(s).alias("spec_id"), F.lit(n).alias("seed"), F.lit(r).alias("rate")) for s, n, r in rows if n is not None and r is not None]
    none = F.array().cast("array<struct<spec_id:string,seed:bigint,rate:double>>")
    return (
        distinct_questions(questions)
        .select("corpus_id", "question_key", "question_no", "first_batch", F.explode(F.array(*drawn) if drawn else none).alias("s"))
        .select("*", unit_interval(F.col("s.seed"), F.col("corpus_id"), F.col("question_key")).alias("unit"))
        .filter(F.col("unit") < F.col("s.rate"))
        .select(F.col("s.spec_id").alias("spec_id"), "corpus_id", "question_key", "question_no", "first_batch", "unit")
    )
