"""Samples whose categories follow given proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.questions import distinct_questions, type_key, unit_interval
from passagemill.session import cut

#: Random keys are counted in this many equal ranges, so that a category of any size is cut without being sorted whole.
KEY_RANGES = 4096


def allocate(counts: DataFrame) -> DataFrame:
    """Integer quotas per (corpus_id, type_key) by largest remainder, with floors and caps.

    ``counts`` has target_share, min_count, sample_count and available. Each type first gets its minimum, as far as
    questions are there. The rest of the sample is filled in proportion to the shares: a type takes part once its share
    of the fill reaches its minimum, and stops at what is available, so what it can't take goes to the others. The
    level of the fill at which the sample is full is found by going through the levels where a type joins or stops.
    Shares of the fill are rounded down, and what is missing goes by one each to the largest remainders, ties to the
    smaller type_key. So quotas add up to the sample, or to all that is available of types with a share and the minima
    of those without, whichever is less. Where the minima alone exceed the sample they are kept, and ``minima_exceed``
    says so. ``missing`` is what the type lacks of its rounded share or minimum. Without a package nothing is drawn.
    A package has a handful of categories, so the windows by package stay small.
    """
    by = Window.partitionBy("corpus_id")
    share, floor, cap, size = (F.col(c) for c in ("target_share", "least", "available", "sample_count"))
    q = counts.withColumns({
        "wanted": F.greatest(F.round(share * size).cast("bigint"), F.col("min_count")),
        "least": F.least(F.col("min_count"), F.col("available")),
    }).withColumn("minima", F.sum("least").over(by))
    joins = F.struct((floor / share).alias("level"), F.lit(0).alias("kind"), (-floor).cast("double").alias("fixed"), share.alias("slope"))
    stops = F.struct((cap / share).alias("level"), F.lit(1).alias("kind"), cap.cast("double").alias("fixed"), (-share).alias("slope"))
    order = by.orderBy("level", "type_key", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full_at = F.when(F.col("slope0") > 1e-12, (size - F.col("fixed0")) / F.col("slope0")).otherwise(F.col("level"))
    levels = (
        q.filter(share > 0)
        .select("corpus_id", "type_key", "sample_count", "minima", F.inline(F.array(joins, stops)))
        .withColumns({
            "fixed0": F.col("minima") + F.coalesce(F.sum("fixed").over(before), F.lit(0.0)),
            "slope0": F.coalesce(F.sum("slope").over(before), F.lit(0.0)),
            "turn": F.row_number().over(order),
        })
        .filter(F.col("fixed0") + F.col("slope0") * F.col("level") >= size - 1e-9)
        .groupBy("corpus_id").agg(F.min_by(full_at, "turn").alias("full_at"))
    )
    exact = F.when(share > 0, F.least(F.greatest(F.coalesce(F.col("full_at") * share, cap), floor), cap)).otherwise(floor).cast("double")
    q = q.join(levels, "corpus_id", "left").withColumn("exact", exact).withColumn("base", F.floor(F.col("exact") + 1e-9))
    q = q.withColumn("remainder", F.round(F.col("exact") - F.col("base"), 9))
    left = F.round(F.sum("exact").over(by)) - F.sum("base").over(by)
    nth = F.row_number().over(by.orderBy(F.desc("remainder"), "type_key"))
    quota = F.when(size.isNull(), F.lit(0)).otherwise(F.col("base") + (nth <= left).cast("bigint"))
    return q.withColumn("quota", quota.cast("bigint")).select(
        "corpus_id", "type_key", "question_type", "target_share", "min_count", "sample_count", "available", "wanted", "quota",
        F.greatest(F.col("wanted") - F.col("available"), F.lit(0)).alias("missing"), (F.col("minima") > size).alias("minima_exceed"),
    )


def target_counts(questions: DataFrame, packages: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with its package's sample size and the number of distinct questions of its type.

    Packages registered several times count once, by their latest ``prepared_at``. Targets without a package are
    kept with a null sample_count; nulls in target_share and min_count count as 0.
    """
    sizes = packages.groupBy("corpus_id").agg(F.max_by("sample_count", F.coalesce("prepared_at", F.timestamp_seconds(F.lit(0)))).alias("sample_count"))
    have = distinct_questions(questions).groupBy("corpus_id", "type_key").agg(F.count("*").alias("available"))
    return (
        targets.select(
            "corpus_id",
            "question_type",
            type_key(F.col("question_type")).alias("type_key"),
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce("min_count", F.lit(0)).alias("min_count"),
        )
        .join(sizes, "corpus_id", "left")
        .join(have, ["corpus_id", "type_key"], "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
    )


def shortfalls(questions: DataFrame, packages: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets for which the package has fewer distinct questions than the larger of minimum and rounded share."""
    quotas = allocate(target_counts(questions, packages, targets))
    return quotas.filter(F.col("available") < F.col("wanted"))


def quota_sample(questions: DataFrame, packages: DataFrame, targets: DataFrame, salt: str = "quota") -> DataFrame:
    """The sampled questions: corpus_id, question_type, question_key, question_no and their random key.

    Within a category the smallest keys win. Keys are counted in ``KEY_RANGES`` ranges first; ranges below the quota
    are taken whole and only the one range that holds the quota's end is ordered, so no category is one task's work.
    Ties of keys go to the smaller question_key. Questions without a type, or of a type without a target, are never drawn.
    """
    quotas = allocate(target_counts(questions, packages, targets)).select(
        "corpus_id", "type_key", "question_type", "quota"
    )
    keyed = cut(
        distinct_questions(questions)
        .withColumn("random_key", unit_interval(F.lit(salt), F.col("corpus_id"), F.col("question_key")))
        .withColumn("range_no", F.floor(F.col("random_key") * KEY_RANGES).cast("int"))
    )
    below = Window.partitionBy("corpus_id", "type_key").orderBy("range_no")
    ranges = (
        keyed.groupBy("corpus_id", "type_key", "range_no")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(below))
        .withColumn("before", F.col("upto") - F.col("n"))
        .join(quotas, ["corpus_id", "type_key"])
        .filter(F.col("before") < F.col("quota"))
        .select("corpus_id", "type_key", "range_no", "question_type", (F.col("quota") - F.col("before")).alias("take"))
    )
    nth = Window.partitionBy("corpus_id", "type_key", "range_no").orderBy("random_key", "question_key")
    return (
        keyed.join(ranges, ["corpus_id", "type_key", "range_no"])
        .withColumn("nth", F.row_number().over(nth))
        .filter(F.col("nth") <= F.col("take"))
        .select("corpus_id", "question_type", "question_key", "question_no", "random_key")
    )
