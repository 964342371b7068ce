"""Scores of predictions and comparisons of methods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The last version of each key; of equal versions, one."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("x")).select(*key, "x.*")


def mean_known(value: Column) -> Column:
    """Mean without nulls and NaN; null where nothing is left."""
    return F.avg(F.when(~F.isnan(value), value))


def accuracy(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Counts and mean scores of predictions (llm_accuracy, contain_accuracy) by group."""
    llm, contain = mean_known(F.col("llm_accuracy")), mean_known(F.col("contain_accuracy"))
    return predictions.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.isnan("llm_accuracy") | F.col("llm_accuracy").isNull()).alias("n_invalid"),
        llm.alias("llm_accuracy"),
        contain.alias("contain_accuracy"),
        ((llm + contain) / 2).alias("average_accuracy"),
    )


def top_overlap(pairs: DataFrame, a: Column, b: Column, k: int = 5) -> DataFrame:
    """Pairs with the first k of two rankings and the share of common members."""
    return pairs.withColumn("top_a", F.slice(a, 1, k)).withColumn("top_b", F.slice(b, 1, k)).withColumn(
        "overlap", F.size(F.array_intersect("top_a", "top_b")) / F.lit(float(k))
    )


def _ln_factorial(m: Column) -> Column:
    """Logarithm of m!, exact up to 20 and by Stirling's series beyond, which errs by less than 1e-12 there."""
    x = m.cast("double")
    series = x * F.ln(x) - x + F.lit(0.5) * F.ln(x * (2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(m <= 20, F.ln(F.factorial(F.least(m, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def two_sided_binomial(wins: Column, losses: Column) -> Column:
    """Exact two-sided p of a fair coin for so many wins and losses; 1 where there are none.

    Twice the lower tail, at most 1. Up to 50 tosses binomial numbers are added up, which doubles hold exactly. Beyond,
    the tail's largest term is taken from logarithms of factorials, each further term from the one before; terms beyond
    12 standard deviations add less than double precision holds and are left out.
    """
    n, low = wins + losses, F.least(wins, losses)
    few = F.sequence(F.lit(0), F.least(low, F.lit(25)).cast("int"))

    def count(s: Column, i: Column) -> Column:
        term = F.when(i == 0, 1.0).otherwise(s["term"] * (n - i + 1) / F.greatest(i, F.lit(1)))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    whole = F.aggregate(few, F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum")), count, lambda s: s["sum"]) / F.pow(F.lit(2.0), n)
    largest = F.exp(_ln_factorial(n) - _ln_factorial(low) - _ln_factorial(n - low) - n * math.log(2.0))
    more = F.least(low, F.ceil(6 * F.sqrt(n.cast("double"))) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * (low - j + 1) / (n - low + j)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, add, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(n <= 50, whole).otherwise(largest * tail)))
