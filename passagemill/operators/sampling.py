"""Seeded samples, shuffles and budgets that any engine can repeat: order is by MD5 of the seed and the key."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators.ordered import by_digest, by_number, positions, running_sum


def seeded_key(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def simple_sample(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """n rows with the smallest seeded keys; a top-k, so no full sort."""
    return rows.withColumn("sample_key", seeded_key(seed, F.col(key))).orderBy("sample_key", key).limit(n)


def stratified_sample(rows: DataFrame, n: int, seed: str, key: str, strata: list[str]) -> DataFrame:
    """n rows of each stratum; ranks are cut at n before the shuffle, so large strata stay small."""
    by = Window.partitionBy(*strata).orderBy("sample_key", key)
    return rows.withColumn("sample_key", seeded_key(seed, F.col(key))).withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= n)


def mersenne_positions(size: int, n: int, seed: str) -> list[int]:
    """Positions drawn as Python's seeded generator draws them, in order; for results that must repeat such a draw."""
    return sorted(random.Random(seed).sample(range(size), min(n, size)))


def shuffled(rows: DataFrame, seed: str, key: str, within: list[str]) -> DataFrame:
    """New positions from 0 within each group, in seeded order. Equal keys are ordered by the key itself."""
    keyed = rows.withColumn("shuffle_key", seeded_key(seed, F.col(key)))
    return positions(keyed, within, ["shuffle_key", key], by_digest("shuffle_key"))


def token_prefix(rows: DataFrame, order: str, tokens: str, target: int, within: list[str]) -> DataFrame:
    """The prefix of each group that holds ``target`` tokens: rows with kept_tokens, the last one cut to the rest.

    Groups with fewer tokens keep all of their rows and are marked by ``short``.
    """
    summed = running_sum(rows, within, [order], by_number(order), tokens, "upto")
    return (
        summed.withColumn("short", F.col("upto_all") < target)
        .withColumn("kept_tokens", F.least(F.col(tokens), target - (F.col("upto") - F.col(tokens))))
        .filter(F.col("kept_tokens") > 0)
        .drop("upto_all")
    )
