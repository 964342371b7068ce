"""Rankings stored as arrays: scaling, completeness, ranks of given members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.vectors import min_max


def scaled_scores(rankings: DataFrame, scores: str) -> DataFrame:
    """Each ranking with its scores scaled to 0..1; nulls and NaN stay out of the bounds and become null."""
    known = F.filter(F.col(scores), lambda x: x.isNotNull() & ~F.isnan(x))
    low, high = F.array_min(known), F.array_max(known)
    scale = F.transform(F.col(scores), lambda x: F.when(~F.isnan(x), F.round(min_max(x, low, high), 6)))
    return rankings.withColumn("scaled", scale)


def ranked_members(rankings: DataFrame, members: str, key: list[str]) -> DataFrame:
    """One row per member with its rank from 1: key, rank, passage_idx. Null members are left out."""
    return rankings.select(*key, F.posexplode(members).alias("pos", "passage_idx")).filter(F.col("passage_idx").isNotNull()).select(*key, (F.col("pos") + 1).alias("rank"), "passage_idx")


def is_complete(members: str, scores: str, k: int = 5) -> F.Column:
    """At least k ranked members, as many scores, none of them null or NaN."""
    finite = F.forall(F.col(scores), lambda x: x.isNotNull() & ~F.isnan(x))
    whole = F.forall(F.col(members), lambda x: x.isNotNull())
    return F.coalesce((F.size(members) >= k) & (F.size(members) == F.size(scores)) & finite & whole, F.lit(False))
