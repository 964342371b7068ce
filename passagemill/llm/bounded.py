"""Bounded samples of labelled rows, drawn without gathering a label's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A label with more rows than so many times its bound is thinned by hash before any row is shuffled.
SPARE = 4
#: Labels are few; more than this is taken for a mistake.
MAX_LABELS = 1000
_UNIT = 1 << 30


def bounded_sample(rows: DataFrame, label: str, key: str, bound: int, salt: str) -> DataFrame:
    """At most ``bound`` rows of each label, the smallest by hash of key and salt; rows without a label are left out.

    Labels are counted first. Large ones keep the share of hashes that holds SPARE times the bound on average, so
    about that many rows of a label are shuffled at any size of the data.
    """
    rows = rows.filter(F.col(label).isNotNull())
    counts = rows.groupBy(label).count().take(MAX_LABELS + 1)
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not counts:
        return rows
    shares = F.create_map(*[x for name, n in counts for x in (F.lit(name), F.lit(min(1.0, SPARE * bound / n)))])
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(_UNIT)))
    thin = hashed.filter(F.col("_hash") < F.element_at(shares, F.col(label)) * _UNIT)
    nth = Window.partitionBy(label).orderBy("_hash", key)
    return thin.withColumn("_nth", F.row_number().over(nth)).filter(F.col("_nth") <= bound).drop("_nth", "_hash")
