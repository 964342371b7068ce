"""Nearest vectors of a stated set of queries, by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block on either side; a task holds one block of each and their product.
QUERY_BLOCK, ROW_BLOCK = 256, 4096
#: Queries up to so many bytes of numbers are sent to the tasks; the rows then stay where they are.
SENT_BYTES = 32 << 20


def _products(asked: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int | None, least: float | None) -> pd.DataFrame:
    """The best k rows (or all with at least ``least``) of one block of rows for each query of one block."""
    scores = queries @ rows.T
    scores[asked[:, None] == ids[None, :]] = -np.inf
    if k is not None:
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
        a, b = np.repeat(np.arange(len(asked)), order.shape[1]), order.ravel()
    else:
        a, b = np.nonzero(scores >= least)
    keep = np.isfinite(scores[a, b])
    return pd.DataFrame({"query_id": asked[a][keep], "id": ids[b][keep], "score": scores[a, b][keep]})


_FOUND = "query_id bigint, id bigint, score double"


def nearest(queries: DataFrame, rows: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """query_id, id, score: the k rows of largest dot product for each query, or all with at least ``least``.

    Both sides have id and v (array of numbers). A query isn't its own neighbour. Ties go to the smaller id. Null
    vectors are left out. The stated queries meet all rows block by block: blocks are multiplied as matrices, and only
    the best k (or those above the limit) leave a task. Queries of up to SENT_BYTES, which is checked, are broadcast
    and the rows are read where they lie; more queries meet the rows in pairs of blocks, each pair a key of its own.
    """
    queries, rows = (x.select("id", "v").filter(F.col("v").isNotNull()) for x in (queries, rows))
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    found = _near_sent(queries, rows, k, least) if size["numbers"] * 8 <= SENT_BYTES else _near_paired(queries, rows, size["n"], k, least)
    if k is None:
        return found
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _near_sent(queries: DataFrame, rows: DataFrame, k: int | None, least: float | None) -> DataFrame:
    own = queries.toPandas()
    if not len(own):
        return rows.sparkSession.createDataFrame([], _FOUND)
    sent = rows.sparkSession.sparkContext.broadcast((own["id"].to_numpy(np.int64), np.stack(own["v"]).astype(np.float64)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, matrix = sent.value
        for frame in frames:
            for at in range(0, len(frame), ROW_BLOCK):
                part = frame.iloc[at : at + ROW_BLOCK]
                block = np.stack(part["v"]).astype(np.float64)
                for q in range(0, len(asked), QUERY_BLOCK):
                    yield _products(asked[q : q + QUERY_BLOCK], matrix[q : q + QUERY_BLOCK], part["id"].to_numpy(np.int64), block, k, least)

    return rows.mapInPandas(run, _FOUND)


def _near_paired(queries: DataFrame, rows: DataFrame, n_queries: int, k: int | None, least: float | None) -> DataFrame:
    n_q, n_r = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-rows.count() // ROW_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q = queries.groupBy(block(n_q).alias("qb")).agg(F.collect_list(F.struct("id", "v")).alias("q")).withColumn("rb", every(n_r))
    r = rows.groupBy(block(n_r).alias("rb")).agg(F.collect_list(F.struct("id", "v")).alias("r")).withColumn("qb", every(n_q))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for qs, rs in zip(frame["q"], frame["r"]):
                sides = [(np.array([x["id"] for x in s], np.int64), np.array([x["v"] for x in s], np.float64)) for s in (qs, rs)]
                yield _products(*sides[0], *sides[1], k, least)

    return q.join(r, ["qb", "rb"]).select("q", "r").mapInPandas(run, _FOUND)
