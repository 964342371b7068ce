"""Filling containers of fixed capacity with documents, by patterns of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.llm.vocab import batch_encoder
from passagemill.session import cut, spread

#: Containers are parameters. Plans have at most as many lengths as the capacities add up to, so this bounds what is broadcast.
MAX_KINDS, MAX_CAPACITY = 64, 1 << 20
#: Documents of one length are numbered in this many parts, so that a very common length isn't one task's work.
RANK_PARTS = 256
#: Patterns start from at most so many lengths, with so many ways to fill what is left beside each.
PATTERN_BASES, FILLS_PER_BASE, NNLS_STEPS = 4096, 8, 300


def enumerate_patterns(sizes: np.ndarray, weights: np.ndarray, capacity: int, fills: int = FILLS_PER_BASE) -> list[tuple[tuple[int, int], ...]]:
    """Patterns of at most three different lengths that fill the capacity exactly: ((length, copies), ...).

    The base length takes one to all of the copies that fit; one or two further lengths fill the rest. Lengths with
    many documents are tried first as fillers.
    """
    have = set(sizes.tolist())
    bases = sizes[np.argsort(-weights * sizes, kind="stable")][:PATTERN_BASES]
    common = sizes[np.argsort(-weights, kind="stable")][: 4 * fills]
    found: dict[tuple[tuple[int, int], ...], None] = {}

    def note(*parts: int | tuple[int, int]) -> None:
        copies: dict[int, int] = {}
        for s, m in parts:
            copies[s] = copies.get(s, 0) + m
        found[tuple(sorted(copies.items(), reverse=True))] = None

    for base in bases.tolist():
        most = capacity // base
        for m in sorted({most, max(1, most - 1), max(1, most // 2), 1}, reverse=True):
            rest = capacity - m * base
            if rest == 0:
                note((base, m))
                continue
            if rest in have:
                note((base, m), (rest, 1))
            made = 0
            for s in common.tolist():
                if made >= fills:
                    break
                k = rest // s
                if k and (rest - k * s == 0 or rest - k * s in have):
                    note((base, m), (s, k), *([(rest - k * s, 1)] if rest - k * s else []))
                    made += 1
                elif s < rest and rest - s in have:
                    note((base, m), (s, 1), (rest - s, 1))
                    made += 1
    return list(found)


def fit_counts(patterns: list[tuple[tuple[int, int], ...]], sizes: np.ndarray, weights: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Non-negative least squares: repeat counts whose use of each length comes nearest to the histogram.

    Accelerated projected gradient on the sparse pattern matrix. Rows are scaled by 1/sqrt(count), so that rare
    lengths weigh too; columns by their norm.
    """
    place = {int(s): i for i, s in enumerate(sizes)}
    row = np.array([place[s] for p in patterns for s, _ in p])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    val = np.array([m for p in patterns for _, m in p], float)
    scale = 1 / np.sqrt(np.maximum(weights, 1.0))
    val *= scale[row]
    norm = np.sqrt(np.bincount(col, val**2, len(patterns)))
    val /= norm[col]
    target = weights * scale
    times = lambda x: np.bincount(row, val * x[col], len(sizes))
    back = lambda y: np.bincount(col, val * y[row], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(times(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(np.linalg.norm(back(times(v))), 1e-9)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(times(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x / norm


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns and how often each is used, so that every document of the histogram has a place.

    Fitted repeat counts are rounded down and cut to what is there; what remains is packed by length, longest first,
    each time repeating the pattern found as often as the remaining documents allow. The work depends on the number
    of different lengths, which the capacity bounds, not on the number of documents.
    """
    left = {int(s): int(n) for s, n in histogram.items() if n > 0}
    used: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if not left:
        return used
    sizes = np.array(sorted(left))
    weights = np.array([left[int(s)] for s in sizes], float)
    patterns = enumerate_patterns(sizes, weights, capacity)
    if patterns:
        times = fit_counts(patterns, sizes, weights)
        for i in np.argsort(-times, kind="stable"):
            n = int(times[i] + 1e-6)
            if n == 0:
                break
            n = min([n, *(left[s] // m for s, m in patterns[i])])
            if n:
                used.append((patterns[i], n))
                for s, m in patterns[i]:
                    left[s] -= n * m
    rest = sorted((s for s, n in left.items() if n), reverse=True)
    while rest:
        room, pattern = capacity, []
        for s in rest:
            m = min(room // s, left[s])
            if m:
                pattern.append((s, m))
                room -= m * s
            if room < rest[-1]:
                break
        n = min(left[s] // m for s, m in pattern)
        used.append((tuple(pattern), n))
        for s, m in pattern:
            left[s] -= n * m
        rest = [s for s in rest if left[s]]
    return used


def token_sizes(docs: DataFrame, tokenizers: list[str], key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """``key`` and ``sizes``, an array with the number of tokens under each tokenizer; null texts have none."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [batch_encoder(t, folder) for t in tokenizers]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.zeros((len(texts), len(encoders)), np.int64)
            for at in range(0, len(texts), 256):
                for j, encode in enumerate(encoders):
                    sizes[at : at + 256, j] = [len(x) for x in encode(texts[at : at + 256])]
            ends = pa.array(np.arange(len(texts) + 1) * len(encoders), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(sizes.ravel()))], names=[key, "sizes"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("sizes", T.ArrayType(T.LongType()))])
    return spread(docs.select(F.col(key), F.col(text).alias("_text")), key).mapInArrow(run, schema)


def pack(docs: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Every document with its container, for each row of ``containers``.

    Columns: container_kind, container_no, the key, part_no, start_token, n_tokens. A text longer than the capacity
    alone is cut into full containers and a last part, which is packed like a document. Texts without tokens (null,
    empty) take no space: they have one row with a null container_no. Repeated rows are packed as often as they come.
    Only the histogram of lengths, which the capacity bounds, is planned in one place per container kind.
    """
    kinds = containers.select("container_kind", "tokenizer", F.col("capacity_tokens").cast("bigint")).distinct().take(MAX_KINDS + 1)
    if len(kinds) > MAX_KINDS or sum(k[2] for k in kinds) > MAX_CAPACITY:
        raise ValueError("too many container kinds or too large capacities")
    kind = docs.schema[key].dataType.simpleString()
    if not kinds:
        return docs.sparkSession.createDataFrame([], f"container_kind string, container_no bigint, `{key}` {kind}, part_no bigint, start_token bigint, n_tokens bigint")
    names = sorted({k[1] for k in kinds})
    specs = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(names.index(t) + 1).alias("i"), F.lit(c).alias("capacity")) for k, t, c in sorted(kinds)])
    sized = cut(token_sizes(docs, names, key, text, folder))
    items = (
        sized.select(key, "sizes", F.explode(specs).alias("c"))
        .select(key, "c.container_kind", "c.capacity", F.element_at("sizes", F.col("c.i")).alias("total"))
        .withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("total") / F.col("capacity")) - 1, F.lit(0)))))
        .withColumn("start_token", F.col("part_no") * F.col("capacity"))
        .withColumn("n_tokens", F.least(F.col("total") - F.col("start_token"), F.col("capacity")))
        .withColumn("rank_part", F.pmod(F.xxhash64(key, "part_no"), F.lit(RANK_PARTS)).cast("int"))
    )
    group = ["container_kind", "n_tokens"]
    parts = items.filter("n_tokens > 0").groupBy("container_kind", "capacity", "n_tokens", "rank_part").agg(F.count("*").alias("n"))
    parts = cut(parts)
    plan = parts.groupBy("container_kind", "capacity", "n_tokens").agg(F.sum("n").alias("n")).groupBy("container_kind").applyInPandas(_plan, _PLAN)
    before = Window.partitionBy(*group).orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*group, "rank_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = Window.partitionBy(*group, "rank_part").orderBy(key, "part_no")
    ranked = (
        items.filter("n_tokens > 0")
        .withColumn("nth", F.row_number().over(nth))
        .join(offsets, [*group, "rank_part"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
    )
    slot = F.expr("filter(slots, s -> rank >= s.from_rank AND rank < s.from_rank + s.n)[0]")
    placed = ranked.join(F.broadcast(plan), group).withColumn("s", slot)
    out = ["container_kind", "container_no", key, "part_no", "start_token", "n_tokens"]
    number = F.col("s.base") + F.floor((F.col("rank") - F.col("s.from_rank")) / F.col("s.per"))
    return placed.withColumn("container_no", number.cast("bigint")).select(*out).unionByName(
        items.filter("n_tokens = 0").withColumn("container_no", F.lit(None).cast("bigint")).select(*out)
    )


_PLAN = "container_kind string, n_tokens bigint, slots array<struct<from_rank:bigint,n:bigint,base:bigint,per:bigint>>"


def _plan(histogram: pd.DataFrame) -> pd.DataFrame:
    """The plan of one container kind: for each length, which ranks go to which containers."""
    kind, capacity = histogram.container_kind.iloc[0], int(histogram.capacity.iloc[0])
    base, taken, slots = 0, {}, {}
    for pattern, times in plan_containers(dict(zip(histogram.n_tokens, histogram.n)), capacity):
        for size, copies in pattern:
            start = taken.get(size, 0)
            slots.setdefault(size, []).append((start, times * copies, base, copies))
            taken[size] = start + times * copies
        base += times
    rows = [(kind, s, [dict(zip(("from_rank", "n", "base", "per"), x)) for x in v]) for s, v in slots.items()]
    return pd.DataFrame(rows, columns=["container_kind", "n_tokens", "slots"])
