"""Calls of models from partitions: encoders, extractors and answer models behind small interfaces.

Each interface has a deterministic default without any model, so that plans run and can be checked anywhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.vectors import unit

#: What stands for an answer that a model's service did not give.
REJECTED = "Answer: [generation rejected by model service]"
DIMENSIONS = 64

AnswerModel = Callable[[str], str]


class ModelCalled(RuntimeError):
    """Raised by a model that must not be called."""


def no_model(prompt: str) -> str:
    """Stands where a plan must do without a model."""
    raise ModelCalled(prompt[:80])


def first_line_model(prompt: str) -> str:
    """The default: answers with the first passage's first sentence."""
    line = prompt.split("\n", 1)[0].split(":", 1)[-1]
    return f"Answer: {line.split('. ')[0].strip()}"


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The default encoder: counts of words by hash, with length 1; a text without words is null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1))
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return unit(counts)


def encode(texts: DataFrame, known: DataFrame | None, encoder: Callable[[list[str]], list[list[float]]], text: str = "text", key: str = "hash_id") -> DataFrame:
    """key, text, embedding of texts that ``known`` lacks, each encoded once, in batches within the tasks."""
    rows = texts.select(key, text).dropDuplicates([key])
    if known is not None:
        rows = rows.join(known.select(key), key, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["embedding"] = encoder(frame[text].tolist()) if len(frame) else []
            yield frame

    return rows.mapInPandas(run, f"{key} string, {text} string, embedding array<float>")


def generate(
    prompts: DataFrame, model: AnswerModel, key: str, prompt: str = "prompt", workers: int = 8, tries: int = 2, valid: Callable[[str], bool] = bool, wait: float = 0.0
) -> DataFrame:
    """key, reply, error_type, error: one model call per prompt, a few at a time within each task.

    A call that fails, or whose reply isn't valid, is tried again; what fails to the end becomes REJECTED with its
    error, and no other row is touched by it. Null prompts aren't sent and have a null reply.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def call(text: str | None) -> tuple[str | None, str | None, str | None]:
        if text is None:
            return None, None, None
        problem: tuple[str, str] = ("InvalidReply", "the reply wasn't valid")
        for attempt in range(tries):
            try:
                reply = model(text)
                if valid(reply):
                    return reply, None, None
                problem = ("InvalidReply", reply[:200])
            except Exception as error:  # noqa: BLE001  (a row's failure is a result)
                problem = (type(error).__name__, str(error)[:200])
            if wait and attempt + 1 < tries:
                time.sleep(wait)
        return REJECTED, *problem

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                texts = [None if pd.isna(x) else x for x in frame[prompt]]
                rows = list(pool.map(call, texts))
                yield pd.DataFrame({key: frame[key], **dict(zip(("reply", "error_type", "error"), zip(*rows) if rows else ([], [], [])))})

    return prompts.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, reply string, error_type string, error string")


def extract(texts: DataFrame, extractor: Callable[[str], list[tuple[str, str, str]]], key: str, text: str = "text", dropped: tuple[str, ...] = ("ORDINAL", "CARDINAL")) -> DataFrame:
    """key, sentence, entity, label from an extractor that gives (sentence, entity, label); numbers are dropped."""
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *found) for k, t in zip(frame[key], frame[text]) if t for found in dict.fromkeys(extractor(t))]
            yield pd.DataFrame(rows, columns=[key, "sentence", "entity", "label"])

    found = texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, sentence string, entity string, label string")
    return found.filter(~F.col("label").isin(*dropped))


def parse_triples(reply: Column) -> Column:
    """Well-formed triples of a model's JSON reply; anything else is left out."""
    rows = F.from_json(F.get_json_object(reply, "$.triples"), "array<array<string>>")
    return F.filter(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda t: (F.size(t) == 3) & F.forall(t, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
