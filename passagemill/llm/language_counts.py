"""Naive Bayes of languages from all labelled texts, whose labels are checked on the way.

Labels are checked as ``naive_bayes.corrected`` does, over counts that are summed where the texts lie: each round
scores all texts by models of the other parts, and moves the n-grams of those that it finds in another language than
their label's.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from passagemill.llm import naive_bayes
from passagemill.llm.languages import CODES
from passagemill.llm.naive_bayes import LEAST_SENTENCE
from passagemill.llm.ngrams import BITS, letters_only, located, scored, tallied
from passagemill.llm.totals import summed
from passagemill.session import cut

SIZE = len(CODES) << BITS
#: Pairs, and signs of documents, that are looked at together.
SOME, SIGNS = 2000, 1 << 22


def _model(seen: np.ndarray) -> naive_bayes.NaiveBayes | None:
    """Of the languages that were seen at all."""
    known = np.flatnonzero(seen.any(axis=1))
    return naive_bayes.from_counts(seen[known], tuple(CODES[j] for j in known)) if len(known) else None


def part_of(texts: list[str], folds: int) -> int:
    return zlib.crc32("\n".join(texts).encode("utf-8", "replace")) % folds


def _parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SIGNS bytes of its first column."""
    ends, a, at = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)), 0, 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, at + SIGNS, "right")))
        yield batch.slice(a, b - a)
        a, at = b, int(ends[b - 1])


def count_given(lines: list[str], folds: list[int], labels: list[int], total: np.ndarray) -> None:
    """Adds the n-grams of documents, by part and by their label."""
    groups: dict[tuple[int, int], list[str]] = {}
    for line, fold, label in zip(lines, folds, labels):
        groups.setdefault((fold, label), []).append(line)
    for (fold, label), own in groups.items():
        at = fold * SIZE + (label << BITS)
        total[at : at + (1 << BITS)] += tallied("\n".join(own))


def count_moved(lines: list[str], folds: list[int], labels: list[int], models: list[naive_bayes.NaiveBayes | None], doubt: float, last: bool, total: np.ndarray) -> None:
    """Moves the n-grams of sentences that aren't in the language of their document's label to the one found, if any.

    The last time all parts are one, and what no language was found for is added under its label besides.
    """
    for fold, model in enumerate(models):
        own = [i for i, f in enumerate(folds) if f == fold] if model is not None else []
        if not own:
            continue
        line = "\n".join([lines[i] for i in own])
        sizes = [lines[i].count("\n") + 1 for i in own]
        given = np.repeat(np.array([labels[i] for i in own], np.int64), sizes)
        x, counts = scored(model.table, line)
        x -= np.logaddexp.reduce(x, axis=1, keepdims=True)
        starts = np.cumsum(sizes) - sizes
        best = np.repeat(np.add.reduceat(np.maximum(x, LEAST_SENTENCE), starts, axis=0).argmax(axis=1), sizes)
        unlike = x.max(axis=1) - x[np.arange(len(x)), best] >= doubt
        now = np.where(unlike, -1, np.array([CODES.index(c) for c in model.classes])[best])
        moved = np.flatnonzero((now != given) & (counts > 0))
        if not len(moved):
            continue
        each = line.split("\n")
        slot = total[0 if last else fold * SIZE :]
        given, now = given[moved] << BITS, now[moved] << BITS
        for owner, h in located("\n".join([each[i] for i in moved.tolist()])):
            at, to = given[owner] | h, now[owner] | h
            np.subtract.at(slot, at, 1)
            np.add.at(slot, to[to >= 0], 1)
            if last:
                np.add.at(total, SIZE + at[to < 0], 1)


def train(documents: DataFrame, parts: Callable[[str], list[str]], folds: int, doubt: float, rounds: int = 2) -> np.ndarray:
    """How often each of CODES has each n-gram, by language, in all documents (text, lang), of which ``parts`` gives what is learned from.

    n-grams are counted under the labels once; each round counts what moves from them to other languages.
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(parts(t), CODES.index(c)) for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [r for r in rows if r[0]]
            lines = iter(letters_only([p for own, _ in rows for p in own]).split("\n"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(["\n".join(islice(lines, len(own))) for own, _ in rows], pa.string()), pa.array([part_of(own, folds) for own, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.int32())],
                names=["lines", "part", "label"],
            )

    rows = cut(documents.mapInArrow(prepare, "lines string, part int, label int"))

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for some in _parts_of(batch):
            count_given(*(c.to_pylist() for c in some.columns), total)

    base = seen = summed(rows, SIZE * folds, count).reshape(folds, len(CODES), 1 << BITS)
    context = documents.sparkSession.sparkContext
    for nth in range(rounds):
        last = nth == rounds - 1
        whole = seen.sum(axis=0)
        sent = context.broadcast([_model(whole - seen[fold]) for fold in range(folds)])

        def move(batch: pa.RecordBatch, total: np.ndarray, sent=sent, last=last) -> None:
            for some in _parts_of(batch):
                count_moved(*(c.to_pylist() for c in some.columns), sent.value, doubt, last, total)

        seen = summed(rows, SIZE * (2 if last else folds), move).reshape(-1, len(CODES), 1 << BITS)
        sent.unpersist()
        if last:
            seen[0] += base.sum(axis=0)
        else:
            seen += base
    lost = ~seen[0].any(axis=1)
    seen[0][lost] = seen[1][lost]  # a label keeps its texts rather than none
    return seen[0]


def with_pairs(seen: np.ndarray, pairs: DataFrame, parts: Callable[[list[tuple]], tuple[list[str], list[str]]]) -> naive_bayes.NaiveBayes | None:
    """The model of counts by language and of all pairs: their first texts, each under the language both are likeliest in together."""
    model = _model(seen)
    if model is None:
        return None
    sent = pairs.sparkSession.sparkContext.broadcast(model)
    place = np.array([CODES.index(c) for c in model.classes])

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        for at in range(0, len(rows), SOME):
            first, second = parts(rows[at : at + SOME])
            if first:
                line = letters_only(first)
                best = place[(scored(sent.value.table, line)[0] + sent.value.log_likelihoods(second)[0]).argmax(axis=1)] << BITS
                for owner, h in located(line):
                    np.add.at(total, best[owner] | h, 1)

    found = summed(pairs, SIZE, count).reshape(len(CODES), -1)
    sent.unpersist()
    return _model(seen + found)
