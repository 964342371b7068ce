"""Whether a reply declines to answer: naive Bayes over character n-grams of its sentences.

Names, figures, quoted speech and the question's own words are taken out first, since a refusal may repeat what was
asked and a story may quote one. The model learns from sentences whose wording is known to decline and from sentences
of gold answers, and finds wordings that no list has.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from passagemill.llm import naive_bayes
from passagemill.llm.language_id import nameless, sentences_of
from passagemill.llm.ngrams import BITS, letters_only, scored, tallied
from passagemill.llm.refusals import ANYWHERE, PATTERN, declines, may_decline
from passagemill.llm.text_spans import quote_spans
from passagemill.llm.totals import summed

#: The least number of sentences that decline to learn from.
LEAST_DECLINING = 20
#: How far above held-out answering sentences one without a known wording has to be to decline, and how far below
#: held-out declining ones a known wording still does; and the letters that a sentence without one needs.
SLACK, LEAST_LETTERS = 0.25, 9
#: One held-out sentence in so many may lie beyond these limits: of those that answer, and of those that decline.
ANSWERS_ABOVE, DECLINES_BELOW = 8000, 2000
#: Kinds of sentences, and the model's classes.
ANSWERS, TELLS, DECLINES = 0, 1, 2
CLASSES = ("answers", "declines")
#: Scores lie within FARTHEST and are counted in steps.
FARTHEST, STEP = 20.0, 0.001
BINS, WIDTH = round(2 * FARTHEST / STEP), (4 << BITS) + 6
#: Without a model, a sentence that names somebody new declines if so many words at most are left of it.
FEW_WORDS = 6

_WORD = regex.compile(r"[\p{L}\p{M}]{3,}")
_CJK_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]{2,}")
_NAME = regex.compile(r"(?<!^)(?<![.!?:]\s)(?<=\s)\p{Lu}\p{L}{2,}")
_GERMAN = regex.compile(r"\b(?:ich|nicht|keine?|der|die|das|dazu|nichts|bei|es|aus|ohne|angaben)\b", regex.I)
_DIGIT = regex.compile(r"\d")
#: The least letters of a sentence that declines without a known wording, and of any sentence.
_LETTERS = regex.compile(rf"(?:[^\p{{L}}\p{{M}}]*+[\p{{L}}\p{{M}}]){{{LEAST_LETTERS}}}")
_SOME_LETTERS = regex.compile(r"(?:[^\p{L}\p{M}]*+[\p{L}\p{M}]){3}")
_SPLIT, _SPLIT_ASCII = regex.compile(r"([\p{L}\p{M}]{3,})"), re.compile("([a-zA-Z]{3,})")


@lru_cache(maxsize=20_000)
def asked_words(question: str) -> tuple[frozenset[str], frozenset[str]]:
    """The question's words of four letters or more and its names, in lower case; and its pairs of signs in unspaced scripts."""
    words = {w.lower() for w in (_SPLIT_ASCII if question.isascii() else _SPLIT).findall(question) if len(w) > 3 or w[0].isupper()}
    if question.isascii():
        return frozenset(words), frozenset()
    pairs = {run[i : i + 3] for run in _CJK_RUN.findall(question) for i in range(len(run) - 2)}
    return frozenset(words), frozenset(pairs)


def without_question(sentence: str, question: str | None) -> str:
    """A sentence without quoted speech and without the words of the question."""
    spans = quote_spans(sentence)
    for a, b in reversed(spans):
        if b - a < len(sentence.strip()):
            sentence = sentence[:a] + " " + sentence[b:]
    if not question:
        return sentence
    words, pairs = asked_words(question)
    bits = (_SPLIT_ASCII if sentence.isascii() else _SPLIT).split(sentence)
    bits[1::2] = [" " if w.lower() in words else w for w in bits[1::2]]
    out = "".join(bits)
    if pairs and not out.isascii():
        hit = [False] * len(out)
        for i in range(len(out) - 2):
            if out[i : i + 3] in pairs:
                hit[i] = hit[i + 1] = hit[i + 2] = True
        out = "".join(" " if h else c for c, h in zip(out, hit))
    return out


def new_names(rest: str) -> int:
    """Names in what the question doesn't account for. German writes its nouns like names, so they aren't counted."""
    return 0 if _GERMAN.search(rest) else len(_NAME.findall(rest))


@dataclass(frozen=True)
class Refusals:
    """The model, the score from which a sentence declines, and the score from which one with a known wording does."""

    model: naive_bayes.NaiveBayes | None = None
    high: float = 0.0
    low: float = 0.0

    def decline(self, rests: list[str]) -> list[bool]:
        """For each sentence without its question's words whether it declines."""
        if self.model is None:
            return [declines(r) and not _tells(r) for r in rests]
        scores = score(self.model, rests).tolist()
        return [s > self.low and (may and declines(r) and not _tells(r) or s > self.high and _says_nothing_new(r)) for s, may, r in zip(scores, may_decline(rests), rests)]


def _says_nothing_new(rest: str) -> bool:
    """Whether a sentence of some length holds neither a figure nor a new name."""
    return _LETTERS.match(rest) is not None and not new_names(rest) and not _DIGIT.search(rest)


def _tells(rest: str) -> bool:
    """Whether a sentence with a declining wording names somebody new and says more than a few words about it."""
    names = new_names(rest)
    return names > 0 and len(_WORD.findall(PATTERN.sub(" ", rest.lower()))) + names > FEW_WORDS


def score(model: naive_bayes.NaiveBayes, rests: list[str]) -> np.ndarray:
    """The mean log odds of a sentence's n-grams; 0 where nothing is left."""
    x, counts = scored(model.table[:, 1] - model.table[:, 0], letters_only([nameless(r) or r for r in rests]))
    return x / np.maximum(counts, 1)


def of_reply(text: str, question: str | None) -> list[tuple[int, str]]:
    """The sentences of a reply with a known wording: those that decline, and those that tell something with it."""
    out = []
    if ANYWHERE.search(text.lower()):
        for a, b in sentences_of(text):
            rest = without_question(text[a:b].strip(), question)
            if not declines(rest):
                continue
            if _tells(rest):
                out.append((TELLS, rest))
            elif not new_names(rest) and not any(c.isdigit() for c in rest):
                out.append((DECLINES, rest))
    return out


def of_answer(text: str, question: str | None) -> list[tuple[int, str]]:
    """The sentences of a gold answer, or of what is said around one."""
    rests = (without_question(text[a:b].strip(), question) for a, b in sentences_of(text))
    return [(ANSWERS, r) for r in rests if _LETTERS.match(r)]


def train(replies: Iterable[tuple[str, str | None]], answers: Iterable[tuple[str, str | None]]) -> Refusals:
    """From replies and gold answers, each with its question. Half sets the limits of a model of the other half."""
    found = [x for reply in replies for x in of_reply(*reply)] + [x for answer in answers for x in of_answer(*answer)]
    total, held = np.zeros(WIDTH, np.int64), np.zeros(2 * BINS, np.int64)
    _count(found, total)
    halves = _halves(total)
    if halves is None:
        return Refusals()
    _hold(found, halves, held)
    return _limited(total, held)


def train_over(found: DataFrame) -> Refusals:
    """``train`` from all sentences: what kind each is, and what the question leaves of it."""
    total = summed(found, WIDTH, lambda batch, x: _count(_pairs(batch), x))
    halves = _halves(total)
    if halves is None:
        return Refusals()
    sent = found.sparkSession.sparkContext.broadcast(halves)
    held = summed(found, 2 * BINS, lambda batch, x: _hold(_pairs(batch), sent.value, x))
    sent.unpersist()
    return _limited(total, held)


def _pairs(batch: pa.RecordBatch) -> list[tuple[int, str]]:
    return list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))


def _count(found: list[tuple[int, str]], total: np.ndarray) -> None:
    """Adds n-grams by half and class, and the number of sentences by half and kind."""
    grams, sizes = total[: 4 << BITS].reshape(4, -1), total[4 << BITS :].reshape(2, 3)
    for half in (0, 1):
        own = [(kind, rest) for kind, rest in found if _half(rest) == half]
        if own:
            for declining in (0, 1):
                if rests := [nameless(r) or r for kind, r in own if (kind == DECLINES) == declining]:
                    grams[2 * half + declining] += tallied(letters_only(rests))
            sizes[half] += np.bincount([kind for kind, _ in own], minlength=3)


def _halves(total: np.ndarray) -> list[naive_bayes.NaiveBayes | None] | None:
    """The models of the other half for each half; None where there is too little to learn from."""
    grams, sizes = total[: 4 << BITS].reshape(2, 2, -1), total[4 << BITS :].reshape(2, 3)
    if sizes[:, DECLINES].sum() < LEAST_DECLINING or not sizes[:, ANSWERS].sum():
        return None
    both = bool((sizes[:, [ANSWERS, DECLINES]] > 0).all())
    return [naive_bayes.from_counts(grams[1 - half], CLASSES) if both else None for half in (0, 1)]


def _hold(found: list[tuple[int, str]], halves: list[naive_bayes.NaiveBayes | None], held: np.ndarray) -> None:
    """Adds the scores that sentences get from the other half's model: those that answer or tell, and those that decline."""
    rows = held.reshape(2, BINS)
    for half, model in enumerate(halves):
        own = [(kind, rest) for kind, rest in found if _half(rest) == half] if model else []
        if own:
            at = np.clip(((score(model, [r for _, r in own]) + FARTHEST) / STEP).astype(np.int64), 0, BINS - 1)
            np.add.at(rows, (np.array([kind == DECLINES for kind, _ in own], int), at), 1)


def _limited(total: np.ndarray, held: np.ndarray) -> Refusals:
    """The model of both halves, with the scores that but few held-out sentences lie beyond."""
    answers, declining = held.reshape(2, BINS)
    if not declining.any():
        return Refusals()
    above = answers[::-1].cumsum()[::-1]  # with a score in the bin or above
    high = STEP * (np.flatnonzero(above > answers.sum() // ANSWERS_ABOVE).max() + 1) - FARTHEST if answers.any() else 0.0
    below = declining.cumsum()
    low = STEP * np.flatnonzero(below > declining.sum() // DECLINES_BELOW).min() - FARTHEST
    grams = total[: 4 << BITS].reshape(2, 2, -1).sum(axis=0)
    return Refusals(naive_bayes.from_counts(grams, CLASSES), max(0.0, float(high)) + SLACK, min(0.0, float(low) - SLACK))


def _half(text: str) -> int:
    """Equal texts are in one half."""
    return zlib.crc32(text.encode("utf-8", "replace")) // 7 % 2


def refusing(replies: list[tuple[str, str | None]], model: Refusals = Refusals()) -> list[bool]:
    """For each reply, with its question, whether all of its sentences decline, whoever they name.

    A few words beside them, such as a greeting, don't count. All sentences are looked at together.
    """
    rests: dict[str, int] = {}
    places: list[list[int]] = []
    for body, question in replies:
        own = []
        for a, b in sentences_of(body):
            s = body[a:b].strip()
            if _SOME_LETTERS.match(s):
                own.append(rests.setdefault(without_question(s, question), len(rests)))
        places.append(own)
    declined = model.decline(list(rests)) if rests else []
    rest = list(rests)

    def short(i: int) -> bool:
        return len(_WORD.findall(rest[i])) <= 3 and sum(map(len, _CJK_RUN.findall(rest[i]))) <= 6

    return [any(declined[i] for i in own) and all(declined[i] or short(i) for i in own) for own in places]


def refuses(body: str, question: str | None, model: Refusals = Refusals()) -> bool:
    return refusing([(body, question)], model)[0]
