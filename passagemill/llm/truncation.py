"""Whether a response breaks off before its end, from the likelihood that a text ends there.

A maximum-entropy model weighs that likelihood with the marks at the end, with what is left open, and with whether the
gold answer goes on from there. It is trained on complete texts and on the same texts broken off at places by chance.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from passagemill.llm import endings, maxent
from passagemill.llm.totals import summed
from passagemill.session import cut

#: Share of responses taken to be broken off beforehand; the odds of training, where half are, have to outweigh it.
SHARE = 0.25
#: Cuts made of each complete text.
CUTS = 3
#: How strongly the weights are drawn to PRIOR.
RIDGE = 2.0
#: Share of training texts that end in dots, as complete ones may and broken off ones often do; share that is wrapped, and in what.
DOTTED = 0.1
WRAPPED, WRAPPERS = 0.1, (('{"answer": "', '"}'), ("**", "**"), ("“", "”"), ("(", ")"))
STRONG = "!?。！？।؟॥"
CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_OTHER_SCRIPT = re.compile(r"[\u0370-\u1fff]")
_FOUR_WORDS = re.compile(r"[\W_]*+(?:[^\W_]++[\W_]++){3}[^\W_]")
_GOLD_GOES_ON = re.compile(r"[.!?…。！？।]?[\"”’»)」』]*(?:\s|$)")
# two letters with marks and white space after them, or a mark that needs none
_INNER_END = re.compile(r"[.!?…。！？।؟॥](?:(?<=[。！？।؟॥])|(?<=[^\W\d_]{2}[.!?…])[.!?…]*[\"”’»)]*\s)")
_LISTED = re.compile(r"^[\s\-*•\d.)]+")
_BRACKETS = (("{", "}"), ("[", "]"), ("(", ")"), ("「", "」"))
_OPENS = re.compile("[{\\[(「*“«„]")


def script(text: str) -> str:
    return "latin" if text.isascii() else "unspaced" if CJK.search(text) else "other" if _OTHER_SCRIPT.search(text) else "latin"


def _several_words(text: str) -> bool:
    """Whether there are four words or more."""
    return _FOUR_WORDS.match(text) is not None


def left_open(answer: str) -> bool:
    """Whether a bracket, quotation or emphasis is opened and not closed."""
    if not _OPENS.search(answer):
        return False
    for a, b in _BRACKETS:
        if a in answer and answer.count(a) > answer.count(b):
            return True
    if "**" in answer and answer.count("**") % 2:
        return True
    if answer.isascii():
        return False
    for mark, closing in (("“", "”"), ("«", "»"), ("„", "“”")):
        i = answer.rfind(mark)
        if i < 0 or any(c in answer[i + 1 :] for c in closing):
            continue
        if mark == "“" and "„" in answer[:i] or mark == "«" and "»" in answer[:i]:
            continue
        return True
    return False


def signs(body: str, answer: str, gold: str | None) -> tuple[str, int]:
    """What speaks for and against an end after ``body``, the part of ``answer`` that answers: the text that may end, and a bit for each sign."""
    text = body.rstrip()
    tail = text.rstrip("\"'”’“»«*_ ")
    last, kind = tail[-1:], script(text)
    strong = loose = dots = dot = False
    if last and not last.isalnum():
        strong = last in STRONG
        dots = last == "…" or tail.endswith("..")
        dot = last == "." and not dots
        loose = last in ",;:([{«„–—-/&" and text[-1:] == last
    listed = None if tail[:1].isalpha() else _LISTED.match(tail)
    short = not _several_words(tail[listed.end() :] if listed else tail) and not (kind == "unspaced" and len(tail) > 12)
    told = _INNER_END.search(tail) is not None  # a sentence that ended before the last one
    inside = at_word = at_sentence = False
    g = gold.strip() if gold else ""
    if len(g) > len(text) > 0 and g.startswith(text):
        rest = g[len(text) :]
        ended = _GOLD_GOES_ON.match(rest) and (rest[0] in ".!?…。！？।" or text[-1] in ".!?…。！？।") or strong
        inside = not ended and rest[0].isalnum() and text[-1].isalnum() and kind != "unspaced"
        at_word = not ended and not inside
        at_sentence = bool(ended)
    found = strong | dot << 1 | dots << 2 | loose << 3 | left_open(answer) << 4 | short << 5 | inside << 6 | at_word << 7 | at_sentence << 8
    return text, int(found | told << 9 | (kind == "unspaced") << 10 | (kind == "other") << 11)


def likelihoods(texts: list[str], ends: endings.Endings) -> np.ndarray:
    return np.maximum(-12.0, np.log(ends.probabilities(texts) + 1e-9))


def features(likely: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The model's features of many ends, a row each."""
    strong, dot, dots, loose, opened, short, inside, at_word, at_sentence, told, signs, other = ((bits >> k & 1).astype(bool) for k in range(12))
    plain = ~(strong | dot | dots | loose)
    return np.column_stack([
        np.ones(len(likely)), likely, strong, dot, dots, loose, opened, short, inside, at_word, at_word & short, at_sentence,
        likely * dot, likely * strong, likely * short, likely * at_sentence, likely * signs, likely * other,
        signs, other, plain * likely, short & plain, likely * dots, told & plain, likely * (told & plain),
        likely * (signs & short), signs & short, likely * (told & signs & plain),
    ])


FEATURES = 28
#: What the weights are drawn to: what holds in any language where training says nothing.
PRIOR = {1: -1.0, 2: -3.0, 5: 3.0, 6: 3.0, 8: 5.0, 9: 2.0, 11: -2.0}


@dataclass(frozen=True)
class Truncation:
    ends: endings.Endings
    weights: np.ndarray = field(default_factory=lambda: np.array([PRIOR.get(j, 0.0) for j in range(FEATURES)]))

    def broken_off(self, rows: list[tuple[str, str, str | None]]) -> list[bool]:
        """For each (body, answer, gold answer) whether the answer breaks off."""
        if not rows:
            return []
        texts, bits = zip(*[signs(*r) for r in rows])
        return (features(likelihoods(texts, self.ends), np.array(bits)) @ self.weights > math.log(1 / SHARE - 1)).tolist()


_SENTENCE_END = re.compile(r"[.!?…。！？।؟॥](?:(?<=[^\W\d_]{3}[.!?…])[.!?…]*[\"”’»)]*(?=\s|$)|(?<=[。！？।؟॥])[\"”’»)」』]*)")


def _sentence_ends(text: str) -> set[int]:
    return {m.end() for m in _SENTENCE_END.finditer(text)}


def half_of(text: str) -> int:
    """The half that a text is in: what the model learns from was not seen by its likelihood of ends."""
    return zlib.crc32(text.encode("utf-8", "replace")) // 5 % 2


def examples(whole: str) -> list[tuple[str, int, bool]]:
    """A complete text, with and without its closing mark and its gold answer, and cuts of it: signs, and whether it is broken off.

    Chance depends on the text alone. An unrelated gold answer would show no sign, so none is given where it isn't the text's own.
    """
    out: list[tuple[str, int, bool]] = []
    pick = random.Random(zlib.crc32(whole.encode("utf-8", "replace")))

    def add(text: str, gold: str | None, broken: bool) -> None:
        if text.strip():
            answer = text
            if pick.random() < DOTTED:
                text = answer = text.rstrip(".。 ") + ("..." if pick.random() < 0.7 else "…")
            elif pick.random() < WRAPPED:  # as models often write their answers
                before, after = pick.choice(WRAPPERS)
                answer = before + text + ("" if broken else after)
                text = answer if before.startswith("{") else text
            out.append((*signs(text, answer, gold), broken))

    text = whole.strip()
    bare = text.rstrip(".。") or text
    stops = sorted(_sentence_ends(text) - {len(text)})
    for body in (text, bare):
        add(body, None, False)
    if stops:
        add(text[: pick.choice(stops)], text, False)
    if bare != text:
        add(bare, text, False)
    done = {len(text), len(bare), *stops, *(s - 1 for s in stops)}
    for j in range(CUTS):
        most = min(len(bare), 24) if j == 0 else len(bare)
        k = pick.randrange(1, most) if most > 1 else 0
        if j == 1 and " " in text[:k]:
            k = text.rindex(" ", 0, k)
        while k and text[k - 1].isspace():
            k -= 1
        if k == 0 or k in done:
            continue
        own = pick.random() < 0.5 or j == 0
        # a word or two without a gold answer may be a whole answer
        if own or _several_words(text[:k]) or script(text) == "unspaced" and k > 12:
            add(text[:k], text if own else None, True)
    return out


#: Fewer complete texts than these are no ground to weigh the signs by.
LEAST_TEXTS = 20


def shown(texts: list[str], halves: list[endings.Endings]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all examples of some texts: how likely the other half's texts end there, the signs, and whether it is broken off."""
    parts = [(np.zeros(0), np.zeros(0, np.int16), np.zeros(0, np.int8))]
    own: tuple[list[str], list[str]] = ([], [])
    for t in texts:
        own[half_of(t)].append(t)
    for half in (0, 1):
        found = [e for t in own[half] for e in examples(t)]
        if found:
            ended, bits, broken = zip(*found)
            parts.append((likelihoods(ended, halves[1 - half]), np.array(bits, np.int16), np.array(broken, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def train(texts: list[str]) -> Truncation:
    """From complete texts and their sentences."""
    both = [endings.counted([s for t in texts if half_of(t) == half for s in split_ends(t)]) for half in (0, 1)]
    ends = endings.from_counts(*(a + b for a, b in zip(*both)))
    if len(texts) < LEAST_TEXTS:
        return Truncation(ends)
    halves = [endings.from_counts(*x) for x in both]
    likely, bits, broken = shown(texts, halves)
    return Truncation(ends, maxent.fit(features(likely, bits), broken.astype(float), PRIOR, RIDGE))


def train_over(texts: DataFrame) -> Truncation:
    """``train`` from all of the complete texts in the only column, each of which is there once."""
    size, context = 1 << endings.BITS, texts.sparkSession.sparkContext
    width = 2 * size + 3  # a half's counts at ends and at any place, its ends, its places and its texts

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        halves: tuple[list[str], list[str]] = ([], [])
        for t in batch.column(0).to_pylist():
            halves[half_of(t)].append(t)
        for half, own in enumerate(halves):
            if own:
                x = total[half * width : (half + 1) * width]
                final, places, *sizes = endings.counted([s for t in own for s in split_ends(t)])
                x[:size] += final
                x[size : 2 * size] += places
                x[2 * size :] += [*sizes, len(own)]

    both = summed(texts, 2 * width, count).reshape(2, width)
    ends, *halves = (endings.from_counts(x[:size], x[size : 2 * size], int(x[-3]), int(x[-2])) for x in (both.sum(axis=0), *both))
    if both[:, -1].sum() < LEAST_TEXTS:
        return Truncation(ends)
    unseen = context.broadcast(halves)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                parts = shown(whole.column(0).slice(at, 2000).to_pylist(), unseen.value)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["likely", "bits", "broken"])

    rows = cut(texts.mapInArrow(show, "likely binary, bits binary, broken binary"))
    unseen.unpersist()

    def slopes_at(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + FEATURES + FEATURES * FEATURES)
            for batch in batches:
                for likely, bits, broken in zip(*(c.to_pylist() for c in batch.columns)):
                    x = features(np.frombuffer(likely), np.frombuffer(bits, np.int16))
                    total += maxent.slopes(x, np.frombuffer(broken, np.int8).astype(float), w)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        return np.sum([np.frombuffer(x) for x in rows.mapInArrow(run, "total binary").toArrow().column(0).to_pylist()], axis=0)

    return Truncation(ends, maxent.fit_over(slopes_at, FEATURES, PRIOR, RIDGE))


_ENDED = re.compile(r"(?<=[^\W\d_]{3}[.!?])\s+(?=[^\W\d_a-z])|(?<=[。！？।؟])|\n\s*\n")


def split_ends(text: str) -> list[str]:
    """A complete text's parts that end as complete texts do."""
    return [t for t in _ENDED.split(text) if t.strip()]
