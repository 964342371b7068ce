"""How likely a text ends where it ends, from n-grams at the ends of complete texts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

ORDERS = (1, 2, 3, 4, 5, 7, 11)
BITS = 20
#: What a shorter ending counts for beside a longer one.
BACKOFF = 1.5
_FIGURE = re.compile("[0-9]")
#: What an answer may be wrapped in.
_OPENING = "\"'“„«「『*_([{ "
_MARKS = ".!?…。！？｡؟।"


@dataclass(frozen=True)
class Endings:
    """Hashed counts of n-grams: at ends of texts, and at any place."""

    final: np.ndarray
    total: np.ndarray
    base: float

    def probability(self, text: str) -> float:
        """Probability of an end after ``text``, backing off from the longest ending to none. Closing marks are put aside."""
        body = bare_end(text)
        p = self.base
        for key in _keys(body):
            n = float(self.total[key])
            if n == 0:
                break
            p = (float(self.final[key]) + BACKOFF * p) / (n + BACKOFF)
        return p

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """``probability`` of many texts at once."""
        longest = ORDERS[-1]
        bodies = ["\x02" + _last_signs(t).lower() for t in texts]
        line = "".join([b[-longest:][::-1].ljust(longest, "\0") for b in bodies])
        code = _zeroed(line).reshape(len(texts), longest)
        sizes = np.array([len(b) for b in bodies])
        p = np.full(len(texts), self.base)
        h = np.full(len(texts), 0x811C9DC5, np.uint32)
        alive = np.ones(len(texts), bool)
        for order in range(1, longest + 1):
            h = (h ^ code[:, order - 1]) * np.uint32(0x01000193)
            if order in ORDERS:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                key = ((x ^ (x >> np.uint32(13))) + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
                n = self.total[key].astype(float)
                alive &= (sizes >= order) & (n > 0)
                p = np.where(alive, (self.final[key] + BACKOFF * p) / (n + BACKOFF), p)
        return p


def bare_end(text: str) -> str:
    """The text in lower case without the marks, quotes and brackets at its end; figures count as zeros."""
    return zeros(_last_signs(text)).lower()


def _last_signs(text: str) -> str:
    body = text.strip().lstrip(_OPENING).rstrip("\"'”’“»«)]}」』*_ ")
    return body.rstrip(_MARKS).rstrip("\"'”’“»«」』 ")[-24:]


@lru_cache(maxsize=1)
def _digits() -> np.ndarray:
    """Of each sign whether it is a digit; the last ones lie below U+20000."""
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x20000) if chr(i).isdigit()]] = True
    return table


def _zeroed(line: str) -> np.ndarray:
    """The codes of a line, figures as zeros."""
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_digits()[code], np.uint32(48), code)


def zeros(text: str) -> str:
    if text.isascii():
        return _FIGURE.sub("0", text)
    return "".join("0" if c.isdigit() else c for c in text)


def _keys(body: str) -> list[int]:
    out, h, n = [], 0x811C9DC5, 0
    padded = "\x02" + body
    for c in reversed(padded):
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        n += 1
        if n in ORDERS:
            out.append(_fold(h, n))
        if n >= ORDERS[-1]:
            break
    return out


def _fold(h: int, n: int) -> int:
    h = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
    return ((h ^ (h >> 13)) + n * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS)


def fit(texts: list[str]) -> Endings:
    """From complete texts. Every place within a text counts as one where a text could have ended but did not."""
    return from_counts(*counted(texts))


def from_counts(final: np.ndarray, total: np.ndarray, ends: int, places: int) -> Endings:
    return Endings(final.astype(np.float32), total.astype(np.float32), ends / places if places else 0.5)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """n-grams at ends of texts and at any place, the number of texts, and of places; those of all texts are sums."""
    rows = ["\x02" + body for t in texts if (body := _whole(t))]
    code = _zeroed("\n".join(rows).lower())[::-1].copy()
    n = len(code)
    if n == 0:
        return np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), 0, 0
    final, total = [], []
    breaks = code == 10
    starts = np.append(0, np.flatnonzero(breaks) + 1)
    h = np.full(n, 0x811C9DC5, np.uint32)
    alive = ~breaks & (code != 2)
    for order in range(1, ORDERS[-1] + 1):
        if order > n:
            break
        h = (h[: n - order + 1] ^ code[order - 1 :]) * np.uint32(0x01000193)
        alive = alive[: n - order + 1] & ~breaks[order - 1 :]
        if order in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            x = ((x ^ (x >> np.uint32(13))) + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
            total.append(x[alive])
            at_end = starts[starts < len(alive)]
            final.append(x[at_end[alive[at_end]]])
        # no n-gram reaches over the start of its text
        alive = alive & (code[order - 1 :][: len(alive)] != 2)
    return np.bincount(np.concatenate(final), minlength=1 << BITS), np.bincount(np.concatenate(total), minlength=1 << BITS), len(rows), n + 1


def _whole(text: str) -> str:
    body = text.strip().lstrip(_OPENING).rstrip("\"'”’“»«)]}」』*_ ").rstrip(_MARKS).rstrip("\"'”’“»«」』 ")
    return body.replace("\n", " ")
