"""Hashed character n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

ORDERS = (1, 2, 3, 4)
BITS = 17
#: n-grams scored at a time; bounds the memory of one step.
CHUNK = 1 << 17
#: Signs of lines that are looked at together; what is worked on then stays near the processor.
SIGNS = 1 << 15

_KEPT = regex.compile(r"[\p{L}\p{M}\n]+")
#: The planes of Unicode that hold signs, other than those for private use.
_PLANES = ((0, 0x40000), (0xE0000, 0xF0000))
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """Of each sign whether it is a letter, a mark or a line break."""
    table = np.zeros(0x110000, bool)
    for a, b in _PLANES:
        for m in _KEPT.finditer(np.arange(a, b, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")):
            table[a + m.start() : a + m.end()] = True
    return table


def letters_only(texts: list[str]) -> str:
    """The texts in lower case, one a line, with one space for whatever isn't a letter or mark."""
    line = "\n".join([" " + t.replace("\n", " ") + " " for t in texts]).lower()
    table, parts, before = _kept(), [], True  # whether the sign before the piece is kept
    for at in range(0, len(line), SIGNS):
        code = np.frombuffer(line[at : at + SIGNS].encode("utf-32-le", "surrogatepass"), np.uint32)
        kept = table[code]
        first = ~kept
        first[1:] &= kept[:-1]
        first[0] &= before
        before = bool(kept[-1])
        parts.append(np.where(kept, code, np.uint32(32))[kept | first].tobytes())
    return b"".join(parts).decode("utf-32-le", "surrogatepass")


def hashed(texts: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, text by text, and the number of them in each text.

    Words are padded by one space. n-grams of one letter leave the spaces out.
    """
    if not texts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    line = letters_only(texts)
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    breaks = code == 10
    owner = np.cumsum(breaks) - breaks
    to_break = np.full(n, n, np.int64)
    at = np.flatnonzero(breaks)
    ends = np.append(at, n)
    to_break = ends[owner] - np.arange(n)
    space = (code == 32) | breaks
    found, owners = [], []
    h = np.zeros(n, np.uint32)
    for order in range(1, max(orders) + 1):
        shifted = code[order - 1 :]
        h = h[: n - order + 1] if order > 1 else h
        if len(shifted) == 0:
            break
        h = (h ^ (shifted * _MIX[(order - 1) % 4])) * np.uint32(0x01000193) + np.uint32(order)
        if order not in orders:
            continue
        ok = to_break[: len(h)] >= order
        if order == 1:
            ok &= ~space
        else:
            ok &= ~(space[: len(h)] & space[order - 1 :][: len(h)]) if order == 2 else True
        keep = np.flatnonzero(ok)
        x = h[keep]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((x ^ (x >> np.uint32(13))) >> np.uint32(32 - bits))
        owners.append(owner[keep])
    h, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner.astype(np.uint16) if len(texts) < 1 << 16 else owner, kind="stable")  # a radix sort of small numbers
    return h[order], np.bincount(owner, minlength=len(texts)).astype(np.int64)


def places(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ORDERS the hash of the n-gram that begins at each sign of ``letters_only``'s lines, and whether one does; the same n-grams as ``hashed``."""
    breaks = code == 10
    space = (code == 32) | breaks
    h = np.zeros(len(code), np.uint32)
    ok = ~breaks
    for order in ORDERS:
        if order > len(code):
            break
        shifted = code[order - 1 :]
        h = h[: len(shifted)] ^ shifted * _MIX[order - 1]
        h *= np.uint32(0x01000193)
        h += np.uint32(order)
        ok = ok[: len(shifted)] & ~breaks[order - 1 :]
        x = h >> np.uint32(15)
        x ^= h
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        x >>= np.uint32(32 - BITS)
        yield x, ok & ~space if order == 1 else ok & ~(space[:-1] & space[1:]) if order == 2 else ok


def _pieces(line: str) -> Iterator[tuple[int, np.ndarray]]:
    """The number of lines, and their codes, in pieces of about SIGNS signs of whole lines."""
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.append(np.flatnonzero(code == 10), len(code))
    a = at = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, at + SIGNS, "right")))
        yield b - a, code[at : ends[b - 1]]
        a, at = b, int(ends[b - 1]) + 1


def tallied(line: str) -> np.ndarray:
    """How often each n-gram is in some lines of ``letters_only``."""
    found = np.zeros(1 << BITS, np.int64)
    for _, code in _pieces(line):
        if len(code):
            found += np.bincount(np.concatenate([x[ok] for x, ok in places(code)]), minlength=1 << BITS)
    return found


def located(line: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All n-grams of some lines of ``letters_only``: the number of the line and the hash of each."""
    first = 0
    for lines, code in _pieces(line):
        owner = np.cumsum(code == 10)
        owner += first
        first += lines
        for x, ok in places(code):
            keep = np.flatnonzero(ok)
            yield owner[keep], x[keep]


def scored(table: np.ndarray, line: str) -> tuple[np.ndarray, np.ndarray]:
    """For each line of ``letters_only`` the sum of its n-grams' rows in ``table``, and how many it has."""
    out, sizes = [], []
    for lines, code in _pieces(line):
        total, many = np.zeros((lines, *table.shape[1:]), np.float32), np.zeros(lines, np.int64)
        starts = np.append(0, np.flatnonzero(code == 10) + 1)
        for x, ok in places(code):
            keep = np.flatnonzero(ok)
            at = np.searchsorted(keep, starts)
            count = np.diff(at, append=len(keep))
            some = np.flatnonzero(count)
            if len(some):
                total[some] += np.add.reduceat(table.take(x[keep], axis=0), at[some], axis=0)
                many += count
        out.append(total)
        sizes.append(many)
    return np.concatenate(out), np.concatenate(sizes)


def sums(table: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the sum of its n-grams' rows in ``table``."""
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    ends = np.cumsum(counts)
    starts = ends - counts
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        some = np.flatnonzero(counts[a:b]) + a
        if len(some):
            rows = table.take(h[starts[some[0]] : ends[some[-1]]], axis=0)
            out[some] = np.add.reduceat(rows, starts[some] - starts[some[0]], axis=0)
        a = b
    return out
