"""Byte-pair encoding by dynamic programming over byte prefixes.

An encoding is right exactly when each neighbouring pair of its tokens is what merging would give for the two
together. So every byte prefix has one valid last token: a token that ends there and fits the last token of the
prefix before it. Storing that token for each prefix gives the encoding of every prefix, lets bytes be appended
without looking back, and lets an edit reuse all that lies before it.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import regex

from passagemill.llm.vocab import byte_ranks, split_pattern

#: Entries of the per-process tables. When one is full it is emptied: this bounds memory and changes no result.
PIECE_TABLE = 200_000
PAIR_TABLE = 2_000_000


@dataclass(frozen=True)
class Encoded:
    """A text, its ids, where its pre-tokens begin in the text and in the ids, and how many bytes were encoded for it."""

    text: str
    ids: list[int]
    starts: list[int]
    places: list[int]
    encoded_bytes: int


class PrefixEncoder:
    """Encodes with one byte-level vocabulary; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces_of = regex.compile(pattern)
        self.tokens = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.tokens.add_word(token.decode("latin-1"), (i, len(token)))
        self.tokens.make_automaton()
        self._alone: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Plain merging by rank; used for the few bytes of one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stands_alone(self, token: int) -> bool:
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self._merge(self.bytes_of[token]) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIR_TABLE:
                self._pairs.clear()
            known = self._merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._pairs[key] = known
        return known

    def extend(self, last: list[int], data: bytes, known: int = 0) -> list[int]:
        """The last tokens of all prefixes of ``data``, of which ``last`` holds those up to ``known`` bytes."""
        del last[known:]
        last += [-1] * (len(data) - known)
        fits, alone = self.fits, self.stands_alone
        start_at = max(0, known - self.longest) if known else 0
        text = data[start_at:].decode("latin-1")
        for end, (token, length) in self.tokens.iter(text):
            end += start_at
            if last[end] >= 0:
                continue
            before = end - length
            if alone(token) if before < 0 else (last[before] >= 0 and fits(last[before], token)):
                last[end] = token
        return last

    @property
    def longest(self) -> int:
        found = self.__dict__.get("_longest")
        if found is None:
            found = self.__dict__["_longest"] = max(map(len, self.ranks))
        return found

    def walk_back(self, last: list[int], size: int) -> list[int]:
        """The ids of the prefix of ``size`` bytes."""
        ids, bytes_of = [], self.bytes_of
        while size > 0:
            token = last[size - 1]
            ids.append(token)
            size -= len(bytes_of[token])
        ids.reverse()
        return ids

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ids = self._pieces.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            if whole is not None and self.stands_alone(whole):
                ids = (whole,)
            else:
                ids = tuple(self.walk_back(self.extend([], data), len(data)))
            if len(self._pieces) >= PIECE_TABLE:
                self._pieces.clear()
            if len(piece) <= 64:
                self._pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            piece, add, table = self.piece, ids.extend, self._pieces
            for p in self.pieces_of.findall(text):
                add(table.get(p) or piece(p))
        return ids

    def encode_with_places(self, text: str) -> Encoded:
        """The ids of a text, and where each pre-token and its ids begin: what an edit needs later."""
        ids: list[int] = []
        starts, places = [], []
        for m in self.pieces_of.finditer(text):
            starts.append(m.start())
            places.append(len(ids))
            ids.extend(self.piece(m.group()))
        return Encoded(text, ids, starts, places, len(text.encode("utf-8", "replace")))

    def encode_edited(self, old: Encoded, new: str) -> Encoded:
        """The encoding of ``new`` from that of ``old``: only pre-tokens near the edit are encoded.

        A pre-token depends on the text from its start on, two characters beyond its end included. So pre-tokens that
        end before the edit stay, and once a pre-token of ``new`` starts where one of ``old`` did, behind the edit,
        the rest stays as well. Text appended is an edit at the end. ``encoded_bytes`` says what was encoded.
        """
        same = _alike(old.text, new, False)
        tail = min(_alike(old.text, new, True), min(len(old.text), len(new)) - same)
        shift = len(new) - len(old.text)
        kept = max(bisect_left(old.starts, same - 1) - 1, 0)
        begin = old.starts[kept] if kept < len(old.starts) else 0
        ids = old.ids[: old.places[kept] if kept < len(old.places) else 0]
        starts, places, encoded = old.starts[:kept], old.places[:kept], 0
        for m in self.pieces_of.finditer(new, begin):
            if m.start() >= len(new) - tail:
                k = bisect_left(old.starts, m.start() - shift)
                if k < len(old.starts) and old.starts[k] == m.start() - shift:
                    move = len(ids) - old.places[k]
                    return Encoded(
                        new, ids + old.ids[old.places[k] :], starts + [x + shift for x in old.starts[k:]], places + [x + move for x in old.places[k:]], encoded
                    )
            starts.append(m.start())
            places.append(len(ids))
            ids.extend(self.piece(m.group()))
            encoded += len(m.group().encode("utf-8", "replace"))
        return Encoded(new, ids, starts, places, encoded)


def _alike(a: str, b: str, from_end: bool) -> int:
    """How many characters two texts share at one side, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        equal = a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] if from_end else a[low:mid] == b[low:mid]
        low, high = (mid, high) if equal else (low, mid - 1)
    return low


@lru_cache(maxsize=2)
def prefix_encoder(name: str, folder: str | None = None) -> PrefixEncoder:
    """One encoder per worker process and vocabulary."""
    return PrefixEncoder(byte_ranks(name, folder), split_pattern())
