"""Spans of quoted text."""

from __future__ import annotations

import re

#: What closes a quotation that each mark opens.
CLOSERS = {
    '"': '"',
    "“": "”“",
    "„": "“”",
    "”": "”",
    "«": "»",
    "»": "«»",
    "「": "」",
    "『": "』",
    "‹": "›",
}
_MARK = re.compile("[" + "".join(CLOSERS) + "]")
_ANY = re.compile("[\"“„”«»「『‹]")
#: Up to so many characters on, the first closing mark ends a quotation however it stands. Later ones, up to the end of
#: the paragraph, do so unless the quotation's own mark opens another one before, since then its end is missing.
NEAR_QUOTE = 600
_UNSPACED_OPEN = "「『„“«"
_LEADS = "([{—–-:：،,"


def _far_end(text: str, mark: str, at: int, stop: int) -> int:
    """The place of a closing mark far from its opening one, or -1."""
    end = stop
    for c in CLOSERS[mark]:
        j = text.find(c, at, end)
        end = j if j >= 0 else end
    if end == stop:
        return -1
    if mark not in CLOSERS[mark]:
        return -1 if text.find(mark, at, end) >= 0 else end
    before, after = text[end - 1], text[end + 1 : end + 2]
    again = text[end] == mark and (before.isspace() or before in _LEADS) and after.strip()
    return -1 if again else end


def quote_spans(text: str) -> list[tuple[int, int]]:
    """Start and end (past the closing mark) of each quotation, outermost only, in order."""
    if '"' not in text and (text.isascii() or not _ANY.search(text)):
        return []
    spans, at, n = [], 0, len(text)
    paragraph = -1
    while True:
        m = _MARK.search(text, at)
        if not m:
            return spans
        i = m.start()
        mark = text[i]
        at = i + 1
        before = text[i - 1] if i else " "
        if mark not in _UNSPACED_OPEN and not (before.isspace() or before in "([{—–-:：،,'’" or ord(before) > 0x2E80):
            continue
        if at >= n or (text[at].isspace() and mark not in "«"):
            continue
        if paragraph < at:
            paragraph = text.find("\n\n", at)
            paragraph = n if paragraph < 0 else paragraph
        stop = min(paragraph, at + NEAR_QUOTE)
        ends = [j for c in CLOSERS[mark] if (j := text.find(c, at, stop)) >= 0]
        end = min(ends) if ends else _far_end(text, mark, at, paragraph)
        if end >= 0:
            at = end + 1
            spans.append((i, at))
