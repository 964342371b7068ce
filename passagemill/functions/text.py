"""Text scalars of the retrieval pipeline and its evaluation, as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
#: Characters of a context that a judge is shown.
CONTEXT_CHARS = 20_000


def _case_pairs() -> tuple[str, str]:
    """Capitals of the Latin, Greek and Cyrillic blocks whose small letter is one sign, and these, in the same order."""
    blocks = ((0x41, 0x24F), (0x370, 0x52F))
    upper = [chr(c) for a, b in blocks for c in range(a, b + 1) if len(chr(c).lower()) == 1 and chr(c).lower() != chr(c)]
    return "".join(upper), "".join(c.lower() for c in upper)


#: Capitals and their small letters, one by one: lower case without rules for places in words, the same in any engine.
CAPITALS, SMALL = _case_pairs()


def fold(text: Column) -> Column:
    """Small letters for the capitals of Latin, Greek and Cyrillic, sign by sign."""
    return F.translate(text, CAPITALS, SMALL)


def content_id(namespace: str, text: Column) -> Column:
    """Identity of a text: the namespace and the MD5 of its UTF-8 bytes; null stays null."""
    return F.concat(F.lit(f"{namespace}-"), F.md5(text.cast("binary")))


def namespace_of(identity: Column) -> Column:
    """What stands before the first hyphen of an identity."""
    return F.substring_index(identity, "-", 1)


def numbered(index: Column, chunk: Column) -> Column:
    """A passage: its position, a colon and its text."""
    return F.concat(index.cast("string"), F.lit(":"), chunk)


def leading_index(passage: Column) -> Column:
    """The number before the first colon, or null."""
    found = F.regexp_extract(F.btrim(passage, F.lit(BLANKS)), r"^(\d+):", 1)
    return F.when(found != "", found.cast("bigint"))


def chunk_of(passage: Column) -> Column:
    """A passage without its leading number."""
    return F.regexp_replace(passage, r"^\d+:", "")


def title_and_body(passage: Column) -> tuple[Column, Column]:
    """Split at the first line break; without one the title is empty and the body is everything."""
    at = F.instr(passage, "\n")
    title = F.when(at > 0, F.substring_index(passage, "\n", 1)).otherwise(F.lit(""))
    body = F.when(at > 0, F.substr(passage, at + 1)).otherwise(passage)
    return title, body


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle; an empty one has none."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def normalize_answer(answer: Column) -> Column:
    """Lower case without ASCII punctuation and English articles, blanks collapsed; null becomes empty."""
    plain = F.translate(F.lower(F.coalesce(answer, F.lit(""))), string.punctuation, "")
    spaced = F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")
    return F.btrim(F.regexp_replace(spaced, r"\s+", " "), F.lit(BLANKS))


def contain_match(prediction: Column, gold: Column) -> Column:
    """1 if the normalized gold answer occurs in the normalized prediction.

    A blank or null side gives 0; a gold answer that normalizes to nothing gives 1.
    """
    blank = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS)) == ""
    wanted = normalize_answer(gold)
    inside = (wanted == "") | F.contains(normalize_answer(prediction), wanted)
    return F.when(blank(prediction) | blank(gold), 0).when(inside, 1).otherwise(0)


def extract_answer(reply: Column, mode: str) -> Column:
    """The answer in a model's reply, after the marker ``Answer:``.

    ``between``: up to a second marker, stripped. ``after``: all behind the first marker, stripped. Both leave a reply
    without marker as it is. ``stripped``: as ``after``, and a reply without marker is stripped, too.
    """
    marker = "Answer:"
    at = F.instr(reply, marker)
    rest = F.substr(reply, at + len(marker))
    if mode == "between":
        return F.when(at > 0, F.btrim(F.substring_index(rest, marker, 1), F.lit(BLANKS))).otherwise(reply)
    if mode == "after":
        return F.when(at > 0, F.btrim(rest, F.lit(BLANKS))).otherwise(reply)
    if mode == "stripped":
        return F.btrim(F.when(at > 0, rest).otherwise(reply), F.lit(BLANKS))
    raise ValueError(mode)


def verdict(reply: Column) -> Column:
    """1.0 for exactly ``correct``, case and surrounding blanks aside, else 0.0."""
    return F.when(F.lower(F.btrim(reply, F.lit(BLANKS))) == "correct", 1.0).otherwise(0.0)


def attribute_overlap(question: Column, passage: Column, keywords: list[str]) -> Column:
    """How many keywords occur, as substrings in lower case, in both."""
    q, p = F.lower(question), F.lower(passage)
    both = [(F.contains(q, F.lit(k)) & F.contains(p, F.lit(k))).cast("int") for k in keywords]
    return sum(both[1:], both[0])


def attribute_boost(overlap: Column, weight: float = 0.25) -> Column:
    return F.lit(weight) * F.log1p(overlap)


def asks_attribute(question: Column, keywords: list[str]) -> Column:
    """Whether any keyword is one of the question's words."""
    found = F.regexp_extract_all(F.lower(question), F.lit(r"(\w+)"), F.lit(1))
    return F.arrays_overlap(found, F.array(*[F.lit(k) for k in keywords]))


def prompt(passages: Column, question: Column) -> Column:
    """Ranked passages, one a line, and the question."""
    body = F.array_join(F.transform(passages, lambda p: F.concat(p, F.lit("\n"))), "")
    return F.concat(body, F.lit("Question: "), question, F.lit("\n Thought: "))


def judge_context(passages: Column) -> Column:
    return F.substring(F.array_join(passages, "\n"), 1, CONTEXT_CHARS)


def word_count(text: Column) -> Column:
    """Words between blanks; blank and null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def document_text(title: Column, sentences: Column) -> Column:
    """A document made of its title, a line break and its sentences as they are; a null title counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.array_join(sentences, ""))


def seconds_each(seconds: Column, n: Column) -> Column:
    """A batch's seconds over its number of questions; null for an empty batch."""
    return F.when(n > 0, seconds / n)


def seconds_per_million(seconds: Column, tokens: Column) -> Column:
    """Seconds for a million tokens; null where there are none."""
    return F.when(tokens > 0, seconds / tokens * 1e6)


def value_slug(value: Column) -> Column:
    """A number as part of a name: the point becomes p."""
    return F.replace(value.cast("string"), F.lit("."), F.lit("p"))


def name_key(name: Column) -> Column:
    """Case, blanks, hyphens and underscores aside."""
    return F.regexp_replace(F.lower(name), r"[\s_-]+", "")
