"""Language labels as they arrive, and the languages the operators know."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-letter code, three-letter codes, English name.
KNOWN = {
    "en": ("eng", "english"),
    "fr": ("fra fre", "french"),
    "de": ("deu ger", "german"),
    "es": ("spa", "spanish"),
    "it": ("ita", "italian"),
    "pt": ("por", "portuguese"),
    "nl": ("nld dut", "dutch"),
    "pl": ("pol", "polish"),
    "sv": ("swe", "swedish"),
    "da": ("dan", "danish"),
    "tr": ("tur", "turkish"),
    "id": ("ind", "indonesian"),
    "ru": ("rus", "russian"),
    "uk": ("ukr", "ukrainian"),
    "el": ("ell gre", "greek"),
    "ar": ("ara", "arabic"),
    "fa": ("fas per", "persian"),
    "hi": ("hin", "hindi"),
    "zh": ("zho chi", "chinese"),
    "ja": ("jpn", "japanese"),
    "ko": ("kor", "korean"),
    "th": ("tha", "thai"),
}
CODES = tuple(KNOWN)
# Further names in use for these languages.
OTHER_NAMES = {"mandarin": "zh", "farsi": "fa", "castilian": "es", "bahasa": "id", "cmn": "zh", "in": "id", "deutsch": "de",
               "français": "fr", "español": "es", "italiano": "it", "português": "pt", "nederlands": "nl", "polski": "pl",
               "svenska": "sv", "dansk": "da", "türkçe": "tr", "русский": "ru", "українська": "uk", "ελληνικά": "el",
               "العربية": "ar", "فارسی": "fa", "हिन्दी": "hi", "中文": "zh", "日本語": "ja", "한국어": "ko", "ไทย": "th"}


def _spellings() -> dict[str, str]:
    found = dict(OTHER_NAMES)
    for code, (three, name) in KNOWN.items():
        found |= dict.fromkeys([code, *three.split(), name], code)
    return found


SPELLINGS = _spellings()


def clean_code(label: str | None) -> str | None:
    """The two-letter code a label names, or None for a missing label, a placeholder or an unknown language."""
    key = (label or "").strip().lower()
    if key in SPELLINGS:
        return SPELLINGS[key]
    for mark in "-_ (,;":
        key = key.split(mark)[0]
    return SPELLINGS.get(key)


def clean_code_column(label: Column) -> Column:
    """``clean_code`` as a column expression."""
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    key = F.lower(F.btrim(label, F.lit(" \t\r\n ")))
    return F.coalesce(F.element_at(table, key), F.element_at(table, F.regexp_extract(key, r"^[^-_ (,;]*", 0)))
