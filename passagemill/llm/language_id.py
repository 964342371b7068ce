"""Language of documents and of the stretches of mixed documents, whatever their label says.

Hierarchical discrimination: a linear model over character n-grams finds the language family, then linear support
vector machines, one for each pair of languages of a family, separate the related ones. Both are trained here, on a
bounded sample of labelled documents, whose labels are checked and corrected document by document.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.bounded import bounded_sample
from passagemill.llm.languages import CODES, clean_code_column
from passagemill.llm.naive_bayes import corrected
from passagemill.llm.ngrams import BITS, hashed, sums
from passagemill.llm.text_spans import quote_spans
from passagemill.session import spread

# The family of each language.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da"),
    "romance": ("fr", "es", "it", "pt"),
    "slavic": ("pl", "ru", "uk"),
    "turkic": ("tr",),
    "austronesian": ("id",),
    "hellenic": ("el",),
    "semitic": ("ar",),
    "iranian": ("fa",),
    "indo-aryan": ("hi",),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
    "tai": ("th",),
}
FAMILY_NAMES = tuple(FAMILIES)
PAIRS = tuple((a, b) for f in FAMILIES.values() for i, a in enumerate(f) for b in f[i + 1 :])

#: Bounds of the training sample: documents of each label, and sentences of each document.
TRAIN_DOCS, TRAIN_SENTENCES = 400, 4
#: Labels are checked by models trained without their document, in so many parts.
FOLDS = 3
#: A label is dropped where another language is this much likelier, as a difference of logarithms.
DOUBT = 3.0
#: Scales of margins to choose from, the share of labels taken to be wrong when one is chosen, and the scale of pairs without held-out sentences.
SCALES, WRONG, PAIR_SCALE = tuple(2.0 * 1.15**i for i in range(16)), 0.003, 6.0
#: Passes over the training sentences, the cost of a violated margin, and the step below which a sentence is left out of later passes.
EPOCHS, COST, SETTLED = 5, 4.0, 0.01
#: A sentence counts fully from so many bytes of letters on; the languages of neighbouring sentences differ at this cost.
FULL_LETTERS, SWITCH = 24, 0.7
#: The least log posterior that counts. Two changes must cost less than a sentence of LEAST_LETTERS can gain by it,
#: or a single sentence between two in a related language is never found.
FLOOR = -8.0
#: The cost where a rule, a slash, a dash or a blank line stands between them.
SWITCH_AT_RULE = 0.5
#: What a change to a related language costs in addition, since such languages are easily taken for each other.
RELATED = 0.1
#: From so many bytes of letters on, a stretch may be a language of its own. Below are labels, titles and names, and
#: what the rough cut leaves of references ("pp. 30-81).").
LEAST_LETTERS = 14

_CUT = regex.compile(r"([.!?…։؟۔]['\"”’»)\]]*)\s+(?=[^\s\p{Ll}\d])|([。！？｡।॥][」』”’）]*)|[^\S\n\t]*[\n\t]\s*|\s[/|—–]\s+")
_RULE = regex.compile(r"\s[/|—–]\s|^[-*_=~]{3,}|\n\s*\n|\n[-*_=~]{3,}")
_OTHER = re.compile(r"[\W\d_]+")
#: Not written in a language: addresses, tags, entities, file paths.
_CODE = regex.compile(r"(?:\w+://|www\.)\S+|\S+@\S+|</?[A-Za-z!][^<>]*>|&#?\w+;|[\w-]+(?:\.[a-z][a-z\d-]+)+(?:/\S*)?")


#: Capitalised words within a line are mostly names, which say little about the language around them.
_NAME = regex.compile(r"(?<=[^\s])(\s+(?:[\p{P}]*))\p{Lu}[\p{Ll}\p{M}'’-]+")
_LATIN_NAME = regex.compile(r"(?=\p{Lu})\p{Latin}[\p{Latin}\p{M}'’-]*")
_ALONE = regex.compile(r"[^\p{L}]*\p{Lu}[\p{L}\p{M}]*[^\p{L}]*")


_MAYBE_CODE = regex.compile(r"[<&@]|://|\w\.[a-z][a-z\d]")
_DOTTED = re.compile(r"\.[a-z][a-z\d]")
# the same for texts of ASCII signs, which these find faster; white space and marks are those of regex
_CUT_ASCII = re.compile(
    r"[.!?\t-\r ](?:(?<=[.!?])['\")\]]*()[\t-\r ]+(?=[^\t-\r a-z0-9])|(?<=[\n\t])[\t-\r ]*|(?<=[\x0b-\r ])[\x0b-\r ]*[\n\t][\t-\r ]*|(?<=[\t-\r ])[/|][\t-\r ]+)"
)
_NAME_ASCII = re.compile(r"([\t-\r ](?<=[^\t-\r ][\t-\r ])[\t-\r ]*[!-#%-*,-/:;?@\[-\]_{}]*)[A-Z][a-z'-]+")
_ALONE_ASCII = re.compile(r"[^a-zA-Z]*[A-Z][a-zA-Z]*[^a-zA-Z]*")
_FOREIGN = regex.compile(r"(?:[\p{Latin}\P{L}]*+\p{L}){3}")


def readable(text: str) -> str:
    """The text in composed form without addresses and markup."""
    if ("<" in text or "&" in text or "@" in text or "://" in text or _DOTTED.search(text)) and _MAYBE_CODE.search(text):
        text = _CODE.sub(" ", text)
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def nameless(sentence: str) -> str:
    """A sentence without its names; one that is nothing but a name or title becomes empty."""
    if sentence.isascii():
        left = sentence if sentence[1:].islower() else _NAME_ASCII.sub(r"\1", sentence)
        return "" if _ALONE_ASCII.fullmatch(left) else left
    left = sentence if sentence[1:].islower() else _NAME.sub(r"\1", sentence)
    if not left.isascii() and _FOREIGN.match(left):
        left = _LATIN_NAME.sub(" ", left)
    return "" if _ALONE.fullmatch(left) else left


_ACCENT = regex.compile("[\u0300-\u036f]+")


def _bare(text: str) -> str:
    """Without accents, as some sources deliver it."""
    return text if text.isascii() else _ACCENT.sub("", unicodedata.normalize("NFD", text))


@dataclass(frozen=True)
class LanguageModel:
    """One column of weights for each family and each pair of related languages, and the scales of their margins."""

    table: np.ndarray
    known: tuple[str, ...]
    family_scale: float = 6.0
    pair_scales: tuple[float, ...] = (PAIR_SCALE,) * len(PAIRS)

    @cached_property
    def parts(self) -> tuple[np.ndarray, dict[str, tuple[list[str], np.ndarray]]]:
        """The families' columns, and each larger family's members and columns, as small tables that stay in the cache."""
        nf = len(FAMILY_NAMES)
        inner = {}
        for name, languages in FAMILIES.items():
            members = [c for c in languages if c in self.known]
            if len(members) > 1:
                columns = [nf + PAIRS.index((a, b)) for i, a in enumerate(members) for b in members[i + 1 :]]
                inner[name] = (members, np.ascontiguousarray(self.table[:, columns]))
        return np.ascontiguousarray(self.table[:, :nf]), inner

    def margins(self, texts: list[str]) -> np.ndarray:
        h, counts = hashed(texts)
        return sums(self.table, h, counts) / np.sqrt(np.maximum(counts, 1))[:, None]

    def log_posteriors(self, texts: list[str]) -> np.ndarray:
        """For each text the log posterior of each of CODES: families first, pairs only within likely families."""
        h, counts = hashed(texts)
        scale = np.sqrt(np.maximum(counts, 1))[:, None]
        outer, inner = self.parts
        family = self.families(sums(outer, h, counts) / scale)
        starts = np.cumsum(counts) - counts
        out = np.full((len(texts), len(CODES)), -1e3, np.float32)
        for j, name in enumerate(FAMILY_NAMES):
            if name in inner:
                members, table = inner[name]
                some = np.flatnonzero(family[:, j] > FLOOR)
                out[:, [CODES.index(c) for c in members]] = family[:, [j]] - np.log(len(members))
                if len(some):
                    own = np.repeat(starts[some] - np.append(0, np.cumsum(counts[some])[:-1]), counts[some]) + np.arange(counts[some].sum())
                    found = self.within(members, sums(table, h[own], counts[some]) / scale[some])
                    out[np.ix_(some, [CODES.index(c) for c in members])] = family[some, j][:, None] + found
            else:
                for c in FAMILIES[name]:
                    if c in self.known:
                        out[:, CODES.index(c)] = family[:, j]
        return out

    def families(self, margins: np.ndarray) -> np.ndarray:
        family = self.family_scale * margins
        for j, name in enumerate(FAMILY_NAMES):
            if not set(self.known) & set(FAMILIES[name]):
                family[:, j] = -1e3
        return family - np.logaddexp.reduce(family, axis=1, keepdims=True)

    def within(self, members: list[str], margins: np.ndarray) -> np.ndarray:
        """Log posteriors among related languages, from the votes of their pairs, whose margins are in order."""
        votes = np.zeros((len(margins), len(members)), np.float32)
        column = iter(margins.T)
        for i in range(len(members)):
            for j in range(i + 1, len(members)):
                m = self.pair_scales[PAIRS.index((members[i], members[j]))] * next(column)
                votes[:, i] -= np.logaddexp(0, -m)
                votes[:, j] -= np.logaddexp(0, m)
        return votes - np.logaddexp.reduce(votes, axis=1, keepdims=True)


def _targets(labels: list[str]) -> np.ndarray:
    """+1 and -1 for each column, 0 where a column doesn't concern the language."""
    nf = len(FAMILY_NAMES)
    y = np.zeros((len(labels), nf + len(PAIRS)), np.float32)
    of = {c: j for j, f in enumerate(FAMILY_NAMES) for c in FAMILIES[f]}
    for i, c in enumerate(labels):
        y[i, :nf] = -1
        y[i, of[c]] = 1
        for j, (a, b) in enumerate(PAIRS):
            if c in (a, b):
                y[i, nf + j] = 1 if c == a else -1
    return y


def _fit(rows: list[tuple[np.ndarray, np.ndarray, float]], labels: list[str]) -> LanguageModel:
    """Dual coordinate descent for squared-hinge support vector machines, all columns side by side.

    Violations of rare languages cost more, so that each language weighs about the same.
    """
    y = _targets(labels)
    seen = {c: labels.count(c) for c in set(labels)}
    mean = len(labels) / max(len(seen), 1)
    ridge = np.array([1 / (2 * COST * min(8.0, max(0.5, mean / seen[c]))) for c in labels], np.float32)
    table = np.zeros((1 << BITS, y.shape[1]), np.float32)
    alpha = np.zeros_like(y)
    order = np.random.default_rng(7)
    active = np.array([norm > 0 for _, _, norm in rows])
    for _ in range(EPOCHS):
        for i in order.permutation(np.flatnonzero(active)):
            ids, x, norm = rows[i]
            w = table[ids]
            gradient = y[i] * (x @ w) - 1 + alpha[i] * ridge[i]
            new = np.maximum(alpha[i] - gradient / (norm + ridge[i]), 0) * (y[i] != 0)
            step = new - alpha[i]
            moved = np.abs(step).max() > SETTLED
            active[i] = moved
            if moved:
                table[ids] = w + np.outer(x, step * y[i])
                alpha[i] = new
    return LanguageModel(table, tuple(sorted(set(labels))))


def _rows(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    h, counts = hashed(texts)
    ends = np.cumsum(counts)
    rows = []
    for end, n in zip(ends, counts):
        ids, copies = np.unique(h[end - n : end], return_counts=True)
        x = (copies / np.sqrt(max(n, 1))).astype(np.float32)
        rows.append((ids, x, float(x @ x)))
    return rows


def _scale(values: Callable[[float], tuple[np.ndarray, np.ndarray]]) -> float:
    """The scale of margins under which held-out labels are most likely, if WRONG of them are wrong.

    ``values`` gives, for a scale, the log posteriors of the labels and of their negations.
    """

    def fit(s: float) -> float:
        right, wrong = values(s)
        return float(np.mean((1 - WRONG) * right + WRONG * wrong))

    return max(SCALES, key=fit)


def fit_clean(texts: list[str], labels: list[str], docs: list[int]) -> LanguageModel:
    """Trains on the sentences whose label naive Bayes models of other documents confirm; one part sets the scales."""
    better = corrected(texts, labels, docs, FOLDS, DOUBT)
    keep = [i for i, c in enumerate(better) if c is not None]
    texts, labels, docs = ([x[i] for i in keep] for x in (texts, better, docs))
    rows = _rows(texts)
    model = _fit(rows, labels)
    test = [i for i in range(len(texts)) if docs[i] % FOLDS == 0]
    rest = [i for i in range(len(texts)) if docs[i] % FOLDS]
    if not test or not rest:
        return model
    y = _targets([labels[i] for i in test])
    held = _fit([rows[i] for i in rest], [labels[i] for i in rest]).margins([texts[i] for i in test])
    nf = len(FAMILY_NAMES)
    right = y[:, :nf].argmax(axis=1)

    def family(s: float) -> tuple[np.ndarray, np.ndarray]:
        m = s * held[:, :nf]
        p = (m - np.logaddexp.reduce(m, axis=1, keepdims=True))[np.arange(len(test)), right]
        return p, np.log(np.maximum(-np.expm1(np.minimum(p, -1e-7)), 1e-30))

    scales = [PAIR_SCALE] * len(PAIRS)
    for j in range(len(PAIRS)):
        m = (y[:, nf + j] * held[:, nf + j])[y[:, nf + j] != 0]
        if len(m):
            scales[j] = _scale(lambda s, m=m: (-np.logaddexp(0, -s * m), -np.logaddexp(0, s * m)))
    return replace(model, family_scale=_scale(family), pair_scales=tuple(scales))


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Spans of the lines and sentences of a text, roughly cut, never inside a quotation."""
    spans, start = [], 0
    quotes = quote_spans(text)
    opens = [q[0] for q in quotes]
    for m in (_CUT_ASCII if text.isascii() else _CUT).finditer(text):
        end = m.end(m.lastindex) if m.lastindex else m.start()
        if opens:
            k = bisect_right(opens, m.start()) - 1
            if k >= 0 and end < quotes[k][1]:
                continue
        if end > start:
            spans.append((start, end))
        start = m.end()
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def train_language_model(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Trains on at most TRAIN_DOCS documents of each label, chosen by hash, and TRAIN_SENTENCES sentences of each.

    Labels are checked document by document by naive Bayes models of other documents (``corrected``), and what they
    confirm or correct trains the model.
    """
    labelled = docs.select(F.col(key), F.col(text).alias("_text"), clean_code_column(F.col(label)).alias("_lang")).filter(F.length("_text") > 20)
    sample = bounded_sample(labelled, "_lang", key, TRAIN_DOCS, "language-sample").select("_lang", "_text").collect()
    texts, labels, owners = [], [], []
    pick = np.random.default_rng(11)
    for doc, (lang, body) in enumerate(sorted((r[0], readable(r[1])) for r in sample)):
        spans = [s for s in sentences_of(body) if s[1] - s[0] >= 16]
        if len(spans) > TRAIN_SENTENCES:
            spans = [spans[i] for i in sorted(pick.choice(len(spans), TRAIN_SENTENCES, replace=False))]
        for a, b in spans:
            sentence = body[a:b][:400]
            sentence = _bare(sentence) if pick.random() < 0.15 else sentence
            texts.append(nameless(sentence))
            labels.append(lang)
            owners.append(doc)
    if not texts:
        return LanguageModel(np.zeros((1 << BITS, len(FAMILY_NAMES) + len(PAIRS)), np.float32), ("en",))
    return fit_clean(texts, labels, owners)


def _costs(switch: float) -> np.ndarray:
    """The cost of going from each language to each other one."""
    of = {c: f for f, members in FAMILIES.items() for c in members}
    return np.array([[0.0 if a == b else switch + RELATED * (of[a] == of[b]) for b in CODES] for a in CODES], np.float32)


_COSTS, _COSTS_AT_RULE = _costs(SWITCH), _costs(SWITCH_AT_RULE)


def weighed(letters: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """What each sentence says for each language: its log posteriors, weighed by its letters."""
    return np.maximum(scores, FLOOR) * np.minimum(1.0, letters / FULL_LETTERS)[:, None]


def stretches(text: str, spans: list[tuple[int, int]], letters: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The best path of languages over a document's sentences: (first, last, language, confidence) of each stretch.

    A sentence weighs by its letters, and each change of language costs SWITCH, so names, titles and short labels
    follow their surroundings. A stretch without LEAST_LETTERS joins its longer neighbour.
    """
    emit = weighed(letters, scores)
    n, k = emit.shape
    best = emit[0].copy()
    back = np.zeros((n, k), np.int16)
    for i in range(1, n):
        ruled = _RULE.search(text, spans[i - 1][1] - 1, spans[i][0] + 4)
        ways = best[:, None] - (_COSTS_AT_RULE if ruled else _COSTS)
        back[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + emit[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    path.reverse()
    runs: list[list[int]] = []
    for i, c in enumerate(path):
        if runs and runs[-1][2] == c:
            runs[-1][1] = i
        else:
            runs.append([i, i, c])
    while len(runs) > 1:
        sizes = [letters[a : b + 1].sum() for a, b, _ in runs]
        least = int(np.argmin(sizes))
        if sizes[least] >= LEAST_LETTERS:
            break
        to = max((j for j in (least - 1, least + 1) if 0 <= j < len(runs)), key=lambda j: sizes[j])
        runs[least][2] = runs[to][2]
        merged: list[list[int]] = []
        for r in runs:
            if merged and merged[-1][2] == r[2]:
                merged[-1][1] = r[1]
            else:
                merged.append(r)
        runs = merged
    return [(a, b, c, float(confidences(emit[a : b + 1].sum(axis=0)[None], np.array([b + 1 - a]), np.array([c]))[0])) for a, b, c in runs]


def confidences(totals: np.ndarray, n: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The posterior of a language over the ``n`` sentences that ``totals`` sums up.

    Sentences of one document err together, so their sum counts as that of the root of their number.
    """
    x = totals / np.sqrt(np.maximum(n, 1))[:, None]
    return np.exp(x[np.arange(len(x)), codes] - np.logaddexp.reduce(x, axis=1))


SEGMENTS = "seg_no bigint, start_pos bigint, end_pos bigint, lang string, confidence double"


def document_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Each document's stretches: key, label, seg_no, start_pos, end_pos, lang and confidence (0 to 1).

    A document in one language has one row with seg_no 0. Documents without letters (null, blank, symbols or figures
    only) have one row with a null lang and confidence 0. Positions count code points. Nulls in the label, repeated
    rows and very long texts need nothing special; other columns are not read. The model is trained on a bounded
    sample (see ``train_language_model``) and sent to the tasks (32 columns of 2^17 weights, 17 MB at any size);
    documents are then read once, without a shuffle where the scan is already split.
    """
    session = docs.sparkSession
    model = session.sparkContext.broadcast(train_language_model(docs, text, label, key))
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 500):
                yield _label(whole.iloc[at : at + 500], model.value, key)

    source = docs.select(F.col(key), F.col(text).alias("_text"), F.col(label).alias("_label"))
    schema = f"`{key}` {kind}, label string, {SEGMENTS}"
    return spread(source, key).mapInPandas(run, schema)


def _label(frame: pd.DataFrame, model: LanguageModel, key: str) -> pd.DataFrame:
    spans, parts, owner = [], [], []
    for i, text in enumerate(frame["_text"]):
        if text:
            for a, b in sentences_of(text):
                spans.append((a, b))
                parts.append(nameless(readable(text[a:b])))
                owner.append(i)
    letters = np.array([len(_OTHER.sub("", p).encode()) for p in parts], float)
    scores = model.log_posteriors(parts) if parts else np.zeros((0, len(CODES)))
    bounds = np.searchsorted(np.array(owner), np.arange(len(frame) + 1))
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    starts = bounds[:-1][some]
    single = sure = lettered = whole = np.zeros(0)
    if len(some):
        emit = weighed(letters, scores)
        totals = np.add.reduceat(emit, starts, axis=0)
        whole = totals.argmax(axis=1)
        # no path with a change gains more than each sentence's best language, less the least cost of a change
        single = totals.max(axis=1) >= np.add.reduceat(emit.max(axis=1), starts) - min(SWITCH, SWITCH_AT_RULE)
        lettered = np.add.reduceat(letters, starts)
        sure = confidences(totals, np.diff(bounds)[some], whole)
    place = {int(i): j for j, i in enumerate(some)}
    rows = []
    for i, (k, text, label) in enumerate(zip(frame[key], frame["_text"], frame["_label"])):
        a, b = bounds[i], bounds[i + 1]
        j = place.get(i)
        if j is None or lettered[j] == 0:
            rows.append((k, label, 0, 0, len(text or ""), None, 0.0))
        elif single[j]:
            rows.append((k, label, 0, spans[a][0], spans[b - 1][1], CODES[whole[j]], float(sure[j])))
        else:
            for n, (x, y, c, p) in enumerate(stretches(text, spans[a:b], letters[a:b], scores[a:b])):
                rows.append((k, label, n, spans[a + x][0], spans[a + y][1], CODES[c], p))
    return pd.DataFrame(rows, columns=[key, "label", "seg_no", "start_pos", "end_pos", "lang", "confidence"])


def wrong_labels(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of documents whose label is missing, a placeholder or another language, or that are in several languages."""
    named = segments.filter(F.col("lang").isNotNull()).withColumn("given", clean_code_column(F.col("label")))
    mixed = F.col("seg_no") > 0
    cases = F.col("given").isNull() | (F.col("given") != F.col("lang")) | mixed
    by = Window.partitionBy(key)
    return (
        named.withColumn("case", F.max(cases).over(by))
        .filter("case")
        .select(key, F.col("seg_no").cast("bigint").alias("seg_no"), "lang")
    )
