"""Multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from passagemill.llm.ngrams import BITS, ORDERS, hashed, letters_only, scored, sums

SMOOTHING = 0.02


@dataclass(frozen=True)
class NaiveBayes:
    """Log probabilities of the n-grams under each class; classes have equal priors."""

    table: np.ndarray
    classes: tuple[str, ...]
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and class; and the number of n-grams of each text."""
        if texts and (self.orders, self.bits) == (ORDERS, BITS):
            return scored(self.table, letters_only(texts))
        h, counts = hashed(texts, self.orders, self.bits)
        return sums(self.table, h, counts), counts

    def log_posteriors(self, texts: list[str]) -> np.ndarray:
        x, _ = self.log_likelihoods(texts)
        return x - np.logaddexp.reduce(x, axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> NaiveBayes:
    """n-grams of each class are counted with one weight a class, whatever it holds."""
    h, counts = hashed(texts, orders, bits)
    return _fit(h, counts, labels, orders, bits)


def _fit(h: np.ndarray, counts: np.ndarray, labels: list[str], orders: tuple[int, ...], bits: int) -> NaiveBayes:
    classes = tuple(sorted(set(labels)))
    return from_counts(counted(h, counts, labels, classes, bits), classes, orders, bits)


def counted(h: np.ndarray, counts: np.ndarray, labels: list[str], classes: tuple[str, ...], bits: int = BITS) -> np.ndarray:
    """How often each class has each n-gram."""
    place = {c: j for j, c in enumerate(classes)}
    owner = np.repeat(np.array([place[c] for c in labels], np.int64), counts)
    return np.bincount(owner << bits | h.astype(np.int64), minlength=len(classes) << bits).reshape(len(classes), -1)


def from_counts(seen: np.ndarray, classes: tuple[str, ...], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> NaiveBayes:
    floor = SMOOTHING / (1 << bits)
    table = np.log((1 - SMOOTHING) * seen / np.maximum(seen.sum(axis=1, keepdims=True), 1) + floor)
    return NaiveBayes(np.ascontiguousarray(table.T.astype(np.float32)), classes, orders, bits)


def held_out(grams: tuple[np.ndarray, np.ndarray], labels: list[str | None], owners: np.ndarray, folds: int) -> tuple[np.ndarray, tuple[str, ...]]:
    """The log posterior of each class for each text, from models trained on other documents; and the classes.

    ``grams`` is what ``hashed`` gives for the texts. Texts without a label aren't trained on.
    """
    h, counts = grams
    classes = tuple(sorted({c for c in labels if c is not None}))
    known = np.array([c is not None for c in labels])
    starts = np.cumsum(counts) - counts
    part = owners % folds
    post = np.full((len(labels), len(classes)), -1e3, np.float32)
    for fold in range(folds):
        train, test = np.flatnonzero((part != fold) & known), np.flatnonzero(part == fold)
        if not len(train) or not len(test):
            continue
        own = [np.concatenate([h[starts[i] : starts[i] + counts[i]] for i in some]) for some in (train, test)]
        model = _fit(own[0], counts[train], [labels[i] for i in train], ORDERS, BITS)
        x = sums(model.table, own[1], counts[test])
        columns = [classes.index(c) for c in model.classes]
        post[np.ix_(test, columns)] = x - np.logaddexp.reduce(x, axis=1, keepdims=True)
    return post, classes


#: The least log posterior of one sentence within its document's sum, so that no single sentence decides.
LEAST_SENTENCE = -12.0


def corrected(texts: list[str], labels: list[str], owners: list[int], folds: int, doubt: float, rounds: int = 2) -> list[str | None]:
    """Labels checked by whole documents: the label, a better one, or None for a text that should not be trained on.

    A document's language is the likeliest over all of its texts by models of other documents. Texts that it fits keep
    or get its language; texts that another language fits better by ``doubt`` (parts of mixed documents) get None. Each
    round trains on what the one before found. Classes whose texts are mostly right outweigh the same texts that
    strayed into others, so this holds with a fair share of wrong labels. Documents whose label never had a model
    keep it, and so does a label that would have no text left.
    """
    now: list[str | None] = list(labels)
    grams, owner = hashed(texts), np.array(owners)
    documents, at = np.unique(owner, return_inverse=True)
    for _ in range(rounds):
        post, classes = held_out(grams, now, owner, folds)
        totals = np.zeros((len(documents), len(classes)))
        np.add.at(totals, at, np.maximum(post, LEAST_SENTENCE))
        best = totals.argmax(axis=1)[at]
        unlike = post.max(axis=1) - post[np.arange(len(texts)), best] >= doubt
        now = [None if u else classes[b] for u, b in zip(unlike, best)]
    left = {c for c in now if c is not None}
    return [c if c is not None or labels[i] in left else labels[i] for i, c in enumerate(now)]
