"""What is written twice, once for speed, gives the same."""

import gc
import itertools
import random
import re
from collections import Counter

import numpy as np
import regex

from passagemill.llm import declining, endings, language_counts, language_id, naive_bayes, ngrams, pairs, refusals, sentences, truncation
from tests.llm.test_language import PHRASES, _text
from tests.llm.test_pairs import DECLINING


def _ascii_texts():
    pick = random.Random(4)
    signs = "abcXYZ 019 ..!? \n\t\"')],;:(-_e.g. \x1c"
    return ["".join(pick.choice(signs) for _ in range(pick.randrange(1, 120))) for _ in range(3000)]


def test_expressions_for_ascii_texts():
    for text in _ascii_texts():
        assert [m.span(0) + m.span(1) for m in sentences._CANDIDATE_ASCII.finditer(text)] == [m.span(0) + m.span(1) for m in sentences.CANDIDATE.finditer(text)]
        assert [m.span() for m in sentences._WORD_ASCII.finditer(text)] == [m.span() for m in sentences._WORD.finditer(text)]
        assert sentences._UNMARKED_ASCII.findall(text.lower()) == [w.lower() for w in sentences._UNMARKED.findall(text)]


def test_left_token_goes_back_to_the_last_space_however_far():
    for text in (*_ascii_texts(), "a " + "b" * 500, "b" * 500):
        for end in (len(text), len(text) // 2):
            if text[:end][-1:].isspace():
                continue
            parts = text[:end].split()
            token = parts[-1].strip("\"'“”„«»()[]{}（）「」『』’,;:-–").lower() if parts else ""
            numeric = token[:1].isdigit() or token[-1:].isdigit()
            assert sentences.left_token(text, end) == ("".join("0" if c.isdigit() else c for c in token) if numeric else token)


def test_wordings_anywhere():
    texts = [d.format(n="Ithis Merundek").lower() for d in DECLINING] + [t.lower() for t in _ascii_texts()] + ["the scan't", "xi can't", "Es lässt sich hier nicht sagen".lower()]
    for text in texts + [t[k:] for t in texts[:11] for k in range(0, 20, 3)]:
        assert (refusals.ANYWHERE.search(text) is None) == (refusals.PATTERN.search(text) is None)


def test_probabilities_of_many_ends():
    texts = [*_ascii_texts(), "", "…", "完了しました。", "२३"]
    ends = endings.fit(texts[::2])
    assert (ends.probabilities(texts) == np.array([ends.probability(t) for t in texts])).all()


def test_names_cuts_and_question_words_of_ascii_texts():
    for text in _ascii_texts():
        assert [(*m.span(), m.lastindex and m.end(m.lastindex)) for m in language_id._CUT_ASCII.finditer(text)] == [(*m.span(), m.lastindex and m.end(m.lastindex)) for m in language_id._CUT.finditer(text)]
        assert language_id._NAME_ASCII.sub(r"\1", text) == language_id._NAME.sub(r"\1", text)
        assert bool(language_id._ALONE_ASCII.fullmatch(text)) == bool(language_id._ALONE.fullmatch(text))
        assert declining._SPLIT_ASCII.split(text) == declining._SPLIT.split(text)
        assert pairs._letter_bytes(text) == len(pairs._NO_LETTER.sub("", text))


def test_words_and_ends_within_texts():
    inner, ends = re.compile(r"[^\W\d_]{2}[.!?…]+[\"”’»)]*\s|[。！？।؟॥]"), re.compile(r"(?<=[^\W\d_]{3})[.!?…]+[\"”’»)]*(?=\s|$)|[。！？।؟॥][\"”’»)」』]*")
    for text in [*_ascii_texts(), "完了。」はい", "ab…” c", "कखग।»", "é.é. é!", "“abc?” d"]:
        assert bool(truncation._INNER_END.search(text)) == bool(inner.search(text))
        assert truncation._sentence_ends(text) == {m.end() for m in ends.finditer(text)}
        assert truncation._several_words(text) == (len(re.findall(r"[^\W_]+", text)) >= 4)


def test_ngrams_of_lines_are_those_of_texts(monkeypatch):
    monkeypatch.setattr(ngrams, "SIGNS", 200)  # many pieces
    texts = [*_ascii_texts()[:500], "", "a", "完了しました。", "२३", *[""] * 9, "x" * 900]
    table = np.random.default_rng(6).normal(size=(1 << ngrams.BITS, 3)).astype(np.float32)
    for some in (texts, ["", "b", ""], [""]):
        h, counts = ngrams.hashed(some)
        line = ngrams.letters_only(some)
        sums, sizes = ngrams.scored(table, line)
        assert (sizes == counts).all() and np.allclose(sums, ngrams.sums(table, h, counts), atol=1e-3)
        assert (ngrams.tallied(line) == np.bincount(h, minlength=1 << ngrams.BITS)).all()
        owner, found = (np.concatenate(x) for x in zip(*ngrams.located(line)))
        assert sorted(zip(owner.tolist(), found.tolist())) == sorted(zip(np.repeat(np.arange(len(some)), counts).tolist(), h.tolist()))


def _any_texts():
    pick = random.Random(11)
    signs = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    common = "abÉßΣσİж中は्ि٣²१ ..!?…\n\t\x1c\xa0“”«»(/—"
    return ["".join(pick.choice(common) if pick.random() < 0.8 else pick.choice(signs) for _ in range(pick.randrange(80))) for _ in range(2000)]


def test_letters_are_told_in_pieces(monkeypatch):
    monkeypatch.setattr(ngrams, "SIGNS", 7)
    noise = regex.compile(r"[^\p{L}\p{M}\n]+")
    for some in (_any_texts(), _ascii_texts(), [], [""], ["--", "a\nb"]):
        assert ngrams.letters_only(some) == noise.sub(" ", "\n".join(" " + t.replace("\n", " ") + " " for t in some).lower())
    every = "".join(map(chr, range(0x110000)))
    assert [m.span() for m in regex.finditer(r"[\p{L}\p{M}\n]+", every)] == [tuple(x) for x in np.flatnonzero(np.diff(ngrams._kept(), prepend=False, append=False)).reshape(-1, 2).tolist()]


def test_figures_of_any_script_are_zeros():
    every = "".join(map(chr, range(0x110000)))
    assert (endings._zeroed(every) == np.frombuffer(endings.zeros(every).encode("utf-32-le", "surrogatepass"), np.uint32)).all()
    texts = _any_texts()
    ends = endings.fit(texts[::2])
    assert (ends.probabilities(texts) == np.array([ends.probability(t) for t in texts])).all()


def test_no_wording_is_left_out():
    texts = [d.format(n="Ithis Merundek") for d in DECLINING] + _any_texts() + ["Je ne\xa0peux pas", "désolé, cela m’est impossible", "Éi can't", "\ud800 I can't"]
    may = refusals.may_decline(texts)
    assert [m for m, t in zip(may, texts) if refusals.ANYWHERE.search(t.lower())].count(False) == 0 and sum(may) < 30
    rows = [(q, g, a) for q in (None, "Who was Ithis?") for g in (None, "The mill was sold by the guild.") for a in (None, "", "The mill was sold by the guild. I can't say more.", *texts[:11])]
    assert pairs.declining_sentences_of(rows) == [x for r in rows for x in pairs.declining_sentences_of([r])]


def test_gold_answers_are_scored_only_where_the_prompt_tells_another_language(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [_text(c, rng) for c in ("en", "de") for _ in range(40)]
    model = pairs.PairModel(naive_bayes.fit(texts, ["en"] * 40 + ["de"] * 40), None)
    scored = []
    plain = naive_bayes.NaiveBayes.log_posteriors
    monkeypatch.setattr(naive_bayes.NaiveBayes, "log_posteriors", lambda self, some: (scored.extend(some), plain(self, some))[1])
    en, de, gold = (" ".join(PHRASES[c][k : k + 3]) for c, k in (("en", 0), ("de", 0), ("de", 2)))
    asked = "what did she write about the old bridge by the river?"
    assert pairs._foreign([(asked, gold, en)], model) == [False] and gold not in scored
    assert pairs._foreign([(asked, None, de), (asked, gold, de)], model) == [True, False] and gold in scored


def test_moving_sentences_gives_the_counts_of_all_anew():
    rng = np.random.default_rng(12)
    langs = list(PHRASES)
    at = [i % len(langs) for i in range(120)]
    lines = [ngrams.letters_only([_text(langs[j], rng), _text(langs[(j + (i % 7 == 0)) % len(langs)], rng)]) for i, j in enumerate(at)]
    labels = [language_counts.CODES.index(langs[(j + (i % 11 == 0)) % len(langs)]) for i, j in enumerate(at)]  # some of them wrong
    folds = [i % 2 for i in range(120)]
    base = np.zeros(2 * language_counts.SIZE, np.int64)
    language_counts.count_given(lines, folds, labels, base)
    seen = base.reshape(2, len(language_counts.CODES), -1)
    models = [language_counts._model(seen[1 - fold]) for fold in (0, 1)]
    moved = np.zeros_like(base)
    language_counts.count_moved(lines, folds, labels, models, 3.0, False, moved)
    anew = np.zeros_like(base)
    for line, fold in zip(lines, folds):
        own, model = line.split("\n"), models[fold]
        x, _ = ngrams.scored(model.table, line)
        x = x - np.logaddexp.reduce(x, axis=1, keepdims=True)
        best = int(np.maximum(x, language_counts.LEAST_SENTENCE).sum(axis=0).argmax())
        for s, row in zip(own, x):
            if row.max() - row[best] < 3.0:
                j = fold * len(language_counts.CODES) + language_counts.CODES.index(model.classes[best])
                anew.reshape(-1, 1 << ngrams.BITS)[j] += ngrams.tallied(s)
    assert moved.any() and (base + moved == anew).all()


def test_features_of_many_marks():
    pick = random.Random(7)
    signs = "abÉß 19 ..!?… \n\"')“”(«»;中。！؟हि。」é.e.g. "
    texts = [*_ascii_texts(), *("".join(pick.choice(signs) for _ in range(pick.randrange(1, 120))) for _ in range(3000))]
    model = sentences.train_sentence_model([(t, True) for t in texts[::2]])
    found = [(t, c) for t in texts for r in sentences.regions_of(t, False) for c in sentences.marks_in(t, r, [])]
    assert found and (sentences.all_mark_features(model, found) == np.array([sentences.mark_features(model, t, c) for t, c in found], float)).all()


def test_gathered_tokens_count_the_same():
    texts = [*_ascii_texts(), "Σὺν τοῖς ΟΔΟΣ'Α. İSTANBUL İ ΟΔΟΣ", "ÉCOLE Ärger. ÜBER", "ไทย ภาษา ไทย"]
    at_once, later, gathered = sentences.TokenCounts(), sentences.TokenCounts(), sentences.Gathered()
    for i, text in enumerate(texts):
        sentences._read(text, i % 2 == 0, (at_once,))
        sentences._read(text, i % 2 == 0, (gathered,))
        if i % 100 == 0 or i + 1 == len(texts):
            gathered.into(later)
    assert at_once == later


def test_unmarked_words_in_lower_case():
    signs = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    for a, b in zip(signs, signs[1:] + ["a"]):
        text = f"é{a}{b} {a} x{b}. {a}İ"
        for t in (text, text[:-1]):
            assert sentences.unmarked_words(t) == [w.lower() for w in sentences._UNMARKED.findall(t)], repr(t)


def test_words_of_many_texts_are_counted_at_once(monkeypatch):
    signs = [chr(i) for i in range(0x20000)]
    texts = [*_ascii_texts(), "", "...", *(f"é{a}{b} {a} x{b}. {a}İ"[: None if i % 50 == 0 else -1] for i, (a, b) in enumerate(zip(signs, signs[1:] + ["a"])))]
    single = Counter(w for t in texts for w in sentences.unmarked_words(t))
    assert sentences.counted_unmarked(texts) == single and len(single) > 50_000
    assert sentences.counted_unmarked([]) == sentences.counted_unmarked(["", "1. 2!"]) == {}
    gathered, counts, read = sentences.Gathered(), sentences.TokenCounts(), []
    plain = sentences.unmarked_words
    monkeypatch.setattr(sentences, "unmarked_words", lambda text: read.append(text) or plain(text))
    for text in ("Nobody knew why.", "Никто не знал.", "ΟΔΟΣ ΟΔΟΣ."):
        sentences._read(text, False, (gathered,))
    gathered.into(counts)
    assert counts.unmarked == {"nobody": 1, "knew": 1, "никто": 1, "не": 1, "οδος": 1} and read == ["ΟΔΟΣ ΟΔΟΣ."]


def test_lines_that_begin_with_a_letter_have_no_marker():
    signs = "aéZ①५5)）(.-•、 \u3000"
    for line in ("".join(x) for x in itertools.product(signs, repeat=4)):
        m = sentences._NUMBERED.match(line)
        number = m is not None and (m.group(1) is None or int(m.group(1)) == 1) and len(line) > m.end()
        assert [r.kind for r in sentences.regions_of(line, False)] == ([] if not line.strip() else ["entry" if number else "text"])


def test_no_search_for_cycles_while_texts_are_read():
    run = sentences.uncollected(lambda batches: (gc.isenabled() for _ in batches))
    assert gc.isenabled() and list(run(iter([1, 2]))) == [False, False] and gc.isenabled()
    some = run(iter([1, 2]))
    next(some)
    some.close()
    assert gc.isenabled()
