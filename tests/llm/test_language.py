import numpy as np
import pytest

from passagemill.llm import language_id
from passagemill.llm.language_id import _OTHER, document_languages, fit_clean, nameless, sentences_of, stretches, wrong_labels
from passagemill.llm.languages import CODES, clean_code

PHRASES = {
    "en": ["the river guild kept three water mills", "she wrote a letter to the council about the old bridge", "nobody knew why the ferry came back so late", "the bishop and the school board lost their archive"],
    "de": ["die alte mühle wurde nach dem winter verkauft", "niemand wusste warum die fähre so spät zurückkam", "der bischof und die schule verloren ihr archiv", "sie schrieb einen brief über die brücke an den rat"],
    "nl": ["het oude veer kwam zo laat terug dat niemand het zag", "zij schreef een brief aan de raad over de brug", "de bisschop en de school verloren hun archief", "het klooster werd na de winter verkocht"],
    "es": ["la vieja barca volvió tan tarde que nadie la vio", "ella escribió una carta al consejo sobre el puente", "el obispo y la escuela perdieron su archivo", "el monasterio se vendió después del invierno"],
    "it": ["il vecchio traghetto tornò così tardi che nessuno lo vide", "lei scrisse una lettera al consiglio sul ponte", "il vescovo e la scuola persero il loro archivio", "il monastero fu venduto dopo l'inverno"],
    "ru": ["старый паром вернулся так поздно что его никто не видел", "она написала письмо совету о старом мосте", "епископ и школа потеряли свой архив", "монастырь был продан после зимы"],
    "uk": ["старий пором повернувся так пізно що його ніхто не бачив", "вона написала лист раді про старий міст", "єпископ і школа втратили свій архів", "монастир було продано після зими"],
    "ja": ["古い渡し船はとても遅く戻ったので誰も見なかった。", "彼女は橋について議会に手紙を書いた。", "司教と学校は記録を失った。", "修道院は冬の後で売られた。"],
}


def _text(lang, rng, n=4):
    picked = [PHRASES[lang][i] for i in rng.integers(0, 4, n)]
    return "".join(picked) if lang == "ja" else " ".join(p.capitalize() + "." for p in picked)


@pytest.fixture(scope="module")
def found(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    langs = list(PHRASES)
    for i in range(400):
        lang = langs[i % len(langs)]
        label = lang if i % 10 else langs[(i // 10) % len(langs)]
        rows.append((i, _text(lang, rng), label))
        truth[i] = [lang]
    rows += [
        (1000, _text("en", rng) + "\n---\n" + _text("es", rng), "en"), (1001, None, "en"), (1002, " \n ", None), (1003, "12.5\t33 🙂", "de"),
        (1004, _text("ru", rng), "RUS"), (1005, _text("de", rng), "und"), (1006, "x" * 20000 + " " + _text("en", rng, 300), "en"), (1007, _text("it", rng), None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as seg_no", "'x' as label")
    segments = document_languages(docs)
    return truth, segments.toPandas(), {(r.doc_id, r.seg_no, r.lang) for r in wrong_labels(segments).collect()}


def test_languages_of_plain_documents(found):
    truth, rows, _ = found
    got = rows[rows.doc_id < 1000].groupby("doc_id").lang.apply(list).to_dict()
    assert sum(got[i] == truth[i] for i in truth) / len(truth) > 0.97
    assert rows.confidence.between(0, 1).all()


def test_mixed_documents_have_their_stretches(found):
    _, rows, cases = found
    own = rows[rows.doc_id == 1000].sort_values("seg_no")
    assert own.lang.tolist() == ["en", "es"] and own.seg_no.tolist() == [0, 1]
    assert (1000, 0, "en") in cases and (1000, 1, "es") in cases


def test_cases_are_wrong_or_missing_labels(found):
    truth, rows, cases = found
    assert not any(c[0] in (1001, 1002, 1003, 1004) for c in cases)
    assert (1005, 0, "de") in cases and (1007, 0, "it") in cases
    assert rows[rows.doc_id.isin([1001, 1002, 1003])].lang.isna().all()
    wrong = {i for i in truth if i % 10 == 0 and list(PHRASES)[(i // 10) % len(PHRASES)] != truth[i][0]}
    flagged = {c[0] for c in cases if c[0] < 1000}
    assert len(wrong & flagged) / len(wrong) > 0.9 and len(flagged - wrong) < 10


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert wrong_labels(document_languages(docs)).count() == 0


@pytest.mark.parametrize("label, code", [("en_US", "en"), ("English", "en"), (" FR ", "fr"), ("zh-Hans", "zh"), ("deu", "de"), ("und", None), ("??", None), (None, None), ("", None)])
def test_labels(label, code):
    assert clean_code(label) == code


def test_names_and_quotations():
    assert nameless("Orek Dalmerum") == "" and "Dalmerum" not in nameless("the mill of Orek Dalmerum was sold")
    text = 'He said "Wash hands. Wait outside." and left. Then rain.'
    assert [text[a:b] for a, b in sentences_of(text)] == ['He said "Wash hands. Wait outside." and left.', "Then rain."]


def test_two_changes_cost_less_than_a_certain_sentence_gains():
    most = -language_id.FLOOR * min(1, language_id.LEAST_LETTERS / language_id.FULL_LETTERS)
    assert 2 * (language_id.SWITCH + language_id.RELATED) < most


MIDDLES = {
    "en": "the school wrote about the mills after the winter", "de": "der rat verkaufte nach dem winter die alte brücke",
    "nl": "de raad verkocht na de winter het oude klooster", "es": "el consejo vendió la vieja escuela después del invierno",
    "it": "il consiglio vendette la vecchia scuola dopo l'inverno", "ru": "епископ написал письмо о старом пароме", "uk": "єпископ написав лист про старий пором",
}


@pytest.mark.parametrize("around, middle", [("en", "de"), ("de", "nl"), ("nl", "en"), ("es", "it"), ("it", "es"), ("ru", "uk"), ("uk", "ru"), ("en", "es"), ("de", "ru")])
def test_one_sentence_between_others_joined_by_spaces(around, middle):
    """The middle sentence isn't among the sentences trained on."""
    rng = np.random.default_rng(2)
    train = [(" ".join(rng.choice(PHRASES[c], 2)).capitalize() + ".", c) for c in PHRASES for _ in range(30)]
    model = fit_clean([t for t, _ in train], [c for _, c in train], list(range(len(train))))
    text = " ".join(s.capitalize() + "." for s in (PHRASES[around][1], PHRASES[around][3], MIDDLES[middle], PHRASES[around][0], PHRASES[around][2]))
    spans = sentences_of(text)
    parts = [nameless(text[a:b]) for a, b in spans]
    letters = np.array([len(_OTHER.sub("", p).encode()) for p in parts], float)
    found = stretches(text, spans, letters, model.log_posteriors(parts))
    assert [(a, b, CODES[c]) for a, b, c, _ in found] == [(0, 1, around), (2, 2, middle), (3, 4, around)]
