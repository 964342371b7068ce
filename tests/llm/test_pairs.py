import numpy as np
import pytest

from passagemill.llm import declining, naive_bayes
from passagemill.llm.declining import refuses
from passagemill.llm.pairs import PairModel, broken_pairs, copies, find_defects, is_empty, train_endings
from passagemill.llm.truncation import left_open
from tests.llm.test_language import PHRASES, _text

QUESTION = "In which town was the teacher of Ithis Merundek born?"


@pytest.mark.parametrize("answer", [None, "", " \n", "—", "...", "**", "n/a", "NULL", "[]", '""', "<answer></answer>", "(no output)", "Thought:\nAnswer: ", "​", "n/a" + " " * 80, "<" + "x" * 90 + ">"])
def test_empty(answer):
    assert is_empty(answer)


@pytest.mark.parametrize("answer", ["No", "0", "Sí", "Answer: Yes", '{"answer": "No"}', "N. Orr"])
def test_not_empty(answer):
    assert not is_empty(answer)


@pytest.mark.parametrize("answer", [QUESTION, QUESTION.upper(), "born teacher of Ithis Merundek the was in which town", "Question: " + QUESTION, QUESTION + " " + QUESTION,
                                    "In which town was the teacher of Ithis Merundek", "The user wants to know: " + QUESTION])
def test_copies(answer):
    assert copies(answer, QUESTION)


@pytest.mark.parametrize("answer", [QUESTION + " Dallora.", "Ithis Merundek", "Dallora", "The teacher of Ithis Merundek was born in Dallora"])
def test_answers_are_no_copies(answer):
    assert not copies(answer, QUESTION)
    assert not copies("Dalum Norzanek", "Who was born earlier, Dalum Norzanek or Oren Halnoria?")


@pytest.mark.parametrize("body", ["I'm sorry, but I can't answer this.", "Información insuficiente.", "Bei dieser Anfrage kann ich leider nicht helfen.", "抱歉，根据所给段落我无法回答。", "[no generation: request declined by service]", "Воздержусь от ответа"])
def test_refusals(body):
    assert refuses(body, QUESTION)


@pytest.mark.parametrize("body", ["The envoys said they were sorry and could not help Ithis Merundek.", "“I cannot stay” is the title of the song that Maia Orel wrote in Bawynek.", "The text does not say so outright, but everything points to Dallora.", "Dallora"])
def test_stories_are_no_refusals(body):
    assert not refuses(body, QUESTION)


def test_left_open():
    assert left_open('{"answer": "Dal') and left_open("**Dal") and left_open("the fort “a team of") and not left_open("„Der Saal ist leer.“") and not left_open("(a) b")


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    langs = list(PHRASES)
    passages = [(i, f"{i}:" + _text(langs[i % len(langs)], rng), langs[i % len(langs)]) for i in range(320)]
    golds = [(i, None, _text("en", rng, 3), None) for i in range(1000, 1400)]
    gold = PHRASES["en"][0].capitalize() + ". " + PHRASES["en"][1].capitalize() + "."
    cases = [
        (1, QUESTION, "Dallora", "Dallora", None), (2, QUESTION, "Dallora", None, "empty"), (3, QUESTION, "Dallora", QUESTION, "copies_question"),
        (4, QUESTION, "Dallora", "I can't answer this.", "refusal"), (5, "What did she write about the old bridge?", gold, _text("de", rng), "other_language"),
        (6, "What did she write about the old bridge?", gold, gold[:60], "truncated"), (7, "What did she write about the old bridge?", gold, PHRASES["en"][0].capitalize() + ".", None),
        (8, None, None, "Dallora", None), (9, QUESTION, None, "", "empty"), (10, QUESTION, "n/a", "n/a", None), (11, "What did she write about the old bridge?", gold, PHRASES["en"][3].capitalize(), None),
        (12, QUESTION, "Dallora", "Dall", "truncated"), (2, QUESTION, "Dallora", None, "empty"), (13, QUESTION, "Dallora", "y " * 40000 + "the end.", None),
    ]
    schema = "prediction_id bigint, question string, gold_answer string, pred_answer string"
    predictions = spark.createDataFrame([c[:4] for c in cases] + [(i, q, g, g) for i, q, g, _ in golds], schema).selectExpr("*", "'x' as defect")
    return predictions, spark.createDataFrame(passages, "passage_no bigint, passage string, lang string"), {c[0]: c[4] for c in cases}


def test_defects(tables):
    predictions, passages, truth = tables
    rows = broken_pairs(predictions, passages).collect()
    got = {r.prediction_id: r.defect for r in rows}
    assert len(rows) == len(got)
    assert {i: got.get(i) for i in truth if i != 13} == {i: d for i, d in truth.items() if i != 13}


def test_empty_tables(tables):
    predictions, passages, _ = tables
    assert broken_pairs(predictions.filter("false"), passages.filter("false")).count() == 0


def test_ends_of_complete_texts_are_likelier(tables):
    predictions, _, _ = tables
    ends = train_endings([tuple(r) for r in predictions.select("question", "gold_answer", "pred_answer").collect()])
    model = PairModel(naive_bayes.fit(["the"], ["en"]), ends)
    whole = [PHRASES["en"][i].capitalize() for i in range(4)]
    assert not any(ends.broken_off([(t, t, None) for t in whole]))
    cut = [t[: len(t) - 3] for t in whole]
    assert sum(ends.broken_off([(t, t, None) for t in cut])) >= 3
    assert find_defects([(None, None, None)], model) == ["empty"]


DECLINING = [
    "I'm sorry, but I can't answer who taught {n}.", "I do not know where {n}'s teacher was born.", "The passages do not mention {n}.",
    "Error 503: service unavailable, request declined.", "I cannot answer question 3.", "I'm unable to help with that, Maria.",
    "Je ne peux pas dire où le maître de {n} est né.", "Ich weiß nicht, wo der Lehrer von {n} geboren wurde.", "No sé dónde nació el maestro de {n}.",
    "Die Textstellen erwähnen {n} nicht.", "我不知道{n}的老师出生在哪里。",
]


@pytest.mark.parametrize("body", DECLINING)
def test_refusals_that_name_what_was_asked_or_hold_figures(body):
    assert refuses(body.format(n="Ithis Merundek"), QUESTION)


def test_refusals_are_learned_from_known_wordings():
    """A wording that no list has is found by the model, and a story with a listed one is told apart."""
    asked = "Where was {} Vale born?"
    replies = [(f"Sorry, {a} the archive offers no clue {b}", asked.format(a)) for a in ("Ada", "Bren", "Cora", "Dell") for b in ("so I can't answer this.", "and I cannot answer here.") for _ in range(9)]
    replies += [("I can't answer this without the archive offers.", None)] * 9
    answers = [(f"{t} {i} in the town.", None) for i in "abcdefgh" for t in ("The mill was sold by the guild", "She kept a school by the river", "The answer is given in the old book") for _ in range(4)]
    model = declining.train(replies, answers)
    assert model.model is not None
    assert refuses("Sorry, the archive offers no clue about this.", None, model) and not declining.declines("sorry, the archive offers no clue about this.")
    assert not refuses("The answer is given in the old book.", None, model) and not refuses("Non", None, model)
