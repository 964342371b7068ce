import numpy as np

from passagemill.llm import declining, pairs
from passagemill.llm.pairs import declining_sentences, endings_over, languages_over, refusals_over, train_endings
from passagemill.llm.totals import summed
from tests.llm.test_language import PHRASES, _text

SCHEMA = "prediction_id bigint, question string, gold_answer string, pred_answer string"
QUESTION = "What did she write about the old bridge?"


def _rows():
    rng = np.random.default_rng(8)
    rows = [(QUESTION, g := _text("en", rng, 3), g) for _ in range(60)]
    rows += [(QUESTION, f"The mill number {i} was sold by the guild.", "I can't answer this " + w) for i in range(20) for w in ("here.", "from the text.", "for now.", "without more.", "at all.", "today.")]
    return rows + [(QUESTION, "She " + "said that she went on and " * 200 + "rested qzx.", None)]  # beyond what the sample took of a row


def _table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(5)


def test_vectors_are_summed_over_all_partitions(spark):
    def add(batch, total):
        np.add.at(total, np.array(batch.column(0).to_pylist()) % 3000, 1)

    assert (summed(spark.range(0, 9001, 1, 7), 3001, add) == [4, *[3] * 2999, 0]).all()


def test_ends_and_their_weights_come_from_all_rows(spark):
    rows = _rows()
    found, all_of_them = endings_over(_table(spark, rows)), train_endings(rows)
    assert (found.ends.final == all_of_them.ends.final).all() and (found.ends.total == all_of_them.ends.total).all()
    assert np.allclose(found.weights, all_of_them.weights, atol=1e-3)
    assert found.ends.probability("rested qzx.") > train_endings(rows[:-1]).ends.probability("rested qzx.")


def test_refusals_come_from_all_rows(spark):
    rows = _rows()
    found = refusals_over(_table(spark, rows))
    asked = sorted({(q, g, None) for q, g, _ in rows} | {r for r in rows if r[2] and r[1] != r[2]}, key=str)
    total = np.zeros(declining.WIDTH, np.int64)
    declining._count([x for r in asked for x in declining_sentences(*r)], total)
    assert (found.model.table == declining._limited(total, np.ones(2 * declining.BINS, np.int64)).model.table).all()
    assert found.decline(["I can't answer this here."]) == [True]


def test_languages_come_from_all_sentences_of_all_texts_and_all_prompts(spark, monkeypatch):
    """The tenth sentence of the last of 200 texts, and a prompt, of signs that nothing else has."""
    monkeypatch.setattr(pairs, "DOUBT", 1e9)
    rng = np.random.default_rng(9)
    langs = list(PHRASES)
    texts = [(f"{i}:" + _text(langs[i % len(langs)], rng), langs[i % len(langs)]) for i in range(20 * len(langs))]
    long = " ".join(PHRASES["en"][k % len(PHRASES["en"])].capitalize() + "." for k in range(9))
    texts += [(f"{i}:{long}" + " And so the qeqeqeqe was a qeqeqeqe." * (i == 199), "en") for i in range(200)]
    asked = [("Zyzyzyzy wann hat sie das geschrieben?", None, ". ".join(p.capitalize() for p in PHRASES["de"][:3]) + ".")]

    def likely(texts, asked):
        model = languages_over(spark.createDataFrame(texts, "passage string, lang string"), _table(spark, asked))
        return [model.log_likelihoods([w])[0][0][model.classes.index(c)] for w, c in (("qeqeqeqe", "en"), ("zyzyzyzy", "de"))]

    all_of_them, less = likely(texts, asked), likely(texts[:-1], [])
    assert all_of_them[0] > less[0] + 5 and all_of_them[1] > less[1] + 5


def test_short_and_wrapped_texts_are_complete():
    rows = [(QUESTION, g, None) for g in ("No", *(f"Nor{a}dan {b}ek" for a in "abcdefgh" for b in "klmnop"))]
    ends = train_endings(rows).ends
    assert min(ends.probability(t) for t in ("No", "**No**", "“No”")) > ends.probability("Nor")
    assert ends.probability("**No**") == ends.probability("No")
