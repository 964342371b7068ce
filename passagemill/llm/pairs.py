"""Defective pairs of prompt and response.

The languages of prompt and response are compared by posteriors of a naive Bayes model over character n-grams; broken
off responses are found by the likelihood of n-grams at the end of text (``truncation``); refusals by a naive Bayes
model over character n-grams of sentences (``declining``).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import declining, language_counts, naive_bayes, truncation
from passagemill.llm.language_id import _bare, nameless, readable, sentences_of
from passagemill.llm.languages import clean_code_column
from passagemill.llm.refusals import may_decline
from passagemill.llm.totals import dealt
from passagemill.llm.truncation import CJK as _CJK
from passagemill.session import cut, spread

#: The least bytes of an answer that tells the language of its prompt.
LONG_ANSWER = 60
#: Parts in which labels are checked, and how much likelier another language must be to drop a label.
FOLDS, DOUBT = 3, 3.0
#: Bytes of letters that a response needs to be in a language, and by how much its language must be likelier than the prompt's.
LEAST_LETTERS, LANGUAGE_MARGIN = 16, 6.0
#: Share of the prompt's words that a copy holds.
COPIED = 0.75

# What stands for no answer.
PLACEHOLDERS = frozenset({
    "n/a", "na", "n.a", "n.a.", "none", "null", "nil", "nan", "undefined", "empty", "blank", "tbd", "todo", "(no output)",
    "no output", "(empty)", "(none)", "(blank)", "[empty]", "[blank]", "[none]", "<empty>", "no answer", "no response",
    "(no answer)", "[no answer]", "(no response)", "<no answer>", "<unk>", "<eos>", "<pad>", "无", "なし",
    "нет ответа", "sin respuesta", "keine antwort", "pas de réponse", "sem resposta", "nessuna risposta",
})
_TAG = re.compile(r"<[^<>]*>")
_LABEL = re.compile(r"(?:^|\n)\s*[\"'{\[]*\s*(?:thought|thoughts|answer|final answer|response|reasoning|result|output|antwort|gedanke|réponse|respuesta|risposta|resposta|ответ|мысль|antwoord|svar|odpowiedź|cevap|jawaban|відповідь|απάντηση|答案|回答|答え|思考|답변|답|คำตอบ|उत्तर|إجابة|پاسخ)\s*[\"']?\s*[:：]\s*", re.I)
_INNER_LABEL = re.compile(r"\b(?:thought|answer|final answer)\s*:\s*", re.I)
_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]|[^\W_]+")
_WORD_ASCII = re.compile("[a-z0-9]+")
_NAME = regex.compile(r"(?<!^)(?<![.!?:]\s)(?<=\s)\p{Lu}\p{L}{2,}")
_SIGN = re.compile(r"[^\W_]")
_NO_LETTER = re.compile(r"[\W\d_]+")
_NO_ASCII_LETTER = {i: None for i in range(128) if not chr(i).isalpha()}

@dataclass(frozen=True)
class PairModel:
    languages: naive_bayes.NaiveBayes
    ends: truncation.Truncation
    refusals: declining.Refusals = declining.Refusals()


def words(text: str) -> list[str]:
    """Words in a form that leaves case, accents and width out; single signs in unspaced scripts."""
    if text.isascii():
        return _WORD_ASCII.findall(text.lower())
    text = _bare(unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.casefold())


def is_empty(answer: str | None) -> bool:
    """Null, blanks, punctuation, placeholders, and bare markup or labels."""
    if answer is None:
        return True
    body = answer
    if "<" in body:
        body = _TAG.sub(" ", body)
    if ":" in body or "：" in body:
        body = _INNER_LABEL.sub(" ", _LABEL.sub(" ", body))
    if not _SIGN.search(body):
        return True
    return body.strip(" \t\r\n\"'“”*_`.").lower() in PLACEHOLDERS or answer.strip().lower() in PLACEHOLDERS


def after_question(answer: str, question: str | None) -> str:
    """The answer without labels and without the question where it comes first."""
    body = answer.strip()
    while True:
        m = _LABEL.match(body)
        if not m or m.end() == 0:
            break
        body = body[m.end() :]
    q = (question or "").strip()
    if q and body.lower().startswith(q.lower()) and len(body) > len(q):
        rest = body[len(q) :].strip()
        while q and rest.lower().startswith(q.lower()):
            rest = rest[len(q) :].strip()
        body = _LABEL.sub("", rest) if _LABEL.match(rest) else rest
    return body


def copies(answer: str, question: str | None) -> bool:
    """Whether the answer gives back the question, whole or nearly so, in any order and spelling, and adds nothing.

    Words before the question that name nobody and no figure (a lead-in) add nothing; any word after it does.
    """
    if not question:
        return False
    asked, given = words(question), words(_LABEL.sub(" ", answer) if ":" in answer or "：" in answer else answer)
    # no more words than are in both can count for both
    if not asked or len(given) < COPIED * len(asked) or sum(map(set(asked).__contains__, given)) < COPIED * len(asked):
        return False
    have, want = Counter(given), Counter(asked)
    if sum(min(n, have[w]) for w, n in want.items()) < COPIED * len(asked):
        return False
    if all(w in want for w in given):
        return True
    lead = given[: len(given) - len(asked)]
    tail = given[len(lead) :]
    rest = Counter(tail)
    if tail[-1] not in want:
        return False
    if len(lead) > 10 + 8 * bool(_CJK.search(answer)) or sum(min(n, rest[w]) for w, n in want.items()) < 0.9 * len(asked):
        return False
    named = {w for n in _NAME.findall(answer) for w in words(n)} - want.keys()
    return not named and not any(c.isdigit() for w in lead if w not in want for c in w)


def holds(body: str, gold: str | None) -> bool:
    """Whether the gold answer, of more than three signs, stands in the answer."""
    return bool(gold) and len(gold) > 3 and gold in body


def plain_body(body: str) -> str:
    """Without labels, wherever they stand."""
    return _INNER_LABEL.sub("", _LABEL.sub(" ", body)) if ":" in body or "：" in body else body


def find_defects(rows: list[tuple[str | None, str | None, str | None]], model: PairModel) -> list[str | None]:
    """The defect of each (question, gold answer, answer), or None."""
    out: list[str | None] = [None] * len(rows)
    open_rows: list[int] = []
    bodies: dict[int, str] = {}
    for i, (question, gold, answer) in enumerate(rows):
        if answer is not None and gold is not None and answer.strip() == gold.strip():
            continue
        if is_empty(answer):
            out[i] = "empty"
            continue
        stripped = answer.strip(" \t\r\n\"'“”*_")
        if gold and (stripped == gold.strip() or stripped.rstrip(".。") == gold.strip().rstrip(".。") and stripped):
            continue
        if copies(answer, question):
            out[i] = "copies_question"
            continue
        bodies[i] = after_question(answer, question)
        open_rows.append(i)
    for i, no in zip(open_rows, declining.refusing([(plain_body(bodies[i]), rows[i][0]) for i in open_rows], model.refusals)):
        out[i] = "refusal" if no else None
    open_rows = [i for i in open_rows if out[i] is None]
    foreign = _foreign([(rows[i][0], rows[i][1], bodies[i]) for i in open_rows], model)
    broken = model.ends.broken_off([(bodies[i], rows[i][2], rows[i][1]) for i in open_rows])
    for i, other, cut_off in zip(open_rows, foreign, broken):
        if other:
            out[i] = "other_language"
        elif cut_off:
            out[i] = "truncated"
    return out


def _foreign(rows: list[tuple[str | None, str | None, str]], model: PairModel) -> list[bool]:
    """Whether the response's likeliest language is another than the prompt's, by a margin of log posteriors.

    Every language that the prompt, or a gold answer of some length, may well be in counts as the prompt's.
    """
    told = [nameless(readable(body.replace(gold, " ") if gold else body)) if len(body.encode()) >= LEAST_LETTERS else "" for _, gold, body in rows]
    check = [i for i, t in enumerate(told) if _letter_bytes(t) >= LEAST_LETTERS and rows[i][0]]
    answer = [False] * len(rows)
    if not check:
        return answer
    a = model.languages.log_posteriors([told[i] for i in check])
    asked = {x: nameless(readable(x)) for x in dict.fromkeys(rows[i][0] for i in check)}
    may = _likely(asked, model)
    # of the gold answers only those matter whose prompt isn't in the response's language
    unlike = [(row, i) for row, i in zip(a, check) if not may[rows[i][0]][int(row.argmax())]]
    golds = {x: nameless(readable(x)) for x in dict.fromkeys(rows[i][1] for _, i in unlike if rows[i][1])}
    may_too = _likely({x: t for x, t in golds.items() if _letter_bytes(t) >= 2 * LEAST_LETTERS}, model)
    for row, i in unlike:
        likely = may[rows[i][0]]
        if rows[i][1] in may_too:
            likely = likely | may_too[rows[i][1]]
        best = int(row.argmax())
        answer[i] = not likely[best] and float(row[best] - row[likely].max()) > LANGUAGE_MARGIN
    return answer


def _likely(texts: dict[str, str], model: PairModel) -> dict[str, np.ndarray]:
    """For each text, given in a form to be scored, the languages that it may well be in."""
    if not texts:
        return {}
    post = model.languages.log_posteriors(list(texts.values()))
    return dict(zip(texts, post > post.max(axis=1, keepdims=True) - 3))


def _letter_bytes(text: str) -> int:
    if text.isascii():
        return len(text.translate(_NO_ASCII_LETTER))
    return len(_NO_LETTER.sub("", text).encode())


def sentence_parts(text: str) -> list[str]:
    """A text's sentences without names, as far as they have a few signs."""
    body = readable(text)
    return [p for a, b in sentences_of(body) if b - a >= 16 and (p := nameless(body[a:b]))]


def prompt_parts(pairs: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Prompts and their answers without names, where both have letters enough."""
    asked = [nameless(readable(q)) for q, _ in pairs]
    told = [nameless(readable(after_question(a, q))) for q, a in pairs]
    use = [i for i in range(len(pairs)) if _letter_bytes(asked[i]) >= 8 and _letter_bytes(told[i]) >= 2 * LEAST_LETTERS]
    return [asked[i] for i in use], [told[i] for i in use]


def languages_over(texts: DataFrame, predictions: DataFrame, text: str = "passage", label: str = "lang") -> naive_bayes.NaiveBayes:
    """A naive Bayes model of languages from all labelled texts, labels checked, and from all prompts.

    Prompts are short and worded unlike other texts. A prompt gets the language in which it and a long answer of it are
    likeliest together: the two mostly agree, and where they don't, a few wrong labels are outweighed by the right ones.
    """
    named = texts.select(F.col(text).alias("text"), clean_code_column(F.col(label)).alias("lang")).filter(F.col("lang").isNotNull() & (F.length("text") > 30))
    seen = language_counts.train(dealt(named, "text", "lang").distinct(), sentence_parts, FOLDS, DOUBT)
    long = predictions.filter((F.length("question") > 0) & (F.octet_length("pred_answer") >= LONG_ANSWER)).select("question", "pred_answer")
    prompts = dealt(long, "question").groupBy("question").agg(F.min("pred_answer").alias("answer"))
    return language_counts.with_pairs(seen, prompts, prompt_parts) or naive_bayes.fit(["the"], ["en"])


_MARKED = re.compile(r"[^.…\s][.!?。！？]\s*$")


def is_whole(text: str, is_gold: bool) -> bool:
    """Whether a text is taken for complete: gold answers, however short, and answers with a closing mark."""
    return bool(text.strip()) and (is_gold or _MARKED.search(text) is not None)


def train_endings(rows: list[tuple[str | None, str | None, str | None]]) -> truncation.Truncation:
    """From all complete texts of some (question, gold answer, answer), each once."""
    texts = {g: True for _, g, _ in rows if g}
    texts |= {a: False for _, _, a in rows if a and a not in texts}
    return truncation.train([t for t, is_gold in texts.items() if is_whole(t, is_gold)])


def endings_over(predictions: DataFrame) -> truncation.Truncation:
    """``train_endings`` from a table."""
    both = predictions.select(F.col("gold_answer").alias("text"), F.lit(True).alias("gold")).unionByName(predictions.select(F.col("pred_answer").alias("text"), F.lit(False).alias("gold")))
    texts = dealt(both.filter(F.length("text") > 0), "text").groupBy("text").agg(F.max("gold").alias("gold"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if is_whole(t, g)], pa.string())], names=["text"])

    return truncation.train_over(cut(texts.mapInArrow(keep, "text string")))


def declining_sentences(question: str | None, gold: str | None, answer: str | None) -> list[tuple[int, str]]:
    """What a prediction has to learn refusals from: replies that don't hold the gold answer; and, without it, those that do.

    Without an answer, it is the gold answer alone.
    """
    return declining_sentences_of([(question, gold, answer)])


def declining_sentences_of(rows: list[tuple[str | None, str | None, str | None]]) -> list[tuple[int, str]]:
    """``declining_sentences`` of many predictions."""
    told: list[tuple[bool, str, str | None]] = []
    for question, gold, answer in rows:
        if not answer:
            told.append((True, gold or "", question))
            continue
        body = plain_body(after_question(answer, question))
        known = holds(body, gold)
        told.append((known, body.replace(gold, " ") if known else body, question))
    may = iter(may_decline([text for known, text, _ in told if not known]))
    return [x for known, text, question in told if known or next(may) for x in (declining.of_answer if known else declining.of_reply)(text, question)]


def refusals_over(predictions: DataFrame) -> declining.Refusals:
    """From all distinct predictions, and from the gold answer of each question."""
    fields = predictions.select("question", "gold_answer", "pred_answer")
    replies = fields.filter((F.length("pred_answer") > 0) & ~F.col("pred_answer").eqNullSafe(F.col("gold_answer")))
    golds = fields.filter(F.length("gold_answer") > 0).withColumn("pred_answer", F.lit(None).cast("string"))
    rows = dealt(replies.unionByName(golds), "question", "gold_answer", "pred_answer").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            found = [x for at in range(0, len(rows), 2000) for x in declining_sentences_of(rows[at : at + 2000])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([r for _, r in found], pa.string())], names=["kind", "rest"])

    return declining.train_over(cut(rows.mapInArrow(run, "kind int, rest string")))


def broken_pairs(predictions: DataFrame, labelled: DataFrame) -> DataFrame:
    """prediction_id and defect of each distinct defective prediction.

    Defects are looked for in this order: empty, copies_question, refusal, other_language, truncated. An answer equal
    to its gold answer is none. Null questions and gold answers rule the tests out that need them. Repeated rows of
    one prediction count once (the smallest defect name, where their texts differ). Models are of fixed size and
    learned from all rows, whole; they are sent to the tasks.
    """
    context = predictions.sparkSession.sparkContext
    model = context.broadcast(PairModel(languages_over(labelled, predictions), endings_over(predictions), refusals_over(predictions)))
    unsure = ~F.col("pred_answer").eqNullSafe(F.col("gold_answer")) | F.col("pred_answer").isNull()
    source = predictions.select("prediction_id", "question", "gold_answer", "pred_answer").filter(unsure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                rows = list(zip(*(part.column(i).to_pylist() for i in (1, 2, 3))))
                distinct = list(dict.fromkeys(rows))
                known = dict(zip(distinct, find_defects(distinct, model.value)))
                found = [known[r] for r in rows]
                keep = [i for i, d in enumerate(found) if d]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.string())],
                    names=["prediction_id", "defect"],
                )

    found = spread(source, "prediction_id").mapInArrow(run, "prediction_id bigint, defect string")
    return found.groupBy("prediction_id").agg(F.min("defect").alias("defect"))
