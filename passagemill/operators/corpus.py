"""Relations of a package's corpus: passages, sentences, entities and their mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import chunk_of, content_id, fold, occurrences

#: The default extractor of names: two words in ASCII letters that begin with capitals.
NAME_PATTERN = "[A-Z][a-z]+ [A-Z][a-z]+"
#: The default splitter into sentences: closing marks before blanks, and line breaks.
SENTENCE_BREAK = "[.!?]+\\s+|\\n+"
#: The default tokens: words of at least four letters of scripts with spaces, and pairs of signs of those without.
WORD_TOKENS, UNSPACED = r"[\p{L}\p{M}]{4,}", r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"


def names_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NAME_PATTERN), F.lit(0)))


def tokens_in(text: Column) -> Column:
    """Distinct tokens of a text in any script."""
    spaced = F.regexp_replace(fold(text), f"[{UNSPACED}]+", " ")
    pairs = F.regexp_extract_all(text, F.lit(f"(?=([{UNSPACED}]{{2}}))"), F.lit(1))
    return F.array_distinct(F.concat(F.regexp_extract_all(spaced, F.lit(WORD_TOKENS), F.lit(0)), pairs))


def corpus(passages: DataFrame) -> DataFrame:
    """One row per distinct text of a package: corpus_id, passage_id, passage_idx, text. Null texts are left out."""
    return (
        passages.filter(F.col("passage").isNotNull())
        .groupBy("corpus_id", "passage_id")
        .agg(F.min("passage_idx").alias("passage_idx"), F.min("passage").alias("text"))
    )


def passage_mentions(corpus_rows: DataFrame) -> DataFrame:
    """Entities of each passage and how often each occurs: corpus_id, passage_id, entity, n."""
    return corpus_rows.select("corpus_id", "passage_id", "text", F.explode(names_in(F.col("text"))).alias("entity")).select(
        "corpus_id", "passage_id", "entity", occurrences(F.col("text"), F.col("entity")).alias("n")
    )


def sentences(corpus_rows: DataFrame) -> DataFrame:
    """Distinct sentences of each package: corpus_id, sentence_id, sentence."""
    return (
        corpus_rows.select("corpus_id", F.explode(F.split(chunk_of(F.col("text")), SENTENCE_BREAK)).alias("part"))
        .select("corpus_id", F.btrim("part", F.lit(" \t\r\n")).alias("sentence"))
        .filter(F.col("sentence") != "")
        .distinct()
        .select("corpus_id", content_id("sentence", F.col("sentence")).alias("sentence_id"), "sentence")
    )


def sentence_mentions(sentence_rows: DataFrame) -> DataFrame:
    """Entities of each sentence: corpus_id, sentence_id, entity."""
    return sentence_rows.select("corpus_id", "sentence_id", F.explode(names_in(F.col("sentence"))).alias("entity"))


def stated_questions(questions: DataFrame, every: int = 100) -> DataFrame:
    """The stated query set: distinct questions whose number is divisible by ``every``: question_no, corpus_id, question."""
    return (
        questions.filter((F.col("question_no") % every == 0) & F.col("question").isNotNull())
        .groupBy("question_no")
        .agg(F.min("corpus_id").alias("corpus_id"), F.min("question").alias("question"))
    )


def question_entities(question_rows: DataFrame) -> DataFrame:
    """Names in a question, in lower case: question_no, corpus_id, entity."""
    return question_rows.select("question_no", "corpus_id", F.explode(F.array_distinct(F.transform(names_in(F.col("question")), F.lower))).alias("entity"))


def sentence_triples(sentence_rows: DataFrame) -> DataFrame:
    """Neighbouring names of a sentence as subject and object: corpus_id, sentence_id, subject, object.

    The default for models that extract triples; its rows grow with the sentences, not with pairs of names.
    """
    names = F.regexp_extract_all("sentence", F.lit(NAME_PATTERN), F.lit(0))
    pairs = F.arrays_zip(F.slice("names", 1, F.size("names") - 1).alias("subject"), F.slice("names", 2, F.size("names") - 1).alias("object"))
    rows = sentence_rows.select("corpus_id", "sentence_id", names.alias("names")).filter(F.size("names") > 1)
    return rows.select("corpus_id", "sentence_id", F.explode(pairs).alias("p")).select("corpus_id", "sentence_id", F.col("p.subject").alias("subject"), F.col("p.object").alias("object"))
