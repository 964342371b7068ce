"""Seeded samples, shuffles and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import name_key, word_count
from passagemill.operators import sampling as P
from passagemill.operators.corpus import corpus
from passagemill.plans.registry import Tables, query

KEY = "md5('%s:' || CAST(%s AS VARCHAR))"
TYPED = r"(SELECT question_no, min(corpus_id) AS corpus_id, min(regexp_replace(lower(question_type), '[\s_-]+', '', 'g')) AS type_key FROM questions GROUP BY 1)"
CORPUS = "corpus AS (SELECT corpus_id, passage_id, min(passage_idx) AS passage_idx, min(passage) AS text FROM passages WHERE passage IS NOT NULL GROUP BY 1, 2)"


def _typed(t: Tables) -> DataFrame:
    return t.questions.groupBy("question_no").agg(F.min("corpus_id").alias("corpus_id"), F.min(name_key(F.col("question_type"))).alias("type_key"))


@query(f"SELECT question_no FROM {TYPED} ORDER BY {KEY % ('42:all', 'question_no')}, question_no LIMIT 100")
def simple_sample(t: Tables) -> DataFrame:
    """A hundred questions in seeded order."""
    return P.simple_sample(_typed(t), 100, "42:all", "question_no").select("question_no")


@query(f"""SELECT question_no, type_key, nth FROM (SELECT *, row_number() OVER (PARTITION BY type_key ORDER BY {KEY % ('7', 'question_no')}, question_no) AS nth
FROM {TYPED} WHERE type_key IS NOT NULL) WHERE nth <= 10""")
def stratified_sample(t: Tables) -> DataFrame:
    """Ten questions of each type."""
    rows = _typed(t).filter(F.col("type_key").isNotNull())
    return P.stratified_sample(rows, 10, "7", "question_no", ["type_key"]).select("question_no", "type_key", "nth")


@query(f"""WITH {CORPUS} SELECT corpus_id, passage_id, row_number() OVER (PARTITION BY corpus_id ORDER BY {KEY % ('11', 'passage_id')}, passage_id) - 1 AS position FROM corpus""")
def shuffled_corpus(t: Tables) -> DataFrame:
    """New positions of each package's passages in seeded order."""
    return P.shuffled(corpus(t.passages), "11", "passage_id", ["corpus_id"]).select("corpus_id", "passage_id", "position")


@query(f"""WITH {CORPUS}, sized AS (SELECT corpus_id, passage_id, passage_idx, len(regexp_extract_all(text, '\\S+')) AS tokens FROM corpus),
upto AS (SELECT *, sum(tokens) OVER (PARTITION BY corpus_id ORDER BY passage_idx ROWS UNBOUNDED PRECEDING) AS upto, sum(tokens) OVER (PARTITION BY corpus_id) AS total FROM sized)
SELECT corpus_id, passage_id, CAST(tokens AS BIGINT) AS tokens, CAST(least(tokens, 1000 - (upto - tokens)) AS BIGINT) AS kept_tokens, total < 1000 AS short FROM upto WHERE 1000 - (upto - tokens) > 0 AND tokens > 0""")
def token_budget_prefix(t: Tables) -> DataFrame:
    """Each package's passages up to a thousand words, the last one cut to the rest; packages with fewer are marked."""
    sized = corpus(t.passages).withColumn("tokens", word_count(F.col("text")))
    return P.token_prefix(sized, "passage_idx", "tokens", 1000, ["corpus_id"]).select("corpus_id", "passage_id", "tokens", "kept_tokens", "short")


@query("""SELECT corpus_id, question_no FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY source_index, question_no) AS nth
FROM (SELECT question_no, min(corpus_id) AS corpus_id, min(source_index) AS source_index FROM questions GROUP BY 1)) WHERE nth <= 5""")
def first_questions(t: Tables) -> DataFrame:
    """The first five questions of each package by source position."""
    from pyspark.sql import Window

    rows = t.questions.groupBy("question_no").agg(F.min("corpus_id").alias("corpus_id"), F.min("source_index").alias("source_index"))
    by = Window.partitionBy("corpus_id").orderBy("source_index", "question_no")
    return rows.withColumn("nth", F.row_number().over(by)).filter("nth <= 5").select("corpus_id", "question_no")
