"""Judged retrieval: contexts of rankings, a judge's replies about them, and the scores made of what is valid in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators import judging as J
from passagemill.operators import ranking as K
from passagemill.operators.corpus import corpus
from passagemill.operators.evaluation import latest
from passagemill.plans.registry import Tables, query
from passagemill.session import cut

LAST = """last AS (
  SELECT prediction_id, arg_max(struct_pack(corpus_id := corpus_id, question_id := question_id, question := question, method := method, idx := sorted_passage_idx), loaded_at) AS p
  FROM predictions GROUP BY 1),
flat AS (SELECT prediction_id, p.corpus_id AS corpus_id, lower(trim(p.question_id, E' \\t\\r\\n')) AS key, p.question AS question, p.method AS method, p.idx AS idx FROM last)"""
ASKED = """asked AS (
  SELECT corpus_id, lower(trim(coalesce(id, CAST(source_index AS VARCHAR)), E' \\t\\r\\n')) AS key,
         arg_max(struct_pack(question := question, answer := answer, evidence := evidence), struct_pack(b := batch_no, l := loaded_at, n := question_no)) AS q
  FROM questions GROUP BY 1, 2)"""


def _asked(t: Tables) -> DataFrame:
    """Each question of a package as delivered last: its key, text, gold answer and evidence."""
    key = F.lower(F.btrim(F.coalesce("id", F.col("source_index").cast("string")), F.lit(X.BLANKS)))
    fields = F.struct("question", "answer", "evidence")
    return t.questions.groupBy("corpus_id", key.alias("key")).agg(F.max_by(fields, F.struct("batch_no", "loaded_at", "question_no")).alias("q")).select("corpus_id", "key", "q.*")


def _results(t: Tables, *columns: str) -> DataFrame:
    rows = latest(t.predictions.select("prediction_id", "loaded_at", "corpus_id", "question_id", *columns), ["prediction_id"], ["loaded_at"])
    return rows.withColumn("key", F.lower(F.btrim("question_id", F.lit(X.BLANKS))))


@query(f"""WITH {LAST}, {ASKED},
body AS (SELECT corpus_id, passage_idx, min(text) AS text FROM (
  SELECT corpus_id, passage_id, min(passage_idx) AS passage_idx, min(passage) AS text FROM passages WHERE passage IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2),
ranked AS (SELECT prediction_id, corpus_id, unnest(idx[1:5]) AS passage_idx, generate_subscripts(idx[1:5], 1) AS rank FROM flat),
shown AS (SELECT prediction_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM ranked JOIN body USING (corpus_id, passage_idx) GROUP BY 1),
judged AS (
  SELECT f.prediction_id, coalesce(s.context, '') AS context, a.q.answer AS answer, list_filter(a.q.evidence, lambda e: e IS NOT NULL AND trim(e, E' \\t\\r\\n') <> '') AS evidence
  FROM flat f JOIN asked a USING (corpus_id, key) LEFT JOIN shown s USING (prediction_id) WHERE a.q.evidence IS NOT NULL AND a.q.answer IS NOT NULL),
scored AS (
  SELECT prediction_id, evidence, list_distinct(evidence) AS once, list_filter(list_distinct(evidence), lambda e: contains(context, e)) AS held,
    CASE WHEN contains(lower(context), lower(answer)) THEN 2 WHEN length(context) > 0 THEN 1 ELSE 0 END AS rating FROM judged)
SELECT prediction_id, rating / 2.0 AS context_relevance, round(CASE WHEN len(once) > 0 THEN len(held) / len(once) END, 6) AS evidence_recall,
  CAST(len(evidence) AS INTEGER) AS n_reference, CAST(len(once) AS INTEGER) AS n_classified, 2 AS n_ratings, len(once) > 0 AND len(once) = len(evidence) AS complete FROM scored""")
def judged_retrieval(t: Tables) -> DataFrame:
    """Context relevance and evidence recall of every ranking's first five passages, from the replies of a judge.

    The judge is the one without a model; its replies are texts and go through the same parsing as a model's.
    """
    results = cut(_results(t, "sorted_passage_idx"))
    texts = corpus(t.passages).groupBy("corpus_id", "passage_idx").agg(F.min("text").alias("text"))
    ranked = K.ranked_members(results.withColumn("top", F.slice("sorted_passage_idx", 1, 5)), "top", ["prediction_id", "corpus_id"])
    parts = ranked.join(texts, ["corpus_id", "passage_idx"]).groupBy("prediction_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("parts"))
    shown = parts.select("prediction_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("context"))
    known = _asked(t).filter(F.col("evidence").isNotNull() & F.col("answer").isNotNull())
    clean = F.filter("evidence", lambda e: e.isNotNull() & (F.btrim(e, F.lit(X.BLANKS)) != ""))
    items = J.attach_gold(results.select("prediction_id", "corpus_id", "key"), known, ["corpus_id", "key"]).withColumn("evidence", clean)
    items = items.join(shown, "prediction_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    texts = items.select(
        "prediction_id", "evidence", J.default_judge(F.col("context"), F.col("evidence")).alias("found"),
        *[J.default_relevance(F.col("context"), F.col("answer"), n).alias(n) for n in ("score", "rating")],
    )
    replies = texts.select("prediction_id", "evidence", *[J.reply_object(F.col(n)).alias(n) for n in ("found", "score", "rating")])
    valid = replies.select("prediction_id", "evidence", F.array(J.rating(F.col("score")), J.rating(F.col("rating"))).alias("ratings"), J.valid_classifications(F.col("found"), F.col("evidence")).alias("classified"))
    scores = valid.select("prediction_id", *J.evaluation(F.col("ratings"), F.col("classified"), F.col("evidence")))
    return scores.withColumn("evidence_recall", F.round("evidence_recall", 6))


@query(f"""WITH {LAST}, {ASKED}
SELECT prediction_id, CASE WHEN a.key IS NULL THEN 'no question' ELSE 'other text' END AS reason FROM flat f LEFT JOIN asked a USING (corpus_id, key)
WHERE a.key IS NULL OR f.question IS DISTINCT FROM a.q.question""")
def gold_mismatches(t: Tables) -> DataFrame:
    """Predictions without a question in their package, or with another text than it has."""
    results, asked = _results(t, "question"), _asked(t)
    known = asked.select("corpus_id", "key", "question")
    keyed = results.select("prediction_id", "corpus_id", "key", "question").join(known.withColumnRenamed("question", "asked").withColumn("known", F.lit(True)), ["corpus_id", "key"], "left")
    reason = F.when(F.col("known").isNull(), "no question").when(~F.col("question").eqNullSafe(F.col("asked")), "other text")
    return keyed.select("prediction_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


@query(f"""WITH {LAST}, own AS (SELECT DISTINCT corpus_id, method, key FROM flat WHERE corpus_id IS NOT NULL AND method IS NOT NULL AND key IS NOT NULL),
every AS (SELECT corpus_id, count(DISTINCT key) AS n_all FROM own GROUP BY 1)
SELECT corpus_id, method, count(*) AS n_questions, any_value(n_all) AS n_all, count(*) = any_value(n_all) AS same_set FROM own JOIN every USING (corpus_id) GROUP BY 1, 2""")
def method_question_sets(t: Tables) -> DataFrame:
    """Whether each method was asked all questions that any method of the package was: sets compared by their sizes."""
    own = _results(t, "method").select("corpus_id", "method", "key").dropna().distinct()
    sizes = own.groupBy("corpus_id", "key").agg(F.lit(1).alias("one")).groupBy("corpus_id").agg(F.count("*").alias("n_all"))
    found = own.groupBy("corpus_id", "method").agg(F.count("*").alias("n_questions")).join(sizes, "corpus_id")
    return found.withColumn("same_set", F.col("n_questions") == F.col("n_all"))
