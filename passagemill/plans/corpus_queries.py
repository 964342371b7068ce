"""Packages: construction, checks, increments and TF-IDF candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators import packages as B
from passagemill.operators.corpus import corpus, stated_questions
from passagemill.operators.evaluation import latest
from passagemill.operators.graph import top_passages
from passagemill.operators.ranking import ranked_members
from passagemill.operators.tfidf import query_weights, weights
from passagemill.plans.fragments import folded
from passagemill.plans.registry import Tables, query
from passagemill.session import cut

CORPUS = "corpus AS (SELECT corpus_id, passage_id, min(passage_idx) AS passage_idx, min(passage) AS text FROM passages WHERE passage IS NOT NULL GROUP BY 1, 2)"


@query(rf"""WITH {CORPUS}, place AS (SELECT DISTINCT sha256(regexp_replace(text, '^\d+:', '')) AS text_sha256, corpus_id, passage_idx FROM corpus),
first AS (SELECT text_sha256, corpus_id AS first_corpus, passage_idx AS first_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY corpus_id, passage_idx) AS nth FROM place) WHERE nth = 1)
SELECT text_sha256, count(*) AS n_locations, count(DISTINCT corpus_id) AS n_packages, any_value(first_corpus) AS first_corpus, any_value(first_idx) AS first_idx
FROM place JOIN first USING (text_sha256) GROUP BY 1""")
def shared_documents(t: Tables) -> DataFrame:
    """Distinct chunks, in how many places and packages they stand, and the first place."""
    return B.documents_with_locations(corpus(t.passages))


@query(rf"""WITH {CORPUS} SELECT DISTINCT sha256(regexp_replace(text, '^\d+:', '')) AS text_sha256, corpus_id, passage_idx FROM corpus""")
def document_places(t: Tables) -> DataFrame:
    """Distinct chunks and all places they come from, one a row."""
    return B.document_places(corpus(t.passages))


RANKED = """last AS (SELECT prediction_id, arg_max(struct_pack(corpus_id := corpus_id, idx := sorted_passage_idx), loaded_at) AS p FROM predictions GROUP BY 1),
need AS (SELECT DISTINCT r.corpus_id, c.passage_id FROM (SELECT p.corpus_id AS corpus_id, unnest(p.idx[1:1]) AS passage_idx FROM last) r JOIN corpus c USING (corpus_id, passage_idx))"""


BUILT = f"""WITH {CORPUS}, {RANKED}, extra AS (
  SELECT corpus_id, passage_id FROM (SELECT corpus_id, passage_id, row_number() OVER (PARTITION BY corpus_id ORDER BY md5('5:' || passage_id), passage_id) AS nth
    FROM corpus WHERE (corpus_id, passage_id) NOT IN (SELECT corpus_id, passage_id FROM need)) WHERE nth <= 20),
both_kinds AS (SELECT corpus_id, passage_id, 'required' AS role FROM need UNION ALL SELECT corpus_id, passage_id, 'distractor' FROM extra),
placed AS (SELECT corpus_id, passage_id, role, row_number() OVER (PARTITION BY corpus_id ORDER BY md5('5:shuffle:' || passage_id), passage_id) - 1 AS position FROM both_kinds)"""


def _built(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The corpus, the passage that each ranking has first, and the package constructed of them."""
    rows = corpus(t.passages)
    keyed = rows.select("corpus_id", "passage_id", "passage_idx")
    rankings = latest(t.predictions.select("prediction_id", "loaded_at", "corpus_id", "question_id", "sorted_passage_idx"), ["prediction_id"], ["loaded_at"])
    firsts = ranked_members(rankings.withColumn("first", F.slice("sorted_passage_idx", 1, 1)), "first", ["corpus_id", "question_id"]).select("corpus_id", "question_id", "passage_idx").distinct()
    needs = cut(firsts.join(keyed, ["corpus_id", "passage_idx"]).select("corpus_id", "question_id", "passage_id"))
    return rows, needs, B.constructed_package(needs.select("corpus_id", "passage_id"), keyed, 20, "5")


@query(f"{BUILT} SELECT corpus_id, passage_id, role, position FROM placed")
def constructed_package(t: Tables) -> DataFrame:
    """Passages that some ranking has first, with twenty distractors each package, shuffled."""
    return _built(t)[2]


@query(f"""{BUILT} SELECT DISTINCT r.corpus_id, r.question_id, p.position FROM (
  SELECT p.corpus_id AS corpus_id, p.question_id AS question_id, unnest(p.idx[1:1]) AS passage_idx
  FROM (SELECT prediction_id, arg_max(struct_pack(corpus_id := corpus_id, question_id := question_id, idx := sorted_passage_idx), loaded_at) AS p FROM predictions GROUP BY 1)) r
JOIN corpus c USING (corpus_id, passage_idx) JOIN placed p ON p.corpus_id = r.corpus_id AND p.passage_id = c.passage_id""")
def question_positions(t: Tables) -> DataFrame:
    """Where in the constructed package the passages of each question stand."""
    _, needs, placed = _built(t)
    return B.question_positions(needs, placed).select("corpus_id", "question_id", "position").distinct()


@query(f"""{BUILT} SELECT corpus_id, count(*) FILTER (WHERE role = 'required') AS n_required, count(*) FILTER (WHERE role = 'distractor') AS n_distractors, count(*) AS n_passages,
  CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_words FROM placed JOIN corpus USING (corpus_id, passage_id) GROUP BY 1""")
def constructed_statistics(t: Tables) -> DataFrame:
    """Passages by role, signs and words of each constructed package."""
    rows, _, placed = _built(t)
    return B.package_statistics(placed, rows)


FRAGMENTS = f"""WITH {CORPUS}, fragment AS (
  SELECT DISTINCT question_no, corpus_id, fragment FROM (SELECT question_no, corpus_id, unnest(evidence) AS fragment FROM questions WHERE question_no % 100 = 0) WHERE fragment IS NOT NULL),
held AS (SELECT f.question_no, f.corpus_id, f.fragment, c.passage_id, c.passage_idx FROM fragment f JOIN corpus c USING (corpus_id) WHERE trim(lower(fragment)) <> '' AND contains(lower(text), lower(fragment))),
matched AS (SELECT f.question_no, f.corpus_id, f.fragment, count(h.passage_id) AS n_matches FROM fragment f LEFT JOIN held h USING (question_no, corpus_id, fragment) GROUP BY 1, 2, 3)"""


def _support(t: Tables, rows: DataFrame) -> DataFrame:
    stated = t.questions.filter(F.col("question_no") % 100 == 0).select("question_no", "corpus_id", F.explode("evidence").alias("fragment")).filter(F.col("fragment").isNotNull())
    return B.support_passages(stated, rows)


@query(f"""{FRAGMENTS} SELECT m.question_no, m.corpus_id, md5(m.fragment) AS fragment_md5, m.n_matches, h.passage_idx FROM matched m LEFT JOIN held h USING (question_no, corpus_id, fragment)""")
def support_passages(t: Tables) -> DataFrame:
    """Where the evidence of each stated question stands, and in how many passages: one each, if it is to support a case."""
    found = _support(t, corpus(t.passages))
    return found.select("question_no", "corpus_id", F.md5(F.col("fragment").cast("binary")).alias("fragment_md5"), "n_matches", "passage_idx")


@query(f"""{FRAGMENTS}, support AS (SELECT DISTINCT question_no, corpus_id, passage_id FROM held JOIN matched USING (question_no, corpus_id, fragment) WHERE n_matches = 1),
other AS (SELECT s.question_no, c.corpus_id, c.passage_id, row_number() OVER (PARTITION BY s.question_no, c.corpus_id ORDER BY md5('8:' || c.passage_id), c.passage_id) AS nth
  FROM (SELECT DISTINCT question_no, corpus_id FROM support) s JOIN corpus c USING (corpus_id)
  WHERE NOT EXISTS (SELECT 1 FROM support x WHERE x.question_no = s.question_no AND x.corpus_id = c.corpus_id AND x.passage_id = c.passage_id)),
both_kinds AS (SELECT question_no, corpus_id, passage_id, 'support' AS role FROM support UNION ALL SELECT question_no, corpus_id, passage_id, 'distractor' FROM other WHERE nth <= 10)
SELECT question_no, corpus_id, passage_id, passage_idx, role FROM both_kinds JOIN corpus USING (corpus_id, passage_id)""")
def case_packages(t: Tables) -> DataFrame:
    """For each stated question with evidence found once: these passages and ten distractors, by their own numbers."""
    rows = cut(corpus(t.passages))
    support = _support(t, rows).filter("n_matches = 1").select("question_no", "corpus_id", "passage_id")
    return B.case_packages(cut(support), rows, 10, "8")


@query("""WITH stated AS (SELECT corpus_id, max(passage_count) AS stated_passages, max(question_count) AS stated_questions FROM package GROUP BY 1),
p AS (SELECT corpus_id, count(DISTINCT passage_idx) AS n FROM passages GROUP BY 1), q AS (SELECT corpus_id, count(DISTINCT question_no) AS n FROM questions GROUP BY 1)
SELECT corpus_id, stated_passages, stated_questions, coalesce(p.n, 0) AS found_passages, coalesce(q.n, 0) AS found_questions,
 coalesce(stated_passages = coalesce(p.n, 0) AND stated_questions = coalesce(q.n, 0), false) AS agrees FROM stated LEFT JOIN p USING (corpus_id) LEFT JOIN q USING (corpus_id)""")
def package_verify(t: Tables) -> DataFrame:
    """Stated and found counts of each package."""
    return B.verify(t.package, t.passages, t.questions)


@query("""SELECT DISTINCT passage_id, corpus_id FROM passages a WHERE loaded_at >= TIMESTAMPTZ '2025-10-01 00:00:00+00' AND passage_id IS NOT NULL
AND passage_id NOT IN (SELECT passage_id FROM passages WHERE loaded_at < TIMESTAMPTZ '2025-10-01 00:00:00+00' AND passage_id IS NOT NULL)""")
def new_passages(t: Tables) -> DataFrame:
    """Passages that arrived later and whose text isn't known from before."""
    rows = t.passages.filter(F.col("passage_id").isNotNull()).select("corpus_id", "passage_id", "loaded_at")
    since = F.lit("2025-10-01 00:00:00").cast("timestamp")
    known, arriving = rows.filter(F.col("loaded_at") < since).select("passage_id"), rows.filter(F.col("loaded_at") >= since)
    return arriving.select("passage_id", "corpus_id").distinct().join(known.distinct(), "passage_id", "left_anti")


@query("""SELECT question_id, corpus_id, arg_max(pred_answer, struct_pack(l := loaded_at, p := prediction_id)) AS pred_answer, count(DISTINCT prediction_id) AS n_versions
FROM predictions WHERE question_id IS NOT NULL AND corpus_id IS NOT NULL AND pred_answer IS NOT NULL GROUP BY 1, 2""")
def last_prediction(t: Tables) -> DataFrame:
    """The last answer to each question: of several maps merged, the right side wins."""
    rows = t.predictions.filter(F.col("question_id").isNotNull() & F.col("corpus_id").isNotNull() & F.col("pred_answer").isNotNull())
    return rows.groupBy("question_id", "corpus_id").agg(
        F.max_by("pred_answer", F.struct("loaded_at", "prediction_id")).alias("pred_answer"), F.count_distinct("prediction_id").alias("n_versions")
    )


# English words that carry no topic, stated once more for the check.
NO_TOPIC = """a about above across after again against all almost along already also although always am among an and another any are around as at back be
became because become been before behind being below between both but by can cannot could did do does done down during each either else enough even ever
every few first for from further get give go had has have he hence her here hers him his how however i if in indeed into is it its itself just last least
less made many may me might mine more most much must my neither never next no nobody none nor not nothing now of off often on once one only onto or other
others our out over own per perhaps please put rather same see seem several she should since so some such than that the their them then there these they
this those though through thus to together too toward two under until up upon us very was we well were what when where whether which while who whole whom
whose why will with within without would yet you your"""
LIST = ", ".join(f"'{w}'" for w in NO_TOPIC.split())
TERMS = f"list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


def words_of(text: str) -> str:
    return f"list_filter(regexp_extract_all({folded(text)}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({LIST}))"




@query(f"""WITH {CORPUS}, asked AS (SELECT question_no, min(corpus_id) AS corpus_id, min(question) AS question FROM questions WHERE question_no % 100 = 0 AND question IS NOT NULL GROUP BY 1),
tf AS (SELECT corpus_id, passage_id, term, count(*) AS tf FROM (SELECT corpus_id, passage_id, unnest({TERMS}) AS term FROM (SELECT corpus_id, passage_id, {words_of('text')} AS w FROM corpus)) GROUP BY 1, 2, 3),
idf AS (SELECT corpus_id, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf JOIN (SELECT corpus_id, CAST(count(*) AS DOUBLE) AS n FROM corpus GROUP BY 1) USING (corpus_id) GROUP BY corpus_id, term, n),
raw AS (SELECT corpus_id, passage_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (corpus_id, term)),
p AS (SELECT corpus_id, passage_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY corpus_id, passage_id)) AS w FROM raw),
qtf AS (SELECT question_no, corpus_id, term, count(*) AS tf FROM (SELECT question_no, corpus_id, unnest({TERMS}) AS term FROM (SELECT question_no, corpus_id, {words_of('question')} AS w FROM asked)) GROUP BY 1, 2, 3),
qraw AS (SELECT question_no, corpus_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (corpus_id, term)),
q AS (SELECT question_no, corpus_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY question_no, corpus_id)) AS w FROM qraw),
s AS (SELECT question_no, passage_id, sum(q.w * p.w) AS score FROM q JOIN p USING (corpus_id, term) GROUP BY 1, 2)
SELECT question_no, passage_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_no ORDER BY round(score, 9) DESC, passage_id) AS rank FROM s) WHERE rank <= 5""")
def tfidf_candidates(t: Tables) -> DataFrame:
    """The five passages of each stated question's package with the nearest TF-IDF vectors."""
    asked = cut(stated_questions(t.questions))
    texts = cut(corpus(t.passages).select("corpus_id", "passage_id", "text").join(asked.select("corpus_id").distinct(), "corpus_id", "left_semi"))
    p = cut(weights(texts, ["passage_id"], ["corpus_id"]))
    q = query_weights(asked, p.select("corpus_id", "term", "idf").distinct(), "question_no", ["corpus_id"])
    scores = q.withColumnRenamed("w", "qw").join(p.select("corpus_id", "passage_id", "term", "w"), ["corpus_id", "term"]).groupBy("question_no", "passage_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 9).alias("score"))
    return top_passages(scores).withColumn("score", F.round("score", 6))
