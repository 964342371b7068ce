"""Scalars over texts, answers and judge replies, each over whole tables."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.functions import vectors as V
from passagemill.operators import judging as J
from passagemill.plans.registry import Tables, query
from passagemill.sources.inputs import pending

# Keywords of questions that ask for an attribute.
ATTRIBUTES = ["year", "town", "name", "dose", "born", "founded", "litres", "bridge"]

PUNCTUATION = string.punctuation.replace("'", "''")


def normalized(column: str) -> str:
    """Articles are taken out twice, since two in a row share the blank between them."""
    plain = f"translate(lower(coalesce({column}, '')), '{PUNCTUATION}', '')"
    for _ in range(2):
        plain = rf"regexp_replace({plain}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1 \3', 'g')"
    return rf"trim(regexp_replace({plain}, '\s+', ' ', 'g'), E' \t\r\n')"


ONE = "(SELECT prediction_id, min(question) AS question, min(gold_answer) AS gold_answer, min(pred_answer) AS pred_answer FROM predictions GROUP BY 1)"
CONTAIN = f"""CASE WHEN trim(coalesce(pred_answer, ''), E' \\t\\r\\n') = '' OR trim(coalesce(gold_answer, ''), E' \\t\\r\\n') = '' THEN 0
 WHEN {normalized("gold_answer")} = '' OR contains({normalized("pred_answer")}, {normalized("gold_answer")}) THEN 1 ELSE 0 END"""


def _once(t: Tables) -> DataFrame:
    """Distinct predictions with their texts."""
    return t.predictions.groupBy("prediction_id").agg(*[F.min(c).alias(c) for c in ("question", "gold_answer", "pred_answer")])


@query(f"SELECT prediction_id, {CONTAIN} AS contained FROM {ONE}")
def contain_match(t: Tables) -> DataFrame:
    """Whether the normalized gold answer occurs in the normalized prediction."""
    return _once(t).select("prediction_id", X.contain_match(F.col("pred_answer"), F.col("gold_answer")).alias("contained"))


@query(f"SELECT prediction_id, {normalized('pred_answer')} AS normalized FROM {ONE}")
def normalize_answer(t: Tables) -> DataFrame:
    """Predictions in the form that matching compares."""
    return _once(t).select("prediction_id", X.normalize_answer(F.col("pred_answer")).alias("normalized"))


@query(rf"""SELECT prediction_id,
 CASE WHEN contains(pred_answer, 'Answer:') THEN trim(string_split(pred_answer, 'Answer:')[2], E' \t\r\n') ELSE pred_answer END AS between_markers,
 CASE WHEN contains(pred_answer, 'Answer:') THEN trim(substr(pred_answer, strpos(pred_answer, 'Answer:') + 7), E' \t\r\n') ELSE pred_answer END AS after_marker,
 trim(CASE WHEN contains(pred_answer, 'Answer:') THEN substr(pred_answer, strpos(pred_answer, 'Answer:') + 7) ELSE pred_answer END, E' \t\r\n') AS stripped
FROM {ONE}""")
def answer_extract(t: Tables) -> DataFrame:
    """The three ways of taking the answer out of a reply."""
    reply = F.col("pred_answer")
    return _once(t).select("prediction_id", X.extract_answer(reply, "between").alias("between_markers"), X.extract_answer(reply, "after").alias("after_marker"), X.extract_answer(reply, "stripped").alias("stripped"))


@query(rf"""WITH bare AS (
  SELECT prediction_id, pred_answer, trim(regexp_replace(pred_answer, '```(json)?', '', 'g'), E' \t\r\n') AS whole FROM {ONE} WHERE pred_answer IS NOT NULL),
both_ways AS (SELECT *, regexp_extract(whole, '(\{{[\s\S]*\}})', 1) AS part FROM bare),
found AS (SELECT *, CASE WHEN coalesce(json_type(TRY_CAST(whole AS JSON)) = 'OBJECT', false) THEN TRY_CAST(whole AS JSON)
  WHEN coalesce(json_type(TRY_CAST(nullif(part, '') AS JSON)) = 'OBJECT', false) THEN TRY_CAST(part AS JSON) END AS object FROM both_ways)
SELECT prediction_id, CAST(lower(trim(pred_answer, E' \t\r\n')) = 'correct' AS DOUBLE) AS verdict, object IS NOT NULL AS is_object, json_extract_string(object, '$.answer') AS answer FROM found""")
def judge_parse(t: Tables) -> DataFrame:
    """A judge's verdict, whether its reply holds a JSON object, and the answer in that."""
    reply = F.col("pred_answer")
    rows = _once(t).filter(reply.isNotNull()).select("prediction_id", X.verdict(reply).alias("verdict"), J.reply_object(reply).alias("object"))
    return rows.select("prediction_id", "verdict", (F.to_json("object") != "{}").alias("is_object"), F.try_variant_get("object", "$.answer", "string").alias("answer"))


@query(r"""SELECT DISTINCT passage_no, CAST(nullif(regexp_extract(trim(passage, E' \t\r\n'), '^(\d+):', 1), '') AS BIGINT) AS idx,
 CASE WHEN contains(passage, chr(10)) THEN substr(passage, 1, strpos(passage, chr(10)) - 1) ELSE '' END AS title,
 CASE WHEN contains(passage, chr(10)) THEN substr(passage, strpos(passage, chr(10)) + 1) ELSE passage END AS body,
 'passage-' || md5(passage) AS computed_id FROM passages WHERE passage IS NOT NULL""")
def passage_parts(t: Tables) -> DataFrame:
    """Leading number, title line, body and content identity of each passage."""
    p = F.col("passage")
    title, body = X.title_and_body(p)
    return t.passages.filter(p.isNotNull()).select("passage_no", X.leading_index(p).alias("idx"), title.alias("title"), body.alias("body"), X.content_id("passage", p).alias("computed_id")).distinct()


OVERLAP = " + ".join(f"CAST(contains(lower(question), '{k}') AND contains(lower(answer), '{k}') AS INTEGER)" for k in ATTRIBUTES)


@query(f"""SELECT question_no, len(list_intersect(regexp_extract_all(lower(question), '\\w+'), {ATTRIBUTES})) > 0 AS asks, {OVERLAP} AS overlap,
 round(0.25 * ln(1 + ({OVERLAP})), 6) AS boost
FROM (SELECT question_no, min(question) AS question, min(answer) AS answer FROM questions GROUP BY 1) WHERE question IS NOT NULL AND answer IS NOT NULL""")
def attribute_gate(t: Tables) -> DataFrame:
    """Whether a question asks for an attribute, and the boost of an answer that shares its keywords."""
    q = t.questions.groupBy("question_no").agg(F.min("question").alias("question"), F.min("answer").alias("answer")).dropna()
    overlap = X.attribute_overlap(F.col("question"), F.col("answer"), ATTRIBUTES)
    return q.select("question_no", X.asks_attribute(F.col("question"), ATTRIBUTES).alias("asks"), overlap.alias("overlap"), F.round(X.attribute_boost(overlap), 6).alias("boost"))


@query(r"""WITH q AS (SELECT question_no, min(question) AS question, arg_min(evidence, loaded_at) AS evidence FROM questions GROUP BY 1)
SELECT question_no, md5(array_to_string(list_transform(list_filter(evidence, lambda e: e IS NOT NULL), lambda e: e || chr(10)), '') || 'Question: ' || question || chr(10) || ' Thought: ') AS prompt_hash,
 substr(array_to_string(list_filter(evidence, lambda e: e IS NOT NULL), chr(10)), 1, 20000) AS context
FROM q WHERE question IS NOT NULL AND evidence IS NOT NULL""")
def prompt_assembly(t: Tables) -> DataFrame:
    """The prompt of each question over its evidence, and the context that a judge is shown."""
    q = t.questions.groupBy("question_no").agg(F.min("question").alias("question"), F.min_by("evidence", "loaded_at").alias("evidence")).dropna()
    parts = F.filter("evidence", lambda e: e.isNotNull())
    return q.select("question_no", F.md5(X.prompt(parts, F.col("question")).cast("binary")).alias("prompt_hash"), X.judge_context(parts).alias("context"))


@query(r"""SELECT corpus_id, count(*) AS n_passages, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_words
FROM (SELECT corpus_id, passage_id, min(passage) AS text FROM passages WHERE passage IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def corpus_stats(t: Tables) -> DataFrame:
    """Passages, characters and words of each package."""
    from passagemill.operators.corpus import corpus

    return corpus(t.passages).groupBy("corpus_id").agg(F.count("*").alias("n_passages"), F.sum(F.length("text").cast("bigint")).alias("n_chars"), F.sum(X.word_count(F.col("text"))).alias("n_words"))


@query(r"""SELECT regexp_replace(lower(coalesce(question_type, '?')), '[\s_-]+', '', 'g') AS type_key, count(DISTINCT question_no) AS n FROM questions GROUP BY 1""")
def type_counts(t: Tables) -> DataFrame:
    """Questions of each type, spellings aside."""
    key = X.name_key(F.coalesce("question_type", F.lit("?")))
    return t.questions.select(key.alias("type_key"), "question_no").distinct().groupBy("type_key").agg(F.count("*").alias("n"))


@query("""WITH asked AS (SELECT DISTINCT corpus_id, lower(trim(coalesce(id, CAST(source_index AS VARCHAR)), E' \\t\\r\\n')) AS key FROM questions WHERE corpus_id IS NOT NULL),
done AS (SELECT DISTINCT corpus_id, lower(trim(question_id, E' \\t\\r\\n')) AS key FROM predictions WHERE pred_answer IS NOT NULL AND llm_accuracy IS NOT NULL AND NOT isnan(llm_accuracy))
SELECT a.corpus_id, a.key FROM asked a WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.corpus_id = a.corpus_id AND d.key = a.key)""")
def pending_questions(t: Tables) -> DataFrame:
    """Questions without an answer that has a valid judgement: what a run that is taken up again still has to do."""
    key = lambda c: F.lower(F.btrim(c, F.lit(X.BLANKS)))
    item = lambda k: F.struct("corpus_id", k.alias("key"))
    asked = t.questions.filter(F.col("corpus_id").isNotNull()).select(item(key(F.coalesce("id", F.col("source_index").cast("string")))).alias("item")).distinct()
    done = t.predictions.select(item(key(F.col("question_id"))).alias("item"), "pred_answer", "llm_accuracy")
    whole = F.col("pred_answer").isNotNull() & F.col("llm_accuracy").isNotNull() & ~F.isnan("llm_accuracy")
    return pending(asked, done, "item", whole).select("item.*")


@query("""SELECT DISTINCT passage_no, CAST(passage_idx AS VARCHAR) || ':' || regexp_replace(passage, '^\\d+:', '') AS passage,
 passage IS NOT DISTINCT FROM CAST(passage_idx AS VARCHAR) || ':' || regexp_replace(passage, '^\\d+:', '') AS unchanged FROM passages WHERE passage IS NOT NULL AND passage_idx IS NOT NULL""")
def numbered_passages(t: Tables) -> DataFrame:
    """Each passage's text under its place in the package, and whether it was stored so."""
    p = F.col("passage")
    rows = t.passages.filter(p.isNotNull() & F.col("passage_idx").isNotNull())
    text = X.numbered(F.col("passage_idx"), X.chunk_of(p))
    return rows.select("passage_no", text.alias("passage"), p.eqNullSafe(text).alias("unchanged")).distinct()


@query("""SELECT spec_id, replace(CAST(sample_rate AS VARCHAR), '.', 'p') AS slug, spec_id || '-' || replace(CAST(sample_rate AS VARCHAR), '.', 'p') || '-s' || CAST(seed AS VARCHAR) AS run_name FROM sample_specs""")
def run_names(t: Tables) -> DataFrame:
    """Names of runs made of their parameters, with p for the point."""
    slug = X.value_slug(F.col("sample_rate"))
    return t.sample_specs.select("spec_id", slug.alias("slug"), F.concat("spec_id", F.lit("-"), slug, F.lit("-s"), F.col("seed").cast("string")).alias("run_name"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, round(sqrt(list_dot_product(e, e)), 5) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS first, len(e) AS dimensions FROM v WHERE list_dot_product(e, e) > 0""")
def unit_vectors(t: Tables) -> DataFrame:
    """The length of each stored vector, and its first number at length 1."""
    rows = t.embeddings.filter(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").alias("v"), V.norm(F.col("embedding")).alias("norm")).filter("norm > 0")
    return rows.select("vec_id", F.round("norm", 5).alias("norm"), F.round(F.element_at(V.unit(F.col("v")), 1), 5).alias("first"), F.size("v").cast("bigint").alias("dimensions"))
