"""Scores of predictions, comparisons of methods, and checks of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators import evaluation as E
from passagemill.operators import ranking as K
from passagemill.operators.corpus import corpus
from passagemill.plans.registry import Tables, query

LATEST = """last AS (
  SELECT prediction_id, arg_max(struct_pack(run_id := run_id, corpus_id := corpus_id, question_id := question_id, method := method, gold := gold_answer, pred := pred_answer,
    idx := sorted_passage_idx, scores := sorted_passage_scores, llm := llm_accuracy, contain := contain_accuracy), loaded_at) AS p FROM predictions GROUP BY 1),
flat AS (SELECT prediction_id, p.run_id AS run_id, p.corpus_id AS corpus_id, p.question_id AS question_id, p.method AS method, p.gold AS gold, p.pred AS pred,
    p.idx AS idx, p.scores AS scores, p.llm AS llm, p.contain AS contain FROM last)"""
SCORES = """count(*) AS n, count(*) FILTER (WHERE llm IS NULL OR isnan(llm)) AS n_invalid,
  round(avg(llm) FILTER (WHERE NOT isnan(llm)), 6) AS llm_accuracy, round(avg(contain) FILTER (WHERE NOT isnan(contain)), 6) AS contain_accuracy,
  round((avg(llm) FILTER (WHERE NOT isnan(llm)) + avg(contain) FILTER (WHERE NOT isnan(contain))) / 2, 6) AS average_accuracy"""
MEANS = ("llm_accuracy", "contain_accuracy", "average_accuracy")
TYPES = r"""types AS (
  SELECT corpus_id, lower(trim(coalesce(id, CAST(source_index AS VARCHAR)), E' \t\r\n')) AS key,
         min(regexp_replace(lower(question_type), '[\s_-]+', '', 'g')) AS type_key FROM questions GROUP BY 1, 2)"""
TYPED = rf"""{TYPES},
typed AS (SELECT f.*, t.type_key FROM flat f JOIN types t ON f.corpus_id = t.corpus_id AND lower(trim(f.question_id, E' \t\r\n')) = t.key WHERE t.type_key IS NOT NULL)"""


def _latest(t: Tables, *columns: str) -> DataFrame:
    return E.latest(t.predictions.select("prediction_id", "loaded_at", *columns), ["prediction_id"], ["loaded_at"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in MEANS})


def _typed(t: Tables) -> DataFrame:
    """Predictions with the type of their question."""
    key = lambda c: F.lower(F.btrim(c, F.lit(X.BLANKS)))
    types = (
        t.questions.groupBy("corpus_id", key(F.coalesce("id", F.col("source_index").cast("string"))).alias("key"))
        .agg(F.min(X.name_key(F.col("question_type"))).alias("type_key")).filter(F.col("type_key").isNotNull())
    )
    rows = _latest(t, "corpus_id", "question_id", "method", "llm_accuracy", "contain_accuracy").withColumn("key", key(F.col("question_id")))
    return rows.join(types, ["corpus_id", "key"])


@query(f"WITH {LATEST} SELECT method, {SCORES} FROM flat GROUP BY 1")
def accuracy_by_method(t: Tables) -> DataFrame:
    """Mean accuracies of each method over distinct predictions."""
    return _rounded(E.accuracy(_latest(t, "method", "llm_accuracy", "contain_accuracy"), ["method"]))


@query(f"WITH {LATEST}, {TYPED} SELECT type_key, method, {SCORES} FROM typed GROUP BY 1, 2")
def accuracy_by_type(t: Tables) -> DataFrame:
    """The same by type of question."""
    return _rounded(E.accuracy(_typed(t), ["type_key", "method"]))


@query(f"""WITH {LATEST}, {TYPED}, by_type AS (
  SELECT type_key, method, avg(llm) FILTER (WHERE NOT isnan(llm)) AS llm, avg(contain) FILTER (WHERE NOT isnan(contain)) AS contain FROM typed GROUP BY 1, 2)
SELECT method, count(*) AS n_types, round(avg(llm), 6) AS macro_llm, round(avg(contain), 6) AS macro_contain FROM by_type GROUP BY 1""")
def macro_average(t: Tables) -> DataFrame:
    """Means of the types' means."""
    by_type = E.accuracy(_typed(t), ["type_key", "method"])
    return by_type.groupBy("method").agg(F.count("*").alias("n_types"), F.round(F.avg("llm_accuracy"), 6).alias("macro_llm"), F.round(F.avg("contain_accuracy"), 6).alias("macro_contain"))


PIVOT = "SELECT metric, round(max(value) FILTER (WHERE method = 'vanilla'), 6) AS vanilla, round(max(value) FILTER (WHERE method = 'linear'), 6) AS linear, round(max(value) FILTER (WHERE method = 'other'), 6) AS other FROM long GROUP BY 1"
LONG = f"""WITH {LATEST}, scored AS (SELECT CASE WHEN method IN ('vanilla', 'linear') THEN method ELSE 'other' END AS method, avg(llm) FILTER (WHERE NOT isnan(llm)) AS llm, avg(contain) FILTER (WHERE NOT isnan(contain)) AS contain FROM flat GROUP BY 1),
long AS (SELECT method, 'llm_accuracy' AS metric, llm AS value FROM scored UNION ALL SELECT method, 'contain_accuracy', contain FROM scored)"""


def _pivot(t: Tables) -> DataFrame:
    known = F.when(F.col("method").isin("vanilla", "linear"), F.col("method")).otherwise("other")
    scores = E.accuracy(_latest(t, "method", "llm_accuracy", "contain_accuracy").withColumn("method", known), ["method"])
    long = scores.unpivot(["method"], ["llm_accuracy", "contain_accuracy"], "metric", "value")
    return long.groupBy("metric").pivot("method", ["vanilla", "linear", "other"]).agg(F.max("value"))


@query(f"{LONG} {PIVOT}")
def method_pivot(t: Tables) -> DataFrame:
    """One row per metric, one column for each of two methods and one for all others."""
    return _pivot(t).select("metric", *[F.round(m, 6).alias(m) for m in ("vanilla", "linear", "other")])


@query(f"{LONG}, wide AS ({PIVOT.replace('round(', '(').replace(', 6)', ')')}) SELECT metric, round(linear - vanilla, 6) AS linear_gain, round(other - vanilla, 6) AS other_gain FROM wide")
def method_differences(t: Tables) -> DataFrame:
    """Gains over the dense baseline."""
    return _pivot(t).select("metric", F.round(F.col("linear") - F.col("vanilla"), 6).alias("linear_gain"), F.round(F.col("other") - F.col("vanilla"), 6).alias("other_gain"))


PAIRED = f"""WITH {LATEST}, side AS (
  SELECT corpus_id, question_id, method, arg_max(struct_pack(idx := idx, pred := pred, contain := contain, llm := llm), prediction_id) AS v
  FROM flat WHERE corpus_id IS NOT NULL AND question_id IS NOT NULL GROUP BY 1, 2, 3),
pair AS (SELECT a.corpus_id, a.question_id, a.v AS a, b.v AS b FROM side a JOIN side b USING (corpus_id, question_id) WHERE a.method = 'vanilla' AND b.method = 'linear')"""


def _pairs(t: Tables) -> DataFrame:
    """Per question the last prediction of either method, side by side, by one aggregation instead of a self join."""
    rows = _latest(t, "corpus_id", "question_id", "method", "sorted_passage_idx", "pred_answer", "contain_accuracy", "llm_accuracy")
    value = F.struct(F.col("sorted_passage_idx").alias("idx"), F.col("pred_answer").alias("pred"), F.col("contain_accuracy").alias("contain"), F.col("llm_accuracy").alias("llm"))
    of = lambda m: F.max_by(F.when(F.col("method") == m, value), F.when(F.col("method") == m, F.col("prediction_id")))
    pairs = rows.filter(F.col("corpus_id").isNotNull() & F.col("question_id").isNotNull()).groupBy("corpus_id", "question_id").agg(of("vanilla").alias("a"), of("linear").alias("b"))
    return pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull())


@query(f"""{PAIRED} SELECT corpus_id, question_id, round(len(list_intersect(a.idx[1:5], b.idx[1:5])) / 5.0, 6) AS overlap, a.idx[1:5] IS DISTINCT FROM b.idx[1:5] AS reordered,
  a.pred IS DISTINCT FROM b.pred AS changed_answer FROM pair WHERE a.idx IS NOT NULL AND b.idx IS NOT NULL""")
def top5_overlap(t: Tables) -> DataFrame:
    """How far two methods' first five passages agree, question by question."""
    found = E.top_overlap(_pairs(t).filter(F.col("a.idx").isNotNull() & F.col("b.idx").isNotNull()), F.col("a.idx"), F.col("b.idx"))
    return found.select("corpus_id", "question_id", F.round("overlap", 6).alias("overlap"), (~F.col("top_a").eqNullSafe(F.col("top_b"))).alias("reordered"), (~F.col("a.pred").eqNullSafe(F.col("b.pred"))).alias("changed_answer"))


@query(f"""{PAIRED}, counts AS (SELECT corpus_id, count(*) FILTER (WHERE a.contain = 1 AND b.contain = 0) AS losses, count(*) FILTER (WHERE a.contain = 0 AND b.contain = 1) AS wins FROM pair GROUP BY 1)
SELECT corpus_id, wins, losses, round(least(1.0, 2 * coalesce(list_sum(list_transform(range(0, least(wins, losses) + 1),
  lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)))), 0)), 6) AS p FROM counts""")
def paired_discordant(t: Tables) -> DataFrame:
    """Questions that only one of two methods answers, by package, and the exact two-sided p."""
    a, b = F.col("a.contain"), F.col("b.contain")
    counts = _pairs(t).groupBy("corpus_id").agg(F.count_if((a == 0) & (b == 1)).alias("wins"), F.count_if((a == 1) & (b == 0)).alias("losses"))
    return counts.withColumn("p", F.round(E.two_sided_binomial(F.col("wins"), F.col("losses")), 6))


@query(f"""WITH {LATEST}, b AS (SELECT prediction_id, scores, list_filter(scores, lambda x: x IS NOT NULL AND NOT isnan(x)) AS known FROM flat WHERE scores IS NOT NULL)
SELECT prediction_id, list_transform(scores, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN NULL WHEN list_max(known) > list_min(known) THEN round((x - list_min(known)) / (list_max(known) - list_min(known)), 6) ELSE 1.0 END) AS scaled FROM b""")
def scaled_scores(t: Tables) -> DataFrame:
    """Each ranking's scores between 0 and 1."""
    rows = _latest(t, "sorted_passage_scores").filter(F.col("sorted_passage_scores").isNotNull())
    return K.scaled_scores(rows, "sorted_passage_scores").select("prediction_id", "scaled")


@query(f"""WITH {LATEST} SELECT method, count(*) AS n, count(*) FILTER (WHERE coalesce(len(idx) >= 5 AND len(idx) = len(scores)
  AND len(list_filter(scores, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(idx, lambda x: x IS NULL)) = 0, false)) AS n_complete FROM flat GROUP BY 1""")
def ranking_completeness(t: Tables) -> DataFrame:
    """Rankings that are long enough and finite, by method."""
    rows = _latest(t, "method", "sorted_passage_idx", "sorted_passage_scores")
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.count_if(K.is_complete("sorted_passage_idx", "sorted_passage_scores")).alias("n_complete"))


IDX = "SELECT DISTINCT corpus_id, passage_idx, text FROM corpus"
CORPUS = "corpus AS (SELECT corpus_id, passage_id, min(passage_idx) AS passage_idx, min(passage) AS text FROM passages WHERE passage IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH {LATEST}, {CORPUS}, ranked AS (SELECT prediction_id, corpus_id, gold, unnest(idx) AS passage_idx, generate_subscripts(idx, 1) AS rank FROM flat)
SELECT r.prediction_id, min(r.rank) AS first_rank, count(*) AS n_support, min(r.rank) <= 5 AS in_top5 FROM ranked r JOIN corpus c USING (corpus_id, passage_idx)
WHERE trim(r.gold, E' \\t\\r\\n') <> '' AND contains(lower(c.text), lower(r.gold)) GROUP BY 1""")
def support_ranks(t: Tables) -> DataFrame:
    """Where in each ranking the first passage stands that holds the gold answer, however short; blank ones are in none."""
    rows = _latest(t, "corpus_id", "gold_answer", "sorted_passage_idx").filter(F.btrim("gold_answer", F.lit(X.BLANKS)) != "")
    ranked = K.ranked_members(rows, "sorted_passage_idx", ["prediction_id", "corpus_id", "gold_answer"])
    held = ranked.join(corpus(t.passages).select("corpus_id", "passage_idx", "text"), ["corpus_id", "passage_idx"]).filter(F.contains(F.lower("text"), F.lower("gold_answer")))
    return held.groupBy("prediction_id").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n_support")).withColumn("in_top5", F.col("first_rank") <= 5)


@query(f"""WITH {LATEST}, {CORPUS}, ranked AS (SELECT DISTINCT corpus_id, unnest(idx) AS passage_idx FROM flat)
SELECT corpus_id, passage_idx FROM ranked WHERE passage_idx IS NOT NULL AND corpus_id IS NOT NULL AND (corpus_id, passage_idx) NOT IN (SELECT corpus_id, passage_idx FROM corpus WHERE passage_idx IS NOT NULL)""")
def foreign_ranked(t: Tables) -> DataFrame:
    """Ranked passages that the package doesn't hold: none if rankings are subsets of their corpus."""
    rows = _latest(t, "corpus_id", "sorted_passage_idx")
    ranked = rows.select("corpus_id", F.explode(F.array_distinct("sorted_passage_idx")).alias("passage_idx")).dropna().distinct()
    return ranked.join(corpus(t.passages).select("corpus_id", "passage_idx"), ["corpus_id", "passage_idx"], "left_anti")


@query(f"""WITH {LATEST}, runs AS (SELECT run_id, method, avg(contain) FILTER (WHERE NOT isnan(contain)) AS m FROM flat GROUP BY 1, 2)
SELECT method, count(*) AS n_runs, round(median(m), 6) AS median_contain FROM runs GROUP BY 1""")
def median_of_runs(t: Tables) -> DataFrame:
    """Median over runs of their mean accuracy."""
    runs = _latest(t, "run_id", "method", "contain_accuracy").groupBy("run_id", "method").agg(E.mean_known(F.col("contain_accuracy")).alias("m"))
    return runs.groupBy("method").agg(F.count("*").alias("n_runs"), F.round(F.median("m"), 6).alias("median_contain"))


@query(f"""WITH {LATEST}, {CORPUS}, ev AS (
  SELECT DISTINCT question_no, corpus_id, md5(s) AS statement FROM (SELECT question_no, corpus_id, unnest(evidence) AS s FROM questions) WHERE s IS NOT NULL AND trim(s) <> ''),
body AS (SELECT DISTINCT corpus_id, md5(trim(unnest(string_split_regex(regexp_replace(text, '^\\d+:', ''), '\\n+')))) AS statement FROM corpus)
SELECT question_no, count(*) AS n_statements, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM body b WHERE b.corpus_id = ev.corpus_id AND b.statement = ev.statement)) AS n_found FROM ev GROUP BY 1""")
def evidence_coverage(t: Tables) -> DataFrame:
    """Evidence statements of each question that stand as a line in a passage of its package."""
    said = t.questions.select("question_no", "corpus_id", F.explode("evidence").alias("s")).filter(F.col("s").isNotNull() & (F.trim("s") != ""))
    said = said.select("question_no", "corpus_id", F.md5(F.col("s").cast("binary")).alias("statement")).distinct()
    lines = corpus(t.passages).select("corpus_id", F.explode(F.split(X.chunk_of(F.col("text")), r"\n+")).alias("s")).select("corpus_id", F.md5(F.trim("s").cast("binary")).alias("statement"), F.lit(True).alias("there")).distinct()
    found = said.join(lines, ["corpus_id", "statement"], "left")
    return found.groupBy("question_no").agg(F.count("*").alias("n_statements"), F.count_if(F.col("there").isNotNull()).alias("n_found"))
