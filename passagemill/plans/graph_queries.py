"""Index, graph, propagation and retrieval over the packages' passages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import content_id
from passagemill.operators import corpus as C
from passagemill.operators import graph as G
from passagemill.operators import retrieval as R
from passagemill.operators.similarity import nearest
from passagemill.plans import fragments as S
from passagemill.plans.registry import Tables, query
from passagemill.session import cut

BASE = (S.CORPUS, S.MENTIONS)
RETRIEVAL = (*BASE, S.SENTENCES, S.QUESTIONS, S.EDGES, S.SEEDS, S.similarity("ssim", "sentence", "sentence_id", "sentence"), S.similarity("psim", "corpus", "passage_id", "text"))
ONLY_SEEDS = "active AS (SELECT *, 1 AS tier FROM start)"


def _vectors(t: Tables, every: int = 1) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows.filter(F.col("id") % every == 0)


NEAREST_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
"""


@query(NEAREST_SQL + """SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5""")
def dense_topk(t: Tables) -> DataFrame:
    """Dense retrieval: the five nearest vectors of each stated query."""
    return nearest(_vectors(t, 100), _vectors(t), k=5).withColumn("score", F.round("score", 6))


@query(NEAREST_SQL + "SELECT query_id, arg_max(id, score) AS id, round(max(score), 6) AS score FROM scored GROUP BY 1")
def seed_nearest_vector(t: Tables) -> DataFrame:
    """The nearest vector of each stated query, without a lower limit."""
    return nearest(_vectors(t, 100), _vectors(t), k=1).select("query_id", "id", F.round("score", 6).alias("score"))


@query(NEAREST_SQL + "SELECT query_id, id, round(score, 6) AS score FROM scored WHERE score >= 0.3")
def synonym_edges(t: Tables) -> DataFrame:
    """All vectors within a similarity of the stated queries."""
    return nearest(_vectors(t, 100), _vectors(t), least=0.3).withColumn("score", F.round("score", 6))


@query(S.clauses(*BASE) + "SELECT corpus_id, passage_id, entity, n FROM mention")
def entity_counts(t: Tables) -> DataFrame:
    """How often each entity occurs in each passage that mentions it."""
    return C.passage_mentions(C.corpus(t.passages))


@query(S.clauses(*BASE, S.EDGES) + "SELECT corpus_id, src, dst, round(weight, 6) AS weight FROM edge")
def edge_weights(t: Tables) -> DataFrame:
    """Weighted edges between passages and entities."""
    return G.entity_edges(C.passage_mentions(C.corpus(t.passages))).withColumn("weight", F.round("weight", 6))


@query(S.clauses(*BASE, S.EDGES) + "SELECT corpus_id, src, dst, weight FROM adjacent")
def adjacent_edges(t: Tables) -> DataFrame:
    """Edges between passages next to each other."""
    return G.adjacent_edges(C.corpus(t.passages))


@query(S.clauses(*BASE) + """SELECT DISTINCT corpus_id, 'entity-' || md5(entity) AS node_id, 'entity' AS kind FROM mention
UNION ALL SELECT corpus_id, passage_id, 'passage' FROM corpus""")
def graph_vertices(t: Tables) -> DataFrame:
    """Entities and passages as vertices."""
    rows = C.corpus(t.passages)
    return G.vertices(rows, C.passage_mentions(rows)).select("corpus_id", "node_id", "kind")


@query(S.clauses(*BASE, S.EDGES) + """SELECT corpus_id, kind, count(*) AS n_edges, round(sum(weight), 4) AS weight
FROM (SELECT * FROM edge UNION ALL SELECT * FROM adjacent) GROUP BY 1, 2""")
def graph_stats(t: Tables) -> DataFrame:
    """Edges of each kind by package."""
    rows = C.corpus(t.passages)
    edges = G.entity_edges(C.passage_mentions(rows)).withColumn("kind", F.lit("mention")).unionByName(G.adjacent_edges(rows).withColumn("kind", F.lit("adjacent")))
    return edges.groupBy("corpus_id", "kind").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 4).alias("weight"))


@query(S.clauses(*BASE, S.SENTENCES) + """SELECT corpus_id, entity, count(*) AS n_sentences,
(SELECT count(*) FROM mention m WHERE m.corpus_id = s.corpus_id AND m.entity = s.entity) AS n_passages FROM smention s GROUP BY corpus_id, entity""")
def entity_degrees(t: Tables) -> DataFrame:
    """Sentences and passages of each entity, from the mention relations in both directions."""
    rows = C.corpus(t.passages)
    in_sentences = C.sentence_mentions(C.sentences(rows)).groupBy("corpus_id", "entity").agg(F.count("*").alias("n_sentences"))
    in_passages = C.passage_mentions(rows).groupBy("corpus_id", "entity").agg(F.count("*").alias("n_passages"))
    return in_sentences.join(in_passages, ["corpus_id", "entity"], "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))


@query(S.clauses(*BASE, S.QUESTIONS, S.SEEDS) + "SELECT question_no, corpus_id, asked, entity, round(score, 6) AS score FROM seed")
def seed_entities(t: Tables) -> DataFrame:
    """The nearest entity of the package for each entity of a stated question."""
    asked = C.question_entities(C.stated_questions(t.questions))
    return R.seed_entities(asked, C.passage_mentions(C.corpus(t.passages))).withColumn("score", F.round("score", 6))


def _asked(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stated questions, and the passages and sentences of their packages; each is computed once."""
    asked = cut(C.stated_questions(t.questions))
    rows = cut(C.corpus(t.passages).join(asked.select("corpus_id").distinct(), "corpus_id", "left_semi"))
    return asked, rows, cut(C.sentences(rows))


def _propagated(t: Tables) -> R.Propagated:
    asked, rows, parts = _asked(t)
    seeds = R.seed_entities(C.question_entities(asked), C.passage_mentions(rows))
    return R.propagate(seeds, C.sentence_mentions(parts), R.overlap_similarity(asked, parts, "sentence_id", "sentence"))


@query(S.clauses(*RETRIEVAL, S.propagation()) + "SELECT question_no, entity, round(score, 6) AS score, CAST(tier AS INTEGER) AS tier FROM active")
def propagated_entities(t: Tables) -> DataFrame:
    """Active entities after two rounds of propagation."""
    return _propagated(t).active.select("question_no", "entity", F.round("score", 6).alias("score"), "tier")


@query(S.clauses(*RETRIEVAL, S.propagation()) + "SELECT question_no, entity, round(score, 6) AS weight FROM total")
def propagated_weights(t: Tables) -> DataFrame:
    """Entity weights summed over seeds and all rounds."""
    return _propagated(t).weights.select("question_no", "entity", F.round("score", 6).alias("weight"))


@query(S.clauses(*RETRIEVAL, S.propagation()) + """
SELECT question_no, round, sentence_id, round(w, 6) AS sentence_score, entity FROM (
  SELECT question_no, corpus_id, 1 AS round, sentence_id, w FROM pick1 UNION ALL SELECT question_no, corpus_id, 2, sentence_id, w FROM pick2)
JOIN smention USING (corpus_id, sentence_id) WHERE w > 0""")
def propagation_trace(t: Tables) -> DataFrame:
    """Which sentence reached which entity, round by round."""
    return _propagated(t).trace.select("question_no", "round", "sentence_id", F.round("sentence_score", 6).alias("sentence_score"), "entity")


def _prepared(t: Tables, expand: bool = True) -> R.Retrieval:
    asked, rows, parts = _asked(t)
    return R.prepare(asked, rows, C.passage_mentions(rows), parts, C.sentence_mentions(parts), C.question_entities(asked), expand)


TOP5 = """ROW_NUMBER() OVER (PARTITION BY question_no ORDER BY score DESC, passage_id)"""


@query(S.clauses(*RETRIEVAL, S.propagation(), S.priors()) + "SELECT question_no, passage_id, round(sim, 6) AS sim, round(prior, 6) AS prior FROM prior")
def passage_priors(t: Tables) -> DataFrame:
    """Prior of every passage of a stated question's package."""
    r = _prepared(t)
    return R.every_passage(r.questions, r.corpus, r.priors).select("question_no", "passage_id", F.round("sim", 6).alias("sim"), F.round("prior", 6).alias("prior"))


@query(S.clauses(*RETRIEVAL, S.propagation(), S.priors()) + f"""
SELECT question_no, passage_id, round(score, 6) AS score, rank FROM (
  SELECT question_no, passage_id, prior AS score, row_number() OVER (PARTITION BY question_no ORDER BY prior DESC, passage_id) AS rank FROM prior) WHERE rank <= 5""")
def ablation_no_pagerank(t: Tables) -> DataFrame:
    """Ranking by the prior alone."""
    r = _prepared(t)
    scores = R.every_passage(r.questions, r.corpus, r.priors).select("question_no", "passage_id", F.col("prior").alias("score"))
    return G.top_passages(scores).withColumn("score", F.round("score", 6))


@query(S.clauses(*RETRIEVAL, S.propagation(), S.priors(), S.pagerank("total"), recursive=True) + "SELECT question_no, passage_id, round(score, 6) AS score FROM rank")
def pagerank_passages(t: Tables) -> DataFrame:
    """Personalized PageRank of the passages for each stated question."""
    return R.rank_by_graph(_prepared(t)).withColumn("score", F.round("score", 6))


RETRIEVED = f"""
SELECT question_no, passage_id, round(score, 6) AS score, rank, path FROM (
  SELECT *, {TOP5} AS rank, 'graph' AS path FROM rank
  UNION ALL
  SELECT question_no, passage_id, sim, row_number() OVER (PARTITION BY question_no ORDER BY sim DESC, passage_id), 'dense'
  FROM prior WHERE question_no NOT IN (SELECT question_no FROM seed)) WHERE rank <= 5"""


@query(S.clauses(*RETRIEVAL, S.propagation(), S.priors(), S.pagerank("total"), recursive=True) + RETRIEVED)
def retrieve_graph(t: Tables) -> DataFrame:
    """The composed retrieval: graph ranks, and similarity for questions without seeds."""
    return R.retrieve(_prepared(t)).withColumn("score", F.round("score", 6))


@query(S.clauses(*RETRIEVAL, ONLY_SEEDS, S.priors(), S.pagerank("start"), recursive=True) + RETRIEVED)
def ablation_no_propagation(t: Tables) -> DataFrame:
    """The same without propagation: only seeds are active."""
    return R.retrieve(_prepared(t, expand=False)).withColumn("score", F.round("score", 6))


@query(S.clauses(*RETRIEVAL, S.propagation()) + """
SELECT a.question_no, (SELECT count(*) FROM start s WHERE s.question_no = a.question_no) AS n_seeds,
       (SELECT count(*) FROM active x WHERE x.question_no = a.question_no) AS n_active,
       (SELECT count(*) FROM active x WHERE x.question_no = a.question_no AND x.tier > 0) AS n_propagated,
       EXISTS (SELECT 1 FROM start s WHERE s.question_no = a.question_no) AS used_graph FROM asked a""")
def retrieval_diagnostics(t: Tables) -> DataFrame:
    """Seeds, active and propagated entities of each stated question."""
    asked, rows, parts = _asked(t)
    seeds = R.seed_entities(C.question_entities(asked), C.passage_mentions(rows))
    moved = R.propagate(seeds, C.sentence_mentions(parts), R.overlap_similarity(asked, parts, "sentence_id", "sentence"))
    n_seeds = R.start_scores(seeds).groupBy("question_no").agg(F.count("*").alias("n_seeds"))
    n_active = moved.active.groupBy("question_no").agg(F.count("*").alias("n_active"), F.count_if(F.col("tier") > 0).alias("n_propagated"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        asked.select("question_no").join(n_seeds, "question_no", "left").join(n_active, "question_no", "left")
        .select("question_no", zero("n_seeds"), zero("n_active"), zero("n_propagated"), F.col("n_seeds").isNotNull().alias("used_graph"))
    )


# The points of either factor; the other one stays at its base.
THRESHOLDS, WEIGHTS, BASE_WEIGHT = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), (0.01, 0.05, 0.1, 0.5, 1.0, 1.5, 2.0), 0.05


def _at_points(rows: DataFrame, n: int) -> DataFrame:
    """The rows once for each of n points: a question at a point is a question of its own, numbered question_no * n + point."""
    points = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point")
    return rows.select("*", points).withColumn("question_no", F.col("question_no") * n + F.col("point")).drop("point")


def _value(points: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, points)), (F.col("question_no") % len(points)).cast("int") + 1)


@query(" UNION ALL ".join(
    f"(SELECT CAST({d} AS DOUBLE) AS least, CAST({i} AS INTEGER) AS point, * FROM ({S.clauses(*RETRIEVAL, S.propagation(d))} SELECT count(*) AS n_active, count(DISTINCT question_no) AS n_questions FROM active))"
    for i, d in enumerate(THRESHOLDS)))
def threshold_grid(t: Tables) -> DataFrame:
    """One factor at a time: active entities for each value of the threshold, all values in one plan."""
    n = len(THRESHOLDS)
    asked, rows, said = _asked(t)
    seeds = R.seed_entities(C.question_entities(asked), C.passage_mentions(rows))
    similarity = R.overlap_similarity(asked, said, "sentence_id", "sentence")
    active = R.propagate(_at_points(seeds, n), C.sentence_mentions(said), _at_points(similarity, n), _value(THRESHOLDS)).active
    points = t.spark.createDataFrame(list(enumerate(THRESHOLDS)), "point int, least double")
    counts = active.groupBy((F.col("question_no") % n).cast("int").alias("point")).agg(F.count("*").alias("n_active"), F.count_distinct("question_no").alias("n_questions"))
    return points.join(counts, "point", "left").fillna(0, ["n_active", "n_questions"])


@query(" UNION ALL ".join(
    f"(SELECT CAST({w} AS DOUBLE) AS weight, CAST({i} AS INTEGER) AS point, * FROM ({S.clauses(*RETRIEVAL, S.propagation(), S.priors(weight=w), S.pagerank('total'), recursive=True)} "
    f"SELECT question_no, passage_id, round(score, 6) AS score, rank FROM (SELECT question_no, passage_id, score, {TOP5} AS rank FROM rank) WHERE rank <= 5))"
    for i, w in enumerate(WEIGHTS)))
def weight_grid(t: Tables) -> DataFrame:
    """The other factor: the five best passages for each weight of passages, all values in one plan."""
    n = len(WEIGHTS)
    r = _prepared(t)
    scaled = _at_points(r.priors, n).withColumn("prior", F.col("prior") * _value(WEIGHTS) / BASE_WEIGHT)
    moved = R.Propagated(_at_points(r.propagated.weights, n), r.propagated.active, r.propagated.trace)
    ranks = R.rank_by_graph(replace(r, seeds=_at_points(r.seeds, n), priors=cut(scaled), propagated=moved))
    best = G.top_passages(ranks).withColumns({"weight": _value(WEIGHTS), "point": (F.col("question_no") % n).cast("int")})
    return best.select("weight", "point", F.floor(F.col("question_no") / n).cast("bigint").alias("question_no"), "passage_id", F.round("score", 6).alias("score"), "rank")


NAMED = """
, named AS (SELECT DISTINCT q.question_no, q.corpus_id, q.entity AS name, m.entity AS found
  FROM asked_entity q LEFT JOIN (SELECT DISTINCT corpus_id, entity FROM mention) m ON q.corpus_id = m.corpus_id AND lower(m.entity) = q.entity)"""


def _named(t: Tables, mentions: DataFrame) -> DataFrame:
    """Names of stated questions with their node; a name that the package doesn't know has a null one."""
    asked = C.question_entities(C.stated_questions(t.questions))
    known = mentions.select("corpus_id", F.col("entity").alias("found"), F.lower("entity").alias("entity")).distinct()
    return asked.join(known, ["corpus_id", "entity"], "left").select("question_no", "corpus_id", F.col("entity").alias("name"), content_id("entity", F.col("found")).alias("node_id")).distinct()


@query(S.clauses(*BASE, S.QUESTIONS) + NAMED + "SELECT question_no, corpus_id, name, 'entity-' || md5(found) AS node_id FROM named")
def observed_nodes(t: Tables) -> DataFrame:
    """The names that stated questions ask for and their nodes, null where there is none."""
    return _named(t, C.passage_mentions(C.corpus(t.passages)))


@query(S.clauses(*BASE, S.QUESTIONS, S.EDGES) + """
, focus AS (SELECT DISTINCT question_no, corpus_id, 'entity-' || md5(entity) AS node FROM (
    SELECT q.question_no, q.corpus_id, m.entity FROM asked_entity q JOIN mention m ON q.corpus_id = m.corpus_id AND lower(m.entity) = q.entity))
SELECT f.question_no, e.src, e.dst, 'mention' AS kind, round(e.weight, 6) AS weight FROM focus f JOIN edge e ON e.corpus_id = f.corpus_id AND e.dst = f.node""")
def one_hop(t: Tables) -> DataFrame:
    """Edges at the entities that stated questions name."""
    rows = C.corpus(t.passages)
    mentions = C.passage_mentions(rows)
    named = C.question_entities(C.stated_questions(t.questions))
    focus = (
        named.join(mentions.select("corpus_id", F.col("entity").alias("name"), F.lower("entity").alias("entity")).distinct(), ["corpus_id", "entity"])
        .select("question_no", "corpus_id", F.concat(F.lit("entity-"), F.md5(F.col("name").cast("binary"))).alias("dst")).distinct()
    )
    return G.entity_edges(mentions).join(focus, ["corpus_id", "dst"]).select("question_no", "src", "dst", F.lit("mention").alias("kind"), F.round("weight", 6).alias("weight"))


TRIPLES = rf"""triple AS (
  SELECT corpus_id, sentence_id, names[i] AS subject, names[i + 1] AS object FROM (
    SELECT corpus_id, sentence_id, names, unnest(range(1, len(names))) AS i FROM (
      SELECT corpus_id, sentence_id, regexp_extract_all(sentence, '{C.NAME_PATTERN}') AS names FROM sentence) WHERE len(names) > 1))"""


@query(S.clauses(*BASE, S.SENTENCES, TRIPLES) + "SELECT corpus_id, sentence_id, subject, object FROM triple")
def open_triples(t: Tables) -> DataFrame:
    """Names that follow each other in a sentence, as subject and object."""
    return C.sentence_triples(C.sentences(C.corpus(t.passages)))


@query(S.clauses(*BASE, S.SENTENCES, S.QUESTIONS, S.SEEDS, TRIPLES, """
edge AS (SELECT corpus_id, passage_id AS src, 'entity-' || md5(entity) AS dst, CAST(n AS DOUBLE) AS weight FROM mention),
adjacent AS (SELECT corpus_id, 'entity-' || md5(subject) AS src, 'entity-' || md5(object) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM triple GROUP BY 1, 2, 3),
prior AS (SELECT question_no, corpus_id, NULL::VARCHAR AS passage_id, 0.0 AS prior FROM asked WHERE false)""",
S.pagerank("start"), recursive=True) + f"SELECT question_no, passage_id, round(score, 6) AS score, rank FROM (SELECT *, {TOP5} AS rank FROM rank) WHERE rank <= 5")
def phrase_graph_retrieve(t: Tables) -> DataFrame:
    """Retrieval over a graph of phrases: triples and mentions as edges, reset to the seeds, passages by their mass."""
    rows = cut(C.corpus(t.passages))
    mentions = cut(C.passage_mentions(rows))
    asked = C.stated_questions(t.questions)
    seeds = R.seed_entities(C.question_entities(asked), mentions)
    entity = lambda c: F.concat(F.lit("entity-"), F.md5(F.col(c).cast("binary")))
    links = C.sentence_triples(C.sentences(rows)).groupBy("corpus_id", entity("subject").alias("src"), entity("object").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    held = mentions.select("corpus_id", F.col("passage_id").alias("src"), entity("entity").alias("dst"), F.col("n").cast("double").alias("weight"))
    steps = G.transitions(held.unionByName(links).join(asked.select("corpus_id").distinct(), "corpus_id", "left_semi"))
    reset = G.reset_vector(R.start_scores(seeds).select("question_no", "corpus_id", entity("entity").alias("node_id"), F.col("score").alias("w")))
    ranks = G.personalized_pagerank(steps, reset, 0.5, 20).filter(F.col("n").startswith("passage-"))
    return G.top_passages(ranks.select("question_no", F.col("n").alias("passage_id"), F.col("x").alias("score"))).withColumn("score", F.round("score", 6))


@query()
def propagated_sequential(t: Tables) -> DataFrame:
    """Propagation entity after entity (no SQL: the order of turns can't be stated as one)."""
    asked, rows, parts = _asked(t)
    seeds = R.seed_entities(C.question_entities(asked), C.passage_mentions(rows))
    moved = R.propagate_sequential(seeds, C.sentence_mentions(parts), R.overlap_similarity(asked, parts, "sentence_id", "sentence"))
    return moved.active.select("question_no", "entity", F.round("score", 6).alias("score"), "tier")


@query(S.clauses(*BASE, S.SENTENCES, S.QUESTIONS, S.EDGES, TRIPLES) + NAMED + """
, link AS (
  SELECT corpus_id, src, dst, weight, 'unlabelled' AS kind FROM edge
  UNION ALL SELECT corpus_id, src, dst, weight, 'unlabelled' FROM adjacent
  UNION ALL SELECT corpus_id, 'entity-' || md5(subject), 'entity-' || md5(object), CAST(count(*) AS DOUBLE), 'relation' FROM triple WHERE subject <> object GROUP BY 1, 2, 3),
focus AS (SELECT DISTINCT question_no, corpus_id, 'entity-' || md5(found) AS node FROM named WHERE found IS NOT NULL)
SELECT DISTINCT f.question_no, l.src, l.dst, l.kind, round(l.weight, 6) AS weight FROM link l JOIN focus f ON f.corpus_id = l.corpus_id AND (l.src = f.node OR l.dst = f.node)""")
def observed_edges(t: Tables) -> DataFrame:
    """Edges of any kind with a focus node at either end: relations are labelled, mentions and neighbours aren't."""
    rows = C.corpus(t.passages)
    mentions = C.passage_mentions(rows)
    entity = lambda c: content_id("entity", F.col(c))
    relations = C.sentence_triples(C.sentences(rows)).filter("subject <> object").groupBy("corpus_id", entity("subject").alias("src"), entity("object").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    plain = G.entity_edges(mentions).unionByName(G.adjacent_edges(rows)).withColumn("kind", F.lit("unlabelled"))
    focus = _named(t, mentions).filter(F.col("node_id").isNotNull()).select("question_no", "corpus_id", "node_id").distinct()
    found = G.edges_at(plain.unionByName(relations.withColumn("kind", F.lit("relation"))), focus)
    return found.select("question_no", "src", "dst", "kind", F.round("weight", 6).alias("weight"))


@query(S.clauses(*BASE) + """, gram AS (
  SELECT corpus_id, entity, len(w) AS n, unnest(w) AS gram FROM (
    SELECT corpus_id, entity, list_distinct(list_transform(range(1, greatest(length(entity) - 2, 1) + 1), lambda i: substr(lower(entity), i, 3))) AS w
    FROM (SELECT DISTINCT corpus_id, entity FROM mention)))
SELECT a.corpus_id, a.entity AS first, b.entity AS second, round(count(*) / sqrt(CAST(a.n * b.n AS DOUBLE)), 6) AS score
FROM gram a JOIN gram b ON a.corpus_id = b.corpus_id AND a.gram = b.gram AND a.entity < b.entity GROUP BY a.corpus_id, a.entity, b.entity, a.n, b.n
HAVING count(*) >= 0.8 * sqrt(CAST(a.n * b.n AS DOUBLE)) - 1e-9""")
def synonym_names(t: Tables) -> DataFrame:
    """Pairs of distinct names of a package whose sets of trigrams have a cosine of 0.8 or more."""
    return R.similar_names(C.passage_mentions(C.corpus(t.passages)).select("corpus_id", "entity").distinct()).withColumn("score", F.round("score", 6))


@query(S.clauses(*BASE) + r"""SELECT 'passage' AS namespace, count(DISTINCT passage_id) AS n FROM corpus UNION ALL SELECT 'entity', count(DISTINCT md5(entity)) FROM mention""")
def store_counts(t: Tables) -> DataFrame:
    """Distinct texts of each namespace of the embedding store."""
    rows = C.corpus(t.passages)
    ids = rows.select("passage_id").unionByName(C.passage_mentions(rows).select(F.concat(F.lit("entity-"), F.md5(F.col("entity").cast("binary"))).alias("passage_id"))).distinct()
    return ids.groupBy(F.substring_index("passage_id", "-", 1).alias("namespace")).agg(F.count("*").alias("n"))
