"""Seeds, propagation over sentences, passage priors and the composed retrieval, for all stated questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import content_id, occurrences
from passagemill.functions.vectors import min_max
from passagemill.operators.corpus import tokens_in
from passagemill.operators.graph import adjacent_edges, entity_edges, personalized_pagerank, reset_vector, top_passages, transitions
from passagemill.session import cut


@dataclass(frozen=True)
class Propagated:
    """Node weights, active entities and the trace of a propagation."""

    weights: DataFrame
    active: DataFrame
    trace: DataFrame


def overlap_similarity(questions: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Cosine of token sets between a question and the texts of its package: question_no, corpus_id, key, sim.

    An equi-join on (corpus_id, token): texts that share no token have no row.
    """
    q = questions.select("question_no", "corpus_id", tokens_in(F.col("question")).alias("t"))
    q = q.select("question_no", "corpus_id", F.size("t").alias("nq"), F.explode("t").alias("token"))
    p = texts.select("corpus_id", key, tokens_in(F.col(text)).alias("t"))
    p = p.select("corpus_id", key, F.size("t").alias("np"), F.explode("t").alias("token"))
    shared = q.join(p, ["corpus_id", "token"]).groupBy("question_no", "corpus_id", key, "nq", "np").agg(F.count("*").alias("n"))
    return shared.select("question_no", "corpus_id", key, (F.col("n") / F.sqrt(F.col("nq") * F.col("np"))).alias("sim"))


def trigrams(name: Column) -> Column:
    """Distinct runs of three signs of a name in lower case."""
    low = F.lower(name)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3)))
    return F.array_distinct(runs)


def seed_entities(question_entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """For each question entity the nearest entity of the package: question_no, corpus_id, asked, entity, score.

    Nearness is the cosine of the names' sets of letter trigrams, without a lower limit; ties go to the entity that
    sorts first. It is found by an equi-join on (corpus_id, trigram). A name that shares no trigram with any has no seed.
    """
    q = question_entities.select("question_no", "corpus_id", F.col("entity").alias("asked"), trigrams(F.col("entity")).alias("t"))
    q = q.select("question_no", "corpus_id", "asked", F.size("t").alias("nq"), F.explode("t").alias("gram"))
    e = mentions.select("corpus_id", "entity").distinct().select("corpus_id", "entity", trigrams(F.col("entity")).alias("t"))
    e = e.select("corpus_id", "entity", F.size("t").alias("ne"), F.explode("t").alias("gram"))
    shared = q.join(e, ["corpus_id", "gram"]).groupBy("question_no", "corpus_id", "asked", "entity", "nq", "ne").agg(F.count("*").alias("n"))
    scored = shared.withColumn("score", F.col("n") / F.sqrt(F.col("nq") * F.col("ne")))
    best = Window.partitionBy("question_no", "corpus_id", "asked").orderBy(F.desc("score"), "entity")
    return scored.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("question_no", "corpus_id", "asked", "entity", "score")


def similar_names(names: DataFrame, least: float = 0.8) -> DataFrame:
    """corpus_id, first, second, score: pairs of names of a package with a trigram cosine of at least ``least``.

    Two such sets share at least least^2 of the larger one, so each name is looked up by its rarest trigrams only, as
    many as it could have without sharing one: pairs of names that merely share common trigrams never meet.
    """
    grams = names.select("corpus_id", "entity", trigrams(F.col("entity")).alias("t")).select("corpus_id", "entity", "t", F.size("t").alias("n"), F.explode("t").alias("gram"))
    df = grams.groupBy("corpus_id", "gram").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("corpus_id", "entity").orderBy("df", "gram")
    prefix = (
        grams.join(df, ["corpus_id", "gram"]).withColumn("nth", F.row_number().over(rare))
        .filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * (least * least) - 1e-9) + 1)
        .select("corpus_id", "gram", "entity", "t", "n")
    )
    prefix = cut(prefix)
    other = prefix.select("corpus_id", "gram", F.col("entity").alias("second"), F.col("t").alias("t2"), F.col("n").alias("n2"))
    near = (F.col("entity") < F.col("second")) & (F.col("n") >= F.col("n2") * (least * least) - 1e-9) & (F.col("n2") >= F.col("n") * (least * least) - 1e-9)
    pairs = prefix.join(other, ["corpus_id", "gram"]).filter(near).dropDuplicates(["corpus_id", "entity", "second"])
    shared = F.size(F.array_intersect("t", "t2"))
    root = F.sqrt((F.col("n") * F.col("n2")).cast("double"))
    return pairs.filter(shared >= least * root - 1e-9).select("corpus_id", F.col("entity").alias("first"), "second", (shared / root).alias("score"))


def start_scores(seeds: DataFrame) -> DataFrame:
    """One row per question and seed: several question entities with one seed count by the largest score."""
    return seeds.groupBy("question_no", "corpus_id", "entity").agg(F.max("score").alias("score"))


def propagate(seeds: DataFrame, mentions: DataFrame, similarity: DataFrame, least: float | Column = 0.05, top_sentences: int = 3, rounds: int = 2) -> Propagated:
    """Set-based propagation from entities over their sentences to entities.

    ``mentions``: corpus_id, sentence_id, entity; ``similarity``: question_no, corpus_id, sentence_id, sim. In each
    round, entities of at least ``least`` pick their most similar unused sentences; a picked sentence passes the sum
    of its entities' scores times its similarity to each of its entities. Picked sentences are used up for the question.
    """
    keys = ["question_no", "corpus_id"]
    mentions, similarity = cut(mentions), cut(similarity)
    frontier = total = cut(start_scores(seeds))
    active = frontier.withColumn("tier", F.lit(0))
    used = trace = None
    for t in range(1, rounds + 1):
        frontier = frontier.filter((F.col("score") >= least) & (F.col("score") > 0))
        reach = frontier.join(mentions, ["corpus_id", "entity"])
        if used is not None:
            reach = reach.join(used, [*keys, "sentence_id"], "left_anti")
        reach = cut(reach.join(similarity, [*keys, "sentence_id"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0))))
        best = Window.partitionBy(*keys, "entity").orderBy(F.desc("sim"), "sentence_id")
        chosen = reach.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= top_sentences).select(*keys, "sentence_id").distinct()
        sums = reach.join(chosen, [*keys, "sentence_id"], "left_semi").groupBy(*keys, "sentence_id").agg(F.sum("score").alias("act"), F.max("sim").alias("sim"))
        picked = cut(sums.select(*keys, "sentence_id", (F.col("act") * F.col("sim")).alias("w")))
        used = picked.select(*keys, "sentence_id") if used is None else used.unionByName(picked.select(*keys, "sentence_id"))
        passed = picked.filter(F.col("w") > 0).join(mentions, ["corpus_id", "sentence_id"])
        step = passed.select(*keys, F.lit(t).alias("round"), "sentence_id", F.col("w").alias("sentence_score"), "entity")
        trace = step if trace is None else trace.unionByName(step)
        gained = cut(passed.groupBy(*keys, "entity").agg(F.sum("w").alias("score")))
        total = total.unionByName(gained).groupBy(*keys, "entity").agg(F.sum("score").alias("score"))
        now = gained.filter(F.col("score") >= least).withColumn("tier", F.lit(t))
        active = active.join(now, [*keys, "entity"], "left_anti").unionByName(now)
        frontier = gained.filter(F.col("score") > 0)
    return Propagated(total, active, trace)


def propagate_sequential(seeds: DataFrame, mentions: DataFrame, similarity: DataFrame, least: float = 0.05, top_sentences: int = 3, rounds: int = 2) -> Propagated:
    """Propagation entity after entity: a sentence that one entity has used is gone for those after it.

    The order is fixed here: entities by score down and name, sentences by similarity down and id, a sentence's
    entities by name. A contribution, the entity's score times the similarity, below ``least`` is dropped; weights add
    up, while score and tier of an entity are those of its last contribution. Seeds have tier 1.
    An entity can lose at most ``top_sentences`` choices to each entity before it, so its best
    ``top_sentences`` x (entities of the frontier) sentences are all that is sent to the question's task.
    """
    keys = ["question_no", "corpus_id"]
    mentions, similarity = cut(mentions), cut(similarity)
    frontier = weights = cut(start_scores(seeds))
    active = frontier.withColumn("tier", F.lit(1))
    used = trace = None
    for t in range(1, rounds + 1):
        frontier = frontier.filter(F.col("score") >= least)
        reach = frontier.join(mentions, ["corpus_id", "entity"])
        if used is not None:
            reach = reach.join(used, [*keys, "sentence_id"], "left_anti")
        reach = reach.join(similarity, [*keys, "sentence_id"]).filter(F.col("sim") * F.col("score") >= least)
        size = frontier.groupBy(*keys).agg(F.count("*").alias("n"))
        best = Window.partitionBy(*keys, "entity").orderBy(F.desc("sim"), "sentence_id")
        near = reach.join(size, keys).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= F.col("n") * top_sentences)
        picked = cut(near.select(*keys, "entity", "score", "sentence_id", "sim").groupBy(*keys).applyInPandas(_take_turns(top_sentences), _PICKS))
        now_used = picked.select(*keys, "sentence_id")
        used = now_used if used is None else used.unionByName(now_used)
        given = picked.withColumnRenamed("entity", "source").join(mentions, ["corpus_id", "sentence_id"])
        step = given.select(*keys, F.lit(t).alias("round"), "turn", "sentence_id", F.col("gives").alias("sentence_score"), "source", "entity")
        trace = step if trace is None else trace.unionByName(step)
        gained = cut(given.groupBy(*keys, "entity").agg(F.sum("gives").alias("total"), F.max_by("gives", "turn").alias("score")))
        weights = weights.unionByName(gained.select(*keys, "entity", F.col("total").alias("score"))).groupBy(*keys, "entity").agg(F.sum("score").alias("score"))
        frontier = gained.select(*keys, "entity", "score")
        active = active.join(frontier, [*keys, "entity"], "left_anti").unionByName(frontier.withColumn("tier", F.lit(t + 1)))
    return Propagated(weights, active, trace)


_PICKS = "question_no bigint, corpus_id string, entity string, sentence_id string, gives double, turn int"


def _take_turns(top: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Lets each entity of a question take its best unused sentences, in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "entity", "sim", "sentence_id"], ascending=[False, True, False, True], kind="stable")
        gone, out = set(), []
        for _, own in rows.groupby("entity", sort=False):
            taken = [r for r in own.itertuples() if r.sentence_id not in gone][:top]
            for r in taken:
                gone.add(r.sentence_id)
                out.append((r.question_no, r.corpus_id, r.entity, r.sentence_id, r.score * r.sim, len(out)))
        return pd.DataFrame(out, columns=["question_no", "corpus_id", "entity", "sentence_id", "gives", "turn"])

    return run


def _around_blanks(text: Column) -> Column:
    """All places of a text with a blank between two signs on either side, overlapping ones too."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?=(\S\S \S\S))"), F.lit(1)))


def names_inside(corpus_rows: DataFrame, names: DataFrame) -> DataFrame:
    """corpus_id, passage_id, entity, n: which names (corpus_id, entity) occur in which passages, in lower case.

    Names and passages meet on what stands around a name's first blank, so a passage is only searched for names that
    share such a place with it; names without one are searched in all passages of their package.
    """
    keyed = names.select("corpus_id", "entity", F.lower("entity").alias("low")).withColumn("around", F.nullif(F.regexp_extract("low", r"(\S\S \S\S)", 1), F.lit("")))
    texts = corpus_rows.select("corpus_id", "passage_id", F.lower("text").alias("text"))
    places = texts.select("corpus_id", "passage_id", F.explode(_around_blanks(F.col("text"))).alias("around"))
    pairs = places.join(keyed.filter(F.col("around").isNotNull()), ["corpus_id", "around"]).select("corpus_id", "passage_id", "entity", "low")
    rest = texts.select("corpus_id", "passage_id").join(keyed.filter(F.col("around").isNull()), "corpus_id").select("corpus_id", "passage_id", "entity", "low")
    found = texts.join(pairs.unionByName(rest), ["corpus_id", "passage_id"]).filter(F.contains("text", "low"))
    return found.select("corpus_id", "passage_id", "entity", occurrences(F.col("text"), F.col("low")).alias("n"))


def sparse_priors(
    questions: DataFrame, corpus_rows: DataFrame, similarity: DataFrame, active: DataFrame, ratio: float = 2.0, node_weight: float = 0.05
) -> DataFrame:
    """The priors of ``passage_priors`` that aren't 0: passages with similarity or bonus.

    The least similarity of a package is 0 unless all of its passages have one, so a passage without similarity is
    scaled to 0. Only where all passages are alike, which makes each of them 1, has a question a row for each.
    """
    keys = ["question_no", "corpus_id"]
    sizes = corpus_rows.groupBy("corpus_id").agg(F.count("*").alias("n_all"))
    known = similarity.groupBy(*keys).agg(F.count("*").alias("n"), F.min("sim").alias("least"), F.max("sim").alias("high"))
    bounds = questions.select(*keys).join(sizes, "corpus_id").join(known, keys, "left").withColumn("high", F.coalesce("high", F.lit(0.0)))
    bounds = cut(bounds.select(*keys, F.when(F.col("n") == F.col("n_all"), F.col("least")).otherwise(0.0).alias("low"), "high"))
    alike = F.col("low") == F.col("high")
    scaled = similarity.select(*keys, "passage_id", "sim").join(bounds.filter(~alike), keys).select(*keys, "passage_id", "sim", min_max(F.col("sim"), F.col("low"), F.col("high")).alias("part"))
    flat = bounds.filter(alike).join(corpus_rows.select("corpus_id", "passage_id"), "corpus_id").select(*keys, "passage_id", F.col("low").alias("sim"), F.lit(1.0).alias("part"))
    inside = names_inside(corpus_rows, active.select("corpus_id", "entity").distinct())
    gain = F.col("score") * F.log1p("n") / F.greatest(F.col("tier"), F.lit(1))
    bonus = active.join(inside, ["corpus_id", "entity"]).groupBy(*keys, "passage_id").agg(F.sum(gain).alias("bonus"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    prior = (F.lit(ratio) * zero("part") + F.log1p(zero("bonus"))) * node_weight
    both = scaled.unionByName(flat).join(bonus, [*keys, "passage_id"], "full_outer")
    return both.select(*keys, "passage_id", zero("sim").alias("sim"), prior.alias("prior"))


def passage_priors(
    questions: DataFrame, corpus_rows: DataFrame, similarity: DataFrame, active: DataFrame, ratio: float = 2.0, node_weight: float = 0.05
) -> DataFrame:
    """Prior of every passage of a question's package: (ratio * scaled similarity + ln(1 + bonus)) * node_weight.

    The bonus sums, over active entities that occur in the passage in lower case, score * ln(1 + count) / max(tier, 1).
    """
    return every_passage(questions, corpus_rows, sparse_priors(questions, corpus_rows, similarity, active, ratio, node_weight))


def every_passage(questions: DataFrame, corpus_rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Sparse priors with a row of zeros for each other passage of a question's package."""
    every = questions.select("question_no", "corpus_id").join(corpus_rows.select("corpus_id", "passage_id"), "corpus_id")
    return every.join(priors, ["question_no", "corpus_id", "passage_id"], "left").fillna(0.0, ["sim", "prior"])


@dataclass(frozen=True)
class Retrieval:
    """All relations of one retrieval, for its ablations and diagnostics. The priors are the sparse ones."""

    questions: DataFrame
    corpus: DataFrame
    seeds: DataFrame
    propagated: Propagated
    priors: DataFrame
    steps: DataFrame


def prepare(questions: DataFrame, corpus_rows: DataFrame, passage_mentions: DataFrame, sentence_rows: DataFrame, sentence_mentions: DataFrame, asked: DataFrame, expand: bool = True, least: float = 0.05) -> Retrieval:
    """Everything up to the ranking. Without ``expand`` only the seeds are active."""
    corpus_rows, passage_mentions = cut(corpus_rows), cut(passage_mentions)
    seeds = cut(seed_entities(asked, passage_mentions))
    if expand:
        moved = propagate(seeds, sentence_mentions, overlap_similarity(questions, sentence_rows, "sentence_id", "sentence"), least)
    else:
        start = start_scores(seeds)
        moved = Propagated(start, start.withColumn("tier", F.lit(1)), start)
    similarity = overlap_similarity(questions, corpus_rows, "passage_id", "text")
    priors = cut(sparse_priors(questions, corpus_rows, cut(similarity), cut(moved.active)))
    edges = entity_edges(passage_mentions).unionByName(adjacent_edges(corpus_rows))
    return Retrieval(questions, corpus_rows, seeds, moved, priors, transitions(edges))


def rank_by_graph(r: Retrieval, damping: float = 0.5, iterations: int = 20) -> DataFrame:
    """PageRank mass of passages, personalized by entity weights and passage priors: question_no, passage_id, score."""
    seeded = r.seeds.select("question_no").distinct()
    entities = r.propagated.weights.select("question_no", "corpus_id", content_id("entity", F.col("entity")).alias("node_id"), F.col("score").alias("w"))
    passages = r.priors.join(seeded, "question_no", "left_semi").select("question_no", "corpus_id", F.col("passage_id").alias("node_id"), F.col("prior").alias("w"))
    ranks = personalized_pagerank(r.steps, reset_vector(entities.unionByName(passages)), damping, iterations)
    return ranks.filter(F.col("n").startswith("passage-")).select("question_no", F.col("n").alias("passage_id"), F.col("x").alias("score"))


def retrieve(r: Retrieval, k: int = 5, damping: float = 0.5, iterations: int = 20) -> DataFrame:
    """The k best passages of each question and the path they came by.

    Questions with seeds are ranked by the graph, the others by similarity alone; the two scores can't be compared.
    """
    graph = top_passages(rank_by_graph(r, damping, iterations), k).withColumn("path", F.lit("graph"))
    unseeded = r.questions.select("question_no", "corpus_id").join(r.seeds.select("question_no").distinct(), "question_no", "left_anti")
    similar = r.priors.join(unseeded.select("question_no"), "question_no", "left_semi").select("question_no", "passage_id", F.col("sim").alias("score"))
    # where fewer than k passages have a similarity, those without are ranked by id: the first 2k are enough
    by_id = Window.partitionBy("corpus_id").orderBy("passage_id")
    first = r.corpus.select("corpus_id", "passage_id", F.row_number().over(by_id).alias("nth")).filter(F.col("nth") <= 2 * k)
    others = unseeded.join(first, "corpus_id").select("question_no", "passage_id").join(similar, ["question_no", "passage_id"], "left_anti").withColumn("score", F.lit(0.0))
    return graph.unionByName(top_passages(similar.unionByName(others), k).withColumn("path", F.lit("dense")))
