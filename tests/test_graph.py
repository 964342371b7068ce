import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import corpus as C
from passagemill.operators import graph as G
from passagemill.operators import retrieval as R
from passagemill.operators.similarity import nearest

# A question that needs two passages, and one beside it.
PASSAGES = [
    "0:Queen Beatrice married Frederick Barbarossa in 1156.",
    "1:Frederick Barbarossa ruled the Holy Empire of Germany.",
    "2:Paris Town is the capital of France. Nobody met Marie Claire there.",
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [("c", f"passage-{i}", i, p) for i, p in enumerate(PASSAGES)]
    return spark.createDataFrame(data, "corpus_id string, passage_id string, passage_idx bigint, text string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(100, "c", "Which empire did the husband of Queen Beatrice rule?"), (200, "c", "which river is longest of germany?")], "question_no bigint, corpus_id string, question string")


def test_edges_of_a_passage_sum_to_one(rows):
    edges = G.entity_edges(C.passage_mentions(rows)).groupBy("src").agg(F.sum("weight").alias("w")).collect()
    assert len(edges) == 3 and all(abs(e.w - 1) < 1e-12 for e in edges)


def test_neighbours_by_number_across_gaps(spark):
    data = [("c", "p7", "7:x"), ("c", "p3", "3:x"), ("c", "p10", "10:x"), ("c", "q", "no number"), ("d", "p8", "8:x")]
    edges = G.adjacent_edges(spark.createDataFrame(data, "corpus_id string, passage_id string, text string")).collect()
    assert {(e.src, e.dst) for e in edges} == {("p3", "p7"), ("p7", "p10")}


def _dense_pagerank(edges, reset, d, n_steps):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | set(reset))
    at = {x: i for i, x in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, x in edges:
        if a != b:
            w[at[a], at[b]] += x
            w[at[b], at[a]] += x
    p = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    r = np.array([max(reset.get(x, 0), 0) for x in nodes])
    r /= r.sum()
    x = r.copy()
    for _ in range(n_steps):
        x = d * (x @ p) + (1 - d) * r
    return dict(zip(nodes, x))


def test_pagerank_agrees_with_dense_algebra(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "c", 9.0), ("a", "c", 0.5), ("a", "b", 1.0)]
    frame = spark.createDataFrame([("k", *e) for e in edges], "corpus_id string, src string, dst string, weight double")
    weights = spark.createDataFrame([(1, "k", "a", 2.0), (1, "k", "b", float("nan")), (1, "k", "c", -1.0), (1, "k", "a", 1.0), (2, "k", "c", 1.0)], "question_no bigint, corpus_id string, node_id string, w double")
    ranks = G.personalized_pagerank(G.transitions(frame), G.reset_vector(weights), 0.5, 12).collect()
    for q, reset in ((1, {"a": 3.0}), (2, {"c": 1.0})):
        got = {r.n: r.x for r in ranks if r.question_no == q}
        want = _dense_pagerank(edges, reset, 0.5, 12)
        assert abs(sum(got.values()) - 1) < 1e-9
        assert all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_retrieval_over_two_hops(spark, rows, questions):
    parts = C.sentences(rows)
    prepared = R.prepare(questions, rows, C.passage_mentions(rows), parts, C.sentence_mentions(parts), C.question_entities(questions), least=0.01)
    seeds = {r.entity for r in prepared.seeds.collect()}
    assert "Queen Beatrice" in seeds
    active = {r.entity for r in prepared.propagated.active.collect() if r.question_no == 100}
    assert "Frederick Barbarossa" in active
    found = R.retrieve(prepared, 3).collect()
    graph = [r.passage_id for r in sorted(found, key=lambda r: r["rank"]) if r.question_no == 100]
    assert set(graph[:2]) == {"passage-0", "passage-1"} and {r.path for r in found if r.question_no == 100} == {"graph"}
    assert {r.path for r in found if r.question_no == 200} == {"dense"}


def test_two_entities_with_one_seed_count_by_the_larger(spark):
    seeds = spark.createDataFrame([(1, "c", "x", "E", 0.4), (1, "c", "y", "E", 0.9)], "question_no bigint, corpus_id string, asked string, entity string, score double")
    assert R.start_scores(seeds).collect()[0].score == 0.9


def _propagation_tables(spark):
    seeds = spark.createDataFrame([(1, "c", "a", "A", 1.0), (1, "c", "b", "B", 0.8)], "question_no bigint, corpus_id string, asked string, entity string, score double")
    mentions = spark.createDataFrame([("c", "s1", e) for e in "ABX"] + [("c", "s2", e) for e in "BY"], "corpus_id string, sentence_id string, entity string")
    similarity = spark.createDataFrame([(1, "c", "s1", 0.5), (1, "c", "s2", 0.4)], "question_no bigint, corpus_id string, sentence_id string, sim double")
    return seeds, mentions, similarity


def test_parallel_and_sequential_propagation_differ_on_a_shared_sentence(spark):
    tables = _propagation_tables(spark)
    parallel = R.propagate(*tables, least=0.01, top_sentences=1, rounds=1)
    got = {r.entity: r.score for r in parallel.active.collect()}
    assert math.isclose(got["X"], 0.9) and "Y" not in got  # both pick s1, and their scores add up
    sequential = R.propagate_sequential(*tables, least=0.01, top_sentences=1, rounds=1)
    got = {r.entity: (r.score, r.tier) for r in sequential.active.collect()}
    assert got["X"] == (0.5, 2) and math.isclose(got["Y"][0], 0.32)  # A takes s1, B is left with s2
    assert math.isclose({r.entity: r.score for r in sequential.weights.collect()}["B"], 0.8 + 0.5 + 0.32)


def test_higher_thresholds_activate_no_more(spark):
    tables = _propagation_tables(spark)
    counts = [R.propagate(*tables, least=x, top_sentences=2, rounds=2).active.count() for x in (0.01, 0.3, 2.0)]
    assert counts == sorted(counts, reverse=True)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 8))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id bigint, v array<double>")
    got = nearest(frame.filter("id % 100 = 0"), frame, k=3).collect()
    for q in range(0, 700, 100):
        scores = v @ v[q]
        scores[q] = -np.inf
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-scores)[:3].tolist()
    assert nearest(frame.filter("false"), frame, k=3).count() == 0


def test_empty_tables(spark, rows, questions):
    none = rows.filter("false")
    assert G.entity_edges(C.passage_mentions(none)).count() == 0
    parts = C.sentences(none)
    prepared = R.prepare(questions, none, C.passage_mentions(none), parts, C.sentence_mentions(parts), C.question_entities(questions))
    assert R.retrieve(prepared).count() == 0


def test_similar_names_against_all_pairs(spark):
    import random

    from passagemill.operators.retrieval import similar_names

    pick = random.Random(4)
    base = ["Alda Morvale", "Brenna Castor", "Corin Delamere"]
    names = set(base)
    while len(names) < 80:
        name = list(pick.choice(base))
        for _ in range(pick.randint(1, 2)):
            name[pick.randrange(len(name))] = pick.choice("aeiorst")
        names.add("".join(name))
    rows = spark.createDataFrame([(c, n) for n in sorted(names) for c in "xy"] + [("x", ""), ("x", "ab")], "corpus_id string, entity string")
    grams = lambda n: {n.lower()[i : i + 3] for i in range(max(len(n) - 2, 1))}
    want = {(c, a, b) for c in "xy" for a in names for b in names if a < b and len(grams(a) & grams(b)) >= 0.8 * (len(grams(a)) * len(grams(b))) ** 0.5 - 1e-9}
    got = similar_names(rows).collect()
    assert {(r.corpus_id, r.first, r.second) for r in got} == want and len(got) == len(want) > 10
    assert similar_names(rows.filter("false")).count() == 0


def test_names_inside_passages_by_index(spark):
    from passagemill.operators.retrieval import names_inside

    texts = ["0:Ada Vale and XAda Valery met ada vale.", "1:ada  vale", "2:Bo Li", "3:", "4:Ann"]
    rows = spark.createDataFrame([("c", f"p{i}", t) for i, t in enumerate(texts)], "corpus_id string, passage_id string, text string")
    names = spark.createDataFrame([("c", n) for n in ("Ada Vale", "Bo Li", "Ann", "Cy Dun")], "corpus_id string, entity string")
    got = {(r.passage_id, r.entity): r.n for r in names_inside(rows, names).collect()}
    assert got == {(f"p{i}", n): t.lower().count(n.lower()) for i, t in enumerate(texts) for n in ("Ada Vale", "Bo Li", "Ann", "Cy Dun") if n.lower() in t.lower()}


def test_edges_at_either_end_count_once(spark):
    from passagemill.operators.graph import edges_at

    edges = spark.createDataFrame([("c", "a", "b", 1.0), ("c", "b", "d", 2.0), ("c", "d", "e", 3.0)], "corpus_id string, src string, dst string, weight double")
    focus = spark.createDataFrame([(1, "c", "a"), (1, "c", "b"), (2, "c", "d")], "question_no bigint, corpus_id string, node_id string")
    assert sorted((r.question_no, r.src, r.dst) for r in edges_at(edges, focus).collect()) == [(1, "a", "b"), (1, "b", "d"), (2, "b", "d"), (2, "d", "e")]


def test_nearest_in_pairs_of_blocks(spark, monkeypatch):
    import numpy as np

    from passagemill.operators import similarity as S

    pick = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, pick.normal(size=4).tolist()) for i in range(60)] + [(99, None)], "id bigint, v array<double>")
    queries = vectors.filter("id % 7 = 0")
    want = sorted(map(tuple, S.nearest(queries, vectors, k=3).collect()))
    monkeypatch.setattr(S, "SENT_BYTES", 0), monkeypatch.setattr(S, "QUERY_BLOCK", 3), monkeypatch.setattr(S, "ROW_BLOCK", 7)
    got = sorted(map(tuple, S.nearest(queries, vectors, k=3).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert S.nearest(queries.filter("false"), vectors, k=3).count() == 0
