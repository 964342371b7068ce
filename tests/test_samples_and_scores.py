from math import comb

from pyspark.sql import functions as F

from passagemill.operators import evaluation as E
from passagemill.operators import packages as B
from passagemill.operators import ranking as K
from passagemill.operators import sampling as P
from passagemill.operators.tfidf import query_weights, weights


def test_samples_repeat_and_nest(spark):
    rows = spark.range(200).withColumn("kind", F.col("id") % 3)
    a = {r.id for r in P.simple_sample(rows, 10, "s", "id").collect()}
    b = {r.id for r in P.simple_sample(rows.repartition(5), 20, "s", "id").collect()}
    assert len(a) == 10 and a < b
    strata = P.stratified_sample(rows, 4, "s", "id", ["kind"]).collect()
    assert len(strata) == 12 and {r.kind for r in strata} == {0, 1, 2}
    assert P.mersenne_positions(50, 5, "42:x") == P.mersenne_positions(50, 5, "42:x")
    order = [r.id for r in P.shuffled(rows, "s", "id", ["kind"]).filter("kind = 0").orderBy("position").collect()]
    assert sorted(order) == list(range(0, 200, 3)) and order != sorted(order)


def test_token_prefix_cuts_the_last_chunk(spark):
    rows = spark.createDataFrame([("c", i, 4) for i in range(3)], "corpus_id string, pos int, tokens int")
    got = [r.kept_tokens for r in P.token_prefix(rows, "pos", "tokens", 10, ["corpus_id"]).orderBy("pos").collect()]
    assert got == [4, 4, 2]
    short = P.token_prefix(rows, "pos", "tokens", 13, ["corpus_id"]).collect()
    assert [r.kept_tokens for r in short] == [4, 4, 4] and all(r.short for r in short)


def test_scores_leave_nan_out(spark):
    rows = spark.createDataFrame([("m", 1.0, 0.0), ("m", float("nan"), 1.0), ("m", None, 1.0), ("x", float("nan"), None)], "method string, llm_accuracy double, contain_accuracy double")
    got = {r.method: r for r in E.accuracy(rows, ["method"]).collect()}
    assert (got["m"].n, got["m"].n_invalid, got["m"].llm_accuracy) == (3, 2, 1.0)
    assert got["x"].llm_accuracy is None and got["x"].average_accuracy is None


def test_exact_two_sided_p(spark):
    pairs = [(0, 0), (1, 9), (5, 5), (30, 70), (0, 12), (14, 16), (21, 20), (480, 520), (2000, 2100)]
    rows = spark.createDataFrame(pairs, "w bigint, l bigint").select("w", "l", E.two_sided_binomial(F.col("w"), F.col("l")).alias("p")).collect()
    for r in rows:
        n, k = r.w + r.l, min(r.w, r.l)
        want = min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
        assert abs(r.p - want) < 1e-9


def test_rankings(spark):
    rows = spark.createDataFrame([(1, [4, None, 6], [2.0, float("nan"), 4.0]), (2, [1], [3.0]), (3, None, None), (4, [], [])], "id int, members array<bigint>, scores array<double>")
    scaled = {r.id: r.scaled for r in K.scaled_scores(rows, "scores").collect()}
    assert scaled == {1: [0.0, None, 1.0], 2: [1.0], 3: None, 4: []}
    assert {(r.id, r["rank"], r.passage_idx) for r in K.ranked_members(rows, "members", ["id"]).collect()} == {(1, 1, 4), (1, 3, 6), (2, 1, 1)}
    assert [r.ok for r in rows.orderBy("id").select(K.is_complete("members", "scores", 1).alias("ok")).collect()] == [False, True, False, False]


def test_packages(spark):
    rows = spark.createDataFrame([("c", f"p{i}", i, f"{i}:text {i % 4}") for i in range(12)], "corpus_id string, passage_id string, passage_idx bigint, text string")
    shared = {(r.n_locations, r.n_packages, r.first_corpus) for r in B.documents_with_locations(rows).collect()}
    assert shared == {(3, 1, "c")} and B.document_places(rows.unionByName(rows)).count() == 12
    built = B.constructed_package(rows.limit(2), rows, 3, "s").collect()
    assert sorted(r.position for r in built) == list(range(5)) and sum(r.role == "required" for r in built) == 2
    assert B.new_texts(rows.limit(5), rows.unionByName(rows), "passage_id").count() == 7


def test_tfidf_vectors_have_length_one(spark):
    texts = spark.createDataFrame([("c", "a", "river mill river"), ("c", "b", "old mill"), ("c", "e", "")], "corpus_id string, passage_id string, text string")
    w = weights(texts, ["passage_id"], ["corpus_id"])
    assert all(abs(r.s - 1) < 1e-12 for r in w.groupBy("passage_id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect())
    asked = spark.createDataFrame([(1, "c", "old river?")], "question_no bigint, corpus_id string, question string")
    q = query_weights(asked, w.select("corpus_id", "term", "idf").distinct(), "question_no", ["corpus_id"])
    assert {r.term for r in q.collect()} == {"old", "river"}


def test_last_version_wins(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, None, "c")], "id int, version int, value string")
    assert {(r.id, r.value) for r in E.latest(rows, ["id"], ["version"]).collect()} == {(1, "b"), (2, "c")}


def test_cases_hold_support_that_stands_once(spark):
    rows = spark.createDataFrame([("c", f"p{i}", i, f"{i}:Text {i} of the mill") for i in range(30)] + [("d", "p0", 0, "0:Text 1 of the mill")], "corpus_id string, passage_id string, passage_idx bigint, text string")
    wanted = [(1, "c", "TEXT 7 of"), (1, "c", "of the"), (1, "c", "nowhere"), (1, "c", " "), (2, "d", "text 1"), (1, "c", "TEXT 7 of")]
    found = B.support_passages(spark.createDataFrame(wanted, "question_no bigint, corpus_id string, fragment string"), rows)
    n = {(r.question_no, r.fragment): r.n_matches for r in found.collect()}
    assert n == {(1, "TEXT 7 of"): 1, (1, "of the"): 30, (1, "nowhere"): 0, (1, " "): 0, (2, "text 1"): 1}
    support = found.filter("n_matches = 1").select("question_no", "corpus_id", "passage_id")
    cases = B.case_packages(support, rows, 5, "s").collect()
    assert sorted((r.question_no, r.role) for r in cases) == [(1, "distractor")] * 5 + [(1, "support"), (2, "support")]
    assert {(r.passage_id, r.passage_idx) for r in cases if r.role == "support"} == {("p7", 7), ("p0", 0)}
    assert B.case_packages(support.filter("false"), rows, 5, "s").count() == 0


def test_questions_know_their_places_in_a_package(spark):
    rows = spark.createDataFrame([("c", f"p{i}", i, f"{i}:text {i}") for i in range(12)], "corpus_id string, passage_id string, passage_idx bigint, text string")
    needs = spark.createDataFrame([("c", "p3", "q1"), ("c", "p5", "q1"), ("c", "p3", "q2")], "corpus_id string, passage_id string, question_id string")
    placed = B.constructed_package(needs, rows, 4, "s")
    at = {r.passage_id: r.position for r in placed.collect()}
    assert {(r.question_id, r.position) for r in B.question_positions(needs, placed).collect()} == {("q1", at["p3"]), ("q1", at["p5"]), ("q2", at["p3"])}
    one = B.package_statistics(placed, rows).first()
    assert (one.n_required, one.n_distractors, one.n_passages) == (2, 4, 6) and one.n_words == 12
