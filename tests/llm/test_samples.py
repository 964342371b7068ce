from collections import Counter

import numpy as np
import pytest

from passagemill.llm.quota import allocate, quota_sample, shortfalls, target_counts
from passagemill.llm.stable import stable_sample

QUESTIONS = "question_no bigint, corpus_id string, source_index bigint, id string, question_type string, batch_no int, type_key string"
PACKAGES = "corpus_id string, sample_count bigint, prepared_at timestamp"
TARGETS = "corpus_id string, question_type string, target_share double, min_count bigint"


def _questions(spark, n=60):
    rows = [(i, "c", i, f"Q{i}", "Fact Retrieval" if i % 3 else "2-hop", i % 4, "clash") for i in range(n)]
    rows += [(0, "c", 0, " q0 ", "2_HOP", 3, None), (900, "c", 900, None, None, 0, None), (901, "d", 1, "x", "bridge", 1, None)]
    return spark.createDataFrame(rows, QUESTIONS)


def _tables(spark, targets):
    packages = spark.createDataFrame([("c", 20, None), ("c", 20, None), ("d", 5, None)], PACKAGES)
    return packages, spark.createDataFrame(targets, TARGETS)


def test_quotas_follow_shares_floors_and_caps(spark):
    questions = _questions(spark)
    packages, targets = _tables(spark, [("c", "Fact Retrieval", 0.67, 0), ("c", "2hop", 0.33, 8), ("d", "bridge", 1.0, None), ("d", "comparison", None, 2)])
    got = {(r.corpus_id, r.question_type): r for r in allocate(target_counts(questions, packages, targets)).collect()}
    assert got["c", "2hop"].quota == 8 and got["c", "Fact Retrieval"].quota == 12  # the sample is 20
    assert got["c", "2hop"].available == 20
    assert got["d", "bridge"].quota == 1
    short = {tuple(r) for r in shortfalls(questions, packages, targets).select("corpus_id", "question_type").collect()}
    assert short == {("d", "bridge"), ("d", "comparison")}


def test_sample_has_the_smallest_keys_of_each_category(spark):
    questions = _questions(spark)
    packages, targets = _tables(spark, [("c", "Fact Retrieval", 0.5, 0), ("c", "2hop", 0.5, 0)])
    rows = quota_sample(questions, packages, targets).collect()
    assert Counter(r.question_type for r in rows) == {"Fact Retrieval": 10, "2hop": 10}
    assert len({r.question_key for r in rows}) == 20
    again = quota_sample(questions.repartition(7), packages, targets).collect()
    assert {r.question_key for r in rows} == {r.question_key for r in again}


def _quotas(spark, targets, sample, available):
    rows = [("c", k, k, float(s), m, sample, available) for k, s, m in targets]
    schema = "corpus_id string, type_key string, question_type string, target_share double, min_count bigint, sample_count bigint, available bigint"
    return {r.type_key: r for r in allocate(spark.createDataFrame(rows, schema)).collect()}


def test_minima_are_taken_from_the_sample(spark):
    got = _quotas(spark, [("a", 0.9, 0), ("b", 0.05, 2), ("c", 0.05, 2)], 10, 100)
    assert {k: r.quota for k, r in got.items()} == {"a": 6, "b": 2, "c": 2}
    assert not any(r.minima_exceed for r in got.values())


def test_minima_beyond_the_sample_are_kept_and_reported(spark):
    got = _quotas(spark, [("a", 0.5, 4), ("b", 0.5, 4)], 5, 100)
    assert {k: r.quota for k, r in got.items()} == {"a": 4, "b": 4} and all(r.minima_exceed for r in got.values())


@pytest.mark.parametrize("seed", range(6))
def test_quotas_keep_floors_caps_and_the_sample(spark, seed):
    """Many packages against a search for the level of the fill, one unit at a time."""
    pick = np.random.default_rng(seed)
    rows = []
    for p in range(40):
        k = int(pick.integers(1, 7))
        shares = pick.dirichlet(np.ones(k)) * (pick.random(k) > 0.15)
        for i in range(k):
            rows.append((f"p{p}", f"t{i}", f"t{i}", float(shares[i]), int(pick.integers(0, 6)), 0, int(pick.integers(0, 40))))
    sizes = {f"p{p}": int(pick.integers(0, 60)) for p in range(40)}
    rows = [(*r[:5], sizes[r[0]], r[6]) for r in rows]
    schema = "corpus_id string, type_key string, question_type string, target_share double, min_count bigint, sample_count bigint, available bigint"
    found = allocate(spark.createDataFrame(rows, schema)).collect()
    for p, size in sizes.items():
        own = [r for r in found if r.corpus_id == p]
        least = {r.type_key: min(r.min_count, r.available) for r in own}
        assert all(least[r.type_key] <= r.quota <= max(r.available, least[r.type_key]) for r in own)
        most = sum(r.available if r.target_share > 0 else least[r.type_key] for r in own)
        assert sum(r.quota for r in own) == max(sum(least.values()), min(size, most))
        # nobody between floor and cap is more than one away from its part of the same fill
        free = [r for r in own if least[r.type_key] < r.quota < r.available and r.target_share > 0]
        for a in free:
            for b in free:
                assert a.quota - 1 <= (b.quota + 1) / b.target_share * a.target_share + 1e-9


def test_leftovers_go_to_categories_with_room(spark):
    questions = _questions(spark)
    packages, targets = _tables(spark, [("c", "bridge", 0.9, 0), ("c", "2hop", 0.1, 0)])
    got = {r.question_type: r.quota for r in allocate(target_counts(questions, packages, targets)).collect()}
    assert got == {"bridge": 0, "2hop": 20}


def test_samples_keep_their_members_as_data_grow(spark):
    questions = _questions(spark, 400)
    specs = spark.createDataFrame([("a", 41, 0.1), ("b", 41, 0.4), ("c", 7, 0.1), ("none", None, 0.5)], "spec_id string, seed bigint, sample_rate double")
    members = lambda q: {(r.spec_id, r.corpus_id, r.question_key) for r in stable_sample(q, specs).collect()}
    whole = members(questions)
    for batch in range(4):
        part = members(questions.filter(f"batch_no <= {batch}").repartition(5))
        assert part <= whole
    a, b = ({m[1:] for m in whole if m[0] == s} for s in "ab")
    assert a <= b and 0.05 < len(a) / 402 < 0.2
    assert {m[1:] for m in whole if m[0] == "c"} != a
    assert not any(m[0] == "none" for m in whole)
    assert stable_sample(questions.filter("false"), specs).count() == 0
    assert stable_sample(questions, specs.filter("false")).count() == 0
