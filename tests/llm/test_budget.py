from collections import Counter
from datetime import datetime

import pytest

from passagemill.llm.budget import BudgetState, update_budget
from passagemill.llm.vocab import batch_encoder

PASSAGES = "passage_no bigint, corpus_id string, passage_idx bigint, passage string, lang string, loaded_at timestamp, n_tokens int"
DAY = datetime(2025, 1, 1)
ROWS = [
    (1, "c", 0, "0:A mill by the river.", "EN", DAY, 1),
    (1, "c", 0, "0:A mill by the river.", "EN", datetime(2025, 3, 1), 1),
    (2, "c", 1, "1:Une école.", "fra", DAY, 1),
    (3, "d", 0, "0:A mill by the river.", None, DAY, 1),
    (4, "d", 1, None, "en", DAY, 1),
    (5, "e", 0, "", "xx", DAY, 1),
]


def _tables(spark):
    packages = spark.createDataFrame(
        [("c", "Hotpot QA", DAY), ("c", None, datetime(2025, 5, 1)), ("d", "other", DAY)], "corpus_id string, source_dataset string, prepared_at timestamp"
    )
    return packages, spark.createDataFrame([("hotpotqa", "encyclopedia")], "source_dataset string, domain string")


def _cube(state):
    return {tuple(r[:3]): (r.n_passages, r.n_tokens) for r in state.cube.collect()}


def _brute(rows, tokenizer="byte_bpe_50k"):
    size = lambda t: len(batch_encoder(tokenizer)([t])[0])
    source = {"c": ("hotpotqa", "encyclopedia"), "d": ("other", "unknown"), "e": ("unknown", "unknown")}
    lang = {"EN": "en", "fra": "fr", None: "und", "xx": "und"}
    once = {(r[1], r[2]): r for r in sorted(rows, key=lambda r: r[5])}
    n, tokens = Counter(), Counter()
    for r in once.values():
        if r[3] is not None:
            key = (source[r[1]][0], lang[r[4]], source[r[1]][1])
            n[key] += 1
            tokens[key] += size(r[3])
    return {k: (n[k], tokens[k]) for k in n}


def test_totals_from_nothing_and_by_deltas(spark, tmp_path):
    packages, catalog = _tables(spark)
    first = update_budget(BudgetState.empty(spark), spark.createDataFrame(ROWS, PASSAGES), packages, catalog)
    assert _cube(first) == _brute(ROWS)
    first.write(str(tmp_path / "v1"))
    known = BudgetState.read(spark, str(tmp_path / "v1"))
    # one removed, one changed, one new
    changed = [ROWS[0], (2, "c", 1, "1:Une école fermée.", "fra", datetime(2025, 6, 1), 1), *ROWS[3:], (6, "c", 2, "2:A mill by the river.", "EN", DAY, 1)]
    changed = [r for r in changed if r[0] != 3]
    second = update_budget(known, spark.createDataFrame(changed, PASSAGES), packages, catalog)
    assert _cube(second) == _brute(changed)
    fresh = second.counts.count() - known.counts.count()
    assert fresh == 2  # only contents without a count are encoded


def test_another_tokenizer_and_a_removal_in_one_step(spark):
    packages, catalog = _tables(spark)
    first = update_budget(BudgetState.empty(spark), spark.createDataFrame(ROWS, PASSAGES), packages, catalog, "byte_bpe_multi_50k")
    assert _cube(first) == _brute(ROWS, "byte_bpe_multi_50k")
    left = [r for r in ROWS if r[0] != 2] + [(7, "d", 3, "3:Le moulin, la rivière et l'école.", "fra", DAY, 1)]
    second = update_budget(first, spark.createDataFrame(left, PASSAGES), packages, catalog)
    assert _cube(second) == _brute(left)
    back = update_budget(second, spark.createDataFrame(ROWS, PASSAGES), packages, catalog, "byte_bpe_multi_50k")
    assert _cube(back) == _brute(ROWS, "byte_bpe_multi_50k")
    assert back.counts.groupBy("content_hash", "tokenizer_hash").count().filter("count > 1").count() == 0


def test_a_missing_count_is_an_error(spark):
    packages, catalog = _tables(spark)
    first = update_budget(BudgetState.empty(spark), spark.createDataFrame(ROWS, PASSAGES), packages, catalog)
    lost = BudgetState(first.counts.filter("false"), first.docs, first.cube)
    with pytest.raises(Exception, match="no token count"):
        update_budget(lost, spark.createDataFrame(ROWS[3:], PASSAGES), packages, catalog).cube.collect()


def test_same_content_is_encoded_once(spark):
    packages, catalog = _tables(spark)
    rows = [(i, "c", i, "same text", "en", DAY, 1) for i in range(20)]
    state = update_budget(BudgetState.empty(spark), spark.createDataFrame(rows, PASSAGES), packages, catalog)
    assert state.counts.count() == 1 and _cube(state)["hotpotqa", "en", "encyclopedia"][0] == 20


def test_empty_tables(spark):
    packages, catalog = _tables(spark)
    empty = spark.createDataFrame([], PASSAGES)
    assert update_budget(BudgetState.empty(spark), empty, packages.filter("false"), catalog).cube.count() == 0
